"""Chat formatting: budgeted, turn-aligned windows over conversations.

A conversation's turns become windows of at most ``budget`` tokens.  Prefix sums
of the turns' token counts choose how many new turns a window takes; each window
begins with the conversation's system turn (if its first turn is one) and with
the turns before its new ones, as many as ``history`` tokens hold.  Every turn is
new in exactly one window.  The loss mask covers the texts of assistant turns
where they are new; repeated turns are context and never targets.

A turn is written ``<|im_start|>role\\ntext<|im_end|>\\n``.  In texts a backslash
is doubled and ``<|`` becomes ``<\\|``, so no text can look like a mark, and
``unescape`` gives back every text exactly; in roles line ends are escaped too.

Scale.  Rows are dealt out by conversation and sorted by turn; a task streams
over them and holds the turns of one window, whatever a conversation's length
(a digest over a whole conversation is sequential by nature, its memory is not).
A turn that alone exceeds the budget is a window of its own, marked
``over_budget``.

Defined cases.  Null roles and texts count as empty; null turn numbers come
first; equal turn numbers are ordered by role and text; rows with a null
conversation id are one conversation.  Ids are of any type that sorts.  An empty
table gives no windows.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections import deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import lean

BUDGET, HISTORY = 1024, 256
START, END = "<|im_start|>", "<|im_end|>"
#: Tokens of a turn besides its role and text: two marks and two line ends.
MARKS = 4
WINDOWS = "conv_id {}, window int, repeated int, n_turns int, tokens long, over_budget boolean, text string, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], role, flags=re.DOTALL)


def parse(text: str) -> list[tuple[str, str]]:
    """The turns (role, text) of a formatted window."""
    out, at = [], 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("a turn has no start mark")
        line = text.index("\n", at)
        end = text.index(END, line)
        out.append((unescape_role(text[at + len(START) : line]), unescape(text[line + 1 : end])))
        at = end + len(END) + 1
    return out


class _Counter:
    """Token counts by a ``tiktoken`` ranks file."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("turns", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.encoding.encode_ordinary_batch(texts, num_threads=1)]


def windows_of(turns: Iterator[tuple[str, str, int]], budget: int, history: int) -> Iterator[tuple[int, int, int, bool, str, list[dict]]]:
    """(repeated, new turns, tokens, over budget, text, loss spans) of one conversation's
    (role, text, tokens) turns, in order; holds one window at a time."""
    system: tuple[str, str, int] | None = None
    past: deque[tuple[str, str, int]] = deque()  # turns before the window's new ones, history tokens at most
    prefix, new = [0], []

    def room() -> int:
        return budget - (system[2] if system else 0) - sum(t[2] for t in past)

    def render() -> tuple[int, int, int, bool, str, list[dict]]:
        old = [*([system] if system and not first else []), *past]
        text, loss, at = [], [], 0
        for i, (role, body, _) in enumerate([*old, *new]):
            head, body = f"{START}{escape_role(role)}\n", escape(body)
            if i >= len(old) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            text.append(f"{head}{body}{END}\n")
            at += len(text[-1])
        tokens = sum(t[2] for t in old) + prefix[-1]
        return len(old), len(new), tokens, tokens > budget, "".join(text), loss

    first = True
    for turn in turns:
        if new and prefix[-1] + turn[2] > room() + (system[2] if system and first else 0):
            yield render()
            for t in new[1 if first and system else 0 :]:
                past.append(t)
            first = False
            while past and sum(t[2] for t in past) > history:
                past.popleft()
            prefix, new = [0], []
            while past and turn[2] > room():
                past.popleft()  # the new turn comes before history
        if first and not new and turn[0] == "system":
            system = turn
        new.append(turn)
        prefix.append(prefix[-1] + turn[2])
    if new:
        yield render()


def format_windows(
    conversations: DataFrame,
    ranks_file: str,
    pattern: str,
    *,
    conv_col: str = "conv_id",
    turn_col: str = "turn",
    role_col: str = "role",
    text_col: str = "text",
    budget: int = BUDGET,
    history: int = HISTORY,
) -> DataFrame:
    """Windows in order, conversation by conversation within each partition: ``conv_id, window,
    repeated, n_turns, tokens, over_budget, text, loss`` (``repeated`` turns come first in a
    window; ``loss`` are code-point ranges of ``text``)."""
    kind = conversations.schema[conv_col].dataType.simpleString()
    rows = conversations.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _Counter(ranks_file, pattern)

        def turns():
            for batch in batches:
                types[0] = batch.schema.field(0).type
                conv, _, role, text = (c.to_pylist() for c in batch.columns)
                for c, r, t, n, k in zip(conv, role, text, count(text), count(role)):
                    yield c, (r, t, n + k + MARKS)

        rows, ahead = turns(), None
        ahead = next(rows, None)
        out, size = [], 0
        while ahead is not None:
            conv = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:
                    turn, ahead = ahead[1], next(rows, None)
                    yield turn

            for i, w in enumerate(windows_of(own(), budget, history)):  # ids keep the type they came with
                out.append((conv, i, *w))
                size += len(w[4])
                if size > 1 << 20:
                    yield _batch(out)
                    out, size = [], 0
        if out:
            yield _batch(out)

    loss_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    types = [pa.null(), pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.string(), loss_type]
    names = ["conv_id", "window", "repeated", "n_turns", "tokens", "over_budget", "text", "loss"]

    def _batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return rows.mapInArrow(lean(run), WINDOWS.format(kind))


def read_back(windows: DataFrame, *, in_order: bool = False) -> DataFrame:
    """Per conversation: ``conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars``, all
    read from the formatted texts.  Windows are sorted first, unless they are ``in_order``: straight
    from ``format_windows``, which gives each conversation's windows one after another."""
    kind = windows.schema["conv_id"].dataType.simpleString()
    windows = windows.select("conv_id", "window", "repeated", "text", "loss")
    if not in_order:
        windows = windows.repartition("conv_id").sortWithinPartitions("conv_id", "window")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state: list | None = None

        def done() -> tuple:
            return state[0], state[1], state[2].hexdigest(), state[3], state[4].hexdigest(), state[5]

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            types = [conv, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

        for batch in batches:
            out, conv = [], batch.schema.field(0).type
            for w in batch.to_pylist():
                if w["window"] == 0:
                    if state:
                        out.append(done())
                    state = [w["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in parse(w["text"])[w["repeated"] :]:
                    state[1] += 1
                    state[2].update(f"{role}\n{text}\n".encode())
                for s in w["loss"]:
                    text = unescape(w["text"][s["start"] : s["end"]])
                    state[3] += len(text)
                    state[4].update(text.encode())
                state[5] += len(w["text"])
            if out:
                yield batch_of(out)
        if state:
            yield batch_of([done()])

    return windows.mapInArrow(
        lean(run), f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
