"""From raw articles to the tables of a knowledge pack: filters, chunks, titles, priors."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as tx
from ..storage import cut

#: Chunk ids leave room for this many chunks in a document; they grow in document order.
CHUNKS_PER_DOC = 1_000_000
TARGET_WORDS, MAX_WORDS = 150, 230
_SENTENCE_END = re.compile(r"(?<=[.!?])[\"')\]]*\s+(?=[A-Z0-9\"(])")
_PARENS = re.compile(r"\s*\([\s;,]*\)")


def articles(docs: DataFrame) -> DataFrame:
    """``doc_id, title, paras, url`` of documents: the first line, cut at 60 characters, is the title."""
    paras = tx.paragraphs(F.coalesce("text", F.lit("")))
    return docs.select("doc_id", paras.alias("paras")).select(
        "doc_id", tx.drop_empty_parens(F.substring(F.coalesce(F.get("paras", F.lit(0)), F.lit("")), 1, 60)).alias("title"), "paras", F.lit(None).cast("string").alias("url")
    )


def page_articles(pages: DataFrame) -> DataFrame:
    """``doc_id, title, paras, url`` of web pages: title element, and paragraphs without markup."""
    entity = lambda c: F.replace(F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")), F.lit("&amp;"), F.lit("&"))
    body = F.regexp_replace("html", r"(?is)<(script|style|nav)\b.*?</(script|style|nav)>|<!--.*?-->|<head\b.*?</head>", " ")
    lines = F.regexp_replace(body, r"(?i)</?(p|br|div|h[1-6]|li|article|section|tr)\b[^>]*>", "\n")
    plain = entity(F.regexp_replace(lines, "<[^>]*>", ""))
    title = F.trim(tx.drop_empty_parens(entity(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1))))
    return pages.select(F.col("page_id").alias("doc_id"), title.alias("title"), tx.paragraphs(plain).alias("paras"), "url")


def count_all_words(paras: Column) -> Column:
    return F.aggregate(paras, F.lit(0), lambda n, p: n + tx.count_words(p))


def accepted(rows: DataFrame, *, min_words: int = 40, max_docs: int | None = None) -> DataFrame:
    """Articles that a pack takes, with ``words``: a title, enough words, no page that only tells
    readings apart, and of equal titles the first by ``doc_id``.

    A rejected copy does not hide a later one: titles are compared after the other filters.
    """
    first = F.substring(F.coalesce(F.get("paras", F.lit(0)), F.lit("")), 1, 300)
    ok = rows.withColumn("words", count_all_words(F.col("paras"))).filter((F.col("title") != "") & (F.col("words") >= min_words))
    ok = ok.filter(~(first.rlike("(?i)may (also )?refer to") & (F.col("words") < 400)))
    kept = ok.withColumn("__k", F.row_number().over(Window.partitionBy("title").orderBy("doc_id"))).filter("__k = 1").drop("__k")
    return kept if max_docs is None else kept.orderBy("doc_id").limit(max_docs)


def prior(words: Column) -> Column:
    return F.least(F.lit(1.0), F.log10(F.greatest(F.lit(10), words)) / 4.5)


def chunk_paragraphs(paras: list[str], target: int = TARGET_WORDS, most: int = MAX_WORDS) -> Iterator[tuple[str, str]]:
    """(section, text) chunks of about ``target`` words.

    Paragraphs stay whole unless they exceed ``most`` words, which are cut between sentences;
    headings name the section of what follows, and sections without prose are left out.
    """
    section, held, size = "", [], 0

    def flush() -> list[tuple[str, str]]:
        nonlocal held, size
        out = [(section, " ".join(held))] if held else []
        held, size = [], 0
        return out

    for par in (_PARENS.sub("", p) for p in paras):
        words = len(par.split())
        if not words:
            continue
        if len(par) < 80 and par[-1] not in ".:?!,;" and words <= 10 and par[0].isupper():
            yield from flush()
            section = par
        elif section.lower() in tx.SKIP_SECTIONS:
            continue
        elif words > most:
            yield from flush()
            for sentence in _SENTENCE_END.split(par):
                n = len(sentence.split())
                if held and size + n > target:
                    yield from flush()
                held.append(sentence)
                size += n
            yield from flush()
        else:
            if held and size + words > most:
                yield from flush()
            held.append(par)
            size += words
            if size >= target:
                yield from flush()
    yield from flush()


def chunks(rows: DataFrame, *, target: int = TARGET_WORDS, most: int = MAX_WORDS, lead_only_under: int = 0, lead_only_after: int = 0) -> DataFrame:
    """``chunk_id, doc_id, ord, section, text``; map-only.

    Of articles with fewer than ``lead_only_under`` words, and of those whose id is above
    ``lead_only_after`` (if it is not 0; ids of ``dense_ids`` count articles), only the first two chunks are kept.
    Ids are integers up to 9.2e12; ``dense_ids`` numbers articles whose ids are not.
    Chunk ids are contiguous within a document and ordered like documents.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc, paras, words in zip(*(c.to_pylist() for c in batch.columns)):
                for i, (section, text) in enumerate(chunk_paragraphs(paras or [], target, most)):
                    if i < 2 or words >= lead_only_under and not 0 < lead_only_after < doc:
                        out.append((doc * CHUNKS_PER_DOC + i, doc, i, section, text))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.string()))], ["chunk_id", "doc_id", "ord", "section", "text"])

    return rows.select("doc_id", "paras", count_all_words(F.col("paras")).alias("words")).mapInArrow(run, "chunk_id long, doc_id long, ord int, section string, text string")


def passages(rows: DataFrame) -> DataFrame:
    """``chunk_id, doc_id, ord, title, section, text`` with a chunk for each paragraph; no Python."""
    return rows.select("doc_id", "title", F.posexplode("paras").alias("ord", "text")).select(
        (F.col("doc_id") * CHUNKS_PER_DOC + F.col("ord")).alias("chunk_id"), "doc_id", "ord", "title", F.lit("").alias("section"), "text"
    )


def scope(chunks: DataFrame, docs: DataFrame, spec: str) -> DataFrame:
    """``chunk_id`` of the chunks that ``spec`` names: ``all``, or a union by commas of ``lead:n`` (the first n
    chunks of each document), ``top:m`` (all chunks of the m documents of the highest prior) and
    ``toplead:m`` (the first chunk of those), for ``chunks(chunk_id, doc_id, ord)`` and ``docs(doc_id, prior)``."""
    found = None
    for part in (p.strip() for p in spec.split(",")):
        kind, _, n = part.partition(":")
        if kind not in ("all", "lead", "top", "toplead") or kind != "all" and not n.isdigit():
            raise ValueError(f"no such scope: {part}")
        own = chunks
        if kind == "lead":
            own = own.filter(F.col("ord") < int(n))
        elif kind != "all":
            own = own.join(docs.orderBy(F.desc("prior"), "doc_id").limit(int(n)).select("doc_id"), "doc_id", "left_semi")
            own = own.filter("ord = 0") if kind == "toplead" else own
        found = own.select("chunk_id") if found is None else found.unionByName(own.select("chunk_id"))
    return found.distinct()


def dense_ids(rows: DataFrame, order: list[str], out: str = "id") -> DataFrame:
    """The rows with numbers from 1 in an order without ties, whatever the type of their ids.

    Rows are range-partitioned and written; a number is a row's place in its partition after those of
    the partitions before, of which only counts reach the driver.  No task sees more than a partition.
    """
    parted = rows.repartitionByRange(*order).withColumn("__part", F.spark_partition_id())
    held = cut(parted, "ordered")
    counts = {r["__part"]: r["n"] for r in held.groupBy("__part").agg(F.count("*").alias("n")).collect()}
    before, total = [], 0
    for part in sorted(counts):
        before.append((part, total))
        total += counts[part]
    first = F.broadcast(rows.sparkSession.createDataFrame(before, "__part int, __before long"))  # a row for each partition
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return held.join(first, "__part").withColumn(out, place + F.col("__before")).drop("__part", "__before")


def doc_table(rows: DataFrame, chunked: DataFrame) -> DataFrame:
    """``id, title, first_chunk, n_chunks, prior, words, url``; articles without a chunk are dropped."""
    by = chunked.groupBy("doc_id").agg(F.min("chunk_id").alias("first_chunk"), F.count("*").cast("int").alias("n_chunks"))
    words = count_all_words(F.col("paras"))
    return rows.join(by, "doc_id").select(F.col("doc_id").alias("id"), "title", "first_chunk", "n_chunks", prior(words).alias("prior"), words.alias("words"), "url")


def title_table(rows: DataFrame) -> DataFrame:
    """``norm, doc_id, kind`` (0 title, 2 alias)."""
    return rows.select("doc_id", F.inline(tx.aliases(F.col("title")))).select("norm", "doc_id", "kind")


#: Counters of hashed grams, and bytes of text that a worker cuts at a time.
_COUNTERS, _TEXT_BYTES = 1 << 20, 8 << 20


def _word_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, np.ndarray, list[np.ndarray]]]:
    """Distinct words of some texts, all words as places among those, and where grams of two and three words begin.

    Words end at ASCII white space, as for the pattern ``\\s``."""
    for batch in batches:
        texts = batch.column(0)
        size = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        lo = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(size, (size[lo - 1] if lo else 0) + _TEXT_BYTES, "right")))
            words = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.fill_null(texts.slice(lo, hi - lo), "")))
            coded = words.flatten().dictionary_encode()
            row = np.repeat(np.arange(len(words)), words.value_lengths().to_numpy(zero_copy_only=False))
            yield coded.dictionary, coded.indices.to_numpy(), [np.flatnonzero(row[: -n] == row[n:]) for n in (1, 2)]
            lo = hi


def _counters(words: pa.Array, code: np.ndarray, begins: list[np.ndarray]) -> list[np.ndarray]:
    """The counter of each gram."""
    h = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object))[code]
    found, primes = [], np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
    for n, begin in enumerate(begins, 2):
        x = sum(h[begin + j] * primes[j] for j in range(n))
        found.append((((x ^ (x >> np.uint64(32))) * primes[0]) >> np.uint64(44)).astype(np.int64))  # 20 bits
    return found


def _gram_counters(texts: DataFrame) -> np.ndarray:
    """How many grams each counter has met: of all with equal hashes together, so no gram has occurred more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(_COUNTERS, np.int64)
        for part in _word_parts(batches):
            for at in _counters(*part):
                n += np.bincount(at, minlength=_COUNTERS)
        met = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(met.astype(np.int32)), pa.array(n[met])], ["at", "n"])

    rows = texts.mapInArrow(run, "at int, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()  # a row for each counter
    out = np.zeros(_COUNTERS, np.int64)
    out[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return out


def _grams(texts: DataFrame, on: np.ndarray) -> DataFrame:
    """``gram, n``: counts of the grams whose counter is ``on``, in parts."""
    held = texts.sparkSession.sparkContext.broadcast(np.packbits(on))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        on = np.unpackbits(held.value).astype(bool)
        for words, code, begins in _word_parts(batches):
            for n, (begin, at) in enumerate(zip(begins, _counters(words, code, begins)), 2):
                some = begin[on[at]]
                counts = pc.binary_join_element_wise(*(words.take(pa.array(code[some + j])) for j in range(n)), " ").value_counts()
                yield pa.RecordBatch.from_arrays([counts.field(0), counts.field(1)], ["gram", "n"])

    return texts.mapInArrow(run, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n"))


def ngram_dictionary(texts: DataFrame, col: str = "text", *, top: int = 20_000, min_count: int = 4, max_bytes: int = 32_768) -> DataFrame:
    """``gram, n``: the most frequent 2- and 3-grams of words until ``max_bytes`` are used up.

    A first pass counts hashes of grams.  A gram occurs at most as often as its counter says, so the grams of counters of
    some least count, counted exactly in a second pass, are all that are as frequent; only these are shuffled.  If they do
    not yet fill ``top`` or ``max_bytes``, the least count goes down, to ``min_count`` in the end.
    """
    texts = texts.select(F.col(col).cast("string").alias("text"))
    met = _gram_counters(texts)
    order, rank = np.sort(met)[::-1], top
    while True:
        least = max(min_count, int(order[rank])) if rank < len(order) else min_count
        found = cut(_grams(texts, met >= least).filter(F.col("n") >= least), "grams")
        n, size = found.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("gram") + 1), F.lit(0))).first()
        if least <= min_count or n >= top or size > max_bytes:
            break
        rank *= 8
    best = found.orderBy(F.desc("n"), "gram").limit(top)
    used = F.sum(F.octet_length("gram") + 1).over(Window.orderBy(F.desc("n"), "gram"))  # over ``top`` rows at most
    return best.withColumn("used", used).filter(F.col("used") <= max_bytes).select("gram", "n")
