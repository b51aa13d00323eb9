"""Chooses the rates, penalties and features of ``toxicity`` by cross-validation inside the learning rows.

    python -m quarry.llm.choose_toxicity /root/testdata/sf0.1

Rows whose crc32(doc_id as text) mod 5 is 0 are held out of everything here: they are
neither read for features nor scored.  The others are dealt into four folds by another
hash; each setting is fitted on three and scored on the fourth.  Settings are ranked by
the log loss over all folds; recall and false alarms at 0.5 are printed beside it.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow as pa
import pyarrow.dataset as ds

from . import textbytes as tb
from .toxicity import Ftrl, coordinates, fit_rows, row_features

FOLDS = 4
GRID = {"alpha": [0.3, 1.0, 3.0], "l1": [1.0, 4.0, 8.0, 16.0], "epochs": [2, 3, 5], "heads": [(), (4,), (4, 6)]}


def learning_rows(sf_dir: str) -> tuple[list[int], list[str], np.ndarray]:
    labels: dict[int, int] = {}
    for r in ds.dataset(f"{sf_dir}/labels.parquet").to_table(["doc_id", "toxic"]).to_pylist():
        if r["doc_id"] is not None and r["toxic"] in (0, 1) and zlib.crc32(str(r["doc_id"]).encode()) % 5:
            labels[r["doc_id"]] = max(labels.get(r["doc_id"], 0), r["toxic"])
    docs = ds.dataset(f"{sf_dir}/documents.parquet").to_table(["doc_id", "text"]).to_pylist()
    texts = {r["doc_id"]: r["text"] or "" for r in docs if r["doc_id"] in labels}
    ids = sorted(texts, key=lambda i: zlib.crc32(f"order{i}".encode()))
    return ids, [texts[i] for i in ids], np.array([labels[i] for i in ids], float)


def folds_of(ids: list[int]) -> np.ndarray:
    return np.array([zlib.crc32(f"fold{i}".encode()) % FOLDS for i in ids])


def score_setting(args: tuple) -> tuple[Ftrl, float, float, int]:
    """(setting, log loss, recall, false alarms) over all folds."""
    how, rows, labels, folds = args
    loss, hits, alarms = [], 0, 0
    for k in range(FOLDS):
        own, rest = np.flatnonzero(folds != k), np.flatnonzero(folds == k)
        h, n = np.unique(np.concatenate([rows[i] for i in own]), return_counts=True)
        index = h[n >= how.min_count]
        w, b = fit_rows([coordinates(index, rows[i]) for i in own], labels[own], len(index), how)
        p = np.array([1 / (1 + np.exp(-np.clip(b + w[coordinates(index, rows[i])].sum(), -40, 40))) for i in rest])
        y = labels[rest]
        loss += list(-np.log(np.clip(np.where(y == 1, p, 1 - p), 1e-12, 1)))
        hits += int(((p >= 0.5) & (y == 1)).sum())
        alarms += int(((p >= 0.5) & (y == 0)).sum())
    return how, float(np.mean(loss)), hits / max(1.0, labels.sum()), alarms


def main(sf_dir: str) -> None:
    ids, texts, labels = learning_rows(sf_dir)
    folds = folds_of(ids)
    data, offsets = tb.buffer(pa.array(texts))
    rows: dict[tuple, list[np.ndarray]] = {}
    for heads in GRID["heads"]:
        rows[heads] = [r for lo, hi in tb.pieces(offsets) for r in row_features(data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo], heads)]
    settings = [Ftrl(**dict(zip(GRID, values))) for values in itertools.product(*GRID.values())]
    with ProcessPoolExecutor() as pool:
        found = sorted(pool.map(score_setting, [(how, rows[how.heads], labels, folds) for how in settings]), key=lambda r: r[1])
    print(f"{len(ids)} learning rows, {int(labels.sum())} of label 1, {FOLDS} folds")
    for how, loss, recall, alarms in found[:10] + found[-1:]:
        print(f"loss {loss:.5f} recall {recall:.3f} false alarms {alarms}: {how}")


if __name__ == "__main__":
    main(sys.argv[1])
