"""Numbers that describe a text, computed for blocks of texts on numpy arrays, and sums over partitions."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lattica.llm.common import blocks, texts, utf8, word_hashes, words

NAMES = ["log_words", "word_length", "upper", "digits", "symbols", "bars", "exclamations", "other_marks", "not_ascii", "distinct", "top_word", "repeats", "repeat_pairs", "log_lines", "dup_lines", "line_words"]


def _table(chars: bytes | range) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CLASSES = [_table(range(65, 91)), _table(range(97, 123)), _table(range(48, 58)), _table(b"#*$%&<>"), _table(b"|"), _table(b"!"), _table(b".,;:?\"'()-"), _table(range(0xC0, 256))]


def block_stats(raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of ``NAMES`` for each text of a block."""
    n = len(offsets) - 1
    count = np.stack([np.diff(np.r_[0, np.cumsum(t[raw], dtype=np.int64)][offsets]) for t in _CLASSES], 1).astype(float)
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends, lower=False)
    letters = np.r_[0, np.cumsum(ends - starts)]
    same = np.r_[0, np.cumsum(np.r_[h[1:] == h[:-1], False])] if len(h) else np.zeros(1, np.int64)
    pairs = h[:-1] * np.uint64(3) + h[1:] if len(h) > 1 else h[:0]
    out = np.zeros((n, len(NAMES)))
    newline = np.flatnonzero(raw == 10)
    for i in range(n):
        a, b = int(at[i]), int(at[i + 1])
        w = b - a
        lines = newline[np.searchsorted(newline, offsets[i]):np.searchsorted(newline, offsets[i + 1])] - offsets[i]
        data = raw[offsets[i]:offsets[i + 1]]
        if w:
            _, seen = np.unique(h[a:b], return_counts=True)
            few = np.unique(pairs[a:b - 1]) if w > 1 else h[:0]
            parts = data.tobytes().split(b"\n") if len(lines) else [b""]
            filled = [p for p in parts if p.strip()]
            out[i] = [np.log1p(w), (letters[b] - letters[a]) / w, 0, 0, 0, 0, 0, 0, 0, len(seen) / w ** 0.8, seen.max() / w, (same[b - 1] - same[a]) / w, 1 - len(few) / max(1, w - 1), np.log1p(len(filled)), 1 - len(set(filled)) / max(1, len(filled)), np.log1p(w / max(1, len(filled)))]
    low, up, digit, symbol, bar, mark, other, wide = count[:, 1], count[:, 0], *count[:, 2:].T
    size = np.maximum(1, low + up + wide)
    w = np.maximum(1, np.diff(at))
    out[:, 2], out[:, 3], out[:, 4], out[:, 5], out[:, 6], out[:, 7], out[:, 8] = up / size, digit / (size + digit), symbol / w, bar / w, mark / w, other / w, wide / size
    return out


def text_stats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, stats array<double>) of every document; a null text counts as empty, all zeros."""
    from pyspark.sql import functions as F

    def run(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            x = np.concatenate([block_stats(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]) for a, b in blocks(offsets)] or [np.zeros((0, len(NAMES)))])
            yield pa.RecordBatch.from_arrays([batch.column(0), matrix_column(x)], ["doc_id", "stats"])

    slim = texts(docs, id_col, text_col)
    return slim.mapInArrow(run, "doc_id long, stats array<double>")


def matrix_column(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))


def column_matrix(col: pa.Array, width: int) -> np.ndarray:
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def summed(df: DataFrame, function, width: int) -> np.ndarray:
    """Sum over all batches of ``function(batch)``, a matrix of ``width`` columns, added up row by row in Spark.

    Each task adds up its own batches; only the sums of one matrix row meet in a group.
    """
    def run(batches):
        total = None
        for batch in batches:
            if batch.num_rows:
                x = function(batch)
                total = x if total is None else total + x
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total))), pa.array([r.tobytes() for r in total], pa.binary())], ["i", "row"])

    def add(key, table):
        total = np.sum([np.frombuffer(x.as_py()) for x in table.column("row")], axis=0)
        return pa.table({"i": pa.array([key[0].as_py()], pa.int64()), "row": pa.array([total.tobytes()], pa.binary())})

    rows = df.mapInArrow(run, "i long, row binary").groupBy("i").applyInArrow(add, "i long, row binary").collect()
    out = np.zeros((max((r["i"] for r in rows), default=-1) + 1, width))
    for r in rows:
        out[r["i"]] = np.frombuffer(r["row"])
    return out
