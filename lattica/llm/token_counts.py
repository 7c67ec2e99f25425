"""Token counts by rank-synchronous merging of ragged arrays.

Texts arrive as Arrow batches and are counted in place, without a shuffle; a task's memory is one
block of about 1 MB of text (or one longer text) and a bounded cache of pre-tokens.

Defined cases: a null text counts as empty, with 0 bytes and 0 tokens; special strings inside a text
count as one token each, as the library does by default. Extra columns are ignored; an empty table
gives an empty result, repeated rows are counted each.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.common import blocks, texts, utf8


def _count_block(model: bpe.Bpe, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    codes, bounds = bpe.code_points(raw, offsets)
    starts, ends = model.pretokens(codes, bounds)
    place = model.places(codes, starts, ends)
    total = np.r_[0, np.cumsum(model.lengths[place], dtype=np.int64)]
    at = np.searchsorted(starts, bounds)
    return total[at[1:]] - total[at[:-1]]


def count_tokens(model: bpe.Bpe, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Tokens of each row, for bytes that lie one after another."""
    out = np.zeros(len(offsets) - 1, np.int64)
    marks = [s.encode() for s in model.specials]
    for a, b in blocks(offsets):
        part, own = raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a]
        data = part.tobytes()
        if any(m in data for m in marks):
            pieces, row, extra = [], [], np.zeros(b - a, np.int64)
            for i in range(b - a):
                rest = [data[own[i]:own[i + 1]]]
                for m in marks:
                    rest = [x for r in rest for x in r.split(m)]
                extra[i] = len(rest) - 1
                pieces += rest
                row += [i] * len(rest)
            sizes = np.r_[0, np.cumsum([len(p) for p in pieces])].astype(np.int64)
            got = _count_block(model, np.frombuffer(b"".join(pieces), np.uint8), sizes)
            out[a:b] = extra + np.bincount(row, got, b - a).astype(np.int64)
        else:
            out[a:b] = _count_block(model, part, own)
    return out


def token_counts(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit of every document.

    ``vocabulary`` is the path of a byte-level tokenizer file on every worker.
    """
    def run(batches):
        model = bpe.load(vocabulary)
        for b in batches:
            raw, offsets = utf8(b.column(1))
            n = count_tokens(model, raw, offsets)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.diff(offsets), pa.int64()), pa.array(n, pa.int64())], ["doc_id", "n_bytes", "n_tokens"])

    slim = texts(docs, id_col, text_col)
    return slim.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
