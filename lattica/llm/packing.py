"""Best-fit packing of token pieces, after Martello-Toth dominance reduction.

Tokenising and cutting run in the tasks. Packing needs only how many pieces there are of each length,
at most ``limit`` numbers whatever the corpus, so the plan is made from that histogram: first bins
that dominance proves to be part of some optimal packing are fixed for good (pairs, exact fits, items
that nothing fits beside), then the shrunken instance is packed best-fit, longest first. The plan is a
list of runs: *the next m * q pieces of length L lie q to a bin in m bins from sequence s on, from
offset o on*. A piece finds its place from its rank among pieces of its length, and that rank is the
sum of its task's offset and its number within the task; no group is ever gathered.

Defined cases: a null text counts as empty, and each document ends with id 0, so every document has
at least one piece. Repeated rows are packed each. Extra columns are ignored; an empty table gives an
empty result. Texts longer than ``limit`` are cut to full pieces, the last one may be shorter.
"""

from __future__ import annotations

import bisect
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm import bpe
from lattica.llm.common import blocks, materialize, texts, utf8

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task long, nth long"


def document_ids(model: bpe.Bpe, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of each row's text followed by id 0, one row after another, and the rows' offsets.

    Rows whose code points the normaliser maps one to one go through the arrays; the library itself
    encodes the others, and those with special strings.
    """
    codes, bounds = bpe.code_points(raw, offsets)
    n = len(bounds) - 1
    odd = np.r_[0, np.cumsum(~model.simple[codes])]
    slow = odd[bounds[1:]] > odd[bounds[:-1]]
    data = raw.tobytes()
    if b"<|" in data:
        slow |= np.array([b"<|" in data[a:b] for a, b in zip(offsets[:-1], offsets[1:], strict=True)], bool)
    if slow.any():
        rows = []
        for i in np.flatnonzero(slow):
            rows.append((i, np.array(model.library.encode(data[offsets[i]:offsets[i + 1]].decode("utf-8", "replace"), add_special_tokens=False).ids, "<u4")))
        codes = codes[np.repeat(~slow, np.diff(bounds))]
        bounds = np.r_[0, np.cumsum(np.where(slow, 0, np.diff(bounds)))]
    else:
        rows = []
    codes = model.lower[codes]
    starts, ends = model.pretokens(codes, bounds)
    place = model.places(codes, starts, ends)
    sizes = model.lengths[place].astype(np.int64)
    total = np.r_[0, np.cumsum(sizes)]
    at = np.searchsorted(starts, bounds)
    counts = total[at[1:]] - total[at[:-1]]
    for i, ids in rows:
        counts[i] = len(ids)
    out_at = np.r_[0, np.cumsum(counts + 1)]
    out = np.zeros(out_at[-1], "<u4")
    fast_ids = model.flat[bpe.ragged(model.starts[place], sizes)]
    to = bpe.ragged(out_at[:-1], np.where(slow, 0, counts))
    out[to] = fast_ids
    for i, ids in rows:
        out[out_at[i]:out_at[i] + len(ids)] = ids
    return out, out_at


def pieces(docs: DataFrame, vocabulary: str, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The pieces of every document, with the task that cut them and their number among its pieces of that length."""
    def run(batches):
        model, task, seen = bpe.load(vocabulary), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            raw, offsets = utf8(batch.column(1))
            doc_ids = batch.column(0)
            for a, b in blocks(offsets):
                ids, at = document_ids(model, raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a])
                cut = -(-np.diff(at) // limit)
                row = np.repeat(np.arange(b - a), cut)
                nth_piece = bpe.ragged(np.zeros(b - a, np.int64), cut)
                start = nth_piece * limit
                length = np.minimum(limit, np.diff(at)[row] - start)
                data, first = memoryview(ids.tobytes()), at[row] + start
                crc = [zlib.crc32(data[4 * x:4 * (x + y)]) for x, y in zip(first.tolist(), length.tolist(), strict=True)]
                nth = []
                for size in length.tolist():
                    nth.append(seen[size])
                    seen[size] += 1
                yield pa.RecordBatch.from_arrays([
                    doc_ids.slice(a, b - a).take(pa.array(row)), pa.array(nth_piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                    pa.array(crc, pa.int64()), pa.array(np.full(len(row), task), pa.int64()), pa.array(nth, pa.int64())], ["doc_id", "piece", "start", "length", "ids_crc32", "task", "nth"])

    slim = texts(docs, id_col, text_col)
    return slim.mapInArrow(run, PIECES)


def _beyond(counts: dict[int, int], r: int, single: int) -> bool:
    """Do two or more pieces fit into ``r`` that together exceed ``single``?"""
    have = sorted(x for x, n in counts.items() if n and x <= r)
    lo, hi = 0, len(have) - 1
    while lo <= hi:
        pair = have[lo] + have[hi]
        if pair > r or lo == hi and counts[have[lo]] < 2:
            hi -= 1
        elif pair > single:
            return True
        else:
            lo += 1
    one = two = 0
    full = (1 << r + 1) - 1
    for x in have:
        for _ in range(min(counts[x], r // x)):
            two |= (two << x | one << x) & full
            one |= 1 << x
    return two >> single + 1 != 0


def reduce_instance(counts: dict[int, int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Take out of ``counts`` the bins that dominance fixes: (contents, how many bins), longest first.

    The longest piece L with the largest piece i that fits beside it dominates every bin of L if
    nothing fits beside L, if L and i fill the bin, or if no two or more pieces that fit beside L
    exceed i together: any such set could trade places with i.
    """
    fixed = []
    changed = True
    while changed:
        changed = False
        for long in sorted(counts, reverse=True):
            while counts[long]:
                r = limit - long
                counts[long] -= 1
                fit = max((x for x, n in counts.items() if n and x <= r), default=0)
                keep = bool(fit) and fit != r and _beyond(counts, r, fit)
                counts[long] += 1
                if keep:
                    break
                if not fit:
                    bins, content = counts[long], [(long, 1)]
                elif fit == long:
                    bins, content = counts[long] // 2, [(long, 2)]
                else:
                    bins, content = min(counts[long], counts[fit]), [(long, 1), (fit, 1)]
                for x, q in content:
                    counts[x] -= q * bins
                fixed.append((content, bins))
                changed = True
    return fixed


def best_fit(counts: dict[int, int], limit: int) -> list[tuple[list[tuple[int, int]], int]]:
    """Best-fit decreasing over lengths: (contents, how many bins). Equal bins are kept as one entry."""
    open_bins: dict[int, list] = defaultdict(list)
    rooms: list[int] = []

    def put(content, bins, room):
        if not open_bins[room]:
            bisect.insort(rooms, room)
        open_bins[room].append((content, bins))

    for long in sorted((x for x, n in counts.items() if n), reverse=True):
        left = counts[long]
        while left:
            at = bisect.bisect_left(rooms, long)
            if at < len(rooms):
                room = rooms[at]
                content, bins = open_bins[room].pop()
                if not open_bins[room]:
                    del rooms[at]
            else:
                room, content, bins = limit, [], left
            q = room // long
            whole = min(bins, left // q)
            if whole:
                put([*content, (long, q)], whole, room - q * long)
            left -= whole * q
            rest = bins - whole
            if rest and left:  # fewer than q are left: one bin takes them
                put([*content, (long, left)], 1, room - left * long)
                left, rest = 0, rest - 1
            if rest and content:
                put(content, rest, room)
    return [x for group in open_bins.values() for x in group]


def plan(histogram: dict[int, int], limit: int) -> np.ndarray:
    """Runs (length, first rank, q to a bin, first sequence, offset), sorted by length and first rank."""
    counts = {x: n for x, n in histogram.items() if n}
    groups = reduce_instance(counts, limit)
    groups += best_fit(counts, limit)
    used, runs, sequence = defaultdict(int), [], 0
    for content, bins in groups:
        offset = 0
        for x, q in content:
            runs.append((x, used[x], q, sequence, offset))
            used[x] += q * bins
            offset += x * q
        sequence += bins
    return np.array(sorted(runs), np.int64).reshape(-1, 5)


#: Rows (task, length, pieces before) that are broadcast, 24 bytes each; more are joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def pack(docs: DataFrame, vocabulary: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    cut = materialize(pieces(docs, vocabulary, limit, id_col, text_col))
    by_task = materialize(cut.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")))
    histogram = {r["length"]: r["n"] for r in by_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    runs = spark.sparkContext.broadcast(plan(histogram, limit))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    offsets = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bounded = F.broadcast(offsets) if by_task.count() <= BROADCAST_ROWS else offsets.hint("merge")
    ranked = cut.join(bounded, ["task", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def run(batches):
        table = runs.value
        key = table[:, 0] << 44 | table[:, 1]
        for b in batches:
            length, rank = (b.column(i).to_numpy(zero_copy_only=False) for i in (3, 5))
            at = table[np.searchsorted(key, length << 44 | rank, side="right") - 1]
            nth = rank - at[:, 1]
            yield pa.RecordBatch.from_arrays([*b.columns[:5], pa.array(at[:, 3] + nth // at[:, 2]), pa.array(at[:, 4] + nth % at[:, 2] * length)], ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(run, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
