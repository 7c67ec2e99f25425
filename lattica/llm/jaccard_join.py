"""N-gram Jaccard join in metric space: pivots, Voronoi regions, triangle-inequality windows.

The Jaccard distance of shingle sets is a metric. Links within ``eps`` are found by pivots that are documents:

1. A document is compared with the pivots of its region. It belongs to the Voronoi region of its nearest
   pivot and, by the triangle inequality, to that of each pivot at most ``2 eps`` farther: a linked pair
   meets in the region of either's nearest pivot. Documents linked with the region's pivot need not be
   compared with each other, and only those not closer to it by more than ``eps`` than the nearest unlinked
   one are kept; a region without an unlinked one is done.
2. Pivots have met their whole region and leave it. Regions go down to new pivots, round after round, until
   each fits a leaf: ``LEAF_TEXTS`` documents and ``LEAF_SHINGLES`` shingles. A leaf is one task's, which
   goes on with the same rule by itself (``link_region``) until nothing is left to compare.
3. Where pivots do not at least halve the pairs of a region (all its documents about equally far from all
   pivots), its documents are dealt into blocks, and each pair of blocks is a leaf of its own.

All documents of a region are dealt over tasks of leaf size in every round, whatever its size. Most texts are at
distance 1 from nearly all others, where no window tells regions apart, so cells come before regions:

* Only documents that may have a partner enter. Two documents within ``eps`` share one of the first
  ``n - ceil(t n) + 1`` shingles of any common order; the order puts shingles of a single text first, and a
  document whose first ones are only those goes no further. Which shingles several texts hold comes from all
  texts: per-range sorted hashes, merged into one bitmap. Beyond ``MAX_SLOTS`` the bitmap is no longer
  broadcast: shingles travel to their counts and back instead.
* Documents that share one of these first shingles and may be near in size are one cell (the connected parts
  of a star graph). Cells too large for a leaf are cut once more by shingles counted among them alone. Cells are the
  regions that the first pivots are taken from. No pair is made there.

Sets are sets of 64-bit shingle hashes; equal sets are one vertex, whatever number of copies.

Defined cases: a null or empty text, or one without words, has the empty set and is linked with
nothing. Fewer words than the shingle width make one shingle. Repeated rows are copies. Extra columns
are ignored; an empty table gives an empty result. A null doc_id is linked like others but never names
a component unless all of its members are null.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lattica.llm.bpe import ragged
from lattica.llm.common import U64, any_names, blocks, bound_batches, discard, materialize, mix, plus, pow2, shingle_sets, spread_join, texts, utf8
from lattica.llm.components import connected_components
from lattica.llm.exact_dedup import without_ids

#: Shingle hashes below 2**SAMPLE_BITS (a quarter of all values) are tested for being in one text only.
SAMPLE_BITS = 62
#: Slots of 2 bits for shared shingles: so many a document, and at most (64 MB, broadcast).
SLOTS_PER_DOC, MAX_SLOTS = 512, 1 << 28
#: The bitmap serves up to so many times the documents that its slots are made for.
SPARE = 16
#: From so many sets on a shingle is common, or frequent; it then stands later in the order.
COMMON, FREQUENT = 8, 64
#: Documents a range of hashes is made for.
DOCS_PER_RANGE = 8192
#: Texts and shingles of a region that one task joins; larger regions are taken apart by pivots.
LEAF_TEXTS, LEAF_SHINGLES = 256, 400_000
PIVOTS = 8


def _need(n, num: int, den: int):
    """The smallest overlap of a set of ``n`` with a partner."""
    return -(-n * num // den)


def _block_sets(batch_text, width: int):
    raw, offsets = utf8(batch_text)
    for a, b in blocks(offsets):
        yield from shingle_sets(raw[offsets[a]:offsets[b]], offsets[a:b + 1] - offsets[a], width)


def _stored_sets(batch):
    raw, offsets = utf8(batch.column(0))
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
        yield raw[a:b].view(U64)


def _set_key(u: np.ndarray) -> int:
    """One number for a set; equal sets have equal numbers."""
    if not len(u):
        return 0
    key = (int(mix(u).sum(dtype=U64)) + len(u) * 0x9E3779B97F4A7C15) & 0xFFFFFFFFFFFFFFFF
    return key - (key >> 63 << 64)


def _slot(h: np.ndarray, bits: int) -> np.ndarray:
    return (mix(h) & U64(bits - 1)).astype(np.int64)


def _capped(h: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (hash, tag), sorted; of one hash ``FREQUENT`` tags are enough to tell its class."""
    order = np.lexsort((tag, h))
    h, tag = h[order], tag[order]
    fresh = np.r_[True, (h[1:] != h[:-1]) | (tag[1:] != tag[:-1])] if len(h) else np.zeros(0, bool)
    h, tag = h[fresh], tag[fresh]
    few = np.ones(len(h), bool)
    few[FREQUENT:] = h[FREQUENT:] != h[:-FREQUENT]
    return h[few], tag[few]


def shared_shingles(sets: DataFrame, read, sample: int, ranges: int, slots: int) -> bytes:
    """How many different sets hold each sampled shingle: 2 bits a slot, compressed.

    0: one set; 1: fewer than ``COMMON``; 2: fewer than ``FREQUENT``; 3: more. Slots that several
    shingles share have the largest of their classes. ``read`` yields the sets of a batch.
    """
    shift, per = U64(sample - (ranges - 1).bit_length()), slots // ranges

    def local(batches):
        for batch in batches:
            hs, tags = [], []
            for u in read(batch):
                part = u[:_sampled(u, sample)]
                hs.append(part)
                tags.append(np.full(len(part), _set_key(u) & 0xFFFFFFFFFFFFFFFF, U64))
            if not hs:
                continue
            h, tag = _capped(np.concatenate(hs), np.concatenate(tags))
            r = (h >> shift).astype(np.int64)
            at = np.flatnonzero(np.r_[True, r[1:] != r[:-1], True]) if len(r) else np.zeros(1, np.int64)
            blobs = [h[a:b].tobytes() + tag[a:b].tobytes() for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_pydict({"r": pa.array(r[at[:-1]] if len(r) else [], pa.int64()), "blob": pa.array(blobs, pa.binary())})

    def merge(key, table):
        hs, tags = [], []
        for blob in table.column("blob"):
            data = blob.as_py()
            n = len(data) // 16
            hs.append(np.frombuffer(data, U64, n))
            tags.append(np.frombuffer(data, U64, n, 8 * n))
        h, _ = _capped(np.concatenate(hs), np.concatenate(tags))
        at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
        n = np.diff(np.r_[at, len(h)])
        kind = (n > 1).astype(np.uint8) + (n >= COMMON) + (n >= FREQUENT)
        level = np.zeros(per, np.uint8)
        slot = _slot(h[at], per)
        for k in (1, 2, 3):
            level[slot[kind == k]] = k
        packed = (level.reshape(-1, 4) << np.array([0, 2, 4, 6], np.uint8)).sum(1, dtype=np.uint8)
        return pa.table({"r": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(packed.tobytes(), 1)], pa.binary())})

    found = sets.mapInArrow(local, "r long, blob binary").groupBy("r").applyInArrow(merge, "r long, bits binary")
    out = np.zeros(slots // 4, np.uint8)
    for row in found.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        out[row["r"] * (per // 4):row["r"] * (per // 4) + len(part)] = part
    return zlib.compress(out.tobytes(), 1)


def _sampled(u: np.ndarray, sample: int) -> int:
    return len(u) if sample == 64 else int(np.searchsorted(u, U64(1 << sample)))


def _window(u: np.ndarray, levels: np.ndarray, sample: int, shift: U64, per: int, num: int, den: int) -> np.ndarray | None:
    """The shared shingles among the first ``n - need + 1`` in the order; None if the set has no partner.

    The order: sampled shingles of one set, sampled shared ones by class, the others; then by hash.
    """
    most = len(u) - _need(len(u), num, den) + 1
    part = u[:_sampled(u, sample)]
    slot = (part >> shift).astype(np.int64) * per + _slot(part, per)
    level = (levels[slot >> 2] >> ((slot & 3) * 2).astype(np.uint8)) & 3
    own = int((level == 0).sum())
    if own >= most:
        return None
    ranked = [part[level == k] for k in (1, 2, 3)]
    return np.concatenate([*ranked, u[len(part):]])[:most - own]


def _windows(docs: DataFrame, width: int, num: int, den: int, packed, ranges: int, slots: int) -> DataFrame:
    """(doc_id, key, n) of every document; for those that may have a partner also the window and the set."""
    shift, per = U64(SAMPLE_BITS - (ranges - 1).bit_length()), slots // ranges

    def run(batches):
        levels, seen = np.frombuffer(zlib.decompress(packed.value), np.uint8), set()
        for batch in batches:
            keys, sizes, window, sets = [], [], [], []
            for u in _block_sets(batch.column(1), width):
                key = _set_key(u)
                first = _window(u, levels, SAMPLE_BITS, shift, per, num, den) if len(u) and key not in seen else None
                keys.append(key)
                sizes.append(len(u))
                window.append(None if first is None else first.tobytes())
                sets.append(None if first is None else u.tobytes())
                if first is not None:
                    seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(window, pa.binary()), pa.array(sets, pa.binary())], ["doc_id", "key", "n", "window", "shingles"])

    return docs.mapInArrow(run, "doc_id long, key long, n long, window binary, shingles binary")


def _windows_by_exchange(docs: DataFrame, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame]:
    """``_windows`` for more texts than a bitmap of bounded size can tell apart, as two tables.

    Each sampled shingle travels to its count; those that several sets hold come back to the sets. Shingles in
    more than one in a thousand rows get their count by broadcast (fewer than a thousand), so none gathers in a task.
    """
    def run(batches):
        seen = set()
        for batch in batches:
            keys, sizes, sets = [], [], []
            for u in _block_sets(batch.column(1), width):
                key = _set_key(u)
                keys.append(key)
                sizes.append(len(u))
                sets.append(None if key in seen or not len(u) else u.tobytes())
                seen.add(key)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(sets, pa.binary())], ["doc_id", "key", "n", "shingles"])

    def sampled(batches):
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            parts = [u[:_sampled(u, SAMPLE_BITS)] for u in _stored_sets(batch.select([1]))]
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, [len(x) for x in parts])), pa.array(np.concatenate([np.zeros(0, U64), *parts]).view(np.int64))], ["key", "s"])

    def windows(batches):
        for batch in batches:
            found = []
            for u, shared in zip(_stored_sets(batch.select([2])), batch.column(3).to_pylist(), strict=True):
                n = _sampled(u, SAMPLE_BITS)
                own, most = n - len(shared), len(u) - _need(len(u), num, den) + 1
                found.append(None if own >= most else np.concatenate([np.array([x["s"] for x in shared], np.int64).view(U64), u[n:]])[:most - own].tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.binary()), batch.column(2)], ["key", "n", "window", "shingles"])

    table = materialize(docs.mapInArrow(run, "doc_id long, key long, n long, shingles binary"))
    sets = table.where("shingles IS NOT NULL").select("key", "n", "shingles")
    rows = materialize(sets.select("key", "shingles").mapInArrow(sampled, "key long, s long"))
    count = F.count(F.lit(1))
    level = F.when(F.col("rows") < COMMON, 1).when(F.col("rows") < FREQUENT, 2).otherwise(3)
    shared = materialize(rows.groupBy("s").agg(F.min("key").alias("a"), F.max("key").alias("b"), count.alias("rows")).where("a <> b").select("s", level.alias("level"), "rows"))
    ranked = spread_join(rows, shared, "s", "rows", rows.count()).groupBy("key").agg(F.array_sort(F.collect_set(F.struct("level", "s"))).alias("shared"))
    none = F.array().cast("array<struct<level:int,s:bigint>>")
    wide = sets.join(ranked, "key", "left").select("key", "n", "shingles", F.coalesce("shared", none).alias("shared")).mapInArrow(windows, "key long, n long, window binary, shingles binary")
    wide = materialize(wide.where("window IS NOT NULL"))
    discard(rows, shared)
    return table.select("doc_id", "key", "n"), wide


def _narrow(members: DataFrame, num: int, den: int) -> DataFrame:
    """Regions anew for members of regions that are too large: all their shingles, counted among them alone."""
    spark = members.sparkSession
    rows = members.count()
    ranges, slots = max(16, pow2(rows / DOCS_PER_RANGE * 4)), min(MAX_SLOTS, max(1 << 20, pow2(rows * SLOTS_PER_DOC * 4)))
    packed = spark.sparkContext.broadcast(shared_shingles(members.select("shingles"), _stored_sets, 64, ranges, slots))
    shift, per = U64(64 - (ranges - 1).bit_length()), slots // ranges

    def run(batches):
        levels = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for batch in batches:
            sets = list(_stored_sets(batch.select([1])))
            windows = [_window(u, levels, 64, shift, per, num, den) for u in sets]
            kept = [i for i, w in enumerate(windows) if w is not None]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(kept, pa.int64())), pa.array([len(sets[i]) for i in kept], pa.int64()), pa.array([windows[i].tobytes() for i in kept], pa.binary())], ["key", "n", "window"])

    wide = members.select("key", "shingles").mapInArrow(run, "key long, n long, window binary")
    found = connected_components(_coarse_edges(wide, num, den)).select(F.col("node").alias("key"), F.concat(F.lit("r"), F.col("component").cast("string")).alias("region"))
    return members.select("key", "shingles").join(found, "key")


def _coarse_edges(wide: DataFrame, num: int, den: int) -> DataFrame:
    """Edges (a, b) that connect all documents which share a region and whose sizes allow a link.

    Each batch links its documents of one region and size class to the first of them; only those
    representatives are grouped by region. Partners are in the same or in adjacent size classes.
    """
    step = np.log(den / num) * 1.01

    def local(batches):
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            s = raw.view(U64) if len(raw) else np.zeros(0, U64)
            count = np.diff(offsets) // 8
            key = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), count)
            size = np.repeat(np.floor(np.log(batch.column(1).to_numpy(zero_copy_only=False)) / step).astype(np.int32), count)
            if not len(s):
                continue
            order = np.lexsort((size, s))
            s, size, key = s[order], size[order], key[order]
            head = np.r_[True, (s[1:] != s[:-1]) | (size[1:] != size[:-1])]
            lead = key[np.maximum.accumulate(np.where(head, np.arange(len(s)), 0))]
            pairs = np.unique(np.stack([key, lead], 1)[key != lead], axis=0)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.r_[s[head].view(np.int64), np.zeros(len(pairs), np.int64)]), pa.array(np.r_[size[head], np.full(len(pairs), -1, np.int32)]),
                pa.array(np.r_[key[head], pairs[:, 0]]), pa.array(np.r_[key[head], pairs[:, 1]])], ["s", "size", "a", "b"])

    found = materialize(wide.select("key", "n", "window").mapInArrow(local, "s long, size int, a long, b long"))
    reps = found.where("size >= 0").repartition("s")
    firsts = reps.groupBy("s", "size").agg(F.min("a").alias("first"), F.count(F.lit(1)).alias("n"))
    to_first = reps.join(firsts.where("n > 1"), ["s", "size"]).where("a <> first").select("a", F.col("first").alias("b"))
    by_size = Window.partitionBy("s").orderBy("size")
    chain = firsts.select("size", "first", F.lead("size").over(by_size).alias("next"), F.lead("first").over(by_size).alias("to")).where("next = size + 1 AND to <> first").select(F.col("first").alias("a"), F.col("to").alias("b"))
    return found.where("size < 0").select("a", "b").unionByName(to_first).unionByName(chain)


def _parts(m: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least row that each of ``m`` rows is connected with through edges (a, b)."""
    part = np.arange(m)
    while True:
        low = np.minimum(part[a], part[b])
        before = part.copy()
        np.minimum.at(part, part[a], low)
        np.minimum.at(part, part[b], low)
        while not np.array_equal(part, part[part]):
            part = part[part]
        if np.array_equal(part, before):
            return part


def _overlaps(ids: np.ndarray, at: np.ndarray, n: np.ndarray, rows: np.ndarray, pivots: np.ndarray, flag: np.ndarray) -> np.ndarray:
    """How many shingles each of ``rows`` shares with each of ``pivots``."""
    own = ids[ragged(at[rows], n[rows])]
    starts = np.cumsum(n[rows]) - n[rows]
    both = np.empty((len(rows), len(pivots)), np.int64)
    for j, p in enumerate(pivots.tolist()):
        mine = ids[at[p]:at[p + 1]]
        flag[mine] = 1
        both[:, j] = np.add.reduceat(flag[own], starts)
        flag[mine] = 0
    return both


def regions(d: np.ndarray, linked: np.ndarray, eps: float) -> list[np.ndarray]:
    """The Voronoi region of each pivot, with its window: places of the rows that have to meet there. ``d``: rows x pivots."""
    least = d.min(1)
    out = []
    for j in range(d.shape[1]):
        inside = d[:, j] <= least + 2 * eps
        free = inside & ~linked[:, j]
        if free.any():  # rows linked with the pivot stay only if they may be near an unlinked one
            out.append(np.flatnonzero(inside & (~linked[:, j] | (d[:, j] >= d[free, j].min() - eps))))
    return out


def link_region(sets: list[np.ndarray], num: int, den: int) -> np.ndarray:
    """For each set the place of the set that stands for its connected part: pivots, windows and regions, down to nothing."""
    m = len(sets)
    n = np.array([len(s) for s in sets], np.int64)
    if m == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return np.array([0, int(den * both < num * (int(n.sum()) - both))])
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    at = np.r_[0, np.cumsum(n)]
    flag = np.zeros(int(ids.max()) + 1, np.int64)
    eps = 1 - num / den + 1e-9
    a, b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    work = [np.arange(m)]
    while work:
        rows = work.pop()
        if len(rows) < 2:
            continue
        picked = np.unique(np.linspace(0, len(rows) - 1, min(PIVOTS, len(rows))).astype(np.int64))
        pivots = rows[picked]
        both = _overlaps(ids, at, n, rows, pivots, flag)
        union = n[rows][:, None] + n[pivots][None, :] - both
        linked = den * both >= num * union
        i, j = np.nonzero(linked)
        a.append(rows[i])
        b.append(pivots[j])
        rest = np.ones(len(rows), bool)
        rest[picked] = False
        rows = rows[rest]
        if len(rows) > 1:
            below = regions((1 - both / union)[rest], linked[rest], eps)
            if 2 * sum(len(x) ** 2 for x in below) > len(rows) ** 2:  # not taken apart: the next pivots try all of them
                below = [np.unique(np.concatenate(below))]
            work += [rows[x] for x in below]
    return _parts(m, np.concatenate(a), np.concatenate(b))


def _join_regions(members: DataFrame, num: int, den: int) -> DataFrame:
    """(a, b): documents of each region and those that stand for their connected part; members: region, key, shingles."""
    def run(batches):
        region, keys, sets = None, [], []

        def close():
            root = link_region(sets, num, den)
            k = np.array(keys, np.int64)
            moved = np.flatnonzero(root != np.arange(len(k)))
            return pa.RecordBatch.from_arrays([pa.array(k[moved]), pa.array(k[root[moved]])], ["a", "b"])

        for batch in batches:
            names, own = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, (name, key) in enumerate(zip(names, own, strict=True)):
                if name != region:
                    if len(keys) > 1:
                        yield close()
                    region, keys, sets = name, [], []
                if not keys or keys[-1] != key:
                    keys.append(key)
                    sets.append(np.frombuffer(batch.column(2)[i].as_py(), U64))
        if len(keys) > 1:
            yield close()

    return members.select("region", "key", "shingles").repartition("region").sortWithinPartitions("region", "key").mapInArrow(run, "a long, b long")


def _meet_pivots(members: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """One round of pivots over regions larger than a leaf; members: region, parts, key, shingles.

    Rows with ``b`` are links (a, b) to pivots. Rows with ``shingles`` are the other members, in the region of
    each pivot whose window holds them, with the distance to it and whether that links them. A region is dealt
    over ``parts`` tasks, and its pivots go to each.
    """
    eps = 1 - num / den + 1e-9
    mark = F.xxhash64("key", F.lit(turn))
    chosen = members.groupBy("region", F.pmod(mark, F.lit(PIVOTS)).alias("i")).agg(F.min_by("key", mark).alias("key"))
    pivots = materialize(members.join(chosen.select("region", "key"), ["region", "key"], "left_semi").dropDuplicates(["region", "key"]))
    pivots = pivots.select("region", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("key").alias("pivot"), F.col("shingles").alias("set"))
    kinds = {"a": pa.int64(), "b": pa.int64(), "region": pa.string(), "cell": pa.string(), "key": pa.int64(), "shingles": pa.binary(), "d": pa.float64(), "linked": pa.bool_()}
    dealt = members.select("region", F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("part"), "key", "shingles")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return pa.table({k: pa.array([], t) for k, t in kinds.items()})
        region = left.column("region")[0].as_py()
        right = right.sort_by("pivot")
        names = right.column("pivot").to_numpy()
        own = left.column("key").to_numpy()
        sets = [np.frombuffer(x.as_py(), U64) for column in (left.column("shingles"), right.column("set")) for x in column]
        n = np.array([len(s) for s in sets], np.int64)
        _, ids = np.unique(np.concatenate(sets), return_inverse=True)
        rows, pivots = np.arange(len(own)), np.arange(len(own), len(sets))
        both = _overlaps(ids, np.r_[0, np.cumsum(n)], n, rows, pivots, np.zeros(int(ids.max()) + 1, np.int64))
        union = n[rows][:, None] + n[pivots][None, :] - both
        d, linked = 1 - both / union, den * both >= num * union
        i, j = np.nonzero(linked & (own[:, None] != names[None, :]))
        k, at = np.nonzero((d <= d.min(1, keepdims=True) + 2 * eps) & ~np.isin(own, names)[:, None])
        no_row, no_link = [None] * len(i), [None] * len(k)
        columns = {
            "a": own[i].tolist() + no_link, "b": names[j].tolist() + no_link, "region": [region] * (len(i) + len(k)), "cell": no_row + [f"{region}/{x}" for x in names[at].tolist()],
            "key": no_row + own[k].tolist(), "shingles": no_row + [sets[x].tobytes() for x in k.tolist()], "d": no_row + d[k, at].tolist(), "linked": no_row + linked[k, at].tolist()}
        return pa.table({c: pa.array(columns[c], t) for c, t in kinds.items()})

    return dealt.groupBy("region", "part").cogroup(pivots.groupBy("region", "part")).applyInArrow(run, "a long, b long, region string, cell string, key long, shingles binary, d double, linked boolean")


def _join_cells(members: DataFrame, num: int, den: int, leaf: tuple[int, int]) -> DataFrame:
    """Links (a, b) inside cells of any size, by rounds of pivots down to leaves; members: region, key, shingles."""
    eps = 1 - num / den + 1e-9
    count, size = F.count(F.lit(1)), F.length("shingles") / 8
    parts = F.greatest(F.ceil(F.col("docs") / leaf[0]), F.ceil(F.col("total") / leaf[1])).cast("int")
    links, turn, held = [], 0, members
    while True:
        sizes = materialize(members.groupBy("region").agg(count.alias("docs"), F.sum(size).alias("total")).withColumn("parts", parts))
        all_rows = sizes.agg(F.sum("docs")).first()[0] or 0
        placed = spread_join(members, sizes, "region", "docs", all_rows)
        links.append(materialize(_join_regions(placed.where("parts = 1 AND docs > 1"), num, den)))
        if sizes.where("parts > 1").isEmpty():
            break
        made = materialize(_meet_pivots(placed.where("parts > 1").select("region", "parts", "key", "shingles"), num, den, turn))
        links.append(made.where("b IS NOT NULL").select("a", "b"))
        rows = made.where("shingles IS NOT NULL")
        stats = materialize(rows.groupBy("cell").agg(count.alias("docs"), F.min(F.when(~F.col("linked"), F.col("d"))).alias("least")))
        kept = spread_join(rows, stats.where("least IS NOT NULL"), "cell", "docs", stats.agg(F.sum("docs")).first()[0] or 0)
        kept = materialize(kept.where(~F.col("linked") | (F.col("d") >= F.col("least") - eps)).select("region", "cell", "key", "shingles"))
        work = kept.groupBy("region", "cell").agg(count.cast("double").alias("n")).groupBy("region").agg(F.sum(F.col("n") * F.col("n")).alias("work"))
        stuck = materialize(work.join(sizes, "region").where("2 * work > docs * docs").select("region", (2 * F.col("parts")).alias("blocks"), "docs"))
        discard(held, stats)
        held = kept
        members = kept.select(F.col("cell").alias("region"), "key", "shingles")
        if not stuck.isEmpty():
            whole = spread_join(kept.dropDuplicates(["region", "key"]), stuck, "region", "docs", all_rows)
            own = F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")
            paired = whole.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
            paired = paired.select(F.concat_ws("/", "region", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).alias("region"), "key", "shingles")
            links.append(materialize(_join_regions(paired, num, den)))
            others = sizes.select("region", "docs").join(stuck, "region", "left_anti")
            held = members = materialize(spread_join(kept, others, "region", "docs", all_rows).select(F.col("cell").alias("region"), "key", "shingles"))
            discard(kept)
        turn += 1
    out = links[0]
    for x in links[1:]:
        out = out.unionByName(x)
    return out


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100, leaf: tuple[int, int] = (LEAF_TEXTS, LEAF_SHINGLES), most_slots: int = MAX_SLOTS) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id.

    Documents link when ``den * overlap >= num * union``; component_id is the smallest doc_id that
    links reach. Exact up to collisions of 64-bit hashes.
    """
    return _components(docs, id_col, text_col, width, num, den, leaf, most_slots).select("doc_id", "n_shingles", "component_id")


def _cells(slim: DataFrame, rows: int, width: int, num: int, den: int, most_slots: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, key, n) of every document; (key, n, window, shingles) of those that may have a partner."""
    ranges, slots = max(16, pow2(rows / DOCS_PER_RANGE)), max(1 << 20, pow2(rows * SLOTS_PER_DOC))
    if slots > most_slots * SPARE:
        return _windows_by_exchange(slim, width, num, den)
    packed = slim.sparkSession.sparkContext.broadcast(shared_shingles(slim.select("text"), lambda batch: _block_sets(batch.column(0), width), SAMPLE_BITS, ranges, min(most_slots, slots)))
    table = materialize(_windows(slim, width, num, den, packed, ranges, min(most_slots, slots)))
    packed.destroy()
    return table.select("doc_id", "key", "n"), table.where("window IS NOT NULL").select("key", "n", "window", "shingles")


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, leaf: tuple[int, int] = (LEAF_TEXTS, LEAF_SHINGLES), most_slots: int = MAX_SLOTS) -> DataFrame:
    """The rows of ``jaccard_components`` with the key of the row's set and one key for all sets of its component."""
    slim = texts(docs, id_col, text_col)
    rows = slim.count()
    every, wide = _cells(slim, rows, width, num, den, most_slots)
    count = F.count(F.lit(1))
    coarse = materialize(connected_components(_coarse_edges(wide, num, den)).select(F.col("node").alias("key"), F.col("component").cast("string").alias("region")))
    sizes = materialize(wide.select("key", "n").distinct().join(coarse, "key").groupBy("region").agg(count.alias("docs"), F.sum("n").alias("total")))
    placed = materialize(spread_join(coarse, sizes, "region", "docs", rows).select("key", "region", ((F.col("docs") > leaf[0]) | (F.col("total") > leaf[1])).alias("large")))
    members = wide.select("key", "shingles").join(placed, "key").groupBy("region", "key", "large").agg(F.first("shingles").alias("shingles"))
    links = materialize(_join_regions(members.where("NOT large"), num, den))
    if not placed.where("large").isEmpty():
        big = materialize(members.where("large").select("region", "key", "shingles"))
        links = links.unionByName(_join_cells(materialize(_narrow(big, num, den)), num, den, leaf))
        discard(big)
    roots = materialize(connected_components(links).select(F.col("node").alias("key"), "component"))
    discard(coarse, sizes, placed)
    classes = every.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"), count.alias("copies"))
    least = materialize(classes.join(roots, "key", "left").where("copies > 1 OR component IS NOT NULL").withColumn("component", F.coalesce("component", "key")))
    named = least.groupBy("component").agg(F.min("first").alias("component_id"), count.alias("sets"))
    moved = materialize(spread_join(least.select("key", "component", "copies"), named, "component", "sets", rows).select("key", "component", "component_id", "copies"))
    joined = spread_join(every, moved, "key", "copies", rows, "left")
    return joined.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component_id", "doc_id")).otherwise(F.col("doc_id")).alias("component_id"), "key", F.coalesce("component", "key").alias("component"))


def _with_set_key(docs: DataFrame, text_col: str, width: int) -> DataFrame:
    """``docs`` with the key of each row's set of shingles as the column _key."""
    def run(batches):
        for b in batches:
            yield b.append_column("_key", pa.array([_set_key(u) for u in _block_sets(b.column("_text"), width)], pa.int64()))

    bound_batches(docs.sparkSession)
    text = docs.withColumn("_text", F.col(text_col).cast("string"))
    return text.mapInArrow(run, plus(text, "_key", "long")).drop("_text")


@any_names
def one_of_each_component(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one row of each group of linked documents, that with the smallest doc_id; same columns.

    Only rows that a Bloom filter of the dropped ids lets through are joined. Rows whose doc_id occurs again are told apart by their sets
    of shingles, so a row goes only if it is linked with one that stays; rows without a doc_id stay.
    """
    found = materialize(_components(docs, id_col, text_col, width, num, den).select("doc_id", "key", "component", (F.col("n_shingles") == 0).alias("bare"), (F.col("component_id") == F.col("doc_id")).alias("first")))
    name = F.col(id_col).cast("long")
    gone = found.where(~F.col("first")).select(F.col("doc_id").alias("_gone")).distinct()
    twice = materialize(found.where("doc_id IS NOT NULL").groupBy("doc_id").count().where("count > 1").select(F.col("doc_id").alias("_twice")))
    if twice.isEmpty():
        return without_ids(docs, materialize(gone), id_col)
    rest = without_ids(docs, materialize(gone.unionByName(twice.select(F.col("_twice").alias("_gone"))).distinct()), id_col)
    told = found.where("NOT bare").join(twice, F.col("doc_id") == F.col("_twice"), "left_semi").select(F.col("doc_id").alias("_id"), F.col("key").alias("_set"), F.col("component").alias("_component"), F.col("first").alias("_first")).distinct()
    again = _with_set_key(docs.join(twice, name == F.col("_twice"), "left_semi"), text_col, width)
    same = (name == F.col("_id")) & (F.col("_key") == F.col("_set"))
    linked = again.join(told.where("_first"), same).groupBy("_id", "_component").agg(F.first(F.struct(*[F.col(f"`{c}`") for c in docs.columns])).alias("_row")).select("_row.*")
    return rest.unionByName(again.join(told, same, "left_anti").select(docs.columns)).unionByName(linked)
