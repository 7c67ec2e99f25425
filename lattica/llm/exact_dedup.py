"""Exact dedup: two-pass Bloom filtering.

Pass 1 hashes every text and counts, for each of ``BLOOM_HASHES`` slots of a hash, whether one or
more hashes fell there: a two-bit saturating Bloom filter. Each task merges its batches into slot lists, or
bitmaps where those are smaller; they are merged by slot range, ``FAN_IN`` tasks at a time, so nothing that a task
holds grows with the rows. Pass 2 tests each hash against the slots
that were hit twice. Rows that miss one are unique beyond doubt and pass straight through, without a
shuffle; only the other rows are grouped by their SHA-256.

The filter is the only thing broadcast. Its bits follow the row count up to ``MAX_BITS`` (64 MB, 33 million rows
at 16 bits). With more rows unique ones pass less often - all but 1.4 % at 16 bits a row, 85 % at 4, 60 % at 2,
25 % at 1 - and the others are grouped as well: the result is the same, and the cost at worst that of one
shuffle of all rows.

Defined cases: null and empty texts are equal to each other. Rows with equal text and equal doc_id
are told apart by their place, and exactly one of them stays. A null doc_id counts as smallest.
Columns beyond doc_id and text pass through untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import zlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lattica.llm.common import LOWER, U64, any_names, bound_batches, discard, free_name, materialize, mix, plus, pow2, texts, utf8

BLOOM_HASHES = 2
BITS_PER_ROW = 16
MAX_BITS = 1 << 29
RANGE_BITS = 1 << 22
#: Tasks whose slots one task merges at once, and slots that a task holds before it hands them on.
FAN_IN, HELD_SLOTS = 32, 1 << 23
#: A group with more rows, and more than one row in MOST_LARGE of all, is joined by broadcast.
LARGE_GROUP, MOST_LARGE = 1000, 10_000
_TABLE = LOWER.tobytes()


def text_digest(col: pa.Array) -> pa.Array:
    """SHA-256 of each text in UTF-8 after lower-casing A-Z only; null counts as empty."""
    raw, offsets = utf8(col)
    lowered = memoryview(raw.tobytes().translate(_TABLE))
    return pa.array([hashlib.sha256(lowered[a:b]).digest() for a, b in zip(offsets[:-1], offsets[1:], strict=True)], pa.binary())


def with_digest(docs: DataFrame, text_col: str = "text", name: str = "_digest") -> DataFrame:
    """``docs`` with the digest of its text in one more column; no shuffle."""
    def run(batches):
        for b in batches:
            yield b.append_column(name, text_digest(b.column(text_col)))

    return docs.mapInArrow(run, plus(docs, name, "binary"))


def _slots(digests: pa.Array, bits: int) -> list[np.ndarray]:
    raw, offsets = utf8(digests)
    head = raw.reshape(-1, 32)[:, :8].copy().view(U64).ravel() if len(raw) else np.zeros(0, U64)
    return [(mix(head + U64(i * 0x9E3779B9)) & U64(bits - 1)).astype(np.int64) for i in range(BLOOM_HASHES)]


def repeated_slots(digests: DataFrame, bits: int, least: int = 2) -> bytes:
    """The bits of slots that two or more digests hit (or, with ``least`` 1, any), as one bitmap of ``bits / 8`` bytes."""
    per = min(RANGE_BITS, bits)
    schema = "r long, part long, sparse boolean, blob binary"

    def packed(r: int, part: int, once: np.ndarray, twice: np.ndarray) -> dict:
        """Slots hit once or more and twice or more, as a list or as two bitmaps."""
        if 32 * len(once) < 2 * per:
            coded = once.astype(np.uint32) << np.uint32(1) | np.isin(once, twice, assume_unique=True).astype(np.uint32)
            return {"r": r, "part": part, "sparse": True, "blob": coded.tobytes()}
        both = np.zeros((2, per), bool)
        both[0, once] = both[1, twice] = True
        return {"r": r, "part": part, "sparse": False, "blob": np.packbits(both).tobytes()}

    def counted(hits: list[np.ndarray], part: int) -> pa.RecordBatch:
        slot, n = np.unique(np.concatenate(hits), return_counts=True)
        rows = []
        at = np.searchsorted(slot, np.arange(0, bits + per, per))
        for r in np.flatnonzero(np.diff(at)).tolist():
            mine, many = slot[at[r]:at[r + 1]] - r * per, n[at[r]:at[r + 1]] > 1
            rows.append(packed(r, part, mine, mine[many]))
        return pa.RecordBatch.from_pylist(rows, pa.schema({"r": pa.int64(), "part": pa.int64(), "sparse": pa.bool_(), "blob": pa.binary()}))

    def local(batches):
        part, held, n = TaskContext.get().partitionId(), [], 0
        for b in batches:
            held += _slots(b.column(0), bits)
            n += BLOOM_HASHES * b.num_rows
            if n >= HELD_SLOTS:
                yield counted(held, part)
                held, n = [], 0
        if n:
            yield counted(held, part)

    def merged(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        once, twice = np.zeros(per, bool), np.zeros(per, bool)
        for sparse, blob in zip(table.column("sparse").to_pylist(), table.column("blob"), strict=True):
            data = np.frombuffer(blob.as_py(), np.uint32 if sparse else np.uint8)
            if sparse:
                slot = data >> np.uint32(1)
                twice[slot] |= once[slot] | (data & np.uint32(1)).astype(bool)
                once[slot] = True
            else:
                hit, again = np.unpackbits(data).view(bool).reshape(2, -1)[:, :per]
                twice |= again | (once & hit)
                once |= hit
        return once, twice

    def join_parts(key, table):
        return pa.Table.from_pylist([packed(key[0].as_py(), key[1].as_py(), *map(np.flatnonzero, merged(table)))], pa.schema({"r": pa.int64(), "part": pa.int64(), "sparse": pa.bool_(), "blob": pa.binary()}))

    def finish(key, table):
        once, twice = merged(table)
        return pa.table({"r": pa.array([key[0].as_py()], pa.int64()), "bits": pa.array([zlib.compress(np.packbits(twice if least == 2 else once).tobytes(), 1)], pa.binary())})

    found, tasks = digests.mapInArrow(local, schema), digests.rdd.getNumPartitions()
    while tasks > FAN_IN:
        tasks = -(-tasks // FAN_IN)
        found = found.withColumn("part", F.floor(F.col("part") / FAN_IN).cast("long")).groupBy("r", "part").applyInArrow(join_parts, schema)
    found = found.select("r", "sparse", "blob").groupBy("r").applyInArrow(finish, "r long, bits binary")
    out = np.zeros(bits // 8 or 1, np.uint8)
    for row in found.toLocalIterator():
        part = np.frombuffer(zlib.decompress(row["bits"]), np.uint8)
        out[row["r"] * (per // 8):row["r"] * (per // 8) + len(part)] = part
    return zlib.compress(out.tobytes(), 1)


def bloom_bits(rows: int) -> int:
    return min(MAX_BITS, max(1 << 13, pow2(rows * BITS_PER_ROW)))


def _hits(digests: pa.Array, twice: np.ndarray, bits: int) -> pa.Array:
    return pa.array(reduce(np.logical_and, ((twice[s >> 3] >> (7 - (s & 7)).astype(np.uint8)) & 1 == 1 for s in _slots(digests, bits))), pa.bool_())


def _flagged(df: DataFrame, digest: str, name: str, packed, bits: int, text: str | None = None) -> DataFrame:
    """``df`` with a boolean column: the digest may occur more than once. With ``text``, the digest is made here too."""
    def run(batches):
        twice = np.frombuffer(zlib.decompress(packed.value), np.uint8)
        for b in batches:
            if text is not None:
                b = b.append_column(digest, text_digest(b.column(text)))
            yield b.append_column(name, _hits(b.column(digest), twice, bits))

    fields = df.schema if text is None else plus(df, digest, "binary")
    return df.mapInArrow(run, T.StructType([*fields.fields, T.StructField(name, T.BooleanType())]))


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256. The largest doc_id of equal texts stays.

    The text is read once and never shuffled: (doc_id, digest, place) is written to the shared folder.
    Grouping pre-aggregates by digest in each task. The winners of very large groups, a bounded number,
    are broadcast when groups are joined back; the others are joined by digest.
    """
    spark = docs.sparkSession
    slim = texts(docs, id_col, text_col)
    d = materialize(with_digest(slim).select("doc_id", "_digest").withColumn("_at", F.monotonically_increasing_id()))
    rows = d.count()
    bits = bloom_bits(rows)
    packed = spark.sparkContext.broadcast(repeated_slots(d.select("_digest"), bits))
    flagged = _flagged(d, "_digest", "_maybe", packed, bits)
    once = flagged.where(~F.col("_maybe")).select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
    more = flagged.where("_maybe")
    best = materialize(more.groupBy("_digest").agg(F.max(F.struct("doc_id", "_at")).alias("_best"), F.count(F.lit(1)).alias("group_size")))
    # groups of more than 1 in MOST_LARGE rows number MOST_LARGE at most: those are broadcast, so their rows stay where they are
    large = best.where(F.col("group_size") > max(LARGE_GROUP, rows // MOST_LARGE)).select("_digest", F.col("_best").alias("_large"), F.col("group_size").alias("_size"))
    tagged = more.join(F.broadcast(large), "_digest", "left")
    hot = tagged.where("_size IS NOT NULL").select("doc_id", "_at", "_digest", F.col("_large").alias("_best"), F.col("_size").alias("group_size"))
    rest = tagged.where("_size IS NULL").select("doc_id", "_at", "_digest").join(best, "_digest").select(*hot.columns)
    joined = hot.unionByName(rest).select(
        "doc_id", F.col("_best.doc_id").alias("keep_id"), "group_size", (F.col("_at") == F.col("_best._at")).alias("kept"), F.lower(F.hex("_digest")).alias("text_sha256"))
    return once.unionByName(joined)


def without_ids(docs: DataFrame, gone: DataFrame, id_col: str) -> DataFrame:
    """``docs`` without the rows whose id is in ``gone``, a table of one column without nulls.

    A Bloom filter of the ids, of bounded size, lets all other rows pass without a shuffle; only rows
    that may be among them are joined.
    """
    spark, key = docs.sparkSession, gone.columns[0]
    digest, maybe = free_name(docs.columns, "_digest"), free_name(docs.columns, "_maybe")

    def code(column):
        return F.unhex(F.sha2(F.coalesce(column.cast("string"), F.lit("")).cast("binary"), 256))

    bits = bloom_bits(gone.count())
    packed = spark.sparkContext.broadcast(repeated_slots(gone.select(code(F.col(key)).alias("_digest")), bits, least=1))
    flagged = _flagged(docs.withColumn(digest, code(F.col(id_col).cast("long"))), digest, maybe, packed, bits)
    rest = flagged.where(~F.col(maybe)).select(docs.columns)
    return rest.unionByName(flagged.where(maybe).select(docs.columns).join(gone, F.col(id_col).cast("long") == F.col(key), "left_anti"))


@any_names
def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each group of equal texts, that with the largest doc_id; same columns.

    Unique rows pass without a shuffle. Of the others each task first keeps its own best row per text,
    so a text that a third of all rows share moves once per task.
    """
    spark = docs.sparkSession
    digest, maybe = free_name(docs.columns, "_digest"), free_name(docs.columns, "_maybe")
    bound_batches(spark)
    only = docs.select(F.col(text_col).cast("string").alias("text"))
    hashes = materialize(with_digest(only).select("_digest"))
    bits = bloom_bits(hashes.count())
    packed = spark.sparkContext.broadcast(repeated_slots(hashes, bits))
    discard(hashes)
    flagged = _flagged(docs, digest, maybe, packed, bits, text_col)
    once = flagged.where(~F.col(maybe)).select(*[F.col(f"`{c}`") for c in docs.columns])
    best = flagged.where(maybe).groupBy(digest).agg(F.max_by(F.struct(*[F.col(f"`{c}`") for c in docs.columns]), F.struct(F.col(id_col).isNotNull(), id_col)).alias("_row")).select("_row.*")
    return once.unionByName(best)
