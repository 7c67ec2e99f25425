"""What the corpus operators share: shared-folder tables, Arrow text access, hashing of words.

Tables that cut lineage are written below ``spark.checkpoint.dir``, the folder that every executor
sees, so a lost executor never takes the only copy of a result with it.
"""

from __future__ import annotations

import functools
import math
import re
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Text bytes that a task handles as one numpy block; longer texts form blocks of their own.
BLOCK_BYTES = 1 << 19
#: Rows and bytes of one Arrow batch that a Python worker holds.
BATCH_ROWS, BATCH_BYTES = 500, 4 << 20
U64 = np.uint64


def shared_dir(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's checkpoint folder, else one below the warehouse."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
        where = tempfile.mkdtemp(prefix="lattica-")
    else:
        where = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_lattica"
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text) of a table, read in Arrow batches of bounded bytes."""
    bound_batches(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of whole texts are kept to ``BATCH_BYTES`` and ``BATCH_ROWS``, unless the session asks for less."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        now = re.fullmatch(r"(\d+)b?", spark.conf.get(f"spark.sql.execution.arrow.{key}"))
        if not now or not 0 < int(now[1]) <= most:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", str(most))


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: later stages start from there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/lattica-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lattica_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing reads them any more."""
    for t in tables:
        if path := getattr(t, "_lattica_path", None):
            jvm, conf = t.sparkSession._jvm, t.sparkSession._jsc.hadoopConfiguration()
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(conf).delete(target, True)


def spread_join(left: DataFrame, right: DataFrame, on: str, size: str, rows: int, how: str = "inner", most: int = 1000, least: int = 100) -> DataFrame:
    """``left`` with ``right``, which has one row for each value of ``on`` and, as ``size``, how often ``left`` holds it.

    Values in more than one in ``most`` of the ``rows`` of ``left`` (and in more than ``least`` rows) are fewer than
    ``most``: those are broadcast, so their rows stay where they are. The others are joined by a shuffle, in which no
    value weighs more than that.
    """
    bound = max(rows / most, least)
    hot = right.where(F.col(size) > bound)
    rest = left.join(F.broadcast(hot.select(on)), on, "left_anti").join(right.where(F.col(size) <= bound), on, how)
    return left.join(F.broadcast(hot), on).unionByName(rest)


def free_name(taken, base: str) -> str:
    """``base`` or ``base_1``, ``base_2``... - a column name that ``taken`` does not use."""
    used, name, i = {c.lower() for c in taken}, base, 0
    while name.lower() in used:
        i += 1
        name = f"{base}_{i}"
    return name


def plus(df: DataFrame, name: str, kind: str) -> T.StructType:
    """The schema of ``df`` with one more column."""
    return T.StructType([*df.schema.fields, T.StructField(name, T._parse_datatype_string(kind))])


def any_names(f):
    """Let ``f(docs, ...)``, which returns rows of ``docs``, take columns of any name, dots and clashes included."""
    @functools.wraps(f)
    def run(docs: DataFrame, *args, id_col: str = "doc_id", text_col: str = "text", **kw):
        names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
        return f(docs.toDF(*names.values()), *args, id_col=names[id_col], text_col=names[text_col], **kw).toDF(*names)

    return run


def utf8(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; nulls are empty. What Arrow still holds of batches before goes back to the system."""
    pa.default_memory_pool().release_unused()
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if col.null_count:
        col = pc.fill_null(col, "")
    large = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    offsets = np.frombuffer(col.buffers()[1], np.int64 if large else np.int32, count=len(col) + 1 + col.offset)[col.offset:].astype(np.int64) if len(col) else np.zeros(1, np.int64)
    data = col.buffers()[2] if len(col) else None
    raw = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]] if data is not None and offsets[-1] > offsets[0] else np.zeros(0, np.uint8)
    return raw, offsets - offsets[0]


def blocks(offsets: np.ndarray, most: int = BLOCK_BYTES):
    """(first row, end row) of runs of rows with about ``most`` bytes."""
    n, at = len(offsets) - 1, 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1)
        yield at, min(end, n)
        at = min(end, n)


# ---- words and hashes -------------------------------------------------------------------------

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, by doubling."""
    out = np.ones(max(n, 1), U64)
    size = 1
    while size < n:
        step = U64(pow(base, size, 1 << 64))
        out[size:2 * size] = out[:min(size, n - size)] * step
        size *= 2
    return out


_cache: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= 2 * BLOCK_BYTES:
        if "up" not in _cache:
            _cache["up"], _cache["down"] = _powers(_BASE, 2 * BLOCK_BYTES + 1), _powers(_INVERSE, 2 * BLOCK_BYTES + 1)
        return _cache["up"][:n], _cache["down"][:n]
    return _powers(_BASE, n), _powers(_INVERSE, n)


def mix(x: np.ndarray) -> np.ndarray:
    """The 64-bit finaliser of splitmix; a bijection, so it never joins two values."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def words(raw: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, first word of each row) of the words ``[^\\x20\\x09-\\x0D]+`` of a block of rows."""
    solid = ~SPACE[raw]
    first = solid.copy()
    first[1:] &= ~solid[:-1]
    last = solid.copy()
    last[:-1] &= ~solid[1:]
    inner = offsets[(offsets > 0) & (offsets < len(raw))]
    first[inner] |= solid[inner]
    last[inner - 1] |= solid[inner - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """A 64-bit hash of each word's bytes, with A-Z lower-cased: differences of one running polynomial."""
    n = len(raw)
    up, down = powers(n + 1)
    total = np.zeros(n + 1, U64)
    np.cumsum(((LOWER[raw] if lower else raw).astype(U64) + U64(1)) * up[:n], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def shingle_sets(raw: np.ndarray, offsets: np.ndarray, width: int):
    """For each row of a block, the sorted distinct hashes of its ``width``-word shingles, lower-cased.

    A row with fewer words has its whole sequence as one shingle; a row without words has none.
    """
    starts, ends, at = words(raw, offsets)
    h = word_hashes(raw, starts, ends)
    odd = [U64(pow(0xC2B2AE3D27D4EB4F, i + 1, 1 << 64)) for i in range(width)]
    rolled = np.zeros(max(0, len(h) - width + 1), U64)
    for i in range(width):
        rolled += h[i:i + len(rolled)] * odd[i]
    rolled = mix(rolled)
    for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True):
        if b - a >= width:
            yield np.unique(rolled[a:b - width + 1])
        elif b > a:
            yield mix(np.array([(sum(int(h[a + i]) * int(odd[i]) for i in range(b - a)) + 0x51ED27 * (b - a)) & 0xFFFFFFFFFFFFFFFF], U64))
        else:
            yield np.zeros(0, U64)


def in_crc(id_col: str, modulo: int, rest: int, equal: bool):
    """crc32 of the id as text, modulo ``modulo``, is (or is not) ``rest``; a null id counts as not held out."""
    held = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulo == rest, F.lit(False))
    return held if equal else ~held


def pow2(x: float) -> int:
    return 1 << max(0, math.ceil(math.log2(max(1.0, x))))
