"""What the operators of this subpackage share: scratch tables, Arrow batches, word hashes."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf
from pyspark.sql.types import IntegralType

#: Bytes of text that one vectorised step takes (a longer document is one step of its own).
STEP_BYTES = 1 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where it is unset and Spark runs in one process."""
    sc = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not base:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(f"file://{tempfile.mkdtemp(prefix='shared-')}")
        base = sc.getCheckpointDir()
    return base.rstrip("/")


class Scratch:
    """Parquet tables in the shared folder: they cut lineage and outlive a lost executor."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.n = 0

    def save(self, df: DataFrame) -> DataFrame:
        self.n += 1
        path = f"{self.root}/{self.n}"
        df.write.parquet(path)
        saved = self.spark.read.schema(df.schema).parquet(path)
        saved._scratch_path = path
        return saved

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more."""
        jvm = self.spark.sparkContext._jvm
        for t in tables:
            path = jvm.org.apache.hadoop.fs.Path(t._scratch_path)
            path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bounded_batches(spark: SparkSession, most: int = 8 << 20) -> None:
    """Let an Arrow batch hold ``most`` bytes at most: JVM and Python hold a batch several times over. A lower setting of the session stays."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = int(spark.conf.get(key).rstrip("bB"))
    if now > most:
        spark.conf.set(key, str(most))


def release() -> None:
    """Hand memory that Arrow and the C library keep for later back to the system: a Python worker outlives its tasks."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL("libc.so.6").malloc_trim(0)
    except (OSError, AttributeError):
        pass  # another C library


def releasing(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """run, and ``release`` at the end of each task."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return task


def releasing_after(udf: Callable) -> Callable:
    """udf, and ``release`` after each batch."""

    def batch(*columns: pa.Array) -> pa.Array:
        out = udf(*columns)
        release()
        return out

    return batch


def is_number(docs: DataFrame, doc_id: str) -> bool:
    return isinstance(docs.schema[doc_id].dataType, IntegralType)


def number_of(docs: DataFrame, doc_id: str) -> Column:
    """An id as a long: itself where it is an integer, else a hash of its text; null for null."""
    if is_number(docs, doc_id):
        return F.col(doc_id).cast("long")
    return F.when(F.col(doc_id).isNotNull(), F.xxhash64(F.col(doc_id).cast("string")))


#: Bytes of a table that may be broadcast; a larger one is joined by a shuffle.
BROADCAST_BYTES = 32 << 20


def hinted(table: DataFrame, size: Column) -> DataFrame:
    """A written table with a broadcast hint if the sum of ``size``, bytes by row, is proved small."""
    total = table.agg(F.sum(size).alias("bytes")).first()["bytes"] or 0
    return F.broadcast(table) if total <= BROADCAST_BYTES else table


#: Slots of a table of keys, as a power of two at most; with more keys than a 64th of these, more rows pass it that needn't.
MOST_SLOTS = 28


def may_be_in(keys: DataFrame) -> Callable[[Column], Column]:
    """A condition on a 64-bit hash that holds for each of ``keys`` (one column of such hashes) and for few others.

    Executors fill a bit for each slot slice by slice; the driver gets 32 MB of bits at most.
    """
    spark, slice_bits = keys.sparkSession, 16
    bits = min(MOST_SLOTS, max(20, (64 * keys.count()).bit_length()))
    keys = keys.toDF("key")

    def fill(batches):
        slices: dict[int, np.ndarray] = {}
        for b in batches:
            slot = b.column(0).to_numpy().view(np.uint64) >> np.uint64(64 - bits)
            of = (slot >> np.uint64(slice_bits)).astype(np.int64)
            for k in np.unique(of).tolist():
                slices.setdefault(k, np.zeros(1 << slice_bits, bool))[(slot[of == k] & np.uint64((1 << slice_bits) - 1)).astype(np.int64)] = True
        for k, x in slices.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([zlib.compress(np.packbits(x, bitorder="little").tobytes(), 1)], pa.binary())], ["slice", "bits"])

    own = keys.repartition(shuffle_partitions(spark), F.shiftrightunsigned("key", 64 - bits + slice_bits))
    packed = np.zeros(1 << bits - 3, np.uint8)
    for r in own.mapInArrow(releasing(fill), "slice int, bits binary").collect():
        at = r["slice"] << slice_bits - 3
        packed[at : at + (1 << slice_bits - 3)] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8)
    held = spark.sparkContext.broadcast(packed)

    @arrow_udf("boolean")
    def may(key: pa.Array) -> pa.Array:
        slot = key.to_numpy(zero_copy_only=False).view(np.uint64) >> np.uint64(64 - bits)
        return pa.array((held.value[(slot >> np.uint64(3)).astype(np.int64)] >> (slot & np.uint64(7)).astype(np.uint8) & 1).astype(bool))

    return may


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fresh(name: str, taken: Iterable[str]) -> str:
    """name, with underscores added until no column has it."""
    low = {c.lower() for c in taken}
    while name.lower() in low:
        name += "_"
    return name


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column; a null is an empty text."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    column = column.cast(pa.large_binary())
    _, offs, data = column.buffers()
    n = len(column)
    if n == 0 or offs is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(offs, np.int64)[column.offset : column.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def steps(column: pa.Array, limit: int = STEP_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole documents of about limit bytes: (first, past last, bytes, offsets from 0)."""
    raw, offsets = bytes_of(column)
    n, lo = len(offsets) - 1, 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, "right")) - 1)
        yield lo, hi, raw[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


_WS = np.zeros(256, bool)
_WS[[9, 10, 11, 12, 13, 32]] = True
_TABLE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, np.ndarray] = {}


def powers(n: int, base: int = _BASE) -> np.ndarray:
    """base**0, base**1, ... modulo 2**64, at least n of them."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        a = np.full(max(n, STEP_BYTES + 1), base, np.uint64)
        a[0] = 1
        have = _powers[base] = np.cumprod(a, dtype=np.uint64)
    return have[:n]


_INVERSE = pow(_BASE, -1, 2**64)


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place on a copy."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def word_hashes(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words are maximal runs of bytes other than ASCII white space, within a document.

    Returns (64-bit hash, first byte, past last byte) by word and, by document, its first word (one more entry at the end).
    """
    n = len(raw)
    if n == 0:
        z = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), z, z, np.zeros(len(offsets), np.int64)
    word = ~_WS[raw]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    first = word.copy()
    first[1:] &= ~word[:-1] | edge[1:n]
    last = word.copy()
    last[:-1] &= ~word[1:] | edge[1:n]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(_TABLE[raw] * powers(n), out=total[1:])
    h = mix((total[end] - total[begin]) * powers(n, _INVERSE)[begin])
    return h, begin, end, np.searchsorted(begin, offsets)


def gram_hashes(h: np.ndarray, k: int) -> np.ndarray:
    """A hash for each run of k items of h (all of them, across documents too)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * powers(len(h)), out=total[1:])
    return mix((total[k:] - total[:-k]) * powers(len(h), _INVERSE)[:n])


def signed(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h).view(np.int64)


def binary_rows(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """Binary column whose row i is the bytes of values[offsets[i]:offsets[i+1]]."""
    values = np.ascontiguousarray(values)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64) * values.itemsize), pa.py_buffer(values)]).cast(pa.binary())


def key_runs(batches: Iterable[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """From batches sorted by key, tables that each hold all rows of their keys; small runs come together."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        if not b.num_rows:
            continue
        k = b.column(b.schema.get_field_index(key)).to_numpy(zero_copy_only=False)
        starts = np.flatnonzero(k[1:] != k[:-1]) + 1
        if held and k[0] != held[-1].column(held[-1].schema.get_field_index(key))[-1].as_py():
            starts = np.concatenate([[0], starts])
        if len(starts):
            cut = int(starts[-1])
            done = [*held, b.slice(0, cut)] if cut else held
            yield pa.Table.from_batches(done)
            held = [b.slice(cut)]
        else:
            held.append(b)
    if held:
        yield pa.Table.from_batches(held)


def sum_arrays(counts: DataFrame, slots: int, width: int = 4096) -> np.ndarray:
    """Sums over all rows of a column ``counts`` (int64 values of ``slots`` slots, as bytes), added up on executors slice by slice."""
    width = min(width, slots)

    def cut(batches):
        total = np.zeros(slots, np.int64)
        for b in batches:
            for v in b.column(0):
                total += np.frombuffer(v.as_py(), np.int64)
        at = list(range(0, slots, width))
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array([total[i : i + width].tobytes() for i in at], pa.binary())], ["slot", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(v.as_py(), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], ["slot", "counts"])

    parts = min(-(-slots // width), shuffle_partitions(counts.sparkSession))
    out = np.zeros(slots, np.int64)
    for r in counts.mapInArrow(cut, "slot int, counts binary").repartition(parts, "slot").mapInArrow(add, "slot int, counts binary").collect():
        v = np.frombuffer(r["counts"], np.int64)
        out[r["slot"] : r["slot"] + len(v)] = v
    return out


def spans(first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """first[0]..last[0]-1, first[1]..last[1]-1, ... as one array of indices."""
    n = last - first
    ends = np.cumsum(n)
    return np.repeat(first - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)


def share_first(wanted: int, n: int, *by: Column) -> Column:
    """A condition that about ``wanted`` of n rows meet, those of the least hash; all do when there are no more."""
    if n <= wanted:
        return F.lit(True)
    return F.xxhash64(*by) < F.lit(-(2**63) + wanted * 2**64 // n)
