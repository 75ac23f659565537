"""Pairs of similar token sets within a group: blocks of sets meet each other, and only pairs that are similar leave a task."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Buckets in which tokens are counted: rare ones come first in a set, and any order that all sets share is right.
BUCKETS = 1 << 18
#: Tokens and sets of a block (a larger set is a block of its own); two blocks and the shared tokens of ROWS x BLOCK_SETS sets are held at once.
BLOCK_TOKENS, BLOCK_SETS, ROWS = 1 << 20, 4096, 512
#: Shared tokens that are listed at once.
PIECE = 1 << 21
_BLOCK = "group string, block long, ids binary, sizes binary, tokens binary"
_PAIR = "a long, b long, na int, nb int, k int"


def similar_sets(sets: DataFrame, group: str, doc_id: str, tokens: str) -> DataFrame:
    """(a, b, na, nb, k) of sets in one group, a < b, that have k >= (na + nb) / 3 tokens in common, which is a Jaccard similarity of 0.5.

    Empty sets have none. Tokens are compared by 64-bit hashes; ids are whole numbers. Nothing is shuffled but the blocks, once: every
    two of a group are read from there by the task that compares them, so disk grows with the input although pairs are all tried.
    """
    spark = sets.sparkSession
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if int(spark.conf.get(key).rstrip("bB")) > 8 << 20:
        spark.conf.set(key, str(8 << 20))
    hashed = sets.where(F.col(group).isNotNull()).select(F.col(group).alias("group"), F.col(doc_id).cast("long").alias("id"), F.transform(tokens, lambda t: F.xxhash64(t)).alias("t"))
    counted = hashed.select(F.explode(F.transform("t", lambda h: h.bitwiseAND(BUCKETS - 1).cast("int"))).alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n")).toArrow()
    counts = np.zeros(BUCKETS, np.int64)
    counts[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    often = spark.sparkContext.broadcast(counts)
    parts = max(4, math.isqrt(8 * spark.sparkContext.defaultParallelism) + 1)
    blocks = hashed.mapInArrow(lambda batches: _blocks(batches, often.value), _BLOCK).repartition(parts, "block")
    x, y = (blocks.select(*[F.col(c).alias(f"{c}{n}") for c in ("group", "block", "ids", "sizes", "tokens")]) for n in "xy")
    # not written as an equality, by which all blocks of a group would go to one task
    cells = x.join(y, (F.col("groupx") <= F.col("groupy")) & (F.col("groupx") >= F.col("groupy")) & (F.col("blockx") <= F.col("blocky")))
    return cells.select("blockx", "blocky", "idsx", "sizesx", "tokensx", "idsy", "sizesy", "tokensy").mapInArrow(_cells, _PAIR)


def _blocks(batches: Iterator[pa.RecordBatch], often: np.ndarray) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[int, np.ndarray]]] = {}
    size: dict[str, int] = {}
    number = TaskContext.get().partitionId() << 32

    def flush(group: str) -> pa.RecordBatch:
        nonlocal number
        rows = held.pop(group)
        del size[group]
        number += 1
        values = [np.array([i for i, _ in rows], np.int64), np.array([len(t) for _, t in rows], np.int32), np.concatenate([t for _, t in rows])]
        return pa.RecordBatch.from_arrays([pa.array([group]), pa.array([number - 1], pa.int64()), *[pa.array([v.tobytes()], pa.binary()) for v in values]], ["group", "block", "ids", "sizes", "tokens"])

    for b in batches:
        lists = b.column(2)
        flat, ends = lists.values.to_numpy(), lists.offsets.to_numpy()
        for k, (group, i) in enumerate(zip(b.column(0).to_pylist(), b.column(1).to_pylist())):
            t = flat[ends[k] : ends[k + 1]]
            if not len(t):
                continue
            if group in held and (size[group] + len(t) > BLOCK_TOKENS or len(held[group]) >= BLOCK_SETS):
                yield flush(group)
            held.setdefault(group, []).append((i, t[np.lexsort((t, often[t & (BUCKETS - 1)]))]))
            size[group] = size.get(group, 0) + len(t)
        while sum(size.values()) > 4 * BLOCK_TOKENS:
            yield flush(max(size, key=size.get))
    for group in list(held):
        yield flush(group)


class _Block:
    def __init__(self, ids: bytes, sizes: bytes, tokens: bytes):
        self.ids, self.n, self.tokens = np.frombuffer(ids, np.int64), np.frombuffer(sizes, np.int32).astype(np.int64), np.frombuffer(tokens, np.int64)
        self.start = np.cumsum(self.n) - self.n

    def prefixes(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
        """(token, number of its set) of the rarest n // 2 + 1 of each of some sets."""
        n, start = self.n[first:last], self.start[first:last]
        sets = np.repeat(np.arange(first, last), n)
        rank = np.arange(len(sets)) - np.repeat(start - start[0], n)
        keep = rank <= np.repeat(n, n) // 2
        return self.tokens[start[0] : start[0] + len(sets)][keep], sets[keep]

    def set(self, k: int) -> np.ndarray:
        return self.tokens[self.start[k] : self.start[k] + self.n[k]]


def _cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for k in range(b.num_rows):
            bx, by, *data = (b.column(j)[k].as_py() for j in range(b.num_columns))
            x = _Block(*data[:3])
            for found in _similar(x, x if bx == by else _Block(*data[3:]), bx == by):
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(found, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32()))], ["a", "b", "na", "nb", "k"])


def _similar(x: _Block, y: _Block, same: bool) -> Iterator[tuple[np.ndarray, ...]]:
    """Similar sets of two blocks. Where the rarest n // 2 + 1 of two have c in common, all have c + ceil(most / 2) - 1 at most, most being the larger size."""
    tokens, sets = y.prefixes(0, len(y.n))
    order = np.argsort(tokens, kind="stable")
    tokens, sets = tokens[order], sets[order]
    for first in range(0, len(x.n), ROWS):
        last = min(first + ROWS, len(x.n))
        t, own = x.prefixes(first, last)
        at, until = np.searchsorted(tokens, t, "left"), np.searchsorted(tokens, t, "right")
        met = until > at
        own, at, many = own[met] - first, at[met], (until - at)[met]
        shared = np.zeros((last - first) * len(y.n), np.int32)
        ends = np.cumsum(many)
        s = 0
        while s < len(many):
            done = ends[s - 1] if s else 0
            e = max(s + 1, int(np.searchsorted(ends, done + PIECE, "right")))
            m = many[s:e]
            which = np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m) + np.repeat(at[s:e], m)
            pair = np.repeat(own[s:e] * len(y.n), m) + sets[which]
            np.add.at(shared, pair, 1)
            s = e
        pair = np.flatnonzero(shared)
        i, j = pair // len(y.n) + first, pair % len(y.n)
        na, nb = x.n[i], y.n[j]
        small, large = np.minimum(na, nb), np.maximum(na, nb)
        may = (2 * small >= large) & (3 * (shared[pair] + (large + 1) // 2 - 1) >= na + nb) & ((x.ids[i] < y.ids[j]) if same else (x.ids[i] != y.ids[j]))
        i, j = i[may], j[may]
        for k in np.unique(i):
            others = j[i == k] if len(i) < 64 else j[np.searchsorted(i, k, "left") : np.searchsorted(i, k, "right")]
            mine = np.sort(x.set(k))
            for p in range(0, len(others), 1024):
                some = others[p : p + 1024]
                every, sizes = np.concatenate([y.set(o) for o in some]), y.n[some]
                hit = mine[np.minimum(np.searchsorted(mine, every), len(mine) - 1)] == every
                common = np.add.reduceat(hit, np.cumsum(sizes) - sizes, dtype=np.int64)
                ok = 3 * common >= len(mine) + sizes
                if ok.any():
                    a, b, na, nb = np.full(ok.sum(), x.ids[k]), y.ids[some][ok], np.full(ok.sum(), len(mine)), sizes[ok]
                    turn = a > b
                    yield np.where(turn, b, a), np.where(turn, a, b), np.where(turn, nb, na), np.where(turn, na, nb), common[ok]
