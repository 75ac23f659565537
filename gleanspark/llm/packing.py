"""Best-fit packing of documents into bins of a fixed capacity, in bulk-synchronous rounds.

A document's length is its number of words (or a given column). Whole multiples of the capacity are bins of their own; what
remains is packed. Documents of more than half a bin can't share one, so each opens its own. Then, in each round, documents
and gaps lie range-sorted over partitions by (size, hash). A partition sweeps its documents from long to short, each into its
gap's successor: the smallest local gap that holds it. Documents left over, ranked in their partition, are promised by
rank to gaps of the next partitions above that have some, which hold any of them; those beyond all gaps are dealt by rank over
the partitions, so that each has all lengths, and may open as many bins there as their sum needs. The changed gaps move to the
partition of their new size, and the round repeats until all documents are placed. The driver sees only counts by partition and by size, which don't grow with the data.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.llm._shared import _WS, Scratch, bounded_batches, mix, releasing, releasing_after, shuffle_partitions, steps

DOC, GAP, PLACED = 0, 1, 2
STATE = "kind int, size int, bin long, used int, doc_id {id}, piece int, part int, rank int"
#: A bin's id: the round (0: before the first), the partition that opened it, its number there.
TURN_BITS, PART_BITS, NUMBER_BITS = 10, 21, 32
NAMES = ["kind", "size", "bin", "used", "doc_id", "piece", "part", "rank"]


def first_bin(turn: int, part: int) -> int:
    if turn >> TURN_BITS or part >> PART_BITS:
        raise ValueError("more rounds or partitions than ids of bins have room for")
    return (turn << PART_BITS | part) << NUMBER_BITS


def word_count(text: Column) -> Column:
    """Runs of bytes other than ASCII white space; null for null."""

    def count(column: pa.Array) -> pa.Array:
        out = []
        for _, _, raw, offsets in steps(column):
            first = ~_WS[raw]
            inside = np.ones(len(raw), bool)
            inside[offsets[offsets < len(raw)]] = False
            first[1:] &= _WS[raw[:-1]] | ~inside[1:]
            out.append(np.diff(np.append(0, np.cumsum(first))[offsets]))
        return pa.array(np.concatenate(out) if out else np.zeros(0, np.int64), mask=np.array(column.is_null()))

    return arrow_udf(releasing_after(count), "long")(text)


class Ranges:
    """Partition of a row: cuts of the order by (size, hash) into parts of equal numbers of the first documents."""

    def __init__(self, counts: dict[int, int], capacity: int, parts: int):
        c = np.zeros(capacity + 2)
        for size, n in counts.items():
            c[size] += n
        c += max(1.0, c.sum()) / (capacity * 16)  # gaps come in all sizes
        self.upto = np.append(0, np.cumsum(c))
        self.upto *= parts / self.upto[-1]
        self.parts = parts

    def part(self, size: np.ndarray, h: np.ndarray) -> np.ndarray:
        u = (h >> np.uint64(40)).astype(np.float64) / 2**24
        return np.minimum((self.upto[size] + u * (self.upto[size + 1] - self.upto[size])).astype(np.int32), self.parts - 1)


def _row_hash(bins: np.ndarray, pieces: np.ndarray, ids: pa.Array) -> np.ndarray:
    import pyarrow.compute as pc

    i = pc.fill_null(ids.cast(pa.int64()), -1).to_numpy(zero_copy_only=False).astype(np.uint64) if pa.types.is_integer(ids.type) else np.array([hash_text(v) for v in ids.to_pylist()], np.uint64)
    return mix(i * np.uint64(0x9E3779B97F4A7C15) + bins.astype(np.uint64) * np.uint64(0xC2B2AE3D27D4EB4F) + pieces.astype(np.uint64))


def hash_text(v) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(str(v))


def _start(lengths: DataFrame, capacity: int, kind: str) -> DataFrame:
    """Pieces of documents: whole bins and documents of over half a bin placed, their gaps, and the rest."""

    def run(batches):
        number = first_bin(0, TaskContext.get().partitionId())
        for b in batches:
            n = b.column(1).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
            full, rest = n // capacity, n % capacity
            rows = np.concatenate([np.repeat(np.arange(len(n)), full), np.flatnonzero(rest)])
            piece = np.concatenate([np.arange(int(full.sum())) - np.repeat(np.cumsum(full) - full, full), full[rest > 0]])
            size = np.concatenate([np.full(int(full.sum()), capacity), rest[rest > 0]])
            opens = 2 * size > capacity
            bins = np.zeros(len(size), np.int64)
            bins[opens] = number + np.arange(int(opens.sum()))
            number += int(opens.sum())
            ids = b.column(0).take(pa.array(rows))
            part = np.full(len(size), -1)
            yield _batch(np.where(opens, PLACED, DOC), size, bins, np.zeros(len(size)), ids, piece, part, part)
            g = np.flatnonzero(opens & (size < capacity))
            if len(g):
                z = np.zeros(len(g))
                yield _batch(z + GAP, capacity - size[g], bins[g], size[g], pa.nulls(len(g), ids.type), z, z - 1, z - 1)

    return lengths.mapInArrow(releasing(run), STATE.format(id=kind))


def _batch(kind, size, bins, used, ids, piece, part, rank) -> pa.RecordBatch:
    i32 = lambda x: pa.array(np.asarray(x).astype(np.int32))
    return pa.RecordBatch.from_arrays([i32(kind), i32(size), pa.array(np.asarray(bins).astype(np.int64)), i32(used), ids, i32(piece), i32(part), i32(rank)], NAMES)


def _promises(docs: dict[int, tuple[int, int]], gaps: dict[int, int], capacity: int) -> tuple[dict[int, list[tuple[int, int, int]]], dict[int, tuple[int, int, int]], int]:
    """Where documents left over go: by part, intervals (first rank, past last, part); by part, the ranks that no gap holds and
    how many such there are before; and over how many parts these are dealt.

    docs: by part (number, sum of sizes), ranked from short to long. gaps: by part the sum of sizes of gaps left over.
    Each document goes to the nearest part above that still has room; the longest go first.
    """
    stack: list[list] = []  # [part, first rank, past last rank, mean size], the longest on top
    to: dict[int, list[tuple[int, int]]] = {}
    for p in sorted(set(docs) | set(gaps)):
        room = float(gaps.get(p, 0))
        while stack and room > 0:
            top = stack[-1]
            n = min(top[2] - top[1], max(1, int(room / max(1.0, top[3]))))
            to.setdefault(top[0], []).append((top[2] - n, top[2], p))
            top[2] -= n
            room -= n * max(1.0, top[3])
            if top[1] == top[2]:
                stack.pop()
        if p in docs:
            n, total = docs[p]
            stack.append([p, 0, n, total / n])
    total = sum((t[2] - t[1]) * t[3] for t in stack)
    beyond, before = {}, 0
    for t in stack:
        beyond[t[0]] = (t[1], t[2], before)
        before += t[2] - t[1]
    return to, beyond, max(1, int(total // (64 * capacity)))


def _route(state: DataFrame, ranges: Ranges, to: dict, beyond: dict, over: int, kind: str) -> DataFrame:
    """The part where each document and gap is swept next; rank 1 marks a document that may open a bin there."""

    def run(batches):
        for b in batches:
            b = pa.RecordBatch.from_arrays([b.column(n) for n in NAMES], NAMES)
            size, bins, piece, part, rank = (b.column(NAMES.index(n)).to_numpy() for n in ("size", "bin", "piece", "part", "rank"))
            doc = b.column(0).to_numpy() == DOC
            home = ranges.part(size, _row_hash(bins, piece, b.column(4)))
            for p in np.unique(part[doc]).tolist():
                own = doc & (part == p)
                home[own] = p if p >= 0 else home[own]
                for a, z, q in to.get(p, ()):
                    home[own & (rank >= a) & (rank < z)] = q
            first = np.zeros(len(size), np.int32)
            for p, (a, z, before) in beyond.items():
                own = doc & (part == p) & (rank >= a) & (rank < z)
                first[own] = 1
                home[own] = (rank[own] - a + before) % over
            yield pa.RecordBatch.from_arrays([*b.columns[:6], pa.array(home.astype(np.int32)), pa.array(first)], NAMES)

    return state.select(*NAMES).mapInArrow(releasing(run), STATE.format(id=kind))


def _sweep(routed: DataFrame, capacity: int, turn: int, kind: str) -> DataFrame:
    """One part's best fit: documents long to short, each into the smallest local gap that holds it."""

    def run(batches):
        tables = [pa.Table.from_batches([b]) for b in batches if b.num_rows]
        if not tables:
            return
        table = pa.concat_tables(tables)
        parts = table.column("part").to_numpy()
        for p in np.unique(parts).tolist():
            t = table.filter(pa.array(parts == p)).sort_by([("kind", "ascending"), ("size", "ascending"), ("doc_id", "ascending"), ("piece", "ascending"), ("bin", "ascending")]).combine_chunks()
            what, size, bins, used, first = (t.column(c).to_numpy() for c in ("kind", "size", "bin", "used", "rank"))
            ids, piece = t.column("doc_id").combine_chunks(), t.column("piece").to_numpy()
            docs, gaps = np.flatnonzero(what == DOC), np.flatnonzero(what == GAP)
            number = first_bin(turn, p)
            # gaps by size, of which there are at most as many as the capacity; equal ones in the order of bins
            room: dict[int, list[tuple[int, int]]] = defaultdict(list)
            for i in gaps[::-1].tolist():
                room[int(size[i])].append((int(bins[i]), int(used[i])))
            open_sizes = sorted(room)
            changed: list[tuple[int, int, int]] = []
            placed: list[tuple[int, int, int]] = []
            left: list[int] = []
            least = int(size[docs[0]]) if len(docs) else capacity + 1
            quota = -(-int(size[docs[first[docs] == 1]].sum()) // capacity)
            for i in docs[::-1].tolist():
                n = int(size[i])
                at = bisect_left(open_sizes, n)
                if at < len(open_sizes):
                    g = open_sizes[at]
                    bin_, u = room[g].pop()
                    if not room[g]:
                        del open_sizes[at]
                elif first[i] and quota:
                    g, bin_, u = capacity, number, 0
                    number += 1
                    quota -= 1
                else:
                    left.append(i)
                    continue
                placed.append((i, bin_, u))
                if g > n:
                    if g - n >= least:
                        if not room[g - n]:
                            insort(open_sizes, g - n)
                        room[g - n].append((bin_, u + n))
                    else:
                        changed.append((g - n, bin_, u + n))
            left.reverse()
            if left:
                k = np.array(left)
                yield _batch(what[k], size[k], bins[k], used[k], ids.take(pa.array(k)), piece[k], np.full(len(k), p), np.arange(len(k)))
            if placed:
                k, bin_, u = np.array(placed, np.int64).T
                yield _batch(np.full(len(k), PLACED), size[k], bin_, u, ids.take(pa.array(k)), piece[k], np.full(len(k), p), np.full(len(k), -1))
            rest = np.array([(g, *x) for g in open_sizes for x in room[g]] + changed, np.int64).reshape(-1, 3)
            if len(rest):
                z = np.zeros(len(rest))
                yield _batch(z + GAP, rest[:, 0], rest[:, 1], rest[:, 2], pa.nulls(len(rest), ids.type), z, z + p, z - 1)

    return routed.mapInArrow(releasing(run), STATE.format(id=kind))


def pack(docs: DataFrame, capacity: int = 2048, doc_id: str = "doc_id", text: str = "text", length: Column | None = None, most_rounds: int = 1000) -> DataFrame:
    """(doc_id, piece, bin, position, length): where each piece of each document lies.

    Pieces are numbered from 0; all but the last of a document fill a bin. A document whose length is null, zero or less has one
    row with bin and position null and length 0. Repeated rows and rows with a null id are packed like any other. Other columns are not read.
    No bin holds more than ``capacity``; pieces in a bin follow each other without holes. Ids of bins are unique, not dense. Texts of any
    length count whole. Documents of one length are in the order of id and piece, equal gaps in that of bins. An empty table gives an empty result.
    """
    if capacity < 1:
        raise ValueError("capacity >= 1")
    spark = docs.sparkSession
    parts = shuffle_partitions(spark)
    bounded_batches(spark)
    scratch = Scratch(spark, "packing")
    kind = docs.select(doc_id).schema[0].dataType.simpleString()
    n = word_count(F.col(text)) if length is None else length
    lengths = scratch.save(docs.select(F.col(doc_id).alias("doc_id"), n.cast("long").alias("n")))
    done = []
    state = scratch.save(_start(lengths.select("doc_id", F.greatest("n", F.lit(0)).alias("n")), capacity, kind))
    done.append(state.where(f"kind = {PLACED}"))
    ranges = None
    for turn in range(1, most_rounds):
        # at most one row a size and part; a part has few sizes, so this is bounded by sizes plus parts
        seen = state.where(f"kind < {PLACED}").groupBy("kind", "part", "size").agg(F.count("*").alias("n")).collect()
        if not any(r["kind"] == DOC for r in seen):
            break
        if ranges is None:
            ranges = Ranges({s: sum(r["n"] for r in seen if r["kind"] == DOC and r["size"] == s) for s in {r["size"] for r in seen}}, capacity, parts)
            to, beyond, over = {}, {}, 1
        else:
            left: dict[int, tuple[int, int]] = {}
            room: dict[int, int] = {}
            for r in seen:
                if r["kind"] == DOC:
                    a = left.get(r["part"], (0, 0))
                    left[r["part"]] = (a[0] + r["n"], a[1] + r["n"] * r["size"])
                else:
                    # the part of the gap's size, by shares where a size lies in several
                    lo, hi = int(ranges.upto[r["size"]]), min(parts - 1, int(np.nextafter(ranges.upto[r["size"] + 1], 0)))
                    for q in range(lo, hi + 1):
                        room[q] = room.get(q, 0) + r["n"] * r["size"] / (hi - lo + 1)
            to, beyond, over = _promises(left, room, capacity)
            over = min(over, parts)
        routed = _route(state.where(f"kind < {PLACED}"), ranges, to, beyond, over, kind)
        new = scratch.save(_sweep(routed.repartitionById(parts, F.col("part")), capacity, turn, kind))
        done.append(new.where(f"kind = {PLACED}"))
        state = new
    else:
        raise RuntimeError(f"documents are left after {most_rounds} rounds")
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    out = out.select("doc_id", "piece", "bin", F.col("used").alias("position"), F.col("size").alias("length"))
    none = lengths.where("n is null or n <= 0").select("doc_id", F.lit(0).alias("piece"), F.lit(None).cast("long").alias("bin"), F.lit(None).cast("int").alias("position"), F.lit(0).alias("length"))
    return out.unionByName(none)
