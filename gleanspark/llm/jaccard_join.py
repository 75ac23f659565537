"""N-gram Jaccard self-join by a grouped prefix join.

A document is the set of its word n-grams (one of fewer words has one gram of all its words). A global order of the grams puts
rare ones first: by the product of their words' frequencies, and grams that are themselves frequent last. Two sets of Jaccard
similarity t or more share a gram among the first n - ceil(t n) + 1 of each (n: the set's size), their prefixes. So:

1. one pass counts words and grams in a fixed number of buckets over all documents (the order's rarity classes, 2 MB at any size);
2. documents with the same prefix and size are one group; a prefix's least gram under another hash is the group's label;
3. labels whose groups agree in any two of four more least grams at once are joined, so a large cluster of near copies is one joint
   label; which labels are joined decides about the work, not about the result;
4. groups' prefixes go to partitions by gram. Groups of one joint label are near copies as a rule and are not paired here; for
   groups of different ones that meet and pass the length filter the shared grams are counted. Two similar sets have l grams in
   common among the first n - o + l of each (o: the overlap that their sizes call for), for any l that their prefixes have room
   for. Only grams at such places count, which are the rarest, and a pair of fewer than l goes;
5. joint labels join the smallest one that a candidate pair links them to; nodes (distinct sets) of it form blocks. Each
   two blocks of one joint label are a cell, and so are two blocks of different ones with a candidate pair; a node's whole set
   is sent once to each of its cells.
   But first only bits go there, one a gram, whose differences bound those of the sets: nodes that can't be similar to any other
   of the cell stay away;
6. a cell verifies all its pairs by exact overlaps and returns, by node, how many documents are similar and a link to the
   smallest node of its component in the cell: rows grow with nodes, not with pairs.

Nothing is capped. Grams are compared as 64-bit keys (10 bits of rarity class, 54 of the gram's hash).
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.llm._shared import Scratch, binary_rows, bounded_batches, bytes_of, gram_hashes, hinted, is_number, key_runs, may_be_in, mix, number_of, releasing, shuffle_partitions, signed, steps, word_hashes

BITS = 20
BUCKETS = 1 << BITS
SLICE = 1 << 16
#: A gram's bucket is crowded beyond so many times the mean.
CROWDED = 4
#: Nodes of a block, and grams of all its nodes: two blocks' sets and their overlaps are what a task holds at once.
BLOCK = 1024
BLOCK_GRAMS = 1 << 19
#: Grams of sets that are handed on together.
MOST_GRAMS = 1 << 20
#: Postings whose pairs are looked for together.
PART_POSTINGS = 1 << 19
#: Links between labels that the driver reads to join them; beyond that, those of the largest bands. The others' groups are paired by their grams.
MOST_LINKS = 1 << 20
#: Similar sets of SEVERAL grams or more are asked for two shared grams and one more for so many grams, as far as their prefixes have
#: room: each gram asked for makes one more place count, where grams are less rare, and unlike sets hardly ever share two.
PER_GRAM = 128
SEVERAL = 16
#: Sizes are carried as whole powers of this.
STEP = 1.005
_LOW54 = np.uint64((1 << 54) - 1)
_LABEL = np.uint64(0x5851F42D4C957F2D)
_SLOT = np.uint64(0x14057B7EF767814F)
_BANDS = np.array([0x9E6C63D0876A9A63, 0xD1342543DE82EF95, 0xAF251AF3B0F025B5, 0xB564EF22EC7AECE5], np.uint64)


@dataclass
class Rarity:
    """By bucket of words, 8 log2 of their count; by bucket of grams, the same plus 1 where it is crowded, else 0."""

    words: np.ndarray
    grams: np.ndarray


def rarity_classes(docs: DataFrame, text: str, n: int) -> Rarity:
    """Counts of all documents' words and grams, added up on executors slice by slice; the driver gets 2 MB of classes."""

    def count(batches):
        totals = np.zeros((2, BUCKETS), np.int64)
        for b in batches:
            for _, _, raw, offsets in steps(b.column(0)):
                h = word_hashes(raw, offsets)[0]
                for total, x in zip(totals, (h, gram_hashes(h, n))):
                    total += np.bincount((x >> np.uint64(64 - BITS)).astype(np.int64), minlength=BUCKETS)
        flat = totals.ravel()
        at = list(range(0, len(flat), SLICE))
        yield pa.RecordBatch.from_arrays([pa.array([i // SLICE for i in at], pa.int32()), pa.array([zlib.compress(flat[i : i + SLICE].tobytes(), 1) for i in at], pa.binary())], ["slice", "counts"])

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for k, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = np.frombuffer(zlib.decompress(v.as_py()), np.int64)
                sums[k] = sums[k] + v if k in sums else v
        for k, v in sums.items():
            cls = np.minimum(254, np.floor(8 * np.log2(np.maximum(v, 1)))).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([cls.tobytes()], pa.binary()), pa.array([int(v.sum())], pa.int64())], ["slice", "classes", "total"])

    parts = min(2 * BUCKETS // SLICE, shuffle_partitions(docs.sparkSession))
    rows = docs.select(text).mapInArrow(releasing(count), "slice int, counts binary").repartition(parts, "slice").mapInArrow(releasing(add), "slice int, classes binary, total long").collect()
    out = np.zeros(2 * BUCKETS, np.uint8)
    grams = 0
    for r in rows:
        out[r["slice"] * SLICE : (r["slice"] + 1) * SLICE] = np.frombuffer(r["classes"], np.uint8)
        grams += r["total"] if r["slice"] * SLICE >= BUCKETS else 0
    words, classes = out[:BUCKETS], out[BUCKETS:]
    crowded = 8 * np.log2(max(CROWDED * grams / BUCKETS, 1e-9))
    return Rarity(words, np.where(classes > crowded, classes + 1, 0).astype(np.uint8))


def ordered_sets(raw: np.ndarray, offsets: np.ndarray, n: int, rarity: Rarity) -> Iterator[np.ndarray]:
    """The sorted distinct gram keys of each document of a step; empty without words."""
    h, _, _, first = word_hashes(raw, offsets)
    g = gram_hashes(h, n)
    keys = np.zeros(0, np.uint64)
    if len(g):
        total = np.append(0, np.cumsum(rarity.words[(h >> np.uint64(64 - BITS)).astype(np.int64)], dtype=np.int64))
        crowd = rarity.grams[(g >> np.uint64(64 - BITS)).astype(np.int64)].astype(np.int64)
        cls = np.where(crowd > 0, 512 + crowd, 2 * (total[n:] - total[:-n]) // n)
        keys = cls.astype(np.uint64) << np.uint64(54) | g & _LOW54
    for i in range(len(first) - 1):
        a, b = first[i], first[i + 1]
        if b - a >= n:
            yield np.unique(keys[a : b - n + 1])
        elif b > a:
            yield mix(np.array([xxhash.xxh64_intdigest(h[a:b].tobytes(), seed=int(b - a))], np.uint64)) & _LOW54
        else:
            yield np.zeros(0, np.uint64)


def prefix_length(n: int, t: float) -> int:
    return n - int(np.ceil(t * n - 1e-9)) + 1


def group_of(prefix: np.ndarray, size: int) -> int:
    """32 bits of label, 12 of the size's logarithm, 20 of a hash of prefix and size."""
    label = int(mix(prefix ^ _LABEL).min()) >> 32
    return label << 32 | min(4095, int(np.log(size) / np.log(STEP) + 1e-9)) << 20 | xxhash.xxh64_intdigest(prefix.tobytes(), seed=size) & 0xFFFFF


def bands_of(prefix: np.ndarray) -> list[int]:
    """32 bits of each of the prefix's least grams in four other orders, two in a number."""
    h = mix(prefix ^ _LABEL)
    least = mix(np.array([(h * a).min() for a in _BANDS], np.uint64)) >> np.uint64(32)
    return (least[::2] << np.uint64(32) | least[1::2]).view(np.int64).tolist()


def _ends(members: DataFrame) -> DataFrame:
    """(band, label): a band is two of a group's least grams, in any two of the orders: near copies agree in some, other sets hardly ever."""

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            two = b.column(1).flatten().to_numpy().view(np.uint64).reshape(b.num_rows, -1)
            least = np.stack([two >> np.uint64(32), two & np.uint64(0xFFFFFFFF)], axis=2).reshape(b.num_rows, -1)
            i, j = np.triu_indices(least.shape[1], 1)
            band = mix((least[:, i] << np.uint64(32) | least[:, j]) ^ mix(np.arange(1, len(i) + 1, dtype=np.uint64)))
            label = np.repeat(b.column(0).to_numpy() >> 32, len(i))
            order = np.lexsort((label, band.ravel()))
            band, label = signed(band.ravel()[order]), label[order]
            new = np.flatnonzero(np.concatenate([[True], (band[1:] != band[:-1]) | (label[1:] != label[:-1])]))
            yield pa.RecordBatch.from_arrays([pa.array(band[new]), pa.array(label[new])], ["band", "label"])

    return members.select("grp", "bands").mapInArrow(releasing(run), "band long, label long")


def joined_labels(members: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(labels, the smallest label that each is joined to), in the order of labels, of those labels that share a band with another."""
    # a window, so that ends are shuffled once
    band = Window.partitionBy("band")
    total = _ends(members).repartition("band").distinct().select("label", F.min("label").over(band).alias("least"), F.count("*").over(band).alias("n"))
    # the number of links is bounded for the driver's sake; the pairs of labels left out are found by their grams
    links = total.where("label != least").orderBy(F.desc("n"), "least", "label").limit(MOST_LINKS).select("label", "least").toArrow()
    a, b = (links.column(c).combine_chunks().to_numpy() for c in ("label", "least"))
    labels, number = np.unique(np.concatenate([a, b]), return_inverse=True)
    return labels, labels[smallest_reached(len(labels), number[: len(a)], number[len(a) :])]


_NO_LABELS = (np.zeros(0, np.int64), np.zeros(0, np.int64))


def joint_of(label: np.ndarray, joined: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    labels, joints = joined
    if not len(labels):
        return label
    at = np.minimum(np.searchsorted(labels, label), len(labels) - 1)
    return np.where(labels[at] == label, joints[at], label)


def parity_bits(keys: np.ndarray) -> bytes:
    """By slot of a hash, whether an odd number of keys falls there; slots are a power of two, one a key or more.

    Two sets differ in at least as many keys as their bits differ, also after the longer one's halves are combined by exclusive or.
    """
    slots = max(64, 1 << int(len(keys) - 1).bit_length())
    at = (mix(keys ^ _SLOT) & np.uint64(slots - 1)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=slots) & 1).astype(np.uint8), bitorder="little").tobytes()


def may_be_similar(bits: list[bytes], size: np.ndarray, left: np.ndarray, right: np.ndarray, t: float) -> np.ndarray:
    """Whether each left set can have similarity t with each right one, by sizes and parity bits."""
    a, b = size[left][:, None], size[right][None]
    ok = np.minimum(a, b) >= t * np.maximum(a, b) - 1e-9
    limit = (a + b) * (1 - t) / (1 + t) + 1e-6
    width = np.array([len(x) for x in bits])
    for w in np.unique(width):
        i, j = np.flatnonzero(width[left] >= w), np.flatnonzero(width[right] >= w)
        own = np.minimum(width[left[i]][:, None], width[right[j]][None]) == w
        if not (own & ok[np.ix_(i, j)]).any():
            continue
        x, y = (np.stack([np.bitwise_xor.reduce(np.frombuffer(bits[k], np.uint8).reshape(-1, w), axis=0) for k in side]) for side in (left[i], right[j]))
        differ = np.zeros((len(i), len(j)), np.float32)
        for c in range(0, int(w), 512):
            u, v = (np.unpackbits(z[:, c : c + 512], axis=1).astype(np.float32) for z in (x, y))
            differ += u.sum(axis=1)[:, None] + v.sum(axis=1)[None] - 2 * (u @ v.T)
        ok[np.ix_(i, j)] &= ~own | (differ <= limit[np.ix_(i, j)])
    return ok


def _surviving(routes: DataFrame, t: float) -> DataFrame:
    """(node, cell) of those rows (cell, block, node, size, bits) whose set may be similar to another of its cell."""

    def run(batches):
        for table in key_runs(batches, "cell"):
            table = table.combine_chunks()
            cell, block, node, size = (table.column(c).to_numpy() for c in ("cell", "block", "node", "size"))
            bits = table.column("bits")
            cuts = [*np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell)]
            keep = np.zeros(len(cell), bool)
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                if hi - lo < 2:
                    continue
                own = [x.as_py() for x in bits[lo:hi]]
                left = np.flatnonzero(block[lo:hi] == block[lo])
                right = np.flatnonzero(block[lo:hi] != block[lo])
                if len(right):
                    ok = may_be_similar(own, size[lo:hi].astype(np.float64), left, right, t)
                else:
                    right = left
                    ok = may_be_similar(own, size[lo:hi].astype(np.float64), left, left, t)
                    np.fill_diagonal(ok, False)
                keep[lo + left] |= ok.any(axis=1)
                keep[lo + right] |= ok.any(axis=0)
            at = np.flatnonzero(keep)
            if len(at):
                yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array(cell[at])], ["node", "cell"])

    return routes.mapInArrow(releasing(run), "node long, cell long")


def _signatures(docs: DataFrame, n: int, t: float, rarity) -> DataFrame:
    """By document with words: group, hash, size, parity bits and bands of its set, hash of the text."""

    def run(batches):
        for b in batches:
            at, group, whole, size, bits, bands = [], [], [], [], [], []
            for lo, _, raw, offsets in steps(b.column(2)):
                for i, k in enumerate(ordered_sets(raw, offsets, n, rarity.value), lo):
                    if len(k):
                        at.append(i)
                        prefix = k[: prefix_length(len(k), t)]
                        group.append(group_of(prefix, len(k)))
                        bands.append(bands_of(prefix))
                        whole.append(xxhash.xxh64_intdigest(k.tobytes(), seed=7))
                        size.append(len(k))
                        bits.append(parity_bits(k))
            if at:
                rows = pa.array(at)
                yield pa.RecordBatch.from_arrays([b.column(0).take(rows), b.column(1).take(rows), pa.array(signed(np.array(group, np.uint64))), pa.array(signed(np.array(whole, np.uint64))), pa.array(size, pa.int32()), pa.array(bits, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], ["doc", "th", "grp", "whole", "size", "bits", "bands"])

    return docs.mapInArrow(releasing(run), "doc long, th long, grp long, whole long, size int, bits binary, bands array<long>")


def _postings(docs: DataFrame, n: int, t: float, rarity, parts: int) -> DataFrame:
    """Postings of a batch for each partition, as one row: groups with their number of grams, then these grams (32 bits within a
    partition; a collision can only add a candidate) and their places in the prefix (256ths). A task sends a group that it remembers once."""

    def rows(groups, prefixes):
        grp = signed(np.array(groups, np.uint64))
        doc = np.repeat(np.arange(len(groups), dtype=np.int32), [len(p) for p in prefixes])
        key = mix(np.concatenate(prefixes))
        place = np.concatenate([np.arange(len(p)) * 256 // len(p) for p in prefixes]).astype(np.uint8)
        to = (key & np.uint64(0xFFFFFFFF)) % np.uint64(parts)
        order = np.argsort(to, kind="stable")
        cuts = np.searchsorted(to[order], np.arange(parts + 1, dtype=np.uint64))
        gram = (key >> np.uint64(32)).astype(np.uint32)
        for p in np.flatnonzero(np.diff(cuts)):
            own = order[cuts[p] : cuts[p + 1]]
            used, many = np.unique(doc[own], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array([p], pa.int32())] + [pa.array([x.tobytes()], pa.binary()) for x in (grp[used], many.astype(np.int32), gram[own], place[own])], ["part", "grp", "many", "gram", "place"])

    def run(batches):
        seen: set[int] = set()
        groups, prefixes, held = [], [], 0
        for b in batches:
            for _, _, raw, offsets in steps(b.column(2)):
                for k in ordered_sets(raw, offsets, n, rarity.value):
                    if len(k):
                        p = k[: prefix_length(len(k), t)]
                        g = group_of(p, len(k))
                        if g not in seen:
                            seen.add(g)
                            groups.append(g)
                            prefixes.append(p.copy())
                            held += len(p)
                if len(seen) > 1 << 18:
                    seen.clear()
                if held > 1 << 18:
                    yield from rows(groups, prefixes)
                    groups, prefixes, held = [], [], 0
        if groups:
            yield from rows(groups, prefixes)

    return docs.mapInArrow(releasing(run), "part int, grp binary, many binary, gram binary, place binary")


def size_bounds(grp):
    """(least, greatest) size of a group from its number; of numpy arrays."""
    c = (grp.view(np.uint64) >> np.uint64(20) & np.uint64(0xFFF)).astype(np.float64)
    return STEP**c - 1e-6, np.where(c < 4095, STEP ** (c + 1) + 1e-6, np.inf)


def _pairs_of_lists(gram: np.ndarray, grp: np.ndarray, t: float, most: int = 1 << 20, place: np.ndarray | None = None, joined: tuple[np.ndarray, np.ndarray] = _NO_LABELS) -> Iterator[tuple[np.ndarray, ...]]:
    """Pairs of groups of different joint labels that meet at grams and pass the length filter, and how often they met at places that count (all without place)."""
    if place is None:
        place = np.zeros(len(gram), np.uint8)
    names, number = np.unique(grp, return_inverse=True)
    label = joint_of(names >> 32, joined)
    order = np.argsort(label, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    names, label, number = names[order], label[order], rank[number]
    low, high = size_bounds(names)
    first = np.argsort(place, kind="stable")  # groups of one number may differ in places: the least counts
    key, at = np.unique(gram[first].astype(np.uint64) << np.uint64(32) | number[first].astype(np.uint64), return_index=True)
    gram, number = (key >> np.uint64(32)).astype(np.uint32), (key & np.uint64(0xFFFFFFFF)).astype(np.int64)
    place = place[first[at]] * ((1 - t) / 256) * low[number]  # a lower bound
    del key, at, first
    if not len(gram):
        return
    new = np.concatenate([[True], gram[1:] != gram[:-1]])
    run = new | np.concatenate([[True], label[number[1:]] != label[number[:-1]]])
    list_end = np.append(np.flatnonzero(new)[1:], len(gram))[np.cumsum(new) - 1]
    run_end = np.append(np.flatnonzero(run)[1:], len(gram))[np.cumsum(run) - 1]
    # each posting with those of its list that have a later label
    later = list_end - run_end
    rows = np.flatnonzero(later)
    lo, total = 0, np.cumsum(later[rows])
    while lo < len(rows):
        hi = max(lo + 1, int(np.searchsorted(total, (total[lo - 1] if lo else 0) + most, "right")))
        # a posting of a very long list alone may have more partners than a step: they are taken in steps as well
        span = int(total[hi - 1] - (total[lo - 1] if lo else 0))
        for part in range(0, span, most) if hi == lo + 1 else (0,):
            r = rows[lo:hi]
            if hi == lo + 1:
                j = np.arange(int(run_end[r[0]]) + part, min(int(run_end[r[0]]) + part + most, int(list_end[r[0]])))
                i = np.full(len(j), r[0])
            else:
                i = np.repeat(r, later[r])
                ends = np.cumsum(later[r])
                j = run_end[i] + np.arange(len(i)) - np.repeat(ends - later[r], later[r])
            a, b = number[i], number[j]
            ok = (high[a] >= t * low[b]) & (high[b] >= t * low[a])
            i, j, a, b = i[ok], j[ok], a[ok], b[ok]
            overlap = (low[a] + low[b]) * (t / (1 + t))
            small = np.minimum(low[a], low[b])
            wanted = np.maximum(1, np.minimum(np.ceil(overlap - t * np.maximum(high[a], high[b]) - 1e-3), np.where(small < SEVERAL, 1, 2 + small // PER_GRAM)))
            last = wanted - 1 - overlap + 1e-3
            ok = (place[i] <= high[a] + last) & (place[j] <= high[b] + last)
            pair, count = np.unique(a[ok] << 32 | b[ok], return_counts=True)
            yield names[pair >> 32], names[pair & 0xFFFFFFFF], count
        lo = hi


def _size_of(grp: Column, up: int) -> Column:
    return F.pow(F.lit(STEP), F.shiftrightunsigned(grp, 20).bitwiseAND(F.lit(0xFFF)) + up)


def _candidates(postings: DataFrame, t: float, joined) -> DataFrame:
    """Pairs of groups of different joint labels that share enough of their first grams."""

    def run(batches):
        parts: dict[int, tuple[list, list, list]] = {}
        for b in batches:
            part = b.column(0).to_numpy()
            for i in range(b.num_rows):
                grp, many, gram, place = (np.frombuffer(b.column(c)[i].as_buffer(), d) for c, d in ((1, np.int64), (2, np.int32), (3, np.uint32), (4, np.uint8)))
                held = parts.setdefault(int(part[i]), ([], [], []))
                for h, x in zip(held, (gram.copy(), np.repeat(grp, many), place.copy())):
                    h.append(x)
        for p in list(parts):
            gram, grp, place = (np.concatenate(x) for x in parts.pop(p))
            slices = -(-len(gram) // PART_POSTINGS)
            own = (gram % np.uint32(slices)).astype(np.uint32)
            for k in range(slices):
                at = np.flatnonzero(own == k)
                for a, b, n in _pairs_of_lists(gram[at], grp[at], t, place=place[at], joined=joined.value):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(n.astype(np.int32))], ["ga", "gb", "met"])

    met = postings.mapInArrow(releasing(run), "ga long, gb long, met int").groupBy("ga", "gb").agg(F.sum("met").alias("met"))
    # not more than _pairs_of_lists wants, whatever the rounding; the logarithm's last class has no upper bound
    a, b = F.col("ga"), F.col("gb")
    small, large = F.least(_size_of(a, 0), _size_of(b, 0)), F.greatest(_size_of(a, 1), _size_of(b, 1))
    room = (_size_of(a, 0) + _size_of(b, 0)) * (t / (1 + t)) - F.lit(t) * large
    open_end = F.greatest(_size_of(a, 0), _size_of(b, 0)) >= STEP**4095 * 0.999
    asked = F.when(small > SEVERAL + 0.5, 1 + small / PER_GRAM).otherwise(1)
    return met.where(open_end | (F.col("met") >= F.least(room, asked) - 1e-2)).select("ga", "gb")


def _overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray | None) -> np.ndarray:
    """Sizes of intersections of each left with each right set (of each two of left, without right)."""
    every = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.concatenate([[True], every[1:] != every[:-1]])
    ident = np.cumsum(new) - 1
    shared = np.bincount(ident)[ident] > 1
    ident, owner = ident[shared], owner[shared]
    if len(ident):
        ident = np.cumsum(np.concatenate([[False], ident[1:] != ident[:-1]]))
    b = left if right is None else right
    out = np.zeros((len(left), len(b)), np.float32)
    width = 4096
    for lo in range(0, int(ident[-1]) + 1 if len(ident) else 0, width):
        a, z = np.searchsorted(ident, [lo, lo + width])
        dense = np.zeros((len(sets), int(ident[z - 1]) - lo + 1), np.float32)
        dense[owner[a:z], ident[a:z] - lo] = 1
        out += dense[left] @ dense[b].T
    return out


def smallest_reached(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """By number below n, the smallest number that the undirected edges (i, j) lead to."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        new = root.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def _verify(routed: DataFrame, t: float) -> DataFrame:
    """By cell and node with similar nodes in the cell: the smallest node of its component there, and the documents that its similar nodes have."""

    def of_cell(node, block, weight, sets):
        size = np.array([len(s) for s in sets], np.float64)
        kinds = np.unique(block)
        if len(kinds) > 2:
            raise ValueError("a cell has two blocks at most")
        left = np.flatnonzero(block == kinds[0])
        right = left if len(kinds) == 1 else np.flatnonzero(block == kinds[1])
        both = _overlaps(sets, left, None if len(kinds) == 1 else right)
        similar = both >= t * (size[left][:, None] + size[right][None] - both) - 1e-6
        if len(kinds) == 1:
            np.fill_diagonal(similar, False)
        links = np.zeros(len(node), np.int64)
        # at most two blocks' documents: below 2**53, so sums in doubles are exact
        links[left] += np.rint(similar @ weight[right].astype(np.float64)).astype(np.int64)
        if len(kinds) == 2:
            links[right] += np.rint(similar.T @ weight[left].astype(np.float64)).astype(np.int64)
        i, j = np.nonzero(similar)
        return links, smallest_reached(len(node), left[i], right[j])

    def run(batches):
        for table in key_runs(batches, "cell"):
            table = table.combine_chunks()
            cell, block, node, weight = (table.column(c).to_numpy() for c in ("cell", "block", "node", "weight"))
            raw, offsets = bytes_of(table.column("grams"))
            grams, offsets = np.ascontiguousarray(raw).view(np.uint64), offsets // 8
            cuts = [*np.flatnonzero(np.concatenate([[True], cell[1:] != cell[:-1]])), len(cell)]
            found = [[], [], []]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                _, once = np.unique(node[lo:hi], return_index=True)  # in the order of nodes
                at = lo + once
                if len(at) < 2:
                    continue
                links, root = of_cell(node[at], block[at], weight[at], [grams[offsets[i] : offsets[i + 1]] for i in at])
                some = np.flatnonzero(links)
                for f, x in zip(found, (node[at[some]], node[at[root[some]]], links[some])):
                    f.append(x)
            if found[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(f).astype(np.int64)) for f in found], ["node", "least", "links"])

    return routed.mapInArrow(releasing(run), "node long, least long, links long")


def similar_nodes(docs: DataFrame, t: float = 0.7, n: int = 2, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, nodes, links): members(doc, th, node), the documents by number of the id and hash of the text; nodes(node, doc: the
    smallest, weight: how many documents); and links(node, root, links) of nodes that have similar ones: the smallest node of the
    connected component and how many documents the similar nodes have."""
    if not 0 < t <= 1 or n < 1:
        raise ValueError("0 < t <= 1 and n >= 1")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "jaccard")
    rarity = spark.sparkContext.broadcast(rarity_classes(docs, text, n))
    texts = docs.select(number_of(docs, doc_id).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("doc is not null and text is not null")
    members = scratch.save(_signatures(texts, n, t, rarity).select("doc", "th", F.xxhash64("grp", "whole", "size").alias("node"), "grp", "whole", "size", "bits", "bands").distinct())
    joined = spark.sparkContext.broadcast(joined_labels(members))

    @arrow_udf("long")
    def joint(label: pa.Array) -> pa.Array:
        return pa.array(joint_of(label.to_numpy(zero_copy_only=False), joined.value))

    def joint_label(grp: str) -> Column:
        return joint(F.shiftright(grp, 32))

    nodes = members.groupBy("node", "grp", "whole", "size").agg(F.min("bits").alias("bits"), F.count_distinct("doc").alias("weight"), F.min(F.struct("doc", "th")).alias("first"))
    nodes = scratch.save(nodes.select("node", "grp", "whole", "size", "bits", "weight", F.col("first.doc").alias("doc"), F.col("first.th").alias("th"), joint_label("grp").alias("label")))
    # of some millions of postings each: a group's number goes to few partitions, and so does a pair
    gram_parts = max(min(parts, 12), -(-parts // 8))
    found = scratch.save(_candidates(_postings(texts, n, t, rarity, gram_parts).repartitionById(gram_parts, F.col("part")), t, joined))
    # labels join the smallest label that a candidate pair links them to, so near copies under several labels share blocks
    ends = found.select(joint_label("ga").alias("x"), joint_label("gb").alias("y")).distinct()
    near = ends.unionByName(ends.select(F.col("y").alias("x"), F.col("x").alias("y"))).groupBy(F.col("x").alias("label")).agg(F.min("y").alias("other"))
    merged = scratch.save(nodes.select("node", "label", "size").join(near, "label", "left").select("node", "size", F.least("label", F.coalesce("other", "label")).alias("joint")))
    joints = merged.groupBy("joint").agg(F.count("*").alias("n"), F.sum("size").alias("grams")).where("n > 1").withColumn("subs", F.ceil(F.greatest(F.col("n") / BLOCK, F.col("grams") / BLOCK_GRAMS)))
    blocks = merged.join(joints, "joint", "left").select("node", "joint", F.coalesce("n", F.lit(1)).alias("n"), F.coalesce("subs", F.lit(1)).alias("subs"))
    blocks = blocks.withColumn("sub", F.pmod(F.xxhash64("node"), "subs")).withColumn("block", F.xxhash64("joint", "sub"))
    nodes = scratch.save(nodes.join(blocks, "node").select("node", "grp", "whole", "size", "bits", "weight", "doc", "th", "joint", "n", "subs", "sub", "block"))
    small = nodes.select("grp", "node", "block", "joint")
    crossing = (
        found.join(small.select(F.col("grp").alias("ga"), F.col("node").alias("a"), F.col("block").alias("ka"), F.col("joint").alias("ja")), "ga")
        .join(small.select(F.col("grp").alias("gb"), F.col("node").alias("b"), F.col("block").alias("kb"), F.col("joint").alias("jb")), "gb")
        .where("ja != jb")
        .select("a", "b", F.xxhash64(F.least("ka", "kb"), F.greatest("ka", "kb")).alias("cell"))
        .select(F.explode(F.array(F.struct(F.col("a").alias("node"), "cell"), F.struct(F.col("b").alias("node"), "cell"))).alias("r"))
        .select("r.node", "r.cell")
        .distinct()
    )
    with_ = F.explode(F.sequence(F.lit(0).cast("long"), F.col("subs") - 1))
    inner = nodes.where("n > 1").select("node", "joint", "sub", with_.alias("other")).select("node", F.xxhash64("joint", F.least("sub", "other"), F.greatest("sub", "other")).alias("cell"))
    # a node's cells as one list: as many as its block has blocks with a candidate
    routes = crossing.unionByName(inner).join(nodes.select("node", "block", "size", "bits"), "node").select("cell", "block", "node", "size", "bits")
    routes = _surviving(routes.repartition(parts, "cell").sortWithinPartitions("cell"), t).groupBy("node").agg(F.collect_list("cell").alias("cells"))
    wanted = scratch.save(routes.join(nodes.select("node", "block", "weight", "whole", F.col("doc").alias("own_doc"), F.col("th").alias("own_th")), "node"))

    def sets(batches):
        for b in batches:
            lists = b.column(4)
            many, flat = np.asarray(lists.value_lengths()), lists.flatten().to_numpy()
            ends = np.cumsum(many)
            whole = b.column(5).to_numpy()
            at, grams, pieces, held = [], [], [], 0
            for lo, _, raw, offsets in steps(b.column(0)):
                for i, k in enumerate(ordered_sets(raw, offsets, n, rarity.value), lo):
                    if len(k) and signed(np.array([xxhash.xxh64_intdigest(k.tobytes(), seed=7)], np.uint64))[0] == whole[i]:
                        # a set of many cells goes out in pieces of these
                        step = max(1, MOST_GRAMS // len(k))
                        for c in range(int(ends[i] - many[i]), int(ends[i]), step):
                            piece = flat[c : min(c + step, int(ends[i]))]
                            at.append(i)
                            grams.append(k)
                            pieces.append(piece)
                            held += len(k) * len(piece)
                            if held > MOST_GRAMS:
                                yield rows(b, at, grams, pieces)
                                at, grams, pieces, held = [], [], [], 0
            if at:
                yield rows(b, at, grams, pieces)

    def rows(b, at, grams, pieces):
        many = [len(p) for p in pieces]
        take = pa.array(np.repeat(at, many))
        repeated = [g for g, m in zip(grams, many) for _ in range(m)]
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(pieces)), b.column(2).take(take), b.column(1).take(take), b.column(3).take(take), binary_rows(np.concatenate(repeated), np.append(0, np.cumsum([len(g) for g in repeated])))], ["cell", "block", "node", "weight", "grams"])

    rows_of = hinted(wanted, F.lit(96) + F.size("cells") * 16)
    if rows_of is wanted:  # a shuffle: of texts that may be wanted only
        texts = texts.where(may_be_in(wanted.select(F.xxhash64("own_doc", "own_th")))(F.xxhash64("doc", "th")))
    routed = texts.join(rows_of, (F.col("doc") == F.col("own_doc")) & (F.col("th") == F.col("own_th"))).select("text", "node", "block", "weight", "cells", "whole").mapInArrow(releasing(sets), "cell long, block long, node long, weight long, grams binary")
    similar = scratch.save(_verify(routed.repartition(parts, "cell").sortWithinPartitions("cell"), t))
    scratch.drop(wanted, found, merged)
    total = similar.groupBy("node").agg(F.sum("links").alias("links"))
    roots = components(similar.select(F.col("node").alias("a"), F.col("least").alias("b")), scratch)
    links = total.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "links")
    return members.select("doc", "th", "node"), nodes.select("node", "doc", "weight"), links


def jaccard_join(docs: DataFrame, t: float = 0.7, n: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, class_id, links) by document: links is the number of other documents whose sets of word n-grams have Jaccard
    similarity t or more with this one's, class_id the smallest id that a chain of such links leads to (its own without links).

    A document without words (null, empty or white space) has class_id null and no links. A null id gives no row; repeated rows of
    an id count once; an id that has different sets is a document for each of these. Ids that aren't numbers are compared as text.
    Other columns are not read. Texts of any length count whole. An empty table gives an empty result.
    """
    members, nodes, links = similar_nodes(docs, t, n, doc_id, text)
    named = links.join(nodes, "node").select("node", "links", "root", "doc")
    least = named.groupBy("root").agg(F.min("doc").alias("class_id"))
    found = named.join(least, "root").select("node", "links", "class_id")
    by_node = nodes.join(found, "node", "left").select("node", F.coalesce("class_id", "doc").alias("class_id"), (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("links"))
    out = members.select("doc", "node").distinct().join(by_node, "node").select("doc", "class_id", "links")
    own = docs.select(number_of(docs, doc_id).alias("doc"), F.col(doc_id).alias("doc_id"), has_words(F.col(text)).alias("has")).where("doc is not null")
    none = own.where("not has").select("doc_id").distinct().select("doc_id", F.lit(None).cast(docs.schema[doc_id].dataType).alias("class_id"), F.lit(0).cast("long").alias("links"))
    if is_number(docs, doc_id):
        kind = docs.schema[doc_id].dataType
        return out.select(F.col("doc").cast(kind).alias("doc_id"), F.col("class_id").cast(kind).alias("class_id"), "links").unionByName(none)
    names = own.select("doc", "doc_id").distinct()
    out = out.join(names, "doc").join(names.select(F.col("doc").alias("class_id"), F.col("doc_id").alias("name")), "class_id")
    return out.select("doc_id", F.col("name").alias("class_id"), "links").unionByName(none)


def has_words(text: Column) -> Column:
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[ \t\n\x0B\f\r]", "")) > 0


def components(pairs: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root): the smallest node that pairs (a, b) lead to, for nodes in a pair; stars are contracted until nothing changes."""
    edges = scratch.save(pairs.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # large star: neighbours that are greater join the smallest of the neighbourhood
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.unionByName(least.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        # small star: neighbours that are smaller, and the node itself, join the smallest
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        new = scratch.save(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        changed = new.exceptAll(edges).limit(1).count() or edges.exceptAll(new).limit(1).count()
        scratch.drop(edges)
        edges = new
        if not changed:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def one_of_each(docs: DataFrame, t: float = 0.7, n: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of similar ones: that of the smallest id in the connected component.

    An id that has different texts is a document for each; of these the one of the least hash counts as the smallest.
    Rows without an id or without words stay. Of repeated rows (same id and text) that have words one stays. Ids that aren't
    numbers are in the order of a hash. An empty table stays empty.
    """
    members, _, links = similar_nodes(docs, t, n, doc_id, text)
    scratch = Scratch(docs.sparkSession, "one-of-each")
    member = members.join(links.select("node", "root"), "node", "left").select(F.coalesce("root", "node").alias("root"), F.struct("doc", "th").alias("doc"))
    least = member.groupBy("root").agg(F.min("doc").alias("keep"), F.count("*").alias("n")).where("n > 1")
    lost = scratch.save(member.join(least, "root").where("doc != keep").select(F.col("doc.doc").alias("lost_doc"), F.col("doc.th").alias("lost_th")).distinct())
    key = number_of(docs, doc_id)
    gone = (key == lost["lost_doc"]) & (F.xxhash64(text) == lost["lost_th"])
    small = hinted(lost, F.lit(32))
    if small is lost:  # a shuffle: of texts that may be lost only
        may = may_be_in(lost.select(F.xxhash64("lost_doc", "lost_th")))(F.xxhash64(key, F.xxhash64(text)))
        kept = docs.where(~may).unionByName(docs.where(may).join(lost, gone, "left_anti"))
    else:
        kept = docs.join(small, gone, "left_anti")
    twice = docs.groupBy(key.alias("twice_doc")).agg(F.count("*").alias("n")).where("n > 1 and twice_doc is not null").select("twice_doc")
    twice = scratch.save(twice)
    if twice.isEmpty():
        return kept
    again = kept.join(twice, key == twice["twice_doc"], "left_semi")
    has = has_words(F.col(text))
    return kept.join(twice, key == twice["twice_doc"], "left_anti").unionByName(again.where(~has)).unionByName(again.where(has).dropDuplicates([doc_id, text]))
