"""Repeated passages by run-length compressed indexes.

A passage is ``least`` (L) words or more; words are runs of characters other than ASCII white space.

1. Every window of L words has an anchor: its K-gram of least hash. Two equal windows have equal anchors, so a repeated passage
   shows as an anchor with several occurrences. Occurrences whose whole context (all windows that can hold the anchor) is equal
   are settled by that: all are repeats, and all but the first come again.
2. For anchors with several different contexts one occurrence of each goes, with its context's words, to a cell by anchor.
   A cell builds the Burrows-Wheeler transform of its contexts, keeps its runs, and samples the longest common prefix with the
   neighbour at run heads. Streaming over the text carries the samples on (inside a run a value is that of the position before,
   less one), which gives each position's match with the rest of the cell; long matches are marked.
3. An anchor with more than ``hot`` contexts would be one large cell: its windows are counted by hash over all tasks instead.

Marks of a document are united into ranges of words. Nothing is capped; words are compared as 32-bit hashes inside contexts of equal anchors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.llm._shared import _INVERSE, Scratch, binary_rows, bounded_batches, bytes_of, fresh, gram_hashes, hinted, is_number, key_runs, mix, number_of, powers, releasing, releasing_after, shuffle_partitions, signed, spans, steps, word_hashes

K = 10
#: Words that an index is built over at once, when several anchors' contexts share one.
INDEX_WORDS = 1 << 20


def anchors_of(h: np.ndarray, first: np.ndarray, least: int, k: int, span: int = 1 << 23) -> tuple[np.ndarray, np.ndarray]:
    """(positions of anchors among a step's words, their document); h: word hashes, first: each document's first word.

    Windows are taken ``span`` at a time, so that a position fits beside 40 bits of the hash whatever the text's length.
    """
    w = least - k + 1
    g = gram_hashes(h, k)
    low = np.uint64((1 << 24) - 1)
    if span + w > 1 << 24:
        raise ValueError("windows of over eight million words")
    # windows inside one document only
    starts = spans(first[:-1], np.maximum(first[:-1], first[1:] - least + 1))
    found = [np.zeros(0, np.int64)]
    for lo in range(0, len(g) - w + 1, span):
        own = starts[np.searchsorted(starts, lo) : np.searchsorted(starts, lo + span)] - lo
        part = g[lo : lo + span + w - 1]
        if not len(own):
            continue
        m = (part & ~low) | np.arange(len(part), dtype=np.uint64)
        size = 1
        while 2 * size <= w:
            m = np.minimum(m[:-size], m[size:])
            size *= 2
        if size < w:
            m = np.minimum(m[: len(m) - (w - size)], m[w - size :])
        found.append(lo + np.unique((m[own] & low).astype(np.int64)))
    at = np.unique(np.concatenate(found))
    return at, np.searchsorted(first, at, "right") - 1


def _occurrences(docs: DataFrame, least: int, k: int) -> DataFrame:
    """Anchors of all documents: hashes of the K-gram and of its context, place, and words of the context before and from it."""

    def run(batches):
        for b in batches:
            for lo, _, raw, offsets in steps(b.column(2)):
                h, _, _, first = word_hashes(raw, offsets)
                at, doc = anchors_of(h, first, least, k)
                if not len(at):
                    continue
                before = np.minimum(at - first[doc], least - k)
                after = np.minimum(first[doc + 1] - at, least)
                total = np.zeros(len(h) + 1, np.uint64)
                np.cumsum(h * powers(len(h)), out=total[1:])
                ctx = mix((total[at + after] - total[at - before]) * powers(len(h), _INVERSE)[at - before] + before.astype(np.uint64) * np.uint64(1 << 20) + after.astype(np.uint64))
                rows = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(signed(gram_hashes(h, k)[at])), pa.array(signed(ctx)), b.column(0).take(rows), b.column(1).take(rows), pa.array((at - first[doc]).astype(np.int32)), pa.array(before.astype(np.int32)), pa.array(after.astype(np.int32))],
                    ["anchor", "ctx", "doc", "th", "pos", "before", "after"],
                )

    return docs.mapInArrow(releasing(run), "anchor long, ctx long, doc long, th long, pos int, before int, after int")


def _shared(occurrences: DataFrame, parts: int, hot: int) -> DataFrame:
    """Occurrences of anchors that have several: settled is 0 if their context is alone, 1 for the first of equal contexts, 2 for the
    others; index is 0, or 1 for those to look up in a cell, 2 if the anchor is hot."""

    def run(batches):
        for t in key_runs(batches, "anchor"):
            t = t.combine_chunks()
            c = {n: t.column(n).to_numpy() for n in t.column_names}
            new = np.ones(len(t), bool)
            new[1:] = np.any([c[n][1:] != c[n][:-1] for n in ("anchor", "ctx", "doc", "th", "pos")], axis=0)
            c = {n: x[new] for n, x in c.items()}
            a_new = np.concatenate([[True], c["anchor"][1:] != c["anchor"][:-1]])
            c_new = a_new | np.concatenate([[True], c["ctx"][1:] != c["ctx"][:-1]])
            of_a, of_c = np.cumsum(a_new) - 1, np.cumsum(c_new) - 1
            many = np.bincount(of_c)[of_c]
            kinds = np.bincount(of_a[c_new])[of_a]
            settled = np.where(many == 1, 0, np.where(c_new, 1, 2))
            index = np.where(c_new & (kinds > 1), np.where(kinds > hot, 2, 1), 0)
            keep = (settled > 0) | (index > 0)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(c[n][keep]) for n in ("anchor", "doc", "th", "pos", "before", "after")] + [pa.array(settled[keep].astype(np.int8)), pa.array(index[keep].astype(np.int8))], ["anchor", "doc", "th", "pos", "before", "after", "settled", "index"])

    rows = occurrences.repartition(parts, "anchor").sortWithinPartitions("anchor", "ctx", "doc", "th", "pos")
    return rows.mapInArrow(releasing(run), "anchor long, doc long, th long, pos int, before int, after int, settled byte, index byte")


class RunIndex:
    """Run-length Burrows-Wheeler index of sequences of words, each followed by an end of its own.

    ``heads``: first ranks of the runs; ``samples``: text position and longest common prefix with the rank before, at each head.
    """

    def __init__(self, words: np.ndarray, ends: np.ndarray):
        n = len(words)
        end = np.zeros(n, bool)
        end[ends] = True
        ids = np.zeros(n, np.int64)
        ids[~end] = np.unique(words[~end], return_inverse=True)[1] + len(ends)
        ids[end] = np.arange(len(ends))
        levels, rank, size = [ids], ids, 1
        longest = int(np.diff(np.append(-1, ends)).max())
        while size < longest:
            pair = np.zeros(n, np.int64)
            pair[: n - size] = rank[size:] + 1
            key = rank * (int(rank.max()) + 2) + pair
            order = np.argsort(key, kind="stable")
            new = np.concatenate([[False], key[order[1:]] != key[order[:-1]]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            size *= 2
            if new.sum() == n - 1:
                break
            levels.append(rank)
        self.sa = np.argsort(rank, kind="stable")
        before = ids[self.sa - 1]
        before[self.sa == 0] = -1
        self.heads = np.flatnonzero(np.concatenate([[True], before[1:] != before[:-1]]))
        # longest common prefixes at the heads, from the ranks of prefixes of 2^j words
        i = self.sa[self.heads]
        j = self.sa[np.maximum(self.heads - 1, 0)]
        lcp = np.zeros(len(i), np.int64)
        for level in range(len(levels) - 1, -1, -1):
            for _ in range(2 if level == len(levels) - 1 else 1):
                a, b = i + lcp, j + lcp
                ok = (a < n) & (b < n)
                ok[ok] = levels[level][a[ok]] == levels[level][b[ok]]
                lcp[ok] += 1 << level
        lcp[self.heads == 0] = 0
        self.samples = (i, lcp)
        self.n = n

    def stream(self) -> np.ndarray:
        """By text position, the longest common prefix of its suffix with the one ranked before: a sample, or one less than the position before."""
        at = np.zeros(self.n, np.int64)
        value = np.zeros(self.n, np.int64)
        at[self.samples[0]] = self.samples[0]
        value[self.samples[0]] = self.samples[1]
        last = np.maximum.accumulate(at)
        return value[last] - (np.arange(self.n) - last)

    def groups(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """(text positions in rank order, group number): positions of one group share their first ``least`` words."""
        return self.sa, np.cumsum(self.stream()[self.sa] < least)


def _marks_of(words: np.ndarray, offsets: np.ndarray, place: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(context, window's first word in it, whether it came before) of windows that occur at several places.

    place: of each context's first word; places of different documents lie apart, in the documents' order.
    """
    n = np.diff(offsets)
    text = np.zeros(len(words) + len(n), np.uint32)
    owner = np.repeat(np.arange(len(n)), n)
    text[np.arange(len(words)) + owner] = words
    ends = offsets[1:] + np.arange(len(n))
    index = RunIndex(text, ends)
    sa, group = index.groups(least)
    of = np.searchsorted(ends, sa)
    within = sa - (ends - n)[of]
    at = place[of] + within
    order = np.argsort(group, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], group[order][1:] != group[order][:-1]]))
    low, high = np.minimum.reduceat(at[order], starts), np.maximum.reduceat(at[order], starts)
    g = np.cumsum(np.concatenate([[False], group[order][1:] != group[order][:-1]]))
    again = low[g] != high[g]
    rows = order[again]
    return of[rows], within[rows], at[rows] != low[g][again]


def _fetch(docs: DataFrame, wanted: DataFrame, parts: int, least: int) -> DataFrame:
    """Context words of the occurrences to look up; for hot anchors the hashes of their windows."""
    lists = wanted.groupBy("doc", "th").agg(F.collect_list(F.struct("anchor", "pos", "before", "after", "index")).alias("at"))

    def run(batches):
        for b in batches:
            at = b.column(3)
            rows = np.asarray(at.value_lengths())
            flat = at.flatten()
            f = {n: flat.field(n).to_numpy() for n in ("anchor", "pos", "before", "after", "index")}
            ends = np.cumsum(rows)
            for lo, hi, raw, offsets in steps(b.column(2)):
                h, _, _, first = word_hashes(raw, offsets)
                mine = slice(int(ends[lo] - rows[lo]), int(ends[hi - 1]))
                doc = np.repeat(np.arange(hi - lo), rows[lo:hi])
                pos, before, after = f["pos"][mine].astype(np.int64), f["before"][mine].astype(np.int64), f["after"][mine].astype(np.int64)
                a = first[doc] + pos - before
                n = before + after
                words = (h >> np.uint64(32)).astype(np.uint32)[spans(a, a + n)]
                take = pa.array(lo + doc)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(f["anchor"][mine]), b.column(0).take(take), b.column(1).take(take), pa.array((pos - before).astype(np.int32)), binary_rows(words, np.append(0, np.cumsum(n))), pa.array(f["index"][mine])], ["anchor", "doc", "th", "start", "words", "index"]
                )

    once = docs.join(lists, ["doc", "th"]).select("doc", "th", "text", "at")
    return once.mapInArrow(releasing(run), "anchor long, doc long, th long, start int, words binary, index byte")


def _cells(contexts: DataFrame, parts: int, least: int) -> DataFrame:
    """Marks (doc, th, begin, end, again) from the indexes."""

    def index(tables):
        t = pa.concat_tables(tables).combine_chunks()
        doc, th, start = (t.column(c).to_numpy() for c in ("doc", "th", "start"))
        raw, offsets = bytes_of(t.column("words"))
        words, offsets = np.ascontiguousarray(raw).view(np.uint32), offsets // 4
        order = np.lexsort((th, doc))
        new = np.concatenate([[False], (doc[order][1:] != doc[order][:-1]) | (th[order][1:] != th[order][:-1])])
        rank = np.empty(len(doc), np.int64)
        rank[order] = np.cumsum(new)
        of, at, again = _marks_of(words, offsets, (rank << 32) + start, least)
        if not len(of):
            return None
        # windows that follow each other in a context are one mark
        out = []
        for later in (False, True):
            keep = np.ones(len(of), bool) if not later else again
            key = np.unique((of[keep] << 32) + at[keep])
            if not len(key):
                continue
            cut = np.concatenate([[True], key[1:] != key[:-1] + 1])
            a, z = key[cut], key[np.append(np.flatnonzero(cut)[1:] - 1, len(key) - 1)]
            c = a >> 32
            out.append((doc[c], th[c], start[c] + (a & 0xFFFFFFFF), start[c] + (z & 0xFFFFFFFF) + least, np.full(len(c), later)))
        cols = [np.concatenate(x) for x in zip(*out)]
        return pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(np.int32)), pa.array(cols[4])], ["doc", "th", "begin", "end", "again"])

    def run(batches):
        held, size = [], 0
        for t in key_runs(batches, "anchor"):
            n = t.column("words").nbytes // 4
            if held and size + n > INDEX_WORDS:
                if (r := index(held)) is not None:
                    yield r
                held, size = [], 0
            held.append(t)
            size += n
        if held and (r := index(held)) is not None:
            yield r

    rows = contexts.repartition(parts, "anchor").sortWithinPartitions("anchor", "doc", "th", "start")
    return rows.mapInArrow(releasing(run), "doc long, th long, begin int, end int, again boolean")


def _hot(contexts: DataFrame, least: int) -> DataFrame:
    """Marks of hot anchors' contexts by counting the hashes of their windows."""

    def run(batches):
        for b in batches:
            raw, offsets = bytes_of(b.column(3))
            h = mix(np.ascontiguousarray(raw).view(np.uint32).astype(np.uint64) + np.uint64(1))
            offsets = offsets // 4
            n = np.maximum(0, np.diff(offsets) - least + 1)
            at = spans(offsets[:-1], offsets[:-1] + n)
            row = np.repeat(np.arange(len(n)), n)
            take = pa.array(row)
            yield pa.RecordBatch.from_arrays([pa.array(signed(gram_hashes(h, least)[at])), b.column(0).take(take), b.column(1).take(take), pa.array((b.column(2).to_numpy()[row] + at - offsets[row]).astype(np.int32))], ["window", "doc", "th", "begin"])

    w = contexts.select("doc", "th", "start", "words").mapInArrow(releasing(run), "window long, doc long, th long, begin int")
    place = F.struct("doc", "th", "begin")
    ends = w.groupBy("window").agg(F.min(place).alias("low"), F.max(place).alias("high")).where("low != high").select("window", "low")
    marks = w.join(ends, "window").select("doc", "th", "begin", (F.col("begin") + least).alias("end"), (place != F.col("low")).alias("again"))
    return marks.select("doc", "th", "begin", "end", F.lit(False).alias("again")).unionByName(marks.where("again"))


def _united(marks: DataFrame, parts: int) -> DataFrame:
    """Overlapping and adjoining marks of a kind as one range."""

    def run(batches):
        for t in key_runs(batches, "doc"):
            t = t.combine_chunks()
            doc, th, again, begin, end = (t.column(c).to_numpy() for c in ("doc", "th", "again", "begin", "end"))
            new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (th[1:] != th[:-1]) | (again[1:] != again[:-1])])
            base = (np.cumsum(new) - 1) << 34
            a, z = base + begin, np.maximum.accumulate(base + end)
            cut = np.concatenate([[True], a[1:] > z[:-1]])
            i = np.flatnonzero(cut)
            last = np.append(i[1:] - 1, len(doc) - 1)
            yield pa.RecordBatch.from_arrays([pa.array(doc[i]), pa.array(th[i]), pa.array(again[i]), pa.array(begin[i]), pa.array((z[last] - base[i]).astype(np.int32))], ["doc", "th", "again", "begin", "end"])

    rows = marks.repartition(parts, "doc").sortWithinPartitions("doc", "th", "again", "begin", "end")
    return rows.mapInArrow(releasing(run), "doc long, th long, again boolean, begin int, end int")


def _ranges(docs: DataFrame, least: int, k: int, hot: int, doc_id: str, text: str) -> DataFrame:
    if not 1 <= k <= least:
        raise ValueError("1 <= k <= least")
    spark = docs.sparkSession
    bounded_batches(spark)
    parts = shuffle_partitions(spark)
    scratch = Scratch(spark, "repeats")
    texts = docs.select(number_of(docs, doc_id).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text")).where("doc is not null and text is not null")
    shared = scratch.save(_shared(_occurrences(texts, least, k), parts, hot))
    whole = shared.where("settled > 0 and before + after >= " + str(least)).select("doc", "th", (F.col("pos") - F.col("before")).alias("begin"), (F.col("pos") + F.col("after")).alias("end"), "settled")
    marks = whole.select("doc", "th", "begin", "end", F.lit(False).alias("again")).unionByName(whole.where("settled = 2").select("doc", "th", "begin", "end", F.lit(True).alias("again")))
    contexts = _fetch(texts, shared.where("index > 0").select("doc", "th", "anchor", "pos", "before", "after", "index"), parts, least)
    if shared.where("index = 2").limit(1).count():
        contexts = scratch.save(contexts)
        marks = marks.unionByName(_hot(contexts.where("index = 2"), least))
        contexts = contexts.where("index = 1")
    marks = marks.unionByName(_cells(contexts, parts, least))
    return scratch.save(_united(marks, parts))


def repeated_passages(docs: DataFrame, least: int = 50, k: int = K, hot: int = 16384, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, begin, end, again): ranges of words, from 0, that windows of ``least`` words cover which occur at several places.

    again false: the windows occur elsewhere in the corpus (in another document or in this one). again true: those windows
    occur before, in a document of smaller id or earlier in this one; these ranges lie in those of again false. Ranges of a kind
    don't touch. A null or empty text, or one of fewer words, has no ranges, nor has a row without id; repeated rows (same id and
    text) are one document, the same id with other texts others, in the order of a hash. An id that isn't a number counts as a hash
    of it, in whose order documents come before each other, and is given back. Texts of any length count whole. An empty table gives
    an empty result. Other columns are not read.
    """
    if not is_number(docs, doc_id):
        names = docs.select(number_of(docs, doc_id).alias("doc"), F.col(doc_id).alias("doc_id")).where("doc is not null").distinct()
        return _ranges(docs, least, k, hot, doc_id, text).join(names, "doc").select("doc_id", F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "again")
    return _ranges(docs, least, k, hot, doc_id, text).select(F.col("doc").alias("doc_id"), F.col("begin").cast("long").alias("begin"), F.col("end").cast("long").alias("end"), "again")


def _cut(text: Column, ranges: Column) -> Column:
    """The text without ranges of words and the white space after them."""

    def cut(texts: pa.Array, lists: pa.Array) -> pa.Array:
        out = texts.to_pylist()
        wanted = lists.to_pylist()
        for lo, hi, raw, offsets in steps(texts):
            some = [i for i in range(lo, hi) if wanted[i] and out[i] is not None]
            if not some:
                continue
            _, begin, _, first = word_hashes(raw, offsets)
            for i in some:
                d = i - lo
                starts = np.append(begin[first[d] : first[d + 1]], offsets[d + 1])
                keep, at = [], int(offsets[d])
                for r in wanted[i]:
                    keep.append(raw[at : starts[r["begin"]]].tobytes())
                    at = int(starts[r["end"]])
                out[i] = b"".join([*keep, raw[at : offsets[d + 1]].tobytes()]).decode()
        return pa.array(out, pa.string())

    return arrow_udf(releasing_after(cut), "string")(text, ranges)


def remove_repeats(docs: DataFrame, least: int = 50, k: int = K, hot: int = 16384, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars") -> DataFrame:
    """docs whose texts lack the ranges that come again (the first occurrence stays), and without the rows of which no word is left.

    ``n_chars``, where there is such a column, is counted anew for changed texts. Rows without id, without text or without repeats stay as they are;
    repeated rows of a document stay and are cut alike. An empty table stays empty.
    """
    own, hash_, list_ = (fresh(n, docs.columns) for n in ("own_doc", "own_hash", "own_list"))
    scratch = Scratch(docs.sparkSession, "cuts")
    cuts = scratch.save(_ranges(docs, least, k, hot, doc_id, text).where("again").groupBy(F.col("doc").alias(own), F.col("th").alias(hash_)).agg(F.sort_array(F.collect_list(F.struct("begin", "end"))).alias(list_)))
    cuts = hinted(cuts, F.lit(64) + F.size(list_) * 32)
    keyed = docs.withColumn(own, number_of(docs, doc_id)).withColumn(hash_, F.xxhash64(text))
    joined = keyed.join(cuts, [own, hash_], "left").withColumn(text, _cut(F.col(text), F.col(list_)))
    joined = joined.where(F.col(list_).isNull() | (F.length(F.regexp_replace(F.col(text), r"[ \t\n\x0B\f\r]", "")) > 0))
    if n_chars in docs.columns:
        joined = joined.withColumn(n_chars, F.when(F.col(list_).isNull(), F.col(n_chars)).otherwise(F.length(text)).cast(docs.schema[n_chars].dataType))
    return joined.select(*docs.columns)
