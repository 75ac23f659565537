"""Exact range join of vectors under Euclidean distance by pivots.

Pivots are a sample of the vectors, as many as give cells of about ``cell`` vectors, chosen farthest-first. A vector's home is
the cell of its nearest pivot. If x has home p and y has home q and d(x, y) <= r, then d(x, q) <= d(x, p) + 2 r by the triangle
inequality, and x is no farther than r from the plane between p and q: (d(x, q)^2 - d(x, p)^2) / (2 d(p, q)) <= r. So x is copied
to every later cell q for which both hold, and a pair of two cells is found in the later one, once. Cells are cut into blocks,
and pairs of blocks join independently, so a crowded cell is many tasks. A task returns, by vector, how many are near and a link
to the smallest of its component there: rows grow with vectors, not with pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.llm._shared import Scratch, binary_rows, bounded_batches, bytes_of, key_runs, number_of, releasing, share_first, shuffle_partitions
from gleanspark.llm.jaccard_join import components, smallest_reached

#: Float sums may differ in the last digits: bounds are loosened by this, distances are computed in double precision.
SLACK = 1e-6


def _distances(x: np.ndarray, p: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (p * p).sum(1)[None] - 2 * x @ p.T, 0))


def choose_pivots(sample: np.ndarray, k: int) -> np.ndarray:
    """k rows of the sample, each the one farthest from those before (ties: the first)."""
    if not len(sample):
        return sample
    at = [0]
    near = _distances(sample, sample[:1])[:, 0]
    while len(at) < min(k, len(sample)):
        i = int(near.argmax())
        if near[i] <= 0:
            break
        at.append(i)
        near = np.minimum(near, _distances(sample, sample[i : i + 1])[:, 0])
    return sample[at]


def _near(x: np.ndarray, ids: np.ndarray, left: np.ndarray, right: np.ndarray, radius: float, ordered: bool):
    """(u, v) of left and right within the radius whose ids differ, step by step; ordered: only those with the lesser id first."""
    for i in range(0, len(left), 1024):
        for j in range(0, len(right), 4096):
            a, b = left[i : i + 1024], right[j : j + 4096]
            u, v = np.nonzero(_distances(x[a], x[b]) <= radius + 1e-3)
            u, v = a[u], b[v]
            keep = (ids[u] < ids[v]) if ordered else (ids[u] != ids[v])
            u, v = u[keep], v[keep]
            # the difference's own norm, some pairs at a time
            near = np.concatenate([np.sqrt(((x[u[k : k + 65536]] - x[v[k : k + 65536]]) ** 2).sum(axis=1)) for k in range(0, len(u), 65536)] or [np.zeros(0)]) <= radius
            yield u[near], v[near]


def near_vectors(base: DataFrame, dim: int, n: int, radius: float, cell: int, most_pivots: int, block: int) -> DataFrame:
    """By task and vector with near ones there: (node, least: the smallest node of its component in the task, links)."""
    spark = base.sparkSession
    parts = shuffle_partitions(spark)
    k = min(most_pivots, max(1, -(-n // cell)))
    # the sample is at most 16 vectors a pivot
    sample = sorted((r["id"], tuple(r["vec"])) for r in base.where(share_first(8 * k, n, F.col("id"))).select("id", "vec").limit(16 * k).collect())
    pivots = choose_pivots(np.array([v for _, v in sample], np.float64).reshape(-1, dim), k)
    if not len(pivots):
        pivots = np.zeros((1, dim))
    apart = np.maximum(_distances(pivots, pivots), 1e-12)
    shared = spark.sparkContext.broadcast((pivots, apart))
    blocks = max(1, -(-n // (len(pivots) * block)))

    def place(batches):
        p, between = shared.value
        for b in batches:
            for lo in range(0, b.num_rows, 2048):
                part = b.slice(lo, 2048)
                ids, node = part.column(0).to_numpy(), part.column(1)
                vec = part.column(2).flatten().to_numpy().reshape(-1, dim)
                x = vec.astype(np.float64)
                d = _distances(x, p)
                home = d.argmin(axis=1)
                own = d[np.arange(len(x)), home][:, None]
                near = (d <= own + 2 * radius + SLACK) & ((d * d - own * own) / (2 * between[home]) <= radius + SLACK) & (np.arange(len(p))[None] > home[:, None])
                near[np.arange(len(x)), home] = True
                row, to = np.nonzero(near)
                # blocks by id, the home's blocks and those of the copies apart
                of = (ids[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % blocks
                yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), pa.array(of.astype(np.int32)), pa.array(to == home[row]), pa.array(ids[row]), node.take(pa.array(row)), binary_rows(vec[row].ravel(), np.arange(len(row) + 1) * dim)], ["cell", "part", "at_home", "id", "node", "vec"])

    placed = base.mapInArrow(releasing(place), "cell int, part int, at_home boolean, id long, node long, vec binary")
    # each home block meets every block of its cell: of the cell's own blocks those not before it, and all blocks of copies
    routed = placed.withColumn("with", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    inner = F.xxhash64("cell", F.least("part", "with"), F.greatest("part", "with"), F.lit(0))
    home, copy = F.xxhash64("cell", "part", "with", F.lit(1)), F.xxhash64("cell", "with", "part", F.lit(1))
    columns = ["at_home", "part", "id", "node", "vec"]
    routed = routed.select(F.explode(F.when(F.col("at_home"), F.array(F.struct(inner.alias("task"), F.lit(True).alias("inner"), (F.col("part") == F.col("with")).alias("one")), F.struct(home.alias("task"), F.lit(False).alias("inner"), F.lit(False).alias("one")))).otherwise(F.array(F.struct(copy.alias("task"), F.lit(False).alias("inner"), F.lit(False).alias("one"))))).alias("r"), *columns)
    if len(pivots) == 1:
        routed = routed.where("r.inner")  # there are no copies
    routed = routed.select("r.task", "r.inner", "r.one", *columns)
    kind = np.dtype(np.float32 if dict(base.dtypes)["vec"] == "array<float>" else np.float64)

    def meet(batches):
        for table in key_runs(batches, "task"):
            table = table.combine_chunks()
            task, inner_, one, at_home, part, ids, node = (table.column(c).to_numpy() for c in ("task", "inner", "one", "at_home", "part", "id", "node"))
            raw, _ = bytes_of(table.column("vec"))
            vec = np.ascontiguousarray(raw).view(kind).reshape(-1, dim)
            cuts = [*np.flatnonzero(np.concatenate([[True], task[1:] != task[:-1]])), len(task)]
            out: list[list] = [[], [], []]
            for lo, hi in zip(cuts[:-1], cuts[1:]):
                _, once = np.unique(node[lo:hi], return_index=True)  # in the order of nodes; repeated rows count once
                at = lo + once
                x, own = vec[at].astype(np.float64), ids[at]
                if inner_[lo]:
                    own_part, ordered = part[at], bool(one[lo])
                    left = np.flatnonzero(own_part == own_part.min())
                    right = left if ordered else np.flatnonzero(own_part != own_part.min())
                else:
                    left, right, ordered = np.flatnonzero(at_home[at]), np.flatnonzero(~at_home[at]), False
                links, root = np.zeros(len(at), np.int64), np.arange(len(at))
                for u, v in _near(x, own, left, right, radius, ordered):
                    if len(u):
                        links += np.bincount(u, minlength=len(at)) + np.bincount(v, minlength=len(at))
                        root = smallest_reached(len(at), root[u], root[v])[root]
                some = np.flatnonzero(links)
                for f, y in zip(out, (node[at[some]], node[at[root[some]]], links[some])):
                    f.append(y)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["node", "least", "links"])

    return routed.repartition(parts, "task").sortWithinPartitions("task").mapInArrow(releasing(meet), "node long, least long, links long")


def range_join(vectors: DataFrame, radius: float, vec_id: str = "vec_id", embedding: str = "embedding", cell: int = 4096, most_pivots: int = 4096, block: int = 4096) -> DataFrame:
    """(vec_id, class_id, links) by vector: links is the number of other ids' vectors at a Euclidean distance of at most ``radius``,
    class_id the smallest id that a chain of such links leads to (its own without links).

    A vector that is null or empty or has a value that is null, NaN or infinite has class_id null and no links; a null id gives no
    row. Vectors of different lengths are never near each other. An id that comes with several vectors has a row for each; repeated
    rows are one. Ids that aren't numbers are in the order of a hash. Other columns are not read; an empty table gives an empty
    result. Pivots number at most ``most_pivots`` (then cells have more blocks).
    """
    spark = vectors.sparkSession
    bounded_batches(spark)
    scratch = Scratch(spark, "metric")
    kind = vectors.schema[vec_id].dataType
    vec = F.col(embedding) if dict(vectors.dtypes)[embedding] == "array<float>" else F.col(embedding).cast("array<double>")
    base = vectors.select(F.col(vec_id).alias("vec_id"), number_of(vectors, vec_id).alias("id"), vec.alias("vec")).where("id is not null")
    ok = F.col("vec").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    good = base.where(ok).select("vec_id", "id", F.xxhash64("id", "vec").alias("node"), "vec")
    found = None
    sizes = {r["dim"]: r["n"] for r in good.groupBy(F.size("vec").alias("dim")).agg(F.count("*").alias("n")).collect()}
    for dim, n in sorted(sizes.items()):
        near = near_vectors(good.where(F.size("vec") == dim).select("id", "node", "vec"), dim, n, radius, cell, most_pivots, block)
        found = near if found is None else found.unionByName(near)
    none = base.where(F.coalesce(~ok, F.lit(True))).select("vec_id").distinct().select("vec_id", F.lit(None).cast(kind).alias("class_id"), F.lit(0).cast("long").alias("links"))
    if found is None:
        return none
    found = scratch.save(found)
    roots = components(found.select(F.col("node").alias("a"), F.col("least").alias("b")), scratch)
    total = found.groupBy("node").agg(F.sum("links").alias("links")).join(roots, "node", "left").select("node", "links", F.coalesce("root", "node").alias("root"))
    nodes = good.select("vec_id", "id", "node").distinct()
    linked = scratch.save(nodes.join(total, "node"))
    least = linked.groupBy("root").agg(F.min(F.struct("id", "vec_id")).alias("least")).select("root", F.col("least.vec_id").alias("class_id"))
    alone = nodes.join(total, "node", "left_anti").select("vec_id", F.col("vec_id").alias("class_id"), F.lit(0).cast("long").alias("links"))
    return linked.join(least, "root").select("vec_id", "class_id", "links").unionByName(alone).unionByName(none)
