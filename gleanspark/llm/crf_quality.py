"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad. Its features are shares of character classes, word lengths and repetition, of this line and of
the lines before and after it; two neighbouring states have a learned weight as well. Forward-backward gives each line's
marginal probability of being good; weighted by the lines' lengths these make the document's quality. Training maximises
the conditional likelihood of the lines of a bounded sample of labelled documents, each line with its document's label.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.llm._shared import bounded_batches, powers, releasing, releasing_after, share_first, steps

_CLASS = np.zeros((256, 7), np.uint8)  # letters, upper case, digits, white space, sentence marks, other symbols, word starts' helper
for _b in range(256):
    _c = chr(_b)
    _letter = _b >= 128 or _c.isalpha()
    _CLASS[_b] = [_letter, "A" <= _c <= "Z", _c.isdigit(), _c in " \t\r\n\x0b\x0c", _c in ".,;:?'\"()-", not (_letter or _c.isdigit() or _c in " \t\r\n\x0b\x0c.,;:?'\"()-"), 0]
FEATURES = 14


def line_features(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features by line, bytes of each line, number of lines by document) of the lines that aren't blank."""
    n = len(raw)
    docs = len(offsets) - 1
    if n == 0:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(docs, np.int64)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    edge[1:] |= raw == 10
    cuts = np.flatnonzero(edge)
    begin, end = cuts[:-1], cuts[1:]
    if len(begin) and begin[0] != 0:
        begin, end = np.append(0, begin), np.append(begin[0], end)
    sums = np.empty((6, len(begin)), np.float32)
    for k in range(6):
        total = np.zeros(n + 1, np.int32)
        np.cumsum(_CLASS[raw, k], out=total[1:], dtype=np.int32)
        sums[k] = total[end] - total[begin]
    letters, upper, digits, white, marks, symbols = sums
    space = _CLASS[raw, 3].astype(bool)
    starts = ~space
    starts[1:] &= space[:-1] | edge[1:n]
    total = np.zeros(n + 1, np.int32)
    np.cumsum(starts, out=total[1:], dtype=np.int32)
    words = (total[end] - total[begin]).astype(np.float32)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(n), out=total[1:])
    stops = ~space
    stops[:-1] &= space[1:] | edge[1:n]
    w0, w1 = np.flatnonzero(starts), np.flatnonzero(stops) + 1
    same_word = np.zeros(len(w0), np.float32)
    mass = (total[w1] - total[w0]) * powers(n)[n - 1 - w0]
    same_word[1:] = (mass[1:] == mass[:-1]) & (w1[1:] - w0[1:] == w1[:-1] - w0[:-1])
    again = np.bincount(np.searchsorted(begin, w0, "right") - 1, weights=same_word, minlength=len(begin))
    length = (end - begin).astype(np.int64)
    content = length - white
    keep = content > 0
    begin, end, length, content, words = begin[keep], end[keep], length[keep], content[keep], words[keep]
    again = again[keep] / words
    letters, upper, digits, marks, symbols = (x[keep] for x in (letters, upper, digits, marks, symbols))
    mass = (total[end] - total[begin]) * powers(n)[n - 1 - begin]
    doc = np.searchsorted(offsets, begin, "right") - 1
    same = np.zeros(len(begin), np.float32)
    same[1:] = (mass[1:] == mass[:-1]) & (length[1:] == length[:-1]) & (doc[1:] == doc[:-1])
    x = np.empty((len(begin), FEATURES), np.float32)
    x[:, 0] = 1
    x[:, 1] = np.log1p(length) / 5
    x[:, 2] = letters / content
    x[:, 3] = upper / np.maximum(letters, 1)
    x[:, 4] = digits / content
    x[:, 5] = np.minimum(marks / content, 0.3) * 3
    x[:, 6] = np.minimum(symbols / content, 0.3) * 3
    x[:, 7] = symbols > 0.02 * content
    x[:, 8] = upper > 0.5 * np.maximum(letters, 1)
    x[:, 9] = np.minimum(content / words, 20) / 10
    x[:, 10] = np.minimum(symbols / words, 1)
    x[:, 11] = same
    x[:, 12] = again
    x[:, 13] = again > 0.25
    return x, length, np.bincount(doc, minlength=docs)


def with_neighbours(x: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """A line's features beside those of the line before and after it in the same document (zeros where there is none)."""
    out = np.zeros((len(x), 3 * FEATURES), np.float32)
    out[:, :FEATURES] = x
    if len(x):
        first = np.cumsum(lines) - lines
        inner = np.ones(len(x), bool)
        inner[first[lines > 0]] = False
        at = np.flatnonzero(inner)
        out[at, FEATURES : 2 * FEATURES] = x[at - 1]
        out[at - 1, 2 * FEATURES :] = x[at]
    return out


def forward_backward(node: np.ndarray, trans: np.ndarray, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """(probability that a line is good, expected transitions, log partition sum) of all chains.

    node: score of good over bad by line; trans[i, j]: score of state j after i (0 bad, 1 good). Chains advance together, longest first.
    """
    order = np.argsort(-lines, kind="stable")
    many = lines[order]
    first = (np.cumsum(lines) - lines)[order]
    e = np.exp(trans - trans.max())
    emit = np.stack([np.exp(-np.maximum(node, 0)), np.exp(np.minimum(node, 0))], axis=1)
    alpha, beta, scale = np.empty((len(node), 2)), np.ones((len(node), 2)), np.ones(len(node))
    longest = int(many[0]) if len(many) else 0
    active = [int(np.searchsorted(-many, -t, "left")) for t in range(longest)]
    for t in range(longest):
        at = first[: active[t]] + t
        a = emit[at] if t == 0 else (alpha[at - 1] @ e) * emit[at]
        s = a.sum(axis=1)
        alpha[at] = a / s[:, None]
        scale[at] = s
    for t in range(longest - 2, -1, -1):
        at = first[: active[t + 1]] + t
        b = (beta[at + 1] * emit[at + 1]) @ e.T
        beta[at] = b / scale[at + 1][:, None]
    good = alpha * beta
    good = good[:, 1] / good.sum(axis=1) if len(node) else np.zeros(0)
    inner = np.ones(len(node), bool)
    inner[first[many > 0]] = False
    at = np.flatnonzero(inner)
    pair = alpha[at - 1][:, :, None] * e[None] * (emit[at] * beta[at])[:, None, :] / scale[at][:, None, None]
    log_z = float(np.log(scale).sum() + np.maximum(node, 0).sum() + trans.max() * len(at))
    return good, pair.sum(axis=0), log_z


def fit(x: np.ndarray, y: np.ndarray, lines: np.ndarray, weight: np.ndarray, l2: float = 1e-3, rounds: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """(w, trans) that maximise the labelled chains' mean log likelihood per line, by Adam."""
    w, trans = np.zeros(x.shape[1]), np.zeros((2, 2))
    inner = np.ones(len(x), bool)
    inner[(np.cumsum(lines) - lines)[lines > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((2, 2))
    np.add.at(seen, (y[at - 1], y[at]), 1.0)
    n = max(1, len(x))
    m, v = np.zeros(len(w) + 4), np.zeros(len(w) + 4)
    for k in range(1, rounds + 1):
        good, pair, _ = forward_backward(x @ w, trans, lines)
        g = np.concatenate([x.T @ ((y - good) * weight), (seen - pair).ravel()]) / n - l2 * np.concatenate([w, trans.ravel()])
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        step = 0.1 * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-9)
        w, trans = w + step[: len(w)], trans + step[len(w) :].reshape(2, 2)
    return w, trans


def _all_lines(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    parts = [line_features(raw, offsets) for _, _, raw, offsets in steps(column)]
    if not parts:
        return np.zeros((0, FEATURES), np.float32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(p) for p in zip(*parts))


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = 4000) -> tuple[np.ndarray, np.ndarray]:
    """The field's weights, from about ``sample`` labelled documents: as many of each quality, those first by hash of the id; of an id's
    several rows the least text."""
    bounded_batches(docs.sparkSession)
    usable = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").alias("quality"))
    many = {r["quality"]: r["n"] for r in usable.groupBy("quality").agg(F.count("*").alias("n")).collect()}
    chosen = usable.where(F.coalesce(*[F.when(F.col("quality") == q, share_first(sample // 2, n, F.col("doc_id"))) for q, n in many.items()], F.lit(False))).select(F.col("doc_id").alias("label_of"), F.col("quality").alias("y"))

    def features(batches):
        for b in batches:
            x, _, lines = _all_lines(b.column(0))
            ends = np.cumsum(lines)
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(lines), pa.array([x[e - n : e].tobytes() for e, n in zip(ends, lines)], pa.binary())], ["y", "lines", "x"])

    # the sample is bounded by a parameter, so it may be broadcast whatever the corpus is
    rows = docs.select(F.col(doc_id).alias("label_of"), F.col(text).alias("text")).join(F.broadcast(chosen), "label_of").groupBy("label_of").agg(F.min("text").alias("text"), F.max("y").cast("int").alias("y")).select("text", "y").mapInArrow(releasing(features), "y int, lines bigint, x binary").where("lines > 0").collect()
    rows.sort(key=lambda r: (r["y"], r["lines"], bytes(r["x"])))
    if len({r["y"] for r in rows}) < 2:
        return np.zeros(3 * FEATURES), np.zeros((2, 2))
    lines = np.array([r["lines"] for r in rows])
    x = with_neighbours(np.frombuffer(b"".join(bytes(r["x"]) for r in rows), np.float32).reshape(-1, FEATURES), lines).astype(np.float64)
    y = np.repeat([r["y"] for r in rows], lines)
    return fit(x, y, lines, np.ones(len(x)))


def quality_column(text: Column, model: tuple[np.ndarray, np.ndarray]) -> Column:
    """Length-weighted mean of the lines' marginals; null without a line that isn't blank."""
    w, trans = model

    def quality(column: pa.Array) -> pa.Array:
        x, length, lines = _all_lines(column)
        good, _, _ = forward_backward(with_neighbours(x, lines) @ w, trans, lines)
        doc = np.repeat(np.arange(len(lines)), lines)
        mass = np.bincount(doc, weights=length, minlength=len(lines))
        score = np.bincount(doc, weights=good * length, minlength=len(lines)) / np.maximum(mass, 1)
        return pa.array(np.round(score, 6), mask=lines == 0)

    return arrow_udf(releasing_after(quality), "double")(text)


def score_quality(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, sample: int = 4000) -> DataFrame:
    """(doc_id, quality, keep) for every row.

    A text that is null or has only blank lines has quality null and is kept: nothing speaks against it. Repeated rows and
    rows with a null id are scored like any other. Other columns are not read. Without labelled documents of both kinds every quality is 0.5.
    Training takes about ``sample`` labelled documents; scoring takes all texts whole, of any length. An empty table gives an empty result.
    """
    q = quality_column(F.col(text), train(docs, labels, doc_id, text, sample))
    return docs.select(F.col(doc_id).alias("doc_id"), q.alias("quality")).select("doc_id", "quality", F.coalesce(F.col("quality") >= threshold, F.lit(True)).alias("keep"))


def keep_good(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.5, sample: int = 4000) -> DataFrame:
    """docs without the rows whose quality is under the threshold; nulls, empty and repeated rows as in ``score_quality``; an empty table stays empty."""
    q = quality_column(F.col(text), train(docs, labels, doc_id, text, sample))
    return docs.where(F.coalesce(q >= threshold, F.lit(True)))
