"""Language identification by sparse multinomial logistic regression on TF-IDF character n-grams.

n-grams of 1 to 3 code points of the lower-cased text fall into hashed slots. Document frequencies are counted over all
documents. The weights come from follow-the-regularised-leader with elastic-net penalties over a bounded sample of
labelled rows by label, so most are exactly zero; a temperature fitted on held-out rows of that sample calibrates the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.llm._shared import bounded_batches, releasing, releasing_after, sum_arrays

BITS = 14
SLOTS = 1 << BITS
_MUL = [np.uint64(m) for m in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
GROUP = 64


def slots_of(text: str) -> np.ndarray:
    """The slot of every n-gram occurrence of a text."""
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64) + np.uint64(1)
    shift = np.uint64(64 - BITS)
    out, h = [], np.zeros(len(c), np.uint64)
    for n in range(1, 4):
        if len(c) < n:
            break
        h = (h[: len(c) - n + 1] + c[n - 1 :]) * _MUL[n - 1]
        out.append(((h ^ (h >> np.uint64(29))) * _MUL[0]) >> shift)
    return np.concatenate(out).astype(np.int64) if out else np.zeros(0, np.int64)


def counts_of(texts: list[str | None]) -> np.ndarray:
    """Counts of slots, a row for each text."""
    lists = [slots_of(t) if t else np.zeros(0, np.int64) for t in texts]
    base = np.repeat(np.arange(len(lists)) * SLOTS, [len(x) for x in lists])
    return np.bincount(np.concatenate(lists) + base if lists else base, minlength=len(texts) * SLOTS).reshape(len(texts), SLOTS)


@dataclass
class Model:
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    langs: list[str]
    temperature: float

    def logits(self, counts: np.ndarray) -> np.ndarray:
        x = counts * self.idf
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        return (x @ self.weights) / np.maximum(norm, 1e-9) + self.bias

    def predict(self, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        p = softmax(self.logits(counts) / self.temperature)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(p)), best]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def document_frequencies(docs: DataFrame, text: str) -> tuple[np.ndarray, int]:
    """By slot, how many documents have an n-gram there; and the number of documents. All documents count."""

    def run(batches):
        total = np.zeros(SLOTS + 1, np.int64)
        for b in batches:
            texts = b.column(0).to_pylist()
            for i in range(0, len(texts), GROUP):
                x = counts_of(texts[i : i + GROUP])
                total[:-1] += (x > 0).sum(axis=0)
            total[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    found = sum_arrays(docs.select(F.col(text)).mapInArrow(releasing(run), "counts binary"), SLOTS + 1)
    return found[:-1], int(found[-1])


def ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.05, epochs: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias from (slots, values, class) rows by per-coordinate FTRL-proximal with elastic net."""
    z, n = np.zeros((SLOTS + 1, classes)), np.zeros((SLOTS + 1, classes))

    def weights(z, n):
        w = -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2)
        return np.where(np.abs(z) > l1, w, 0.0)

    order = np.random.Generator(np.random.PCG64(7))
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            at, x, y = rows[k]
            at, x = np.append(at, SLOTS), np.append(x, 1.0)
            w = weights(z[at], n[at])
            p = softmax((x @ w)[None])[0]
            p[y] -= 1
            g = x[:, None] * p[None]
            old = n[at]
            new = old + g * g
            z[at] += g - (np.sqrt(new) - np.sqrt(old)) / alpha * w
            n[at] = new
    w = weights(z, n)
    return w[:-1], w[-1]


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature of least negative log likelihood, between 0.02 and 20, by golden-section search on its logarithm."""
    if not len(y):
        return 1.0
    loss = lambda s: -np.log(np.maximum(softmax(logits / np.exp(s))[np.arange(len(y)), y], 1e-12)).mean()
    lo, hi, r = np.log(0.02), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - r * (hi - lo), lo + r * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def _limits(labels: dict[str, tuple[int, int]], sample: int) -> dict[str, int]:
    """By label the greatest hash of the rows that train, from its (rows, least hash): what small labels don't use the others share."""
    out, left = {}, sample
    for k, (name, (n, least)) in enumerate(sorted(labels.items(), key=lambda x: (x[1], x[0]))):
        wanted = min(n, max(1, left // (len(labels) - k)))
        left -= wanted
        out[name] = 2**63 - 1 if wanted == n else max(least, -(2**63) + wanted * 2**64 // n)
    return out


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000) -> Model:
    """A model from about ``sample`` labelled rows and the document frequencies of all rows.

    Each label gives as many rows (those first by hash of id and text), or all it has; one at least, so every label is a class.
    """
    bounded_batches(docs.sparkSession)
    df, total = document_frequencies(docs, text)
    idf = (np.log((1 + total) / (1 + df)) + 1).astype(np.float32)

    def features(batches):
        for b in batches:
            at, many = [], []
            for t in b.column(0).to_pylist():
                x = counts_of([t])[0]
                i = np.flatnonzero(x)
                at.append(i.astype(np.uint16).tobytes())
                many.append(x[i].astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array(at, pa.binary()), pa.array(many, pa.binary())], ["lang", "at", "many"])

    labelled = docs.select(F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"), F.xxhash64(doc_id, text).alias("h")).where("lang is not null and length(text) > 0")
    limits = _limits({r["lang"]: (r["n"], r["least"]) for r in labelled.groupBy("lang").agg(F.count("*").alias("n"), F.min("h").alias("least")).collect()}, sample)
    chosen = docs.sparkSession.createDataFrame(list(limits.items()), "label string, most long")
    rows = labelled.join(F.broadcast(chosen), F.col("lang") == F.col("label")).where("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text")).select("text", "lang").mapInArrow(features, "lang string, at binary, many binary").collect()
    rows.sort(key=lambda r: (hash_bytes(r["at"]), r["lang"]))
    langs = sorted({r["lang"] for r in rows})
    if not langs:
        return Model(idf, np.zeros((SLOTS, 1), np.float32), np.zeros(1), [None], 1.0)
    data = []
    for r in rows:
        at = np.frombuffer(r["at"], np.uint16).astype(np.int64)
        x = np.frombuffer(r["many"], np.int32) * idf[at]
        data.append((at, (x / np.sqrt((x * x).sum())).astype(np.float64), langs.index(r["lang"])))
    held = data[::5] if len(data) >= 20 else []
    used = [d for i, d in enumerate(data) if i % 5] if held else data
    w, b = ftrl(used, len(langs))
    z = np.array([x @ w[at] + b for at, x, _ in held]).reshape(-1, len(langs))
    return Model(idf, w.astype(np.float32), b.astype(np.float32), langs, fit_temperature(z, np.array([y for *_, y in held], np.int64)))


def hash_bytes(b: bytes) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(bytes(b))


def language_column(text: Column, model: Model) -> Column:
    """struct(lang, confidence); both null for a null or empty text."""

    def language(column: pa.Array) -> pa.Array:
        texts = column.to_pylist()
        best, sure, none = [], [], np.array([not t for t in texts], bool)
        for i in range(0, len(texts), GROUP):
            k, p = model.predict(counts_of(texts[i : i + GROUP]))
            best.append(k)
            sure.append(p)
        if not best:
            return pa.array([], pa.struct([("lang", pa.string()), ("confidence", pa.float64())]))
        at = pa.array(np.concatenate(best), mask=none)
        return pa.StructArray.from_arrays([pa.array(model.langs, pa.string()).take(at), pa.array(np.round(np.concatenate(sure).astype(np.float64), 6), mask=none)], ["lang", "confidence"])

    return arrow_udf(releasing_after(language), "struct<lang: string, confidence: double>")(text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", sample: int = 4000) -> DataFrame:
    """(doc_id, lang, predicted, confidence) for every row; lang is the given label.

    A null or empty text has predicted and confidence null. Rows with null ids and repeated rows are predicted like any other;
    null labels don't train. Other columns are not read. Without any label predicted is null. Texts count whole, of any length. Of equal
    scores the first label in the alphabet wins. An empty table gives an empty result.
    """
    found = language_column(F.col(text), train(docs, doc_id, text, lang, sample))
    return docs.select(F.col(doc_id).alias("doc_id"), F.col(lang).alias("lang"), found.alias("found")).select("doc_id", "lang", F.col("found.lang").alias("predicted"), F.col("found.confidence").alias("confidence"))
