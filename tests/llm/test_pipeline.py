import re

import numpy as np
import pytest

import corpus_pipeline
from gleanspark.llm import crf_quality, packing, secret_scan
from tests.llm.test_llm import brute_force_classes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["1L as node", "2 as th", "3 as lost_doc", "4 as own_list", "5 as text_", "6 as size"]


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def corpus():
    import random

    r = random.Random(9)
    words = [f"word{i}" for i in range(3000)]
    line = lambda n: " ".join(r.choices(words, k=n)) + "."
    good = ["\n".join(line(r.randint(6, 14)) for _ in range(r.randint(3, 12))) for _ in range(50)]
    bad = ["\n".join("$$$ %%% ### @@@ !!! " * r.randint(1, 3) for _ in range(6)) + f"\n{i}" for i in range(20)]
    passage = line(70)
    texts = good + bad + [good[0], good[1] + " end", "x " + good[1]] + [line(20) + " " + passage + " " + line(20) for _ in range(4)] + [passage] + ["\n".join(line(12) for _ in range(6)) + "\ntoken = \"" + "9aF3bC7e" * 5 + "\"", "", "  \n", None, "one two three", line(9000)]
    docs = [(i, t, "en", "src1" if i % 3 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    docs += [docs[5], docs[5], (None, good[7], None, None, None), (None, None, None, None, None)]
    labels = [(i, 1 if i < 50 else 0, 0) for i in range(70) if i % 2]
    return docs, labels


def serial_quality(texts, model):
    """Quality text by text, line by line, from the same trained weights by enumeration of two states."""
    w, trans = model
    out = []
    for t in texts:
        raw = np.frombuffer((t or "").encode(), np.uint8)
        x, length, lines = crf_quality.line_features(raw, np.array([0, len(raw)]))
        if not lines[0]:
            out.append(None)
            continue
        node = crf_quality.with_neighbours(x, lines) @ w
        score = np.stack([np.zeros(len(node)), node], axis=1)
        a, b = score.copy(), np.zeros_like(score)
        for i in range(1, len(node)):
            a[i] = [np.logaddexp(*(a[i - 1] + trans[:, s])) + score[i, s] for s in (0, 1)]
        for i in range(len(node) - 2, -1, -1):
            b[i] = [np.logaddexp(*(trans[s] + score[i + 1] + b[i + 1])) for s in (0, 1)]
        p = np.exp(a + b - np.logaddexp(a[:, 0] + b[:, 0], a[:, 1] + b[:, 1])[:, None])[:, 1]
        out.append(round(float((p * length).sum() / length.sum()), 6))
    return out


def serial_repeats(docs, least=50):
    """Texts without windows of words that came before, in the order of ids."""
    seen, out = set(), []
    for d in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        if not d[1]:
            out.append(d)
            continue
        found = list(re.finditer(r"[^ \t\n\x0b\x0c\r]+", d[1]))
        cut = set()
        for s in range(len(found) - least + 1):
            g = tuple(m.group() for m in found[s : s + least])
            if g in seen:
                cut.update(range(s, s + least))
            seen.add(g)
        if not cut:
            out.append(d)
            continue
        starts = [m.start() for m in found] + [len(d[1])]
        text = (d[1][: starts[0]] if found else "") + "".join(d[1][starts[i] : starts[i + 1]] for i in range(len(found)) if i not in cut)
        if text.strip():
            out.append((d[0], text, *d[2:4], len(text)))
    return out + [d for d in docs if d[0] is None]


def test_stages_and_whole_against_brute_force(spark, tmp_path, corpus):
    docs, labels = corpus
    table = spark.createDataFrame(docs, SCHEMA)
    table.selectExpr("*", *CLASH).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    sf = str(tmp_path)
    d = spark.read.parquet(f"{sf}/documents.parquet")
    plain = lambda df: rows(df.select("doc_id", "text", "lang", "source", "n_chars"))
    # 5: each document's quality
    model = crf_quality.train(d, spark.read.parquet(f"{sf}/labels.parquet"))
    score = serial_quality([x[1] for x in docs], model)
    want = [x for x, q in zip(docs, score) if q is None or q >= 0.5]
    d = corpus_pipeline.quality(spark, d, sf)
    assert d.columns[5:] == [c.split(" as ")[1] for c in CLASH] and plain(d) == sorted(want, key=repr) and 40 < len(want) < len(docs) - 15
    # 6: the first of each component; repeated rows once
    d = corpus_pipeline.near_duplicates(spark, d, sf)
    with_id = [x for x in dict.fromkeys(want) if x[0] is not None]
    classes = brute_force_classes([x[1] for x in with_id])
    best: dict = {}
    for k, c, _ in classes:
        if c is not None:
            best[c] = min(best.get(c, 10**9), with_id[k][0])
    want = [with_id[k] for k, c, _ in classes if c is None or with_id[k][0] == best[c]] + [x for x in want if x[0] is None]
    assert plain(d) == sorted(want, key=repr)
    # 3: repeated passages
    d = corpus_pipeline.repeats(spark, d, sf)
    want = serial_repeats(want)
    assert plain(d) == sorted(want, key=repr)
    # 8: secrets
    d = corpus_pipeline.secrets(spark, d, sf)
    forest, changed = secret_scan.train(), 0
    for i, x in enumerate(want):
        raw = np.frombuffer((x[1] or "").encode(), np.uint8)
        begin, end = secret_scan.candidates(raw, np.array([0, len(raw)]))
        data = raw.tobytes()
        for a, z in reversed(list(zip(begin.tolist(), end.tolist()))):
            if forest.predict(np.array([secret_scan.features(data[a:z], raw.tobytes()[max(0, a - 48) : a], x[3] or "")]))[0] >= 0.5:
                data = data[:a] + b"[SECRET]" + data[z:]
                changed += 1
        want[i] = (x[0], None if x[1] is None else data.decode(), *x[2:4], x[4] if x[1] is None else len(data.decode()))
    assert plain(d) == sorted(want, key=repr) and changed >= 1
    # 1: every word lies in one place, no bin is over-full or has holes
    out = corpus_pipeline.packing(spark, d, sf).collect()
    assert rows(corpus_pipeline.run(spark, sf)) == sorted(map(tuple, out), key=repr)
    words = {}
    for x in want:
        words.setdefault(x[0], []).append(len((x[1] or "").split()))
    for k, sizes in words.items():
        assert sum(r.length for r in out if r.doc_id == k) == sum(sizes)
    bins: dict = {}
    for r in out:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append((r.position, r.length))
    for parts in bins.values():
        at = 0
        for p, n in sorted(parts):
            assert p == at
            at += n
        assert at <= 2048
    total = sum(map(sum, words.values()))
    assert len(bins) <= total // 2048 + 3 and corpus_pipeline.ORACLE_SQL is None and [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "ngram_jaccard_join", "suffix_array_dedup", "secret_scan", "best_fit_packing"]


def test_stages_of_an_empty_table(spark, tmp_path, corpus):
    empty = spark.createDataFrame(corpus[0], SCHEMA).limit(0)
    spark.createDataFrame(corpus[1], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES:
        out = stage(spark, empty, str(tmp_path))
        assert out.count() == 0
        if stage is not corpus_pipeline.packing:
            assert out.columns == empty.columns


def test_packing_ties_and_long_texts(spark):
    d = spark.createDataFrame([(i, " ".join(["w"] * n)) for i, n in enumerate([40] * 30 + [60] * 30 + [1] * 50 + [100, 250, 100000, 0])], "doc_id long, text string")
    out = packing.pack(d, capacity=100).collect()
    fill: dict = {}
    for r in out:
        if r.bin is not None:
            fill[r.bin] = fill.get(r.bin, 0) + r.length
    assert sum(fill.values()) == 30 * 100 + 50 + 100 + 250 + 100000 and max(fill.values()) == 100
    # the best possible number of bins is 1035; half a hundred short documents fit one bin with the rest of the long ones
    assert len(fill) <= 1037
