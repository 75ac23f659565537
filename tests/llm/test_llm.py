import numpy as np
import pytest

from gleanspark.llm import _shared, bpe, crf_quality, gif, jaccard_join, language_id, metric_join, packing, secret_scan, suffix_dedup, url_filter

LONG = " ".join(f"w{i}" for i in range(400))
ROWS = [(1, LONG, "en", "s", 1), (2, LONG, "en", "s", 1), (2, LONG, "en", "s", 1), (3, "", "de", None, 0), (4, None, None, "s", None), (None, "a b c", "en", "s", 3), (5, " ".join(f"v{i}" for i in range(60)) + " " + " ".join(f"w{i}" for i in range(60)), "en", "s", 9)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).selectExpr("*", "1 as doc", "2 as anchor", "3 as size")


@pytest.fixture(scope="module")
def none(docs):
    return docs.limit(0)


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_packing(docs, none):
    out = packing.pack(docs, capacity=100).collect()
    assert sum(r.length for r in out) == 3 * 400 + 3 + 120
    assert packing.pack(none).count() == 0
    bins = {}
    for r in out:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append((r.position, r.length))
    for parts in bins.values():
        at = 0
        for p, n in sorted(parts):
            assert p == at
            at += n
        assert at <= 100
    assert sum(r.bin is None for r in out) == 2


def test_repeats(docs, none):
    got = rows(suffix_dedup.repeated_passages(docs))
    assert got == [(1, 0, 400, False), (2, 0, 400, False), (2, 0, 400, True), (5, 60, 120, False), (5, 60, 120, True)]
    assert suffix_dedup.repeated_passages(none).count() == 0
    kept = suffix_dedup.remove_repeats(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {1, 3, 4, None, 5}


def test_jaccard(docs, none):
    assert rows(jaccard_join.jaccard_join(docs)) == sorted([(1, 1, 1), (2, 1, 1), (3, None, 0), (4, None, 0), (5, 5, 0)], key=repr)
    assert jaccard_join.jaccard_join(none).count() == 0 and jaccard_join.one_of_each(none).count() == 0
    assert sorted(r.doc_id or 0 for r in jaccard_join.one_of_each(docs).collect()) == [0, 1, 3, 4, 5]


def near_copies(seed, groups=12, alone=60):
    """Texts with near and exact copies, a passage that many share, empty ones, and a very long one."""
    import random

    r = random.Random(seed)
    words = [f"w{i}" for i in range(4000)]
    passage = [r.choice(words) for _ in range(40)]
    texts = [" ".join(r.choices(words, k=r.randint(1, 120))) for _ in range(alone)]
    for _ in range(groups):
        base = r.choices(words, k=r.randint(30, 150))
        for _ in range(r.randint(2, 14)):
            own = base[:]
            for _ in range(r.randint(0, len(base) // 6)):
                own[r.randrange(len(own))] = r.choice(words)
            texts.append(" ".join(own))
    texts += [" ".join(passage + r.choices(words, k=90)) for _ in range(25)] + [texts[3], texts[3], "", " \n", None, "one", "one", " ".join(r.choices(words, k=30000))]
    r.shuffle(texts)
    return texts


def brute_force_classes(texts, t=0.7):
    sets = []
    for x in texts:
        w = (x or "").split()
        sets.append(frozenset(zip(w, w[1:])) if len(w) > 1 else frozenset(w))
    root, links = list(range(len(sets))), [0] * len(sets)
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) >= t * max(len(a), len(b)) - 1e-9 and len(a & b) >= t * len(a | b) - 1e-9:
                links[i] += 1
                links[j] += 1
                low, high = sorted((root[i], root[j]))
                root = [low if k == high else k for k in root]
    return sorted([(i, root[i] if s else None, links[i]) for i, s in enumerate(sets)], key=repr)


@pytest.mark.parametrize("block", [1024, 4])
def test_jaccard_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard_join, "BLOCK", block)
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", block * 1000)
    texts = near_copies(block)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_force_classes(texts)
    assert rows(jaccard_join.jaccard_join(d)) == want
    assert {r.doc_id for r in jaccard_join.one_of_each(d).collect()} == {i for i, c, _ in want if c in (i, None)}
    named = jaccard_join.jaccard_join(d.selectExpr("concat('d', doc_id) as doc_id", "text")).collect()
    assert sorted((int(r.doc_id[1:]), r.links) for r in named) == sorted((i, n) for i, _, n in want)
    classes = {}
    for r in named:
        classes.setdefault(r.class_id, set()).add(int(r.doc_id[1:]))
    assert sorted(map(sorted, (v for k, v in classes.items() if k))) == sorted(sorted(i for i, c, _ in want if c == k) for k in {c for _, c, _ in want} - {None})


def test_parity_bits_never_lose_a_similar_pair():
    rng = np.random.default_rng(8)
    sets = []
    for n in (3, 40, 63, 64, 65, 120, 500, 700, 1500):
        base = rng.integers(0, 2**63, n).astype(np.uint64)
        for share in (0.0, 0.05, 0.1, 0.17, 0.2, 0.5):
            k = base.copy()
            k[: int(share * n)] = rng.integers(0, 2**63, int(share * n)).astype(np.uint64)
            sets.append(np.unique(k))
    every, size = np.arange(len(sets)), np.array([len(x) for x in sets], float)
    ok = jaccard_join.may_be_similar([jaccard_join.parity_bits(x) for x in sets], size, every, every, 0.7)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            assert ok[i, j] or both < 0.7 * (len(a) + len(b) - both)
    assert ok.sum() < 0.5 * ok.size


def test_pairs_of_lists_in_small_steps():
    rng = np.random.default_rng(5)
    gram, grp = rng.integers(0, 5, 400).astype(np.uint32), (rng.integers(0, 6, 400) << 32 | 1000 << 20 | rng.integers(0, 9, 400)).astype(np.int64)
    want = {}
    for g in range(5):
        own = sorted(set(grp[gram == g].tolist()))
        for i, a in enumerate(own):
            for b in own[i + 1 :]:
                if a >> 32 != b >> 32:
                    want[a, b] = want.get((a, b), 0) + 1
    for most in (1, 7, 1 << 20):
        got = {}
        for a, b, n in jaccard_join._pairs_of_lists(gram, grp, 0.7, most):
            for k in zip(a.tolist(), b.tolist(), n.tolist()):
                got[k[:2]] = got.get(k[:2], 0) + k[2]
        assert got == want


def copies_of_sets(rng, n, many, most):
    base = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
    for _ in range(many):
        k = base.copy()
        at = rng.choice(len(k), int(rng.uniform(0, most) * len(k)), replace=False)
        k[at] = rng.integers(0, 2**63, len(at)).astype(np.uint64)
        yield np.unique(k[int(rng.uniform(0, most / 2) * len(k)) :])


def postings_of_sets(sets):
    prefixes = [k[: jaccard_join.prefix_length(len(k), 0.7)] for k in sets]
    many = [len(p) for p in prefixes]
    grp = np.array([jaccard_join.group_of(p, len(k)) for p, k in zip(prefixes, sets)], np.uint64).view(np.int64)
    gram = (_shared.mix(np.concatenate(prefixes)) >> np.uint64(32)).astype(np.uint32)
    place = np.concatenate([np.arange(m) * 256 // m for m in many]).astype(np.uint8)
    return prefixes, grp, gram, np.repeat(grp, many), place


def test_places_that_count_lose_no_similar_pair():
    rng = np.random.default_rng(12)
    sets = [k for n in (2, 3, 5, 9, 17, 31, 32, 33, 64, 100, 250, 900) for _ in range(3) for k in copies_of_sets(rng, n, 7, 0.25)]
    # unlike sets that share grams at the end of their prefixes only
    late = np.sort(rng.integers(2**61, 2**61 + 2**50, 400).astype(np.uint64))
    for _ in range(20):
        own = np.concatenate([rng.integers(0, 2**61, 25).astype(np.uint64), rng.choice(late, 10), rng.integers(2**62, 2**63, 80).astype(np.uint64)])
        sets.append(np.unique(own))
    _, grp, gram, owner, place = postings_of_sets(sets)
    met = {}
    for a, b, n in jaccard_join._pairs_of_lists(gram, owner, 0.7, place=place):
        for k in zip(a.tolist(), b.tolist(), n.tolist()):
            met[frozenset(k[:2])] = met.get(frozenset(k[:2]), 0) + k[2]
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(np.intersect1d(a, sets[j]))
            if both >= 0.7 * (len(a) + len(sets[j]) - both) and grp[i] >> 32 != grp[j] >> 32:
                room = 0.7 / 1.7 * (len(a) + len(sets[j])) - 0.7 * max(len(a), len(sets[j]))
                assert met.get(frozenset((int(grp[i]), int(grp[j]))), 0) >= max(1, min(room - 1.02 * 0.01 * len(a), min(len(a), len(sets[j])) / jaccard_join.PER_GRAM / 1.01 - 1e-2))
    assert not any(frozenset((int(x), int(y))) in met for x in grp[-20:] for y in grp[-20:])


def test_a_large_cluster_is_one_joint_label(spark):
    rng = np.random.default_rng(13)
    sets = list(copies_of_sets(rng, 300, 400, 0.08))
    prefixes, grp, gram, owner, place = postings_of_sets(sets)
    members = spark.createDataFrame([(int(g), jaccard_join.bands_of(p)) for g, p in zip(grp, prefixes)], "grp long, bands array<long>")
    joined = jaccard_join.joined_labels(members)
    pairs = lambda **x: sum(len(a) for a, _, _ in jaccard_join._pairs_of_lists(gram, owner, 0.7, place=place, **x))
    assert len(set((grp >> 32).tolist())) > 3 and pairs() > 20 * pairs(joined=joined)
    none = jaccard_join.joined_labels(members.limit(0))
    assert len(none[0]) == 0 and (jaccard_join.joint_of(grp, none) == grp).all()


def test_copies_far_from_a_cluster_join_its_label(spark):
    rng = np.random.default_rng(14)
    sets = list(copies_of_sets(rng, 300, 400, 0.3))
    prefixes, grp, gram, owner, place = postings_of_sets(sets)
    joined = jaccard_join.joined_labels(spark.createDataFrame([(int(g), jaccard_join.bands_of(p)) for g, p in zip(grp, prefixes)], "grp long, bands array<long>"))
    pairs = lambda **x: sum(len(a) for a, _, _ in jaccard_join._pairs_of_lists(gram, owner, 0.7, place=place, **x))
    assert pairs() > 20 * pairs(joined=joined)


def test_unlike_sets_with_a_late_gram_in_common_are_no_pair():
    rng = np.random.default_rng(15)
    # place 60 of 300 grams is beyond those that count
    sets = [np.unique(np.concatenate([rng.integers(0, 2**61, 60).astype(np.uint64), [np.uint64(2**61 + i // 40)], rng.integers(2**62, 2**63, 239).astype(np.uint64)])) for i in range(80)]
    _, _, gram, owner, place = postings_of_sets(sets)
    assert not sum(len(a) for a, _, _ in jaccard_join._pairs_of_lists(gram, owner, 0.7, place=place))


def test_keys_are_all_held_and_few_others(spark):
    keys = spark.range(5000).selectExpr("xxhash64(id) as h")
    may = _shared.may_be_in(keys)
    assert keys.where(may(keys["h"])).count() == 5000
    others = spark.range(5000, 105000).selectExpr("xxhash64(id) as h")
    assert others.where(may(others["h"])).count() < 5000
    none = _shared.may_be_in(keys.limit(0))
    assert keys.where(none(keys["h"])).count() == 0


def shuffled_bytes(spark):
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    of = spark.sparkContext._jvm.java.util.ArrayList
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(of(), False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), of())
    return {(stages.apply(i).stageId(), stages.apply(i).attemptId()): stages.apply(i).shuffleWriteBytes() for i in range(stages.size())}


def test_texts_without_a_similar_one_are_not_shuffled(spark, monkeypatch):
    rng = np.random.default_rng(16)
    texts = [" ".join(x.tobytes().hex() for x in rng.integers(0, 2**63, (60, 12))) for _ in range(300)]
    texts[1] = texts[0] + " more"
    path = f"{_shared.shared_dir(spark)}/texts-16"
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(2).write.mode("overwrite").parquet(path)
    monkeypatch.setattr(_shared, "BROADCAST_BYTES", 0)
    before = shuffled_bytes(spark)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = jaccard_join.one_of_each(spark.read.parquet(path)).select("doc_id").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert sorted(r.doc_id for r in got) == [0, *range(2, 300)]
    written = sum(v for k, v in shuffled_bytes(spark).items() if k not in before)
    assert written < sum(map(len, texts)) / 4


@pytest.mark.parametrize("kind", ["double", "float"])
def test_metric_join_against_brute_force(spark, kind):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(300, 8))
    v[150:] = v[:150] + rng.normal(size=(150, 8)) * 0.05
    v[40:70] = v[40] + rng.normal(size=(30, 8)) * 0.1
    v[90:95] = v[90]  # ties
    v = v.astype(np.float32).astype(float)
    data = [(i, x.tolist()) for i, x in enumerate(v)] + [(None, v[0].tolist()), (900, None), (901, []), (902, [float("nan")] * 8), (7, v[7].tolist()), (903, [1.0, 2.0])]
    df = spark.createDataFrame(data, f"vec_id long, embedding array<{kind}>").selectExpr("*", "1 as node", "2 as cell", "3 as id")
    d = np.sqrt(((v[:, None] - v[None]) ** 2).sum(-1)) <= 0.4
    root = jaccard_join.smallest_reached(300, *np.nonzero(d))
    want = [(i, int(root[i]), int(d[i].sum()) - 1) for i in range(300)] + [(900, None, 0), (901, None, 0), (902, None, 0), (903, 903, 0)]
    for cell, block in ((40, 15), (4096, 4096), (30, 4096), (4096, 50)):
        assert rows(metric_join.range_join(df, 0.4, cell=cell, block=block)) == sorted(want, key=repr)
    named = metric_join.range_join(df.selectExpr("concat('v', vec_id) as vec_id", "embedding"), 0.4).collect()
    assert sorted((int(r.vec_id[1:]), r.links) for r in named) == sorted((i, n) for i, _, n in want)
    assert metric_join.range_join(df.limit(0), 0.4).count() == 0


def test_bpe(docs):
    tiktoken = pytest.importorskip("tiktoken")
    b = bpe.Bpe(bpe.vocabulary())
    enc = tiktoken.Encoding("own", pat_str=bpe.PIECES, mergeable_ranks=b.rank, special_tokens={})
    for s in ("", "it's  a\n\ntest ", "日本　語🙂 x", "naïve  über 123!?", "a" * 300):
        p = b.prefixes(s.encode())
        assert b.walk(p) == enc.encode_ordinary(s)
        q, new, _ = b.append(p, s.encode(), " and more's".encode())
        assert b.walk(q) == enc.encode_ordinary(new.decode())
    out = {(r.doc_id, r.n_tokens, r.exact) for r in bpe.encode(docs).collect()}
    assert (3, 0, True) in out and (4, None, None) in out and all(e is not False for *_, e in out)


def test_gif(spark):
    x = gif.encode(3, 2, np.array([[0, 0, 0], [255, 0, 0], [0, 255, 0], [0, 0, 255]]), [{"pixels": np.ones((2, 3), int), "delay": 4}, {"pixels": np.array([[2]]), "left": 1, "delay": 5, "disposal": 3}, {"pixels": np.array([[3, 0]]), "transparent": 0, "disposal": 2}])
    f = list(gif.frames_of(x))
    assert [(a, b, c) for a, b, c, _ in f] == [(0, 40, 0), (3, 50, 40), (2, 0, 90)]
    assert f[1][3][0, 1].tolist() == [0, 255, 0, 255] and f[2][3][0, 1].tolist() == [255, 0, 0, 255] and f[2][3][0, 0].tolist() == [0, 0, 255, 255]
    df = spark.createDataFrame([(1, x), (2, None), (3, b"GIF89a"), (4, x[:-9])], "media_id long, content binary")
    out = gif.decode_gifs(df).collect()
    assert [sum(r.media_id == k and r.error is None for r in out) for k in (1, 2, 3, 4)] == [3, 0, 0, 2]
    rng = np.random.default_rng(1)
    for least in range(2, 9):
        px = rng.integers(0, 1 << least, 9000).astype(np.uint8).tobytes()
        assert gif.lzw_decode(gif.lzw_encode(px, least), least, 9000) == px


def slow_frames(width, height, palette, frames):
    """Frames by the rules, pixel by pixel, from what was encoded."""
    canvas = [[(0, 0, 0, 0)] * width for _ in range(height)]
    out, start = [], 0
    for f in frames:
        before = [r[:] for r in canvas]
        colours = f.get("palette", palette)
        px = f["pixels"].tolist()
        for y, line in enumerate(px):
            for x, v in enumerate(line):
                yy, xx = y + f.get("top", 0), x + f.get("left", 0)
                if yy < height and xx < width and v != f.get("transparent"):
                    canvas[yy][xx] = (*map(int, colours[v]), 255)
        out.append((f.get("disposal", 0), 10 * f.get("delay", 0), start, [r[:] for r in canvas]))
        start += 10 * f.get("delay", 0)
        if f.get("disposal") == 3:
            canvas = before
        elif f.get("disposal") == 2:
            for y in range(len(px)):
                for x in range(len(px[0])):
                    yy, xx = y + f.get("top", 0), x + f.get("left", 0)
                    if yy < height and xx < width:
                        canvas[yy][xx] = (0, 0, 0, 0)
    return out


def test_gif_against_brute_force(spark):
    rng = np.random.default_rng(6)
    for _ in range(25):
        w, h, colours = int(rng.integers(1, 40)), int(rng.integers(1, 40)), int(rng.integers(2, 257))
        palette = rng.integers(0, 256, (colours, 3))
        frames = []
        for _ in range(int(rng.integers(1, 6))):
            own = rng.integers(0, 256, (8, 3)) if rng.random() < 0.3 else None
            f = {"pixels": rng.integers(0, 8 if own is not None else colours, (int(rng.integers(1, h + 3)), int(rng.integers(1, w + 3)))), "left": int(rng.integers(0, w)), "top": int(rng.integers(0, h)), "delay": int(rng.integers(0, 65536)), "disposal": int(rng.integers(0, 4)), "interlaced": bool(rng.integers(0, 2))}
            f |= {"transparent": int(rng.integers(0, 8))} if rng.random() < 0.6 and colours > 8 else {}
            f |= {"palette": own} if own is not None else {}
            frames.append(f)
        got = list(gif.frames_of(gif.encode(w, h, palette, frames)))
        assert [(a, b, c, [[tuple(p) for p in r] for r in d.tolist()]) for a, b, c, d in got] == slow_frames(w, h, palette, frames)
    # a table of codes that fills and is cleared in mid-stream, many frames of long delays, wrong code sizes, a canvas without data
    noise = rng.integers(0, 256, 40000).astype(np.uint8)
    assert gif.lzw_decode(gif.lzw_encode(noise.tobytes(), 8), 8, 40000) == noise.tobytes()
    assert gif.lzw_decode(gif.lzw_encode(noise.tobytes(), 8)[:30000] + b"\xff" * 9000, 8, 20000) == noise.tobytes()[:20000]
    dot = {"pixels": np.zeros((1, 1), int), "delay": 65535}
    many = gif.encode(1, 1, np.array([[1, 2, 3], [4, 5, 6]]), [dot] * 3300)
    wrong = bytearray(gif.encode(1, 1, np.array([[1, 2, 3], [4, 5, 6]]), [dot]))
    wrong[wrong.index(b"\x2c") + 10] = 11
    huge = b"GIF89a" + b"\xff\xff\xff\x1f" + b"\x80\0\0" + bytes(6) + b"\x2c" + bytes(4) + b"\xff\xff\xff\x1f\0" + b"\x02\x01\x04\0\x3b"
    big = gif.encode(5000, 4000, np.array([[1, 2, 3], [4, 5, 6]]), [{"pixels": np.ones((2, 2), int)}])
    df = spark.createDataFrame([(1, many, 0), (2, bytes(wrong), 0), (3, huge, 0), (4, big, 0), (4, big, 0), (None, None, 0)], "media_id long, content binary, frame int").coalesce(1)
    out = gif.decode_gifs(df).selectExpr("media_id", "frame", "start_ms", "width", "error", "length(pixels) as n", "aggregate(histogram, 0, (a, x) -> a + x) as filled").collect()
    assert max(r.start_ms for r in out if r.media_id == 1) == 3299 * 655350 > 2**31
    assert [r.error for r in out if r.media_id == 2] == ["the code size is out of range"] and [r.error for r in out if r.media_id == 3] == ["the code stream ends too soon"]
    assert [(r.width, r.n, r.filled) for r in out if r.media_id == 4] == [(5000, 5000 * 4000 * 4, 4)] * 2
    assert [r.error for r in out if r.media_id is None] == ["no content"] and gif.decode_gifs(df.limit(0)).count() == 0


def test_long_secrets_ids_and_positions(spark):
    text = 'x password  = "' + "aB3$" * 200 + '" y'
    d = spark.createDataFrame([("a", text)], "doc_id string, text string")
    assert secret_scan.redact_secrets(d).first().text == 'x password  = "[SECRET]" y'
    assert [(r.doc_id, r.position, r.length) for r in secret_scan.find_secrets(d).collect()] == [("a", 15, 800)]
    both = spark.createDataFrame([("a", LONG), ("b", LONG)], "doc_id string, text string")
    found = rows(suffix_dedup.repeated_passages(both))
    assert [r for r in found if not r[3]] == [("a", 0, 400, False), ("b", 0, 400, False)] and sum(r[3] for r in found) == 1
    assert suffix_dedup.remove_repeats(both).count() == 1
    h = np.random.default_rng(1).integers(0, 2**63, 3000).astype(np.uint64)
    first = np.array([0, 700, 720, 3000])
    want = suffix_dedup.anchors_of(h, first, 50, 10)
    for span in (1, 37, 1000):
        got = suffix_dedup.anchors_of(h, first, 50, 10, span)
        assert all((a == b).all() for a, b in zip(want, got))
    ids = {packing.first_bin(t, p) for t in (0, 1, 127, 128, 999) for p in (0, 65536, 2**21 - 1)}
    assert len(ids) == 15 and max(ids) < 2**63


def test_classifiers(spark, docs, none):
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    assert crf_quality.score_quality(docs, labels).count() == len(ROWS) and crf_quality.keep_good(none, labels).count() == 0
    # held-out accuracy on generated documents
    good = [(i, f"This is line {i} of a calm text.\nAnother line follows it here.", 1) for i in range(80)]
    bad = [(100 + i, f"BUY!!! $$$ %%% {i} ###\n@@@ *** !!! WIN", 0) for i in range(80)]
    d = spark.createDataFrame([(i, t, "en" if q else "xx") for i, t, q in good + bad], "doc_id long, text string, lang string")
    train = spark.createDataFrame([(i, q) for i, _, q in good[:60] + bad[:60]], "doc_id long, quality int")
    assert {r.doc_id for r in crf_quality.score_quality(d, train).collect() if r.keep} == {i for i, *_ in good}
    assert all(r.predicted == r.lang for r in language_id.identify(d).collect())
    assert language_id.identify(none).count() == 0 and {r.predicted for r in language_id.identify(docs).collect() if r.doc_id in (3, 4)} == {None}


def test_forward_backward_against_enumeration():
    from itertools import product

    rng = np.random.default_rng(2)
    node, trans = rng.normal(size=4), rng.normal(size=(2, 2))
    p = {s: np.exp(sum(node[i] * s[i] for i in range(4)) + sum(trans[s[i], s[i + 1]] for i in range(3))) for s in product((0, 1), repeat=4)}
    want = [sum(v for s, v in p.items() if s[i]) / sum(p.values()) for i in range(4)]
    good, _, log_z = crf_quality.forward_backward(node, trans, np.array([4]))
    assert np.allclose(good, want) and np.isclose(log_z, np.log(sum(p.values())))


def test_secrets(docs, none):
    found = secret_scan.labelled_findings()
    f = secret_scan.train([r for i, r in enumerate(found) if i % 4])
    x = np.array([secret_scan.features(v.encode(), b.encode()[-48:], p) for v, b, p, _ in found[::4]])
    assert ((f.predict(x) >= 0.5) == np.array([y for *_, y in found[::4]])).mean() > 0.97
    d = docs.limit(1).selectExpr("9L as doc_id", "concat('é token = \"', sha1('x'), '\" end') as text", "'src1' as source", "1L as n_chars")
    assert secret_scan.redact_secrets(d).first().text == 'é token = "[SECRET]" end'
    assert [(r.doc_id, r.position, r.length) for r in secret_scan.find_secrets(d).collect()] == [(9, 12, 40)]
    assert secret_scan.find_secrets(none).count() == 0 and secret_scan.redact_secrets(docs).count() == len(ROWS)


def test_urls(spark):
    df = spark.createDataFrame([(1, "http://free-bets.example.com/x"), (2, None), (3, ""), (4, "https://gardening.example.org/en/1")], "page_id long, url string")
    assert {r.page_id: r.blocked for r in url_filter.filter_urls(df).collect()} == {1: True, 2: False, 3: False, 4: False}


def test_one_of_each_with_several_texts_of_an_id(spark):
    a, b = LONG, " ".join(f"u{i}" for i in range(200))
    data = [(1, a), (5, a), (5, b), (5, None), (5, ""), (6, b + " end"), (7, "x y z"), (7, "x  y z"), (8, "p q"), (8, "p q")]
    got = jaccard_join.one_of_each(spark.createDataFrame(data, "doc_id long, text string"))
    kept = rows(got)
    assert [r for r in kept if r[0] != 7] == sorted([(1, a), (5, b), (5, None), (5, ""), (8, "p q")], key=repr)
    assert sum(r[0] == 7 for r in kept) == 1


def test_language_sample_has_every_label(spark):
    data = [(i, f"some english text number {i}", "en" if i % 40 == 0 else None) for i in range(1200)] + [(5000 + i, f"ganz anderer deutscher satz {i}", "de") for i in range(600)] + [(9999, "日本語の文章です", "ja")]
    d = spark.createDataFrame(data, "doc_id long, text string, lang string")
    m = language_id.train(d, sample=60)
    assert m.langs == ["de", "en", "ja"]
    found = {r.doc_id: r.predicted for r in language_id.identify(d, sample=60).collect()}
    assert found[1] == "en" and found[5001] == "de"
    limits = language_id._limits({"a": (10, -5), "b": (10**6, -(2**63) + 2**60), "c": (10**6, 0)}, 2)
    assert set(limits) == {"a", "b", "c"} and all(v >= k for v, k in zip(limits.values(), (-5, -(2**63) + 2**60, 0)))


def test_bpe_tables_against_full_encoding(spark):
    import random

    from pyspark.sql import functions as F

    b, r = bpe.Bpe(bpe.vocabulary()), random.Random(4)
    bits = ["the", " ", "\n", "  ", "naïve", "日本", "　", "'s", "123", "!?", "über", " a", "🙂", "\u2009", "x" * 9]
    text = lambda n: "".join(r.choice(bits) for _ in range(n))
    data = [(i, s := text(r.randint(0, 40)), at := r.randint(0, len(s)), r.randint(0, len(s) - at), text(r.randint(0, 4))) for i in range(300)] + [(900, None, 0, 0, "x"), (901, "a b", 1, 1, None)]
    d = spark.createDataFrame(data, "doc_id long, text string, at int, removed int, more string")
    lines = spark.sparkContext.broadcast(bpe.vocabulary())
    e = bpe.encode(d).join(d, "doc_id").select("*", bpe.prefix_column(F.col("text"), lines).alias("p"), bpe.decode_column(F.col("tokens"), lines).alias("back"))
    got = e.select("*", bpe.append_column(F.col("text"), F.col("last"), F.col("more"), lines).alias("appended"), bpe.edit_column(F.col("text"), F.col("last"), F.col("at"), F.col("removed"), F.col("more"), lines).alias("edited")).collect()
    whole = lambda s: b.prefixes(s.encode()).tobytes()
    assert len(got) == len(data)
    for x in got:
        if x.text is None or x.more is None:
            assert x.appended is None and x.edited is None and (x.text is not None or x.last is None and x.back is None)
            continue
        assert x.last == x.p == whole(x.text) and x.back == x.text and x.tokens == b.walk(np.frombuffer(x.last, np.int32))
        assert x.appended == whole(x.text + x.more)
        assert x.edited == whole(x.text[: x.at] + x.more + x.text[x.at + x.removed :])
