import pytest
from pyspark.sql import functions as F

from gleanspark.functions import answers, text
from gleanspark.operators import extraction
from gleanspark.operators.templates import GENERIC, TemplateError, load_template, parse_template


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("given, want", [("1,165", 1165.0), ("<0.01", 0.01), ("2.05e3", 2050.0), ("none", None), (None, None)])
def test_parse_number(spark, given, want):
    assert one(spark, text.parse_number(F.lit(given))) == want


@pytest.mark.parametrize("given, want", [("12.5 �g/mL", "12.5 µg/mL"), ("5 ug/ml", "5 µg/mL"), ("3 μL", "3 µL")])
def test_fix_units(spark, given, want):
    assert one(spark, text.fix_units(F.lit(given))) == want


def test_units(spark):
    span = F.lit("GMT was 1.23 ug/mL")
    assert one(spark, text.unit_agrees(F.lit(1.23), F.lit("µg / mL"), span)) is True
    assert one(spark, text.unit_agrees(F.lit(1.23), F.lit("mg/mL"), span)) is False
    assert one(spark, text.unit_agrees(F.lit(9.0), F.lit("mg/mL"), span)) is None


def test_answers():
    assert len(answers.array_of('[{"a": 1}, {"a": 2}, {"a": 3')) == 2
    assert answers.array_of('{"other": [1], "records": [{"a": 1}]}') == [{"a": 1}]
    assert answers.array_of(" ") == [] and answers.object_of('```json\n{"a": 1}\n```') == {"a": 1}
    with pytest.raises(ValueError):
        answers.array_of("no json at all here")


DOC = "Group A reached 12.5 ug/mL at day 28. A total of 1,165 subjects were enrolled."


@pytest.mark.parametrize("span, want", [("Group A reached 12.5 ug/mL", True), ("group a  reached 12.5 ug/rnL at day 28", True), ("Group A reached 99 ug/mL at day 28", False), ("1,165", False), ("", False)])
def test_grounding(spark, span, want):
    assert extraction.fuzzy(span, DOC) is want
    assert one(spark, extraction.grounded(F.lit(span), F.lit(DOC))) is want


def test_chunks():
    words = "word " * 2000
    assert "".join(extraction.cut_chunks(words, 1000, 0)) == words
    assert len(extraction.cut_chunks("x" * 10000, 1000, 5000)) < 200


def test_templates():
    assert load_template() is GENERIC and GENERIC.unit_of("value") == "unit"
    for bad in ({}, {"fields": [{"name": "a"}]}, {"fields": [{"name": "source_span", "type": "date"}]}):
        with pytest.raises(TemplateError):
            parse_template(bad)


def test_wilson(spark):
    assert tuple(one(spark, text.wilson_interval(F.lit(0.0), F.lit(0.0)))) == (0.0, 0.0)
    assert tuple(one(spark, text.wilson_interval(F.lit(8.0), F.lit(10.0)))) == (0.4902, 0.9433)


def test_fuzzy_pairs_against_brute_force(spark):
    import random

    from gleanspark.plans.queries import _fuzzy_pairs

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdeiklmnorstu") for _ in range(r.randint(2, 9)))
    items = [(i, " ".join(word() for _ in range(r.randint(8, 25))).capitalize()) for i in range(8)] + [(8, None), (9, "12 34"), (10, "Short one")]
    around = lambda n: " ".join(word() for _ in range(n))
    docs = [(0, None), (1, ""), (2, around(300)), (3, "a short one."), (3, "nothing here")]
    for i, t in items[:8]:
        w = t.split()
        for k, s in enumerate((t, t.lower(), t.replace(" ", "\n  "), " ".join(["Zzz", *w[1:]]), " ".join([w[0][:1] + w[0][2:], *w[1:]]), " ".join(x[:-1] + "q" if len(x) > 3 else x for x in w), " ".join(w[len(w) // 2 :]))):
            docs.append((10 * (i + 1) + k, f"{around(r.randint(0, 90))} {s} {around(r.randint(0, 90))}"))
    d, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    every = d.crossJoin(b.select("item_id", F.col("text").alias("span"), F.regexp_replace("text", r"(\w)(\w)(\w+)", "$1$3").alias("damaged")))
    flags = every.select("item_id", "doc_id", extraction.grounded(F.col("span"), F.col("text")).alias("g"), extraction.grounded(F.col("damaged"), F.col("text")).alias("h"))
    want = sorted(map(tuple, flags.where("g or h").collect()))
    assert sorted(map(tuple, _fuzzy_pairs(d, b).collect())) == want
    assert {(i, 10 * (i + 1) + k) for i in range(8) for k in (1, 2)} <= {(i, n) for i, n, g, _ in want if g} and len(want) > 30
    assert _fuzzy_pairs(d, b.limit(0)).count() == 0


def test_token_neighbours_against_brute_force(spark):
    import random

    from gleanspark.plans.queries import _token_neighbours

    r = random.Random(3)
    many = lambda n, of=400: [f"t{r.randint(0, of)}" for _ in range(n)]
    same, docs = many(80), [(0, "s", None), (1, "s", ""), (2, "s", "one"), (3, "s", "one"), (4, "t", "one"), (5, None, "one")]
    for i in range(10, 40):
        tail = many(r.randint(20, 120), 60 if i % 3 else 400)
        docs.append((i, "st"[i % 2], " ".join([*many(60), *same, *tail] if i % 4 == 0 else [*same[:60], *tail] if i % 4 == 1 else tail)))
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    sets = {i: (s, set(t.split())) for i, s, t in docs if t and s}
    want = [(i, j, round(len(x & y) / len(x | y), 6)) for i, (s, x) in sets.items() for j, (u, y) in sets.items() if i < j and s == u and 2 * len(x & y) >= len(x | y)]
    assert sorted(map(tuple, _token_neighbours(df).collect())) == sorted(want) and len(want) > 5


ODD_PAGES = [
    "a &amp\n b &amp; c &amp;lt; &eacute; &am", "<style>x<script>y</style>z</script>w", "<ScRipt>x</sCRIPT>k<header>u</head>v", "\xa0 a&nbsp; b\xa0 \n", "a<br\x0b/>b</p\n>c", "<ſcript>x</script>y", "\n\n\n\n a \u0085\n", "﻿q &#39;&quot;&copy", "", "&", None, "<p", "</LI >x<\n>",
]


def test_pages_as_their_sql(spark, tmp_path):
    import duckdb

    import __spark_entry__ as entry

    spark.createDataFrame(list(enumerate(ODD_PAGES)), "page_id long, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name in ("strip_html_pages", "read_html_pages"):
        assert sorted(map(tuple, entry.queries()[name](spark, str(tmp_path)).collect())) == sorted(db.execute(entry.oracle_sql()[name]).fetchall()), name


def test_no_place_of_a_span_is_left_out(spark):
    from gleanspark.plans.queries import _fuzzy_pairs

    span = "mitochondrial assays revealed stable outcomes over several winters"
    damaged = span.replace("stable", "stabel").replace("winters", "wintres")
    far = "mitochondrial xx yy zz " * 60 + damaged
    unlike = "ab cd ef gh " * 300 + damaged.replace("mitochondrial", "mitochondriol")
    assert extraction.fuzzy(span, far) and extraction.fuzzy(span, unlike)
    d = spark.createDataFrame([(1, far), (2, unlike), (3, "ab cd ef gh " * 300)], "doc_id long, text string")
    b = spark.createDataFrame([(7, span)], "item_id long, text string")
    assert sorted(r.doc_id for r in _fuzzy_pairs(d, b).where("grounded").collect()) == [1, 2]


def test_best_window_is_the_first_of_the_best():
    import difflib
    import random

    r = random.Random(2)
    for _ in range(60):
        words = [r.choice(("aba", "abb", "b", "cab", "bac", "longest", "a")) for _ in range(r.randint(1, 120))]
        own = [r.choice(words) if r.random() < 0.8 else "longestt" for _ in range(r.randint(1, 6))]
        span, best, found = " ".join(own), 0, []
        for part in extraction.windows(own, words):
            size = sum(x.size for x in difflib.SequenceMatcher(None, span, " ".join(part), autojunk=False).get_matching_blocks())
            if size > best:
                best, found = size, part
        assert extraction.best_window(span, words) == (best / len(span), found)


def test_word_index_in_bounded_steps():
    import tracemalloc

    import pyarrow as pa

    assert text.word_index(pa.array(["b a  b", None, "", "é" * 9, "a"]), most=4).to_pylist() == [[("b", [0, 2]), ("a", [1])], None, [], [("é" * 9, [0])], [("a", [0])]]
    assert text.word_index(pa.array([], pa.string())).to_pylist() == []
    many = pa.array([" ".join(f"w{k}x{j}" for j in range(300)) for k in range(2000)])
    tracemalloc.start()
    index = text.word_index(many)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index) == 2000 and len(index.values) == 600_000 and peak < 60e6


def test_token_neighbours_write_no_pairs(spark):
    """Unlike texts that all share their rarer words are compared without a shuffle of pairs, over several blocks of a source."""
    import random

    from gleanspark.plans.queries import _token_neighbours

    r = random.Random(4)
    docs = [(i, "st"[i % 3 == 0], " ".join(r.sample([f"w{k}" for k in range(60)], r.randint(15, 40)))) for i in range(90)] + [(90, "s", "a b c"), (90, "s", "a b c"), (91, "s", "c b a d")]
    df = spark.createDataFrame(docs, "doc_id long, source string, text string").repartition(3)
    sets = [(i, s, set(t.split())) for i, s, t in docs]
    want = sorted((i, j, round(len(x & y) / len(x | y), 6)) for i, s, x in sets for j, u, y in sets if i < j and s == u and 2 * len(x & y) >= len(x | y))
    assert sorted(map(tuple, _token_neighbours(df).collect())) == want and len(want) > 9
    assert _token_neighbours(df)._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 0
