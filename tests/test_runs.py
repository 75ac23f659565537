import json

import pytest
from pyspark.sql import functions as F

from gleanspark import sinks
from gleanspark.functions import answers
from gleanspark.operators import extraction, runs, state
from gleanspark.operators.templates import GENERIC
from gleanspark.sources import files
from gleanspark.streaming import harvest


def test_retries_and_bucket():
    slept, calls, fresh = [], [], []

    def fails(*errors, then="ok"):
        it = iter(errors)

        def call():
            calls.append(1)
            e = next(it, None)
            if e:
                raise e
            return {"text": then}

        return call

    nap = slept.append
    assert runs.with_retries(fails(OSError("x"), OSError("y")), 3, sleep=nap)[0] == {"text": "ok"} and len(slept) == 2
    assert runs.with_retries(fails(runs.CallError("bad", 400)), 3, sleep=nap) == (None, 1, "bad")
    assert runs.with_retries(fails(runs.CallError("busy", 429)), 3, sleep=nap)[1] == 2
    assert runs.with_retries(fails(runs.CallError("who", 401)), 3, refresh=lambda: fresh.append(1), sleep=nap)[0] and fresh == [1]
    assert runs.with_retries(fails(*[OSError("z")] * 9), 3, sleep=nap)[2] == "OSError: z"
    now = [0.0]
    b = runs.Bucket(2, clock=lambda: now[0], sleep=lambda s: now.__setitem__(0, now[0] + s))
    for _ in range(4):
        b.take()
    assert now[0] == pytest.approx(60)


def test_wire_formats():
    m = [{"role": "system", "content": "s"}, {"role": "user", "content": "u"}]
    chat, other = runs.request_body(runs.CHAT, "m", m, schema={}), runs.request_body(runs.RESPONSES, "m", m, schema={"type": "object"})
    assert chat["messages"] == m and other["instructions"] == "s" and other["input"] == m[1:] and other["text"]["format"]["strict"]
    assert runs.answer_text(runs.CHAT, {"choices": [{"message": {"content": "x"}}]}) == "x" and runs.answer_text(runs.CHAT, {}) == "" and runs.answer_text(runs.RESPONSES, {"output_text": "y"}) == "y"
    key = answers.make_key("chat", "m", m, 0, 1)
    assert key != answers.make_key("chat", "m", m, 0.5, 1) and len(key) == 64
    assert answers.figure_payload({"items": "no", "caption": "c"}) == {**answers.FIGURE_SHAPE, "caption": "c"}


def test_cached_complete(spark):
    def provider():
        def client(body):
            if body["q"] == "bad":
                raise runs.CallError("refused", 400)
            return {"choices": [{"message": {"content": body["q"] * 2}}], "usage": {"prompt_tokens": 2}}

        return client

    requests = spark.createDataFrame([(k, json.dumps({"q": k})) for k in ("a", "b", "bad", "b")], "key string, body string")
    entries = spark.createDataFrame([("a", "known", 95), ("b", "old", 10)], "key string, answer string, created_at long")
    got = {r.key: r for r in runs.cached_complete(requests, entries, provider, F.lit(100), ttl=50).collect()}
    assert got["a"].cached and got["a"].answer == "known" and not got["b"].cached and got["b"].answer == "bb" and got["bad"].error == "refused" and len(got) == 3
    assert not any(r.cached for r in runs.cached_complete(requests, entries, provider, F.lit(100), bypass=True).collect())


def test_sinks(spark, tmp_path):
    r = spark.createDataFrame([("d1", "a,\"b\"\nc", 2.0e7, 1.5, ["value", "unit"], True), ("d2", None, None, None, None, None)], "doc_id string, subject string, value double, p double, _ungrounded array<string>, _grounded boolean")
    one = str(tmp_path / "one.csv")
    sinks.export_csv(r, one, ["doc_id", "subject", "value", "_grounded", "_ungrounded"])
    assert open(one, "rb").read() == b'\xef\xbb\xbfdoc_id,subject,value,_grounded,_ungrounded\r\nd1,"a,""b""\nc",20000000.0,true,value; unit\r\nd2,,,,\r\n'
    back = files.read_csv(spark, one)
    assert back.columns[0] == "doc_id" and {(x.doc_id, x.subject, x.value) for x in back.collect()} == {("d1", 'a,"b"\nc', "20000000.0"), ("d2", "", "")}
    many = str(tmp_path / "many")
    sinks.write_records_csv(r, GENERIC, many)
    sinks.write_records_csv(r, GENERIC, many, mode="append")
    assert files.read_csv(spark, many).count() == 4 and files.read_csv(spark, many).columns == sinks.record_columns(GENERIC)
    figures = spark.createDataFrame([("d1", "f.png", 1.0)], "doc_id string, image string, value double")
    sinks.write_artifacts(r, figures, r.select("doc_id"), GENERIC, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/records.jsonl")).count() == 2 and files.read_csv(spark, str(tmp_path / "out/figures.csv")).columns == list(sinks.FIGURE_COLUMNS)
    sinks.write_summary(r.agg(F.count("*").alias("total")), str(tmp_path / "summary"))
    assert spark.read.json(str(tmp_path / "summary")).first().total == 2
    with pytest.raises(ValueError):
        sinks.write_artifacts(r, figures, r, GENERIC, str(tmp_path / "x"), "xml")


def test_harvest(spark, tmp_path):
    folder, where = tmp_path / "in", str(tmp_path / "state")
    folder.mkdir()

    def handle(new):
        out = files.load_documents(new.withColumn("text0", F.lit(None).cast("string")))
        return out.select("content_hash", F.element_at(F.split("path", "/"), -1).alias("doc_id"), F.when(F.col("text").contains("fail"), "error").otherwise("ok").alias("status"))

    def go():
        q = harvest.harvest(spark, f"file://{folder}", where, handle)
        q.awaitTermination(120)
        assert q.exception() is None

    for name, text in (("a.txt", "one"), ("twin.txt", "one"), ("b.txt", "two"), ("c.txt", "will fail"), ("x.zzz", "no"), ("e.txt", "")):
        (folder / name).write_text(text)
    go()
    done = harvest.table_or_none(spark, where + "/done", harvest.DONE)
    assert {(r.doc_id, r.status) for r in done.collect()} == {("a.txt", "ok"), ("b.txt", "ok"), ("c.txt", "error")}
    (folder / "later copy.txt").write_text("two")
    (folder / "new.txt").write_text("three")
    go()
    assert {r.doc_id for r in done.sparkSession.read.parquet(where + "/done").where("status = 'ok'").collect()} == {"a.txt", "b.txt", "new.txt"}
    stats = harvest.claim_stats(spark, where).first()
    assert (stats.done, stats.failed) == (3, 1)
    events = harvest.event_history(spark, where).collect()
    assert len(events) == 4 and [r.seq for r in events] == sorted({r.seq for r in events}) and harvest.event_history(spark, where, events[1].seq).count() == 2 and harvest.event_history(spark, where, most=1).first().seq == events[-1].seq


def test_contained_spans_against_brute_force(spark):
    import random

    r = random.Random(2)
    words = "alpha beta gamma delta eps zeta".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 30)))) for i in range(60)] + [(99, None), (98, "ALPHA\n beta  Gamma")]
    spans = [(i, " ".join(r.choice(words) for _ in range(n))) for i, n in enumerate((1, 2, 3, 3, 4, 5, 6, 7, 8, 2))] + [(50, "pha beta gam"), (51, "12 3"), (52, ""), (53, None), (54, "lpha")]
    canon = lambda s: " ".join((s or "").split()).lower()
    want = sorted((k, i) for k, s in spans for i, t in docs if any(c.isalpha() for c in canon(s)) and canon(s) in canon(t))
    got = extraction.contained_spans(spark.createDataFrame(spans, "item long, span string"), spark.createDataFrame(docs, "doc_id long, text string"), "item")
    assert sorted(map(tuple, got.collect())) == want and len(want) > 20
    assert extraction.contained_spans(spark.createDataFrame(spans, "item long, span string").limit(0), spark.createDataFrame(docs, "doc_id long, text string"), "item").count() == 0


def test_ground_within_is_grounded(spark):
    docs = spark.createDataFrame([(1, "Group A reached 12.5 ug/mL at day 28. A total of 1,165 subjects were enrolled."), (2, None)], "doc_id long, text string")
    spans = ["Group A  reached 12.5", "group a reached 12.5 ug/rnL", "Group Z failed", "28", None, "A total of 1,165 subjects", "A total of 99 subjects were"]
    records = spark.createDataFrame([(d, i, s) for d in (1, 2) for i, s in enumerate(spans)], "doc_id long, pos int, source_span string")
    want = {(r.doc_id, r.pos): r.g for r in records.join(docs, "doc_id").select("doc_id", "pos", extraction.grounded(F.col("source_span"), F.col("text")).alias("g")).collect()}
    got = {(r.doc_id, r.pos): r._grounded for r in extraction.ground_within(records, docs).collect()}
    assert {k: bool(v) for k, v in got.items()} == {k: bool(v) for k, v in want.items()} and [got[1, i] for i in (0, 1, 2, 3, 5)] == [True, True, False, False, True]
    assert extraction.span_coverage("Group A reached", "x Group A reached y") == 1.0


def test_dedupe_falsy_keys(spark):
    rows = [("d", 0, 0, "0", "s", 1.0), ("d", 0, 1, "", "s", 1.0), ("d", 0, 2, None, "s", 1.0), ("d", 0, 3, "x", "s", None), ("d", 0, 4, "X", "S", None)]
    df = spark.createDataFrame(rows, "doc_id string, chunk_idx int, pos int, subject string, source_span string, value double").withColumn("attribute", F.lit("a"))
    assert sorted(r.pos for r in extraction.dedupe(df, GENERIC).collect()) == [0, 1, 3]


def test_numbered_and_mark(spark):
    df = spark.createDataFrame([(i * i,) for i in range(500)], "k long").repartition(7)
    assert sorted(map(tuple, state.numbered(df, "k", width=1000).collect())) == [(i * i, i) for i in range(500)]
    e = spark.createDataFrame([("a", "old"), ("b", None)], "key string, verdict string")
    v = spark.createDataFrame([("a", None, 0.5, 1.0)], "key string, verdict string, agreement double, verified_at double")
    assert {tuple(r) for r in state.mark(e, v).collect()} == {("a", None), ("b", None)} and state.clear(e).count() == 0
