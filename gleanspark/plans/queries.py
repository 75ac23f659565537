"""Queries over the test tables and their DuckDB SQL."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.pandas.functions import arrow_udf

from gleanspark.functions import text as T
from gleanspark.operators import extraction as X
from gleanspark.operators import neighbours as N
from gleanspark.operators import state as S
from gleanspark.operators.templates import GENERIC

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
_NUM = r"[-+]?[0-9][0-9,]*(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?"
_CANON = r"trim(regexp_replace({}, '\s+', ' ', 'g'))"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@query(f"SELECT doc_id, length({_CANON.format('text')})::INT AS n, md5({_CANON.format('text')}) AS digest FROM documents")
def canon_text_docs(spark, d):
    c = T.canon_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.length(c).alias("n"), F.md5(c).alias("digest"))


@query("SELECT doc_id, left(sha256(text), 32) AS hash FROM documents")
def content_hash_docs(spark, d):
    return table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("hash"))


@query(f"SELECT doc_id, len(n)::INT AS numbers, list_sum(n) AS total, n[1] AS first FROM (SELECT doc_id, list_transform(regexp_extract_all(text, '{_NUM}'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)) AS n FROM documents) WHERE len(n) > 0")
def numbers_in_text_docs(spark, d):
    n = T.numbers_in_text(F.col("text"))
    return table(spark, d, "documents").select("doc_id", n.alias("n")).where("size(n) > 0").select("doc_id", F.size("n").alias("numbers"), F.aggregate("n", F.lit(0.0), lambda a, x: a + x).alias("total"), F.get("n", F.lit(0)).alias("first"))


@query(f"SELECT page_id, TRY_CAST(replace(nullif(regexp_extract(url, '{_NUM}'), ''), ',', '') AS DOUBLE) AS number FROM pages")
def parse_number_urls(spark, d):
    return table(spark, d, "pages").select("page_id", T.parse_number(F.col("url")).alias("number"))


_HTML = "html"
for _tag in ("script", "style", "head"):
    _HTML = f"regexp_replace({_HTML}, '(?is)<{_tag}[^>]*>.*?</{_tag}>', ' ', 'g')"
_HTML = rf"regexp_replace(regexp_replace({_HTML}, '(?i)<(?:br|/p|/div|/tr|/h[1-6]|/li)\s*/?>', chr(10), 'g'), '(?s)<[^>]+>', ' ', 'g')"
for _a, _b in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&copy;", "©"), ("&middot;", "·"), ("&amp;", "&")):
    _HTML = f"replace({_HTML}, '{_a}', '{_b}')"
_HTML = rf"regexp_replace(regexp_replace(regexp_replace({_HTML}, '[ \t]+', ' ', 'g'), '\n{{3,}}', chr(10) || chr(10), 'g'), '^\s+|\s+$', '', 'g')"


@query(f"SELECT page_id, length(t)::INT AS n, md5(t) AS digest FROM (SELECT page_id, {_HTML} AS t FROM pages)")
def strip_html_pages(spark, d):
    t = table(spark, d, "pages").select("page_id", T.strip_html(F.col("html")).alias("t"))
    return t.select("page_id", F.length("t").alias("n"), F.md5("t").alias("digest"))


@query("""SELECT doc_id, k::INT AS chunk_idx, substr(text, k * 1800 + 1, 2000) AS chunk
    FROM (SELECT doc_id, text, unnest(range(0, CASE WHEN length(text) <= 2000 THEN 1 ELSE ceil((length(text) - 200) / 1800.0)::BIGINT END)) AS k FROM documents) WHERE trim(substr(text, k * 1800 + 1, 2000), ' ' || chr(10)) <> ''""")
def chunk_fixed_stride(spark, d):
    return X.chunks(table(spark, d, "documents"), size=2000, overlap=200).select("doc_id", "chunk_idx", "chunk")


def _records(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    raw = X.records_of(X.rule_answers(X.chunks(docs, size=2000, overlap=200)).select("doc_id", "source", "chunk_idx", "answer"), GENERIC)
    return X.dedupe(X.annotate(X.ground_within(raw, docs, exact_only=True), GENERIC, text=None), GENERIC)


_RECORDS = rf"""chunks AS ({ORACLE_SQL["chunk_fixed_stride"]}),
    raw AS (SELECT doc_id, chunk_idx, regexp_extract(chunk, '^([^.\n]{{1,400}})', 1) AS s, regexp_extract(regexp_extract(chunk, '^([^.\n]{{1,400}})', 1), '^(\S+)', 1) AS subject, TRY_CAST(replace(nullif(regexp_extract(chunk, '{_NUM}'), ''), ',', '') AS DOUBLE) AS value FROM chunks),
    rec AS (SELECT doc_id, chunk_idx, nullif({_CANON.format("s")}, '') AS source_span, nullif(subject, '') AS subject, value FROM raw),
    g AS (SELECT r.*, d.source, coalesce(regexp_matches(lower(r.source_span), '\p{{L}}') AND contains(lower({_CANON.format("d.text")}), lower(r.source_span)), false) AS grounded,
          len(list_filter(list_transform(regexp_extract_all(coalesce(r.source_span, ''), '{_NUM}'), lambda x: TRY_CAST(replace(x, ',', '') AS DOUBLE)), lambda x: x = r.value OR (r.value <> 0 AND abs(x - r.value) <= 1e-6 * abs(r.value)))) > 0 AS supported
          FROM rec r JOIN documents d USING (doc_id)),
    u AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, lower(coalesce(subject, '')), lower(left(coalesce(source_span, ''), 120)), coalesce(value::VARCHAR, 'None') ORDER BY chunk_idx) AS n FROM g) WHERE n = 1)"""


@query(f"""WITH {_RECORDS} SELECT source, count(*) AS records, count(*) FILTER (grounded) AS grounded, count(*) FILTER (NOT grounded) AS ungrounded, count(value) AS numeric_records,
    count(*) FILTER (value IS NOT NULL AND grounded AND supported) AS values_grounded, count(*) FILTER (value IS NOT NULL AND NOT (grounded AND supported)) AS values_ungrounded FROM u GROUP BY source""")
def grounding_summary_by_source(spark, d):
    return X.grounding_summary(_records(spark, d), "source")


@query(f"WITH {_RECORDS} SELECT doc_id, chunk_idx::INT AS chunk_idx, subject, value, source_span, grounded FROM u")
def dedupe_records(spark, d):
    return _records(spark, d).select("doc_id", "chunk_idx", "subject", "value", "source_span", F.col("_grounded").alias("grounded"))


@query(rf"""SELECT item_id, doc_id FROM benchmark b JOIN documents d ON contains(lower({_CANON.format("d.text")}), lower({_CANON.format("b.text")})) WHERE regexp_matches(b.text, '\p{{L}}')""")
def ground_benchmark_in_documents(spark, d):
    b = table(spark, d, "benchmark").select("item_id", F.col("text").alias("span"))
    return X.contained_spans(b, table(spark, d, "documents"), "item_id").select("item_id", "doc_id")


@query(r"""WITH t AS (SELECT doc_id, source, list_distinct(list_filter(string_split(regexp_replace(regexp_replace(lower(trim(regexp_replace(text, '\s+', ' ', 'g'))), '([0-9])([a-z])', '\1 \2', 'g'), '[^a-z0-9 ]', ' ', 'g'), ' '), lambda x: x <> '')) AS s FROM documents)
    SELECT a.doc_id AS a, b.doc_id AS b, round(len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))), 6) AS similarity FROM t a JOIN t b ON a.source = b.source AND a.doc_id < b.doc_id
    WHERE len(a.s) > 0 AND len(b.s) > 0 AND len(list_intersect(a.s, b.s)) >= 0.5 * len(list_distinct(list_concat(a.s, b.s)))""")
def token_jaccard_neighbours(spark, d):
    """Token sets of whole texts, compared within a source."""
    return _token_neighbours(table(spark, d, "documents"))


def _token_neighbours(docs: DataFrame) -> DataFrame:
    sets = docs.select("doc_id", "source", T.token_set(F.col("text")).alias("s"))
    id_type = docs.schema["doc_id"].dataType
    pairs = N.similar_sets(sets, "source", "doc_id", "s")
    return pairs.select(*[F.col(c).cast(id_type).alias(c) for c in "ab"], F.round(F.col("k") / (F.col("na") + F.col("nb") - F.col("k")), 6).alias("similarity"))


_ENTRIES = """e AS (SELECT sha256(d.doc_id::VARCHAR) AS key, lang AS stage, source AS model, d.doc_id AS created_at, n_chars AS bytes, n_chars // 4 AS prompt_tokens, n_chars // 16 AS completion_tokens,
    CASE quality WHEN 1 THEN 'confirmed' WHEN 0 THEN 'suspect' END AS verdict FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _entries(spark, d) -> DataFrame:
    x = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return x.select(
        F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("lang").alias("stage"), F.col("source").alias("model"), F.col("doc_id").alias("created_at"), F.col("n_chars").alias("bytes"), F.expr("n_chars div 4").alias("prompt_tokens"), F.expr("n_chars div 16").alias("completion_tokens"),
        F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "suspect").alias("verdict"),
    )


_SUMS = "count(*) AS entries, sum(prompt_tokens)::BIGINT AS prompt_tokens, sum(completion_tokens)::BIGINT AS completion_tokens, sum(bytes)::BIGINT AS bytes FROM e"


@query(f"WITH {_ENTRIES} SELECT 'all' AS kind, 'all' AS name, {_SUMS} UNION ALL SELECT 'stage', coalesce(stage, 'unknown'), {_SUMS} GROUP BY 2 UNION ALL SELECT 'verdict', coalesce(verdict, 'unverified'), {_SUMS} GROUP BY 2")
def cache_summary(spark, d):
    return S.cache_summary(_entries(spark, d))


@query(f"WITH {_ENTRIES} SELECT key, created_at, bytes FROM e WHERE stage = 'en' AND verdict = 'confirmed' ORDER BY created_at DESC, key LIMIT 50")
def cache_query_filter(spark, d):
    return S.cache_query(_entries(spark, d), limit=50, stage="en", verdict="confirmed").select("key", "created_at", "bytes")


def _sample(name: str, order: str, where: str = "true"):
    @query(f"WITH {_ENTRIES} SELECT key, stage, created_at FROM e WHERE {where} ORDER BY {order}, key LIMIT 25")
    def run(spark, d):
        return S.cache_sample(_entries(spark, d), 25, name, seed=7).select("key", "stage", "created_at")

    QUERIES[f"cache_sample_{name}"], ORACLE_SQL[f"cache_sample_{name}"] = QUERIES.pop("run"), ORACLE_SQL.pop("run")


_sample("random", "sha256(key || '|7')")
_sample("unverified", "sha256(key || '|7')", "verdict IS NULL")
_sample("oldest", "created_at")
_sample("newest", "created_at DESC")
_sample("largest", "prompt_tokens + completion_tokens DESC")


@query("SELECT c.conv_id, c.turn, d.doc_id IS NOT NULL AND 400 - d.doc_id <= 300 AS hit FROM conversations c LEFT JOIN documents d ON d.doc_id = c.conv_id")
def cache_hit_miss(spark, d):
    entries = table(spark, d, "documents").select(F.sha2(F.col("doc_id").cast("string"), 256).alias("key"), F.col("doc_id").alias("created_at"), F.col("source").alias("answer"))
    requests = table(spark, d, "conversations").select("conv_id", "turn", F.sha2(F.col("conv_id").cast("string"), 256).alias("key"))
    return S.cache_lookup(requests, entries, F.lit(400), ttl=300).select("conv_id", "turn", "hit")


@query("SELECT doc_id, left(sha256(text), 32) AS content_hash FROM documents WHERE sha256(text) NOT IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def resume_left_anti(spark, d):
    return _resume(spark, d)[0].select("doc_id", "content_hash")


@query("SELECT doc_id, left(sha256(text), 32) AS content_hash FROM documents WHERE sha256(text) IN (SELECT sha256(text) FROM documents JOIN labels USING (doc_id))")
def resume_skipped_semi(spark, d):
    return _resume(spark, d)[1].select("doc_id", "content_hash")


def _resume(spark, d):
    docs = table(spark, d, "documents").select("doc_id", T.content_hash(F.col("text")).alias("content_hash"))
    return S.resume(docs, docs.join(table(spark, d, "labels"), "doc_id", "left_semi"))


@query("SELECT user_id, event_type, arg_max(value, event_id) AS value, arg_max(props, event_id) AS props, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def latest_task_upsert(spark, d):
    return S.latest(table(spark, d, "events").select("user_id", "event_type", "value", "props", "event_id"), ["user_id", "event_type"], "event_id")


@query("""WITH t AS (SELECT user_id, CASE event_id % 5 WHEN 0 THEN 'ok' WHEN 1 THEN 'failed' WHEN 2 THEN 'skipped' WHEN 3 THEN 'running' ELSE 'ok' END AS s FROM events)
    SELECT user_id, count(*) AS total, count(*) FILTER (s = 'ok') AS done, count(*) FILTER (s = 'failed') AS failed, count(*) FILTER (s = 'skipped') AS skipped, round(count(*) FILTER (s <> 'running') / count(*), 4) AS progress FROM t GROUP BY user_id""")
def job_progress_rollup(spark, d):
    s = F.element_at(F.array(*map(F.lit, ("ok", "failed", "skipped", "running", "ok"))), (F.col("event_id") % 5 + 1).cast("int"))
    return S.job_progress(table(spark, d, "events").select("user_id", s.alias("status")), "user_id")


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def dig_props(spark, d):
    return table(spark, d, "events").select("event_id", T.dig(F.col("props"), "k").cast("bigint").alias("k"))


@query("SELECT conv_id, list(role || ': ' || text ORDER BY turn) AS messages FROM conversations GROUP BY conv_id")
def messages_from_conversations(spark, d):
    return S.messages(table(spark, d, "conversations")).select("conv_id", F.transform("messages", lambda m: F.concat(m["role"], F.lit(": "), m["content"])).alias("messages"))


@query("SELECT (n // 10)::BIGINT AS batch, list(doc_id ORDER BY doc_id) AS members, count(*) AS size FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS n FROM documents) GROUP BY n // 10")
def gate_batches(spark, d):
    return S.gate_batches(table(spark, d, "documents").select("doc_id"), "doc_id", payload="doc_id")


@query("SELECT doc_id, coalesce(quality = 1, true) AS include, quality IS NULL AS unjudged FROM documents LEFT JOIN labels USING (doc_id)")
def gate_unjudged_left_join(spark, d):
    v = table(spark, d, "labels").select("doc_id", (F.col("quality") == 1).alias("include"), F.lit(0).alias("pos"))
    return S.gate_verdicts(table(spark, d, "documents").select("doc_id"), v, "doc_id")


@query("""WITH t AS (SELECT * FROM (VALUES (0, 'and'), (1, 'the'), (2, 'der')) v(term_idx, term)), f AS (SELECT doc_id, term_idx, row_number() OVER (PARTITION BY doc_id ORDER BY term_idx) AS n FROM documents JOIN t ON contains(text, term))
    SELECT doc_id, term_idx FROM f WHERE n = 1""")
def search_terms_union_dedupe(spark, d):
    """One scan: a document's terms as an array, of which the first counts."""
    hits = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(t).alias("t")) for i, t in enumerate(("and", "the", "der"))]), lambda x: F.contains("text", x["t"]))
    return table(spark, d, "documents").select("doc_id", F.get(hits, F.lit(0))["i"].alias("term_idx")).where("term_idx is not null")


@query(r"SELECT doc_id, array_to_string(list_filter(string_split(text, ' '), lambda x: x <> ''), ' ') AS abstract FROM documents WHERE contains(text, ' ')")
def inverted_index_rebuild(spark, d):
    """Each text's index of words and positions, and the text that it stands for."""

    @arrow_udf("map<string, array<int>>")
    def index_of(column: pa.Array) -> pa.Array:
        return T.word_index(column)

    docs = table(spark, d, "documents").where("contains(text, ' ')").select("doc_id", index_of("text").alias("index"))
    return docs.select("doc_id", T.rebuild_abstract(F.col("index")).alias("abstract"))


_PAIRS = """o AS (SELECT source AS key, CASE WHEN doc_id % 7 = 0 THEN 'old ' ELSE '' END || doc_id AS doc_id, n_chars, lang FROM documents), n AS (SELECT source AS key, CASE WHEN doc_id % 6 = 0 THEN 'new ' ELSE '' END || doc_id AS doc_id, CASE WHEN doc_id % 5 = 0 THEN n_chars * 2 ELSE n_chars END AS n_chars, CASE WHEN doc_id % 11 = 0 THEN 'xx' ELSE lang END AS lang FROM documents),
    m AS (SELECT coalesce(o.key, n.key) AS key, o.doc_id AS od, n.doc_id AS nd, ((CASE WHEN o.n_chars = n.n_chars THEN 1.0 ELSE 0.0 END) + (CASE WHEN o.lang = n.lang THEN 1.0 ELSE 0.0 END)) / 2 AS score FROM o FULL JOIN n ON o.key = n.key AND o.doc_id = n.doc_id),
    a AS (SELECT key, count(*) FILTER (od IS NOT NULL AND nd IS NOT NULL) AS shared, count(*) FILTER (od IS NULL) AS added, count(*) FILTER (nd IS NULL) AS removed, avg(CASE WHEN od IS NOT NULL AND nd IS NOT NULL THEN score END) AS f FROM m GROUP BY key),
    b AS (SELECT *, round(coalesce(0.5 * shared / (shared + added + removed) + 0.5 * f, shared / (shared + added + removed)), 4) AS agreement FROM a),
    v AS (SELECT *, CASE WHEN agreement >= 0.9 THEN 'confirmed' WHEN agreement >= 0.5 THEN 'drifted' ELSE 'suspect' END AS verdict FROM b)"""


def _compared(spark, d):
    x = table(spark, d, "documents").select(F.col("source").alias("key"), F.col("doc_id").cast("string").alias("signature"), F.col("doc_id").alias("pos"), F.col("n_chars").cast("double").alias("n"), "lang", "doc_id")
    sign = lambda n, w: F.concat(F.when(F.col("doc_id") % n == 0, w).otherwise(""), F.col("doc_id").cast("string"))
    new = x.withColumns({"signature": sign(6, "new "),"n": F.when(F.col("doc_id") % 5 == 0, F.col("n") * 2).otherwise(F.col("n")), "lang": F.when(F.col("doc_id") % 11 == 0, "xx").otherwise(F.col("lang"))})
    c = S.compare_records(x.withColumn("signature", sign(7, "old ")), new, ["n", "lang"], ("n",))
    return c.withColumn("verdict", S.verdict(F.col("agreement")))


@query(f"WITH {_PAIRS} SELECT key, shared, added, removed, agreement, verdict FROM v")
def compare_record_sets(spark, d):
    return _compared(spark, d).select("key", "shared", "added", "removed", "agreement", "verdict")


_P, _N = "(confirmed / sampled)", "sampled"
_HALF = f"1.96 * sqrt({_P} * (1 - {_P}) / {_N} + 1.96 * 1.96 / (4 * {_N} * {_N})) / (1 + 1.96 * 1.96 / {_N})"
_MID = f"({_P} + 1.96 * 1.96 / (2 * {_N})) / (1 + 1.96 * 1.96 / {_N})"


@query(f"""WITH {_PAIRS}, r AS (SELECT count(*) AS sampled, count(*) FILTER (verdict = 'confirmed') AS confirmed, count(*) FILTER (verdict = 'drifted') AS drifted, count(*) FILTER (verdict = 'suspect') AS suspect, 0::BIGINT AS error, round(avg(agreement), 4) AS mean_agreement FROM v)
    SELECT *, round({_P}, 4) AS pass_rate, round(greatest(0, least(1, {_MID} - {_HALF})), 4) AS ci_low, round(greatest(0, least(1, {_MID} + {_HALF})), 4) AS ci_high FROM r""")
def audit_report(spark, d):
    return S.audit_report(_compared(spark, d))


def _figures(spark, d):
    items = F.filter(F.transform(F.sequence(F.lit(1), F.lit(3)), lambda i: F.struct(i.cast("string").alias("label"), F.when((F.col("doc_id") + i) % 3 != 0, F.col("n_chars") * i.cast("double")).alias("value"), F.lit("mg").alias("unit"), F.lit(None).cast("string").alias("note"))), lambda x: x["label"].cast("int") <= F.col("doc_id") % 4)
    return table(spark, d, "documents").select("doc_id", "source", F.concat("source", F.lit(".png")).alias("image"), F.when(F.col("doc_id") % 8 == 0, "blurred").alias("notes"), items.alias("items"))


@query("""WITH i AS (SELECT doc_id, source, n_chars, unnest(range(1, greatest(2, doc_id % 4 + 1))) AS i FROM documents)
    SELECT doc_id, source || '.png' AS image, CASE WHEN doc_id % 4 > 0 THEN i::VARCHAR END AS label, CASE WHEN doc_id % 4 > 0 AND (doc_id + i) % 3 <> 0 THEN (n_chars * i)::DOUBLE END AS value, CASE WHEN doc_id % 4 > 0 THEN 'mg' END AS unit,
    CASE WHEN doc_id % 4 = 0 THEN CASE WHEN doc_id % 8 = 0 THEN 'blurred' ELSE 'no values were read out of this figure' END END AS note FROM i""")
def figure_rows_explode_outer(spark, d):
    return S.figure_rows(_figures(spark, d))


@query("SELECT source, count(*) AS figures, sum(doc_id % 4)::BIGINT AS items, sum(len(list_filter(range(1, doc_id % 4 + 1), lambda i: (doc_id + i) % 3 <> 0)))::BIGINT AS numeric_items FROM documents GROUP BY source")
def figure_summary(spark, d):
    return S.figure_summary(_figures(spark, d), "source")


@query(rf"""SELECT doc_id, doc_id || ' µg/mL of ' || lang AS fixed, CASE WHEN doc_id % 3 = 0 THEN NULL ELSE doc_id % 3 = 1 END AS agrees FROM documents""")
def unit_agreement(spark, d):
    v, r = F.col("doc_id").cast("double"), F.col("doc_id") % 3
    span = F.concat(F.lit("the titre was "), F.col("doc_id").cast("string"), F.element_at(F.array(F.lit(""), F.lit(" ug/mL"), F.lit(" mg/mL")), (r + 1).cast("int")))
    return table(spark, d, "documents").select("doc_id", T.fix_units(F.concat(F.col("doc_id").cast("string"), F.element_at(F.array(*map(F.lit, (" ug/ml of ", " � g / mL of ", " μg/mL of "))), (r + 1).cast("int")), F.col("lang"))).alias("fixed"), T.unit_agrees(v, F.lit("µg/mL"), span).alias("agrees"))


@query()
def salvage_truncated_json(spark, d):
    """Answers that are cut off: the complete records before the cut are saved."""
    from gleanspark.functions.answers import records_column

    whole = F.to_json(F.struct(F.transform(F.sequence(F.lit(1), F.lit(4)), lambda i: F.struct(i.alias("n"), F.col("text").alias("source_span"))).alias("records")))
    docs = table(spark, d, "documents").select("doc_id", whole.alias("w")).select("doc_id", F.expr("substring(w, 1, length(w) - 10 - doc_id % 60)").alias("answer"))
    return docs.select("doc_id", records_column(F.col("answer")).alias("p")).select("doc_id", F.size("p.records").alias("records"), "p.error")


@query()
def fuzzy_ground_benchmark(spark, d):
    """Benchmark passages, and these with damaged words, against all documents: the pairs in which one of the two is grounded."""
    return _fuzzy_pairs(table(spark, d, "documents"), table(spark, d, "benchmark"))


def _fuzzy_pairs(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    b = benchmark.select("item_id", F.col("text").alias("span"), F.regexp_replace("text", r"(\w)(\w)(\w+)", "$1$3").alias("damaged"))
    items = b.collect()
    # the search takes far longer than the reading: all cores get a part of the texts
    cores = docs.sparkSession.sparkContext.defaultParallelism
    docs = docs.select("doc_id", "text")
    docs = docs.repartition(2 * cores) if docs.rdd.getNumPartitions() < 2 * cores else docs
    spans = docs.sparkSession.sparkContext.broadcast([s for r in items for s in (r["span"], r["damaged"])])
    numbered = docs.sparkSession.createDataFrame([(i, *r) for i, r in enumerate(items)], b.select(F.lit(0).alias("at"), "*").schema)
    at = F.array_distinct(F.transform(X.possible_spans(F.col("text"), spans), lambda i: F.floor(i / 2).cast("int")))
    pairs = docs.select("doc_id", "text", F.explode(at).alias("at")).join(F.broadcast(numbered), "at")
    flagged = pairs.select("item_id", "doc_id", X.grounded(F.col("span"), F.col("text")).alias("grounded"), X.grounded(F.col("damaged"), F.col("text")).alias("damaged_grounded"))
    return flagged.where("grounded or damaged_grounded")
