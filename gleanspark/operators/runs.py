"""A run over a corpus as DataFrames: vision routing, calls on partitions, figures as text, totals, envelopes."""

from __future__ import annotations

import json
import random
import time
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIN_TEXT = 200
IMAGE_LIMIT = 12 << 20
FINDINGS, INSIGHTS = 10, 25
ITEM = "struct<label: string, series: string, value: double, value_text: string, unit: string, note: string>"
READING = f"struct<figure_type: string, caption: string, axis_x: string, axis_y: string, items: array<{ITEM}>, tables: array<struct<title: string, columns: array<string>, rows: array<array<string>>>>, text_blocks: array<string>, notes: string>"


def should_run_ocr(policy: str, has_text_layer: Column, text: Column, figures: Column, records: Column | None = None, ungrounded: Column | None = None) -> Column:
    """Whether a document's figures are read: never, always where there are any, or (auto) where its text is missing or short, or
    where the text pass found nothing or something without evidence (``records`` and ``ungrounded`` count these)."""
    if policy not in ("never", "always", "auto"):
        raise ValueError(f"unknown policy {policy!r}")
    if policy == "never":
        return F.lit(False)
    some = F.coalesce(F.size(figures), F.lit(0)) > 0
    if policy == "always":
        return some
    short = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"(?U)^\s+|\s+$", "")) < MIN_TEXT
    after = F.lit(False) if records is None else (records == 0) | (F.coalesce(ungrounded, F.lit(0)) > 0)
    return some & (~has_text_layer | short | F.coalesce(after, F.lit(False)))


def route(docs: DataFrame, policy: str = "auto") -> DataFrame:
    """docs with ``vision_first``: the figures are read at once, as there is no text to try."""
    blank = ~F.coalesce(F.col("text"), F.lit("")).rlike(r"(?U)\S")
    now = F.lit(policy == "always") | (F.lit(policy == "auto") & (~F.col("has_text_layer") | blank))
    return docs.withColumn("vision_first", now & (F.size("figures") > 0))


def within_image_limit(content: Column, most: int = IMAGE_LIMIT) -> Column:
    """struct(ok, note): images above the limit are left out with a note."""
    ok = F.length(content) <= most
    return F.struct(ok.alias("ok"), F.when(~ok, F.concat(F.lit("image too large: "), F.length(content).cast("string"), F.lit(" bytes"))).alias("note"))


def ocr_text(image: Column, reading: Column) -> Column:
    """A figure's reading (of type READING) as lines."""
    line = lambda name, v: F.when(F.coalesce(v, F.lit("")) != "", F.concat(F.lit(f"{name}: "), v))
    some = lambda v: F.nullif(v, F.lit(""))
    number = lambda v: F.when(v == F.floor(v), F.concat(v.cast("bigint").cast("string"), F.lit(".0"))).otherwise(v.cast("string"))
    item = lambda i: F.concat_ws(" ", some(i["label"]), F.when(some(i["series"]).isNotNull(), F.concat(F.lit("("), i["series"], F.lit(")"))), F.concat(F.lit("= "), F.coalesce(number(i["value"]), i["value_text"], F.lit("None"))), some(i["unit"]), F.when(some(i["note"]).isNotNull(), F.concat(F.lit("- "), i["note"])))
    row = lambda r: F.array_join(F.transform(r, lambda c: F.coalesce(c, F.lit(""))), " | ")
    table = lambda t: F.concat(F.array_compact(F.array(line("table", t["title"]), F.when(F.size(t["columns"]) > 0, row(t["columns"])))), F.transform(F.coalesce(t["rows"], F.array()), row))
    none = F.array().cast("array<string>")
    lines = F.concat(
        F.array_compact(F.array(F.concat(F.lit("[figure: "), F.coalesce(image, F.lit("?")), F.lit("]")), line("caption", reading["caption"]), line("axis_x", reading["axis_x"]), line("axis_y", reading["axis_y"]))),
        F.coalesce(F.transform(reading["items"], item), none), F.coalesce(F.flatten(F.transform(reading["tables"], table)), none), F.coalesce(reading["text_blocks"], none),
    )
    return F.array_join(lines, "\n")


def ocr_document_text(figures: DataFrame, by: str = "doc_id", order: str = "image") -> DataFrame:
    """All readings of a document, one block each, in order."""
    one = figures.select(by, order, ocr_text(F.col("image"), F.col("ocr")).alias("block"))
    return one.groupBy(by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(order, "block"))), lambda x: x["block"]), "\n\n").alias("ocr_text"))


def ocr_summary(figures: DataFrame, *by: str) -> DataFrame:
    items = F.coalesce(F.col("ocr.items"), F.array().cast(f"array<{ITEM}>"))
    return figures.groupBy(*by).agg(F.count("*").alias("figures"), F.sum(F.size(items)).alias("items"), F.sum(F.coalesce(F.size("ocr.tables"), F.lit(0))).alias("tables"), F.sum(F.size(F.filter(items, lambda i: i["value"].isNotNull()))).alias("numeric_items"))


def run_totals(results: DataFrame, *by: str) -> DataFrame:
    """Counts by outcome and sums over the documents that went well."""
    ok = F.col("status") == "ok"
    sums = [F.coalesce(F.sum(F.when(ok, F.col(c))), F.lit(0)).alias(c) for c in ("records", "figures", "prompt_tokens", "completion_tokens", "cached_calls") if c in results.columns]
    return results.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(ok).alias("ok"), F.count_if(F.col("status") == "skipped").alias("skipped"), F.count_if(~F.col("status").isin("ok", "skipped")).alias("failed"), *sums)


def gate_summary(verdicts: DataFrame, *by: str) -> DataFrame:
    include = F.coalesce(F.col("include"), F.lit(False))
    return verdicts.groupBy(*by).agg(F.count("*").alias("judged"), F.count_if(include).alias("included"), F.count_if(~include).alias("excluded"))


def job_counts(tasks: DataFrame, by: str = "job_id") -> DataFrame:
    """A job's counters, from its tasks instead of by increments, so that a repeated task can't count twice."""
    return tasks.groupBy(by).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(n) for s, n in (("ok", "done"), ("error", "failed"), ("skipped", "skipped"))])


def slim_record(fields: list[str]) -> Column:
    """A record's JSON for a prompt: no nulls, no flags, no id, at most 160 characters of evidence."""
    cols = [F.substring(c, 1, 160).alias(c) if c == "source_span" else F.col(c) for c in fields if not c.startswith("_") and c != "doc_id"]
    return F.to_json(F.struct(*cols))


def deterministic_envelope(records: DataFrame, figures: DataFrame, by: str = "doc_id", order: tuple[str, ...] = ("chunk_idx", "pos")) -> DataFrame:
    """(by, summary, key_findings, figure_insights, coverage_gaps) without a model's help.

    Findings are the first 10 grounded spans. A figure's numeric items are insights until there are 25 in all; the figure that
    reaches this is the last to give several, each later one with a numeric item gives its first. By definition of the report.
    """
    at = F.struct(*order)
    ok = F.coalesce(F.col("_grounded"), F.lit(False))
    # the first ten by order, folded without ever holding all of a document's records
    firsts = F.slice(F.array_sort(F.collect_list(F.when(ok & (F.coalesce("source_span", F.lit("")) != "") & (F.col("_nth") <= FINDINGS), F.struct(at.alias("at"), F.substring("source_span", 1, 200).alias("span"))))), 1, FINDINGS)
    from pyspark.sql import Window as W

    usable = ok & (F.coalesce("source_span", F.lit("")) != "")
    ranked = records.withColumn("_nth", F.row_number().over(W.partitionBy(by, usable).orderBy(*order)))
    r = ranked.groupBy(by).agg(F.count("*").alias("records"), F.count_if(ok).alias("grounded"), F.count_if(~F.col("_value_grounded")).alias("values_ungrounded"), firsts.alias("first"))
    numeric = F.filter(F.col("ocr.items"), lambda i: i["value"].isNotNull())
    f = figures.select(by, "image", F.coalesce(numeric, F.array().cast(f"array<{ITEM}>")).alias("items"))
    before = F.coalesce(F.sum(F.size("items")).over(W.partitionBy(by).orderBy("image").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    f = f.withColumn("before", before).withColumn("used", F.slice("items", F.lit(1), F.greatest(F.lit(1), F.lit(INSIGHTS) - F.col("before")).cast("int")))
    insight = F.transform("used", lambda i: F.struct(F.col("image"), F.coalesce(i["label"], F.lit("")).alias("finding"), i["value"].alias("value"), i["unit"].alias("unit")))
    g = f.groupBy(by).agg(F.count("*").alias("figures"), F.sum(F.size("items")).alias("numeric_items"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("image", insight.alias("x")))), lambda z: z["x"])).alias("figure_insights"))
    both = r.join(g, by, "full_outer").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("records", "grounded", "values_ungrounded", "figures", "numeric_items")})
    gap = F.when(F.col("values_ungrounded") > 0, F.array(F.concat(F.col("values_ungrounded").cast("string"), F.lit(" numeric values could not be traced to their quoted evidence"))))
    return both.select(
        by, F.format_string("%d records extracted (%d grounded); %d figures read yielding %d numeric readings.", "records", "grounded", "figures", "numeric_items").alias("summary"),
        F.coalesce(F.transform("first", lambda x: x["span"]), F.array().cast("array<string>")).alias("key_findings"), F.coalesce("figure_insights", F.array()).alias("figure_insights"), F.coalesce(gap, F.array().cast("array<string>")).alias("coverage_gaps"),
    )


# -- calls -----------------------------------------------------------------------------------------------------------------


class CallError(RuntimeError):
    """status: the answer's HTTP status, if there was one; 4xx other than 429 isn't tried again."""

    def __init__(self, message: str, status: int | None = None):
        super().__init__(message)
        self.status = status


class Bucket:
    """A token bucket that starts full: so many calls a minute, shared out over partitions by the caller."""

    def __init__(self, per_minute: float, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.rate, self.size, self.clock, self.sleep = per_minute / 60, max(1.0, per_minute), clock, sleep
        self.tokens, self.at = self.size, clock()

    def take(self) -> None:
        while self.rate > 0:
            now = self.clock()
            self.tokens, self.at = min(self.size, self.tokens + (now - self.at) * self.rate), now
            if self.tokens >= 1:
                self.tokens -= 1
                return
            self.sleep((1 - self.tokens) / self.rate)


def with_retries(call: Callable[[], dict], attempts: int = 3, backoff: float = 1.5, jitter: float = 0.3, refresh: Callable[[], None] | None = None, sleep: Callable[[float], None] = time.sleep) -> tuple[dict | None, int, str | None]:
    """(answer, attempts made, error): 401 and 403 renew the access once, other client errors end it, the rest is tried again later."""
    renewed = False
    for n in range(1, attempts + 1):
        try:
            return call(), n, None
        except CallError as e:
            error, status = str(e), e.status
            if status in (401, 403) and refresh and not renewed:
                renewed = True
                refresh()
                continue
            if status is not None and 400 <= status < 500 and status != 429:
                return None, n, error
        except Exception as e:  # noqa: BLE001 - a call's failure is a row's error, never a task's
            error = f"{type(e).__name__}: {e}"
        if n < attempts:
            sleep(backoff ** (n - 1) + random.random() * jitter)
    return None, attempts, error


CHAT, RESPONSES = "chat", "responses"


def request_body(api: str, model: str, messages: list[dict], temperature: float = 0.0, max_tokens: int = 4000, schema: dict | None = None) -> dict:
    """The body of a call in either wire format; in the second, system messages are instructions."""
    if api == CHAT:
        shape = {"response_format": {"type": "json_schema", "json_schema": {"name": "records", "strict": True, "schema": schema}}} if schema else {}
        return {"model": model, "messages": messages, "temperature": temperature, "max_tokens": max_tokens, **shape}
    if api == RESPONSES:
        told = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
        shape = {"text": {"format": {"type": "json_schema", "name": "records", "strict": True, "schema": schema}}} if schema else {}
        return {"model": model, "input": [m for m in messages if m["role"] != "system"], "temperature": temperature, "max_output_tokens": max_tokens, **({"instructions": told} if told else {}), **shape}
    raise ValueError(f"unknown interface {api!r}")


def answer_text(api: str, raw: dict) -> str:
    from gleanspark.functions.answers import response_text

    return (((raw.get("choices") or [{}])[0].get("message") or {}).get("content") or "") if api == CHAT else response_text(raw)


def complete(requests: DataFrame, provider: Callable[[], Callable[[dict], dict]], key: str = "key", body: str = "body", api: str = CHAT, per_minute: float = 0, attempts: int = 3) -> DataFrame:
    """(key, answer, prompt_tokens, completion_tokens, attempts, error) by request: calls on partitions, failures as data.

    ``provider`` makes a client once a partition; a client takes the body of a request and returns the raw answer. The rate is
    shared evenly by the partitions. ``key`` is what the call cache joins on, so only misses need come here.
    """
    parts = max(1, requests.rdd.getNumPartitions()) if per_minute else 1

    def run(batches):
        from gleanspark.functions.answers import usage_from

        client, bucket = provider(), Bucket(per_minute / parts)
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in b.column(1).to_pylist():

                def call(text=text):
                    bucket.take()
                    return client(json.loads(text))

                raw, n, error = with_retries(call, attempts)
                used = usage_from(raw or {})
                for c, v in zip(out, (None if raw is None else answer_text(api, raw), used["prompt_tokens"], used["completion_tokens"], n, error)):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(out, (pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string())))], ["key", "answer", "prompt_tokens", "completion_tokens", "attempts", "error"])

    kind = requests.schema[key].dataType.simpleString()
    return requests.select(key, body).mapInArrow(run, f"key {kind}, answer string, prompt_tokens long, completion_tokens long, attempts int, error string")


def cached_complete(requests: DataFrame, entries: DataFrame, provider, now: Column, ttl: float = 0, bypass: bool = False, **how) -> DataFrame:
    """``complete`` through the call cache: (key, answer, prompt_tokens, completion_tokens, cached, attempts, error); equal calls are made once."""
    from gleanspark.operators.state import cache_lookup

    looked = cache_lookup(requests.dropDuplicates(["key"]), entries, now, ttl, bypass)
    hits = looked.where("hit").select("key", "answer", F.lit(0).cast("long").alias("prompt_tokens"), F.lit(0).cast("long").alias("completion_tokens"), F.lit(True).alias("cached"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("error"))
    made = complete(looked.where("not hit"), provider, **how).select("key", "answer", "prompt_tokens", "completion_tokens", F.lit(False).alias("cached"), "attempts", "error")
    return hits.unionByName(made)
