"""Call cache, audit, jobs and tasks, gate and figures as DataFrame operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from gleanspark.functions import text as T


def cache_query(entries: DataFrame, limit: int | None = None, **equal) -> DataFrame:
    """Entries of the given column values, newest first (ties by key)."""
    for c, v in equal.items():
        if v is not None:
            entries = entries.where(F.col(c) == v)
    out = entries.orderBy(F.desc("created_at"), "key")
    return out.limit(limit) if limit else out


def cache_sample(entries: DataFrame, n: int, strategy: str = "random", seed: int = 0) -> DataFrame:
    """n entries: random by hash of key and seed, oldest, newest, largest by tokens, or unverified ones at random."""
    shuffled = F.sha2(F.concat("key", F.lit(f"|{seed}")), 256)
    order = {"random": [shuffled], "unverified": [shuffled], "oldest": [F.col("created_at")], "newest": [F.desc("created_at")], "largest": [F.desc(F.col("prompt_tokens") + F.col("completion_tokens"))]}
    if strategy not in order:
        raise ValueError(f"unknown strategy {strategy!r}")
    if strategy == "unverified":
        entries = entries.where("verdict is null")
    return entries.orderBy(*order[strategy], "key").limit(n)


def cache_summary(entries: DataFrame) -> DataFrame:
    """Counts and sums in all, by stage and by verdict, in one pass."""
    e = entries.select(F.coalesce("stage", F.lit("unknown")).alias("stage"), F.coalesce("verdict", F.lit("unverified")).alias("verdict"), "prompt_tokens", "completion_tokens", "bytes")
    grouped = e.groupingSets([[], ["stage"], ["verdict"]], "stage", "verdict").agg(F.grouping_id().alias("g"), F.count("*").alias("entries"), F.sum("prompt_tokens").alias("prompt_tokens"), F.sum("completion_tokens").alias("completion_tokens"), F.sum("bytes").alias("bytes"))
    kind = F.when(F.col("g") == 3, "all").when(F.col("g") == 1, "stage").otherwise("verdict")
    return grouped.select(kind.alias("kind"), F.coalesce("stage", "verdict", F.lit("all")).alias("name"), "entries", "prompt_tokens", "completion_tokens", "bytes")


def cache_lookup(requests: DataFrame, entries: DataFrame, now: Column, ttl: float = 0, bypass: bool = False) -> DataFrame:
    """Requests with their answer and whether it is a hit; entries older than ttl (if over 0) and all under bypass are misses."""
    live = entries.where(F.lit(False)) if bypass else entries.where(now - F.col("created_at") <= ttl) if ttl > 0 else entries
    return requests.join(live.select("key", F.col("answer")), "key", "left").withColumn("hit", F.col("answer").isNotNull())


def upsert(old: DataFrame, new: DataFrame, keys: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Rows by key: non-null new values replace old ones, except in the columns to keep."""
    n = new.select(*keys, *[F.col(c).alias(f"_new_{c}") for c in new.columns if c not in keys], F.lit(True).alias("_is_new"))
    cols = [F.coalesce(c, f"_new_{c}").alias(c) if c in keep else F.coalesce(f"_new_{c}", c).alias(c) if c in new.columns else F.col(c) for c in old.columns if c not in keys]
    return old.join(n, keys, "full_outer").select(*keys, *cols)


def invalidate(entries: DataFrame, keys: DataFrame) -> DataFrame:
    return entries.join(keys.select("key").distinct(), "key", "left_anti")


def latest(updates: DataFrame, keys: list[str], at: str) -> DataFrame:
    """By key, each column's last value that isn't null."""
    others = [c for c in updates.columns if c not in (*keys, at)]
    return updates.groupBy(*keys).agg(*[F.max_by(F.when(F.col(c).isNotNull(), F.col(c)), F.when(F.col(c).isNotNull(), F.col(at))).alias(c) for c in others], F.max(at).alias(at))


def completed_hashes(tasks: DataFrame, jobs: DataFrame, source: str = "") -> DataFrame:
    j = jobs.where(F.col("source") == source) if source else jobs
    done = tasks.where("status = 'ok' and content_hash is not null").join(j.select(F.col("id").alias("job_id")), "job_id", "left_semi")
    return done.groupBy("content_hash").agg(F.max_by("artifact", "updated_at").alias("artifact"))


def resume(docs: DataFrame, done: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(documents to do, documents to skip) by content hash."""
    d = done.select("content_hash").distinct()
    return docs.join(d, "content_hash", "left_anti"), docs.join(d, "content_hash", "left_semi")


def job_progress(tasks: DataFrame, *by: str) -> DataFrame:
    s = F.col("status")
    out = tasks.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(s == "ok").alias("done"), F.count_if(s.isin("failed", "cancelled")).alias("failed"), F.count_if(s == "skipped").alias("skipped"))
    return out.withColumn("progress", T.ratio(F.col("done") + F.col("failed") + F.col("skipped"), F.col("total")))


def compare_records(old: DataFrame, new: DataFrame, fields: list[str], numeric: tuple[str, ...] = (), entry: str = "key") -> DataFrame:
    """By entry: shared, added, removed records by signature, agreement of sets and fields and their mean; of equal signatures the last record counts."""
    def side(d, tag):
        return d.groupBy(entry, "signature").agg(F.max_by(F.struct(*fields), "pos").alias(tag))

    both = side(old, "o").join(side(new, "n"), [entry, "signature"], "full_outer")
    shared = F.col("o").isNotNull() & F.col("n").isNotNull()
    score = sum((T.value_agreement(F.col(f"o.{f}"), F.col(f"n.{f}"), f in numeric) for f in fields), F.lit(0.0)) / len(fields)
    out = both.groupBy(entry).agg(F.count_if(shared).alias("shared"), F.count_if(F.col("o").isNull()).alias("added"), F.count_if(F.col("n").isNull()).alias("removed"), F.avg(F.when(shared, score)).alias("field_agreement"))
    sets = F.col("shared") / (F.col("shared") + F.col("added") + F.col("removed"))
    return out.withColumn("set_agreement", sets).withColumn("agreement", F.round(F.coalesce(0.5 * sets + 0.5 * F.col("field_agreement"), sets), 4))


def verdict(agreement: Column, failed: Column | None = None) -> Column:
    v = F.when(agreement >= 0.9, "confirmed").when(agreement >= 0.5, "drifted").otherwise("suspect")
    return v if failed is None else F.when(failed, "error").otherwise(v)


def audit_report(audits: DataFrame) -> DataFrame:
    v = F.col("verdict")
    out = audits.agg(F.count("*").alias("sampled"), *[F.count_if(v == k).alias(k) for k in ("confirmed", "drifted", "suspect", "error")], F.round(F.avg(F.when(v != "error", F.col("agreement"))), 4).alias("mean_agreement"))
    ci = T.wilson_interval(F.col("confirmed").cast("double"), F.col("sampled").cast("double"))
    return out.withColumns({"pass_rate": T.ratio(F.col("confirmed"), F.col("sampled")), "ci_low": ci["low"], "ci_high": ci["high"]})


def numbered(rows: DataFrame, order: str, width: int = 1 << 16, name: str = "index") -> DataFrame:
    """rows with their number from 0 in the order of an integer column, without one task for all: numbers within ranges of
    ``width`` values, plus the counts of the ranges before. Ties are in no set order; a null order comes first."""
    bucket = F.coalesce(F.floor(F.col(order) / width), F.lit(-(2**62)))
    sizes = rows.groupBy(bucket.alias("_bucket")).agg(F.count("*").alias("_n"))
    before = sizes.select("_bucket", F.coalesce(F.sum("_n").over(W.orderBy("_bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    inside = rows.withColumn("_bucket", bucket).withColumn("_inside", F.row_number().over(W.partitionBy("_bucket").orderBy(order)) - 1)
    return inside.join(before, "_bucket").withColumn(name, F.col("_before") + F.col("_inside")).drop("_bucket", "_inside", "_before")


def gate_batches(records: DataFrame, order: str, size: int = 10, payload: str = "id") -> DataFrame:
    """The whole list in groups of consecutive records, one call each."""
    n = numbered(records, order)
    return n.groupBy(F.floor(F.col("index") / size).alias("batch")).agg(F.array_sort(F.collect_list(payload)).alias("members"), F.count("*").alias("size"))


def mark(entries: DataFrame, verdicts: DataFrame) -> DataFrame:
    """entries with the verdict, agreement and time of verdicts(key, verdict, agreement, verified_at) written back; others keep theirs."""
    own = [c for c in ("verdict", "agreement", "verified_at") if c in entries.columns]
    v = verdicts.select("key", *[F.col(c).alias(f"_{c}") for c in own], F.lit(True).alias("_marked"))
    return entries.join(v, "key", "left").select(*[F.when(F.col("_marked"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) if c in own else F.col(c) for c in entries.columns])


def clear(entries: DataFrame) -> DataFrame:
    """No entry at all, in the same shape."""
    return entries.where(F.lit(False))


def list_rows(rows: DataFrame, newest: str, limit: int | None = None, **equal) -> DataFrame:
    """Jobs or tasks of the given column values, newest first; the limit is the option's."""
    for c, v in equal.items():
        if v is not None:
            rows = rows.where(F.col(c) == v)
    out = rows.orderBy(F.desc(newest), *[c for c in ("id", "job_id", "doc_id") if c in rows.columns])
    return out.limit(limit) if limit else out


def find(rows: DataFrame, **key) -> DataFrame:
    """The rows of a key: a filter that reaches the scan."""
    for c, v in key.items():
        rows = rows.where(F.col(c) == v)
    return rows


def gate_verdicts(records: DataFrame, verdicts: DataFrame, key: str = "id") -> DataFrame:
    """Every record stays: one without a verdict is included and marked unjudged."""
    v = verdicts.groupBy(key).agg(F.max_by("include", "pos").alias("include"))
    out = records.join(v, key, "left")
    return out.withColumns({"unjudged": F.col("include").isNull(), "include": F.coalesce("include", F.lit(True))})


def figure_rows(figures: DataFrame) -> DataFrame:
    """A row for each item of a figure; a figure without items has one, with its notes."""
    f = figures.select("doc_id", "image", "notes", F.explode_outer("items").alias("item"))
    return f.select("doc_id", "image", F.col("item.label").alias("label"), F.col("item.value").alias("value"), F.col("item.unit").alias("unit"), F.when(F.col("item").isNull(), F.coalesce("notes", F.lit("no values were read out of this figure"))).otherwise(F.col("item.note")).alias("note"))


def figure_summary(figures: DataFrame, *by: str) -> DataFrame:
    return figures.groupBy(*by).agg(F.count("*").alias("figures"), F.sum(F.greatest(F.size("items"), F.lit(0))).alias("items"), F.sum(F.size(F.filter("items", lambda i: i["value"].isNotNull()))).alias("numeric_items"))


def first_term_wins(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Results of several search terms, one row a document: that of the first term."""
    return found.withColumn("_n", F.row_number().over(W.partitionBy(key).orderBy("term_idx", "pos"))).where("_n = 1").drop("_n")


def search_terms(lines: DataFrame) -> DataFrame:
    """Terms of a list: blank lines and comments go, the first spelling of each stays. lines: (pos, line)."""
    t = lines.withColumn("term", F.btrim(F.regexp_replace("line", r"(?U)\s+", " "))).where("term != '' and not startswith(term, '#')")
    return t.groupBy(F.lower("term").alias("k")).agg(F.min_by("term", "pos").alias("term"), F.min("pos").alias("pos")).select("pos", "term")


def messages(turns: DataFrame) -> DataFrame:
    """Conversations as ordered arrays of (role, content)."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))
