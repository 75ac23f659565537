"""Documents from folders: a binaryFile scan, ids from paths, formats from content, text by the readers."""

from __future__ import annotations

from collections.abc import Iterable
from urllib.parse import quote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.sources import formats, readers


def _glob(suffixes: Iterable[str]) -> str:
    """A Hadoop glob for suffixes in any case."""
    each = ("".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in s) for s in suffixes)
    return "*{" + ",".join(each) + "}"


def discover(spark: SparkSession, folder: str, suffixes: Iterable[str] | None = None, limit: int = 0) -> DataFrame:
    """(path, name, suffix, length, content) of the files below a folder, or of one file.

    With suffixes (any case, dot optional) those files; without, all that aren't never documents and whose suffix or content is
    known. Names that begin with a dot are left out, and so are empty files, which Spark's scan never shows. A limit takes the first paths in order: the option's meaning.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    wanted = None if suffixes is None else ["." + s.lower().lstrip(".") for s in suffixes]
    if wanted is not None:
        reader = reader.option("pathGlobFilter", _glob(wanted))
    name = F.element_at(F.split("path", "/"), -1)
    found = reader.load(folder).withColumn("name", name).withColumn("suffix", formats.suffix_of(F.col("path"))).where(~F.col("name").startswith("."))
    if wanted is not None:
        found = found.where(F.col("suffix").isin(*wanted))
    else:
        found = found.where(~F.col("suffix").isin(*formats.SKIPPED)).where(formats.detected(F.col("content"), F.col("suffix")).isNotNull())
    found = found.select("path", "name", "suffix", "length", "content")
    return found.orderBy("path").limit(limit) if limit else found


def relative_path(path: Column, folder: str) -> Column:
    """A path below the folder, without scheme and with % codes as they are."""
    bare = F.regexp_replace(path, "^[a-z0-9]+:/*(?=/)", "")
    root = folder.split("://", 1)[-1].removeprefix("file:").rstrip("/") + "/"
    inside = F.when(F.startswith(bare, F.lit(root)), F.substr(bare, F.lit(len(root) + 1))).when(F.startswith(bare, F.lit(quote(root))), F.substr(bare, F.lit(len(quote(root)) + 1)))
    return F.coalesce(inside, F.element_at(F.split(path, "/"), -1))


def doc_id_of(relative: Column) -> Column:
    """Folders and the stem joined by two underscores, spaces as one."""
    stem = F.regexp_replace(relative, r"(?<=[^/])\.[^./]+$", "")
    return F.replace(F.replace(F.replace(stem, F.lit("/"), F.lit("__")), F.lit(" "), F.lit("_")), F.lit("%20"), F.lit("_"))


def folder_source(spark: SparkSession, folder: str, suffixes: Iterable[str] | None = None, limit: int = 0, source_name: str = "folder") -> DataFrame:
    """Documents of a folder, one a file: doc_id, title, uri, path, media_type, metadata, source_name, content, content_hash."""
    found = discover(spark, folder, formats.supported_suffixes() if suffixes is None else suffixes, limit)
    rel = relative_path(F.col("path"), folder)
    return found.select(
        doc_id_of(rel).alias("doc_id"), F.regexp_replace("name", r"(?<=.)\.[^.]+$", "").alias("title"), F.col("path").alias("uri"), "path", F.ltrim(F.col("suffix"), F.lit(".")).alias("media_type"),
        F.create_map(F.lit("relative_path"), rel, F.lit("bytes"), F.col("length").cast("string")).alias("metadata"), F.lit(source_name).alias("source_name"), "content", T.content_hash(F.col("content")).alias("content_hash"),
    )


def load_documents(docs: DataFrame, content: str = "content", path: str = "path", text: str | None = None, with_figures: bool = False, most_figures: int = 20) -> DataFrame:
    """docs with format, text, read_error, has_text_layer and figures (array of image and content).

    Rows that have a text already (``text`` names the column) keep it. A file that can't be read has its figures looked for and
    read_error set; without any figure its error is a failure: status 'failed', else 'ok'. No file fails a task.
    """
    c, suffix = F.col(content), formats.suffix_of(F.col(path))
    given = F.col(text) if text else F.lit(None).cast("string")
    out = docs.withColumn("_given", given).withColumn("_suffix", suffix).withColumn("format", F.when(F.col("_given").isNotNull(), "plain").otherwise(formats.detected(c, F.col("_suffix"))))
    out = out.withColumn("_read", F.when(F.col("_given").isNull(), readers.text_of(F.when(F.col("_given").isNull(), F.col("format")), F.when(F.col("_given").isNull(), c), F.col("_suffix"))))
    self_kinds = [f.name for f in formats.FORMATS.values() if f.figures == "self"]
    wants = F.lit(with_figures) | F.col("format").isin(*self_kinds) | F.col("_read.error").isNotNull()
    name = F.element_at(F.split(F.col(path), "/"), -1)
    out = out.withColumn("figures", readers.figures_of(F.when(wants, F.col("format")), c, name, most_figures))
    error = F.col("_read.error")
    image_kinds = [f.name for f in formats.FORMATS.values() if not f.text_layer]
    return (
        out.withColumn("text", F.coalesce("_given", "_read.text", F.lit("")))
        .withColumn("read_error", error)
        .withColumn("has_text_layer", ~F.coalesce(F.col("format").isin(*image_kinds), F.lit(False)) & error.isNull())
        .withColumn("status", F.when(error.isNotNull() & (F.size("figures") == 0), "failed").otherwise("ok"))
        .drop("_given", "_suffix", "_read")
    )


def load_records(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Records of one JSONL file, or of all ``*.records.jsonl`` in a folder."""
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.json(path if path.endswith(".jsonl") else f"{path.rstrip('/')}/*.records.jsonl")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with header, all columns as text and empty cells as empty text; a byte-order mark is no part of the first name."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"', encoding="UTF-8")
    names = [c.lstrip("\ufeff").strip('"') if i == 0 else c for i, c in enumerate(df.columns)]
    return df.select(*[F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(n) for c, n in zip(df.columns, names)])
