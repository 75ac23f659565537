"""Results as files: records and figures as CSV with exact columns, JSON lines, one folder of artifacts, a summary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanspark.functions import text as T
from gleanspark.operators.templates import Template

FIRST = ("doc_id", "doc_title")
LAST = ("_grounded", "_value_grounded", "_unit_grounded", "_ungrounded")
FIGURE_COLUMNS = ("doc_id", "doc_title", "image", "figure_type", "caption", "axis_x", "axis_y", "series", "label", "value", "value_text", "unit", "note")
MARK = "\ufeff"


def record_columns(template: Template) -> list[str]:
    """Where a record comes from, the template's fields, then the flags."""
    return [*FIRST, *(f.name for f in template.fields if f.name not in FIRST), *LAST]


def cells(df: DataFrame, columns) -> DataFrame:
    """The columns in order, as the text of table cells; those that df lacks are empty."""
    kinds = dict(df.dtypes)
    return df.select(*[(T.cell(F.col(c), kinds[c]) if c in kinds else F.lit("")).alias(c) for c in columns])


def csv_lines(df: DataFrame, columns) -> DataFrame:
    """(line): rows as CSV lines with quotes where they are needed."""
    t = cells(df, columns)
    quoted = [F.when(F.col(c).rlike('[",\r\n]'), F.concat(F.lit('"'), F.replace(F.col(c), F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.col(c)) for c in columns]
    return t.select(F.concat_ws(",", *quoted).alias("line"))


def write_csv(df: DataFrame, path: str, columns, mode: str = "overwrite") -> None:
    """A folder of CSV parts, each with the header and a byte-order mark, written by all tasks. mode append adds parts."""
    t = cells(df, columns)
    t.toDF(MARK + columns[0], *columns[1:]).write.mode(mode).csv(path, header=True, quote='"', escape='"', emptyValue="", encoding="UTF-8")


def write_records_csv(records: DataFrame, template: Template, path: str, mode: str = "overwrite") -> None:
    write_csv(records, path, record_columns(template), mode)


def write_figures_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> None:
    write_csv(rows, path, list(FIGURE_COLUMNS), mode)


def export_csv(df: DataFrame, path: str, columns) -> None:
    """One CSV file by the driver, partition after partition: for hand-over, not for tables beyond a disk."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        f.write(",".join(columns) + "\r\n")
        for r in csv_lines(df, columns).toLocalIterator():
            f.write(r["line"] + "\r\n")


def write_artifacts(records: DataFrame, figures: DataFrame, envelopes: DataFrame, template: Template, folder: str, formats: str = "both") -> None:
    """Tables below a folder, each partitioned by document: records as JSON lines and/or CSV, figure rows as CSV, documents as JSON."""
    if formats not in ("jsonl", "csv", "both"):
        raise ValueError("formats is jsonl, csv or both")
    if formats != "csv":
        records.withColumn("_doc", F.col("doc_id")).write.mode("overwrite").partitionBy("_doc").json(f"{folder}/records.jsonl", ignoreNullFields=False)
    if formats != "jsonl":
        write_records_csv(records, template, f"{folder}/records.csv")
    write_figures_csv(figures, f"{folder}/figures.csv")
    envelopes.withColumn("_doc", F.col("doc_id")).write.mode("overwrite").partitionBy("_doc").json(f"{folder}/documents.json", ignoreNullFields=False)


def write_summary(totals: DataFrame, path: str) -> None:
    """A run's totals as JSON."""
    totals.coalesce(1).write.mode("overwrite").json(path)
