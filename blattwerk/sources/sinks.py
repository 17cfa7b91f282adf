"""Writing: front matter with text, the action log, bibliographies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from blattwerk.operators.log import COLUMNS


def json_value(value: Column) -> Column:
    """A string as JSON, null as ``null``."""
    inner = F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("v"))), r'(?s)^\{"v":(.*)\}$', 1)
    return F.when(value.isNull(), "null").otherwise(inner)


def with_front_matter(head: Column, order: list[str], body: Column) -> Column:
    """A document: ``key: json`` lines of ``head`` in ``order`` where present, then the body."""
    has = lambda k: F.map_contains_key(head, k)
    lines = [F.when(has(k), F.concat(F.lit(f"{k}: "), json_value(F.try_element_at(head, F.lit(k))))) for k in order]
    return F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n\n"), body)


def write_documents(docs: DataFrame, folder: str, text: str = "text", target: str = "target") -> None:
    """One row a document as text files, in a folder for each target (done, review)."""
    docs.select(target, F.col(text).alias("value")).write.partitionBy(target).mode("append").text(folder, lineSep="\n")


def append_log(rows: DataFrame, path: str) -> None:
    """Rows appended to the log; missing columns and nulls as the empty string."""
    cols = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in COLUMNS]
    rows.select(*cols).write.mode("append").csv(path, sep=";", header=True, emptyValue="")


def write_bibliography(entries: DataFrame, path: str, column: str = "eintrag") -> None:
    """Entries as one BibTeX file with their number at the top."""
    head = entries.agg(F.concat(F.lit("% "), F.count("*").cast("string"), F.lit(" Einträge")).alias("value")).withColumn("o", F.lit(0))
    body = entries.select(F.col(column).alias("value")).withColumn("o", F.lit(1))
    head.unionByName(body).orderBy("o", "value").select("value").coalesce(1).write.mode("overwrite").text(path)
