"""Sinks: JSON lines, CSV, documents, matrices, reports, logs with markers of completion."""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradus.sources.scans import path_exists


def write_json_lines(df: DataFrame, path: str) -> None:
    """Replaces a table of JSON lines; other than ASCII is written as it is."""
    df.write.mode("overwrite").json(path)


def append_json_lines(df: DataFrame, path: str) -> None:
    """Adds finished units of work to a log."""
    df.write.mode("append").json(path)


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None) -> bool:
    """One CSV file with a header in the order of ``columns``; nothing is written for no rows."""
    df = df.select(*columns) if columns else df
    if df.isEmpty():
        return False
    df.coalesce(1).write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"').csv(path)
    return True


def write_new(df: DataFrame, path: str) -> None:
    """Refuses to write where something is."""
    df.write.mode("errorifexists").json(path)


def pretty_json(df: DataFrame) -> str:
    """A one-row table as an indented document."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a document is made of one row")
    return json.dumps(rows[0].asDict(recursive=True), ensure_ascii=False, indent=2)


def percent_text(share: Column) -> Column:
    """A share as percent with six decimals, empty where there is none."""
    return F.when(share.isNull(), "").otherwise(F.format_string("%.6f", 100 * share))


def matrix(accuracy: DataFrame, domains: tuple[str, ...], text: bool = True) -> DataFrame:
    """(strategy, stage) rows with a column for each domain; with doubles also their average."""
    wide = accuracy.groupBy("strategy", "stage").pivot("domain", list(domains)).agg(F.first("accuracy"))
    if text:
        return wide.select("strategy", "stage", *[percent_text(F.col(d)).alias(d) for d in domains])
    mean = accuracy.groupBy("strategy", "stage").agg((100 * F.avg("accuracy")).alias("average_seen"))
    return wide.select("strategy", "stage", *[(100 * F.col(d)).alias(d) for d in domains]).join(mean, ["strategy", "stage"])


def markdown_table(df: DataFrame, limit: int = 1000) -> str:
    """A small result as a Markdown table; larger ones raise, reports are for people."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"a report has {limit} rows at most")
    show = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", "<br>")
    head = ["| " + " | ".join(df.columns) + " |", "| " + " | ".join("---" for _ in df.columns) + " |"]
    return "\n".join([*head, *("| " + " | ".join(show(v) for v in r) + " |" for r in rows)])


def rewrite_filtered(df: DataFrame, keep: Column, path: str, backup: str) -> tuple[int, int]:
    """Copies a log once to ``backup`` and writes what is kept to ``path``; returns (kept, dropped).

    The table read must not lie at ``path``: a log is never rewritten in place.
    """
    spark = df.sparkSession
    plain = lambda p: re.sub(r"^\w+:/*", "/", p).rstrip("/")
    if any(plain(f).startswith(plain(path) + "/") for f in df.inputFiles()):
        raise ValueError("write the repaired log to another path")
    if not path_exists(spark, backup):
        df.write.json(backup)
    counts = df.agg(F.count_if(keep).alias("kept"), F.count_if(~F.coalesce(keep, F.lit(False))).alias("dropped")).first()
    df.where(keep).write.mode("overwrite").json(path)
    return counts["kept"], counts["dropped"]


def is_complete(spark, path: str) -> bool:
    """Whether a unit of work left its marker of completion."""
    return path_exists(spark, f"{path}/_SUCCESS")
