"""Readers: delimited tickets, log files, JSON lines, issues, source files, inventory tables."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticketweave import fixed_values as fv
from ticketweave.functions.logs import parse_lines

_C, _L = F.col, F.lit

# canonical name -> keywords, in order; the first keyword found in any column name wins
COLUMN_KEYWORDS = {
    "inc_resume": ["inc_resume", "resume", "résumé", "summary", "description", "titre"], "inc_cause": ["inc_cause", "cause", "motif", "reason", "root cause"],
    "inc_solution": ["inc_solution", "solution", "resolution"], "inc_sig": ["inc_sig", "symptome", "signalement", "sig"], "application": ["application", "app", "systeme", "system"],
    "ticket": ["ticket", "incident", "id", "numero", "reference"], "datetime_debut": ["datetime_debut", "date", "date_debut", "ouverture", "created"],
    "groupe_nom": ["groupe", "group", "assignment group", "support"], "inc_statut": ["statut", "status", "state"],
}


def detect_columns(columns: Sequence[str], keywords: Mapping[str, Sequence[str]] = COLUMN_KEYWORDS, exact: bool = False) -> dict[str, str]:
    """Canonical name -> source column, looking only at names."""
    found = {}
    for name, words in keywords.items():
        for word in words:
            hit = next((c for c in columns if (c.lower() == word.lower() if exact else word.lower() in c.lower())), None)
            if hit is not None:
                found[name] = hit
                break
    return found


def canonicalize_columns(df: DataFrame, keywords: Mapping[str, Sequence[str]] = COLUMN_KEYWORDS) -> DataFrame:
    """Rename detected columns; a column serves the canonical name that claims it last, the others keep their names."""
    by_source = {source: name for name, source in detect_columns(df.columns, keywords).items()}
    return df.select(*[_C(f"`{c}`").alias(by_source.get(c, c)) for c in df.columns])


def sniff_delimiter(spark: SparkSession, path: str, encoding: str = "UTF-8") -> str:
    """``;`` or ``,``, whichever the first line has more of; one line is read."""
    head = spark.read.option("encoding", encoding).text(path).limit(1).collect()
    line = head[0][0] if head else ""
    return ";" if line.count(";") > line.count(",") else ","


def read_tickets(spark: SparkSession, path: str, encoding: str = "UTF-8", sep: str | None = None, null_spellings: Sequence[str] = tuple(fv.NULL_SPELLINGS), drop_empty: bool = True) -> DataFrame:
    """Delimited tickets as strings: trimmed, null spellings turned to null, columns without any value dropped."""
    sep = sep or sniff_delimiter(spark, path, encoding)
    raw = (spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("mode", "DROPMALFORMED").option("multiLine", True)
           .option("quote", '"').option("escape", '"').csv(path))
    clean = lambda c: F.trim(_C(f"`{c}`"))
    df = raw.select(*[F.when(~clean(c).isin(list(null_spellings)), clean(c)).alias(c.replace("﻿", "").strip().strip('"')) for c in raw.columns])
    if not drop_empty:
        return df
    seen = df.agg(*[F.count(f"`{c}`").alias(str(i)) for i, c in enumerate(df.columns)]).first()
    return df.select(*[_C(f"`{c}`") for i, c in enumerate(df.columns) if seen[i]])


def with_encoding_fallback(spark: SparkSession, path: str, encodings: Sequence[str] = ("UTF-8", "windows-1252")) -> DataFrame:
    """First encoding that yields no replacement character anywhere in the file."""
    for enc in encodings[:-1]:
        if spark.read.option("encoding", enc).text(path).filter(F.contains("value", _L("�"))).isEmpty():
            return read_tickets(spark, path, enc)
    return read_tickets(spark, path, encodings[-1])


def file_strategy_name(name: str, default: str = "generic") -> str | None:
    """Parser of one file name; None for helper files that are skipped."""
    if re.search(fv.SKIPPED_FILES, name):
        return None
    return next((s for p, s in fv.FILE_STRATEGIES if re.search(p, name)), default)


def read_logs(spark: SparkSession, path: str, default: str = "generic", service: str = "api") -> DataFrame:
    """Log files as structured events. Only file names are looked at to choose parsers; every file is read once."""
    groups: dict[str, list[str]] = {}
    for file in spark.read.text(path).inputFiles():
        strategy = file_strategy_name(unquote(file).rsplit("/", 1)[-1], default)
        if strategy:
            groups.setdefault(strategy, []).append(unquote(file))
    if not groups:
        return parse_lines(spark.createDataFrame([], "line string"), "line", default, service).withColumn("strategy", _L(default))
    return reduce(DataFrame.unionByName, [
        parse_lines(spark.read.text(files).withColumnRenamed("value", "line"), "line", s, service).withColumn("strategy", _L(s)) for s, files in groups.items()])


CORRECTION_SCHEMA = T.StructType([T.StructField(n, T.StringType()) for n in ("timestamp", "ticket_id", "original_label", "corrected_label", "text", "reason")])


def read_corrections(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CORRECTION_SCHEMA).option("mode", "DROPMALFORMED").json(path)


_NAMED = "STRUCT<displayName: STRING, name: STRING>"
ISSUE_SCHEMA = (
    f"key STRING, fields STRUCT<summary: STRING, description: STRING, status: {_NAMED}, priority: {_NAMED}, issuetype: {_NAMED}, assignee: {_NAMED}, "
    f"reporter: {_NAMED}, created: STRING, updated: STRING, resolutiondate: STRING, labels: ARRAY<STRING>, components: ARRAY<{_NAMED}>>")


def flatten_issues(df: DataFrame, payload: str, prefix: str = "jira_") -> DataFrame:
    """Nested issue JSON -> flat rows, null-safe, with labels and component names as arrays."""
    f = df.select(F.from_json(payload, ISSUE_SCHEMA).alias("i")).select(_C("i.key").alias("issue_key"), "i.fields.*")
    who = lambda c: F.coalesce(_C(f"{c}.displayName"), _C(f"{c}.name"))
    return f.select(
        F.concat(_L(prefix), "issue_key").alias("id"), "issue_key", "summary", F.coalesce("description", _L("")).alias("description"),
        *[who(c).alias(c) for c in ("status", "priority", "issuetype", "assignee", "reporter")],
        *[F.try_to_timestamp(c).alias(c) for c in ("created", "updated", "resolutiondate")],
        F.coalesce("labels", F.array().cast("array<string>")).alias("labels"),
        F.coalesce(F.transform("components", lambda c: c["name"]), F.array().cast("array<string>")).alias("components"))


def scan_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, content) of every file below ``root``, one row per whole file."""
    return (spark.read.text(root, wholetext=True, recursiveFileLookup=True)
            .select(_C("_metadata.file_path").alias("path"), _C("value").alias("content")))


def read_inventory(spark: SparkSession, location: str, table: str, properties: Mapping[str, str] | None = None, partition: tuple[str, int, int, int] | None = None) -> DataFrame:
    """An inventory table from JDBC (``jdbc:`` URL) or from a Parquet folder; filters are pushed down either way.

    ``partition`` (column, lower, upper, parts) splits a JDBC read into parallel range queries.
    """
    if not location.startswith("jdbc:"):
        return spark.read.parquet(f"{location.rstrip('/')}/{table}.parquet")
    if partition is None:
        return spark.read.jdbc(location, table, properties=dict(properties or {}))
    col, lo, hi, n = partition
    return spark.read.jdbc(location, table, column=col, lowerBound=lo, upperBound=hi, numPartitions=n, properties=dict(properties or {}))
