"""Scans with explicit schemas: JSON lines, CSV with multi-line cells, JSON documents, tables."""

from __future__ import annotations

import csv
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from gradus.operators.constraints import require_unique
from gradus.sources.csv_blocks import csv_records


def json_lines(spark: SparkSession, path: str, schema: str, unique_id: str | None = None) -> DataFrame:
    """One object a line, blank lines skipped; a missing file or a bad line raises."""
    df = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return require_unique(df, unique_id) if unique_id else df


def path_exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)


def json_lines_if_any(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """As ``json_lines``; a missing file is an empty table, so that a first run can resume."""
    return json_lines(spark, path, schema) if path_exists(spark, path) else spark.createDataFrame([], schema)


def _csv_files(spark: SparkSession, paths: list[str]) -> list[str]:
    """The files that paths, folders and patterns stand for, in the order of their names."""
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    found = []
    for path in paths:
        hadoop = jvm.org.apache.hadoop.fs.Path(path)
        system = hadoop.getFileSystem(conf)
        entries = system.globStatus(hadoop)
        if not entries:
            raise FileNotFoundError(path)
        for entry in entries:
            inside = system.listStatus(entry.getPath()) if entry.isDirectory() else [entry]
            files = [f.getPath() for f in inside if f.isFile() and not f.getPath().getName().startswith(("_", "."))]
            found += sorted(f.toString() for f in files)
    return found


def _csv_header(spark: SparkSession, path: str) -> tuple[str, ...]:
    """The names in the first record of a file, without a byte order mark."""
    jvm = spark._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    stream = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(hadoop)
    try:
        reader = jvm.java.io.BufferedReader(jvm.java.io.InputStreamReader(stream, "UTF-8"))
        record = reader.readLine() or ""
        while record.count('"') % 2:  # a name may be quoted over several lines
            more = reader.readLine()
            if more is None:
                raise ValueError(f"{path}: the header has an open quote")
            record += "\n" + more
    finally:
        stream.close()
    return tuple(next(csv.reader([record.removeprefix("\ufeff")], strict=True), []))


def csv_table(spark: SparkSession, path: str | list[str], schema: str, header: bool = True, split: bool = False) -> DataFrame:
    """CSV with quoted cells over several lines; columns are taken by their names in the header.

    Every file may have its columns in an order of its own, and further columns, which are not
    read into the result. A file without a column of the schema raises, as does a cell that its
    type can't hold. The first record of each file is read by the driver; files with the same
    header are one scan. Without a header, columns are taken by position.

    With ``split`` (and a header) large files are read by many tasks, see ``csv_blocks``; without it a file is one task.
    """
    reader = spark.read.option("multiLine", True).option("quote", '"').option("escape", '"').option("mode", "FAILFAST")
    paths = [path] if isinstance(path, str) else list(path)
    if not header:
        return reader.schema(schema).csv(paths)
    wanted = StructType.fromDDL(schema)
    by_header: dict[tuple[str, ...], list[str]] = {}
    for file in _csv_files(spark, paths):
        names = _csv_header(spark, file)
        lacking = [f.name for f in wanted if f.name not in names]
        if lacking:
            raise ValueError(f"{file}: no column {', '.join(lacking)}")
        if any(names.count(f.name) > 1 for f in wanted):
            raise ValueError(f"{file}: a column stands there twice")
        by_header.setdefault(names, []).append(file)
    out = spark.createDataFrame([], wanted)
    for names, files in by_header.items():
        kinds = {f.name: f.dataType for f in wanted}
        own = StructType([StructField(n if n in kinds else f"__{i}", kinds.get(n, StringType())) for i, n in enumerate(names)])
        if split:
            ddl = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own)
            options = {"mode": "FAILFAST", "quote": '"', "escape": '"'}
            rows = csv_records(spark, files).select(F.from_csv("record", ddl, options).alias("r")).select("r.*")
        else:
            rows = reader.schema(own).option("header", True).option("enforceSchema", True).csv(files)
        part = rows.select(*wanted.names)
        out = part if len(by_header) == 1 else out.unionByName(part)
    return out


def json_document(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Whole files that hold one object each."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def stage_summaries(spark: SparkSession, shared: str, paths: dict[tuple[str, int], str], schema: str) -> DataFrame:
    """(strategy, stage, domain, total, correct) of stage summaries; stage 0 is shared by all strategies."""
    strategies = sorted({s for s, _ in paths})
    parts = [json_document(spark, shared, schema).crossJoin(spark.createDataFrame([(s, 0) for s in strategies], "strategy string, stage int"))]
    parts += [json_document(spark, p, schema).withColumns({"strategy": F.lit(s), "stage": F.lit(k)}) for (s, k), p in sorted(paths.items())]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("strategy", "stage", F.explode("domains").alias("domain", "v")).select(
        "strategy", "stage", "domain", F.col("v.total").alias("total"), F.col("v.correct").alias("correct")
    )


def literal_table(spark: SparkSession, rows: Iterable[tuple], schema: str) -> DataFrame:
    """A small table given in code."""
    return spark.createDataFrame(list(rows), schema)


def limited(df: DataFrame, order: str, n: int) -> DataFrame:
    """The first ``n`` rows in source order; n has to be positive."""
    if n <= 0:
        raise ValueError("a limit has to be positive")
    return df.orderBy(order).limit(n)


def lineage(df: DataFrame, source: str, config: str, split: str) -> DataFrame:
    """One row about a source: rows, and a fingerprint of its content that ignores the order of rows.

    It is the sum of the first 15 hex digits of an MD5 of each row: of its columns as text, in the order of their names, each
    with its length before it and ``-`` for null. Columns without a text (arrays, maps, structs) count as JSON.
    """
    parts = []
    for name, kind in sorted(df.dtypes):
        col = F.col(f"`{name}`")
        text = F.to_json(F.struct(col)) if kind.startswith(("array", "map", "struct")) else col.cast("string")
        parts.append(F.coalesce(F.concat(F.length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    digest = F.conv(F.substring(F.md5(F.concat(*parts)), 1, 15), 16, 10).cast("decimal(38,0)")
    return df.agg(F.count("*").alias("total_rows"), F.coalesce(F.sum(digest), F.lit(0)).cast("string").alias("fingerprint")).select(
        F.lit(source).alias("source"), F.lit(config).alias("config"), F.lit(split).alias("official_split"), "total_rows", "fingerprint"
    )


def file_hashes(spark: SparkSession, path: str) -> DataFrame:
    """(path, sha256) of files; a file is one value of a row, so it must be under 2 GB."""
    return spark.read.format("binaryFile").load(path).select("path", F.sha2("content", 256).alias("sha256"))


#: Tries that questions are generated in, at most.
MAX_ATTEMPTS = 100_000


def synthetic_questions(spark: SparkSession, domain: str, n: int, seed: int) -> DataFrame:
    """(attempt, domain, question, answer): templates filled from hashes of (seed, attempt).

    Repeats of a question are dropped, the first attempt stays; if ``MAX_ATTEMPTS`` tries give
    fewer than ``n`` different questions, an error is raised. Tries are made as needed: four
    for each question first, and ten times as many while that does not do.
    """
    attempts = min(4 * n + 200, max(MAX_ATTEMPTS, n))
    while True:
        out = _synthetic(spark, domain, n, seed, attempts)
        if out.count() == n:
            return out
        if attempts >= max(MAX_ATTEMPTS, n):
            raise ValueError(f"fewer than {n} different questions")
        attempts = min(10 * attempts, max(MAX_ATTEMPTS, n))


def _synthetic(spark: SparkSession, domain: str, n: int, seed: int, attempts: int) -> DataFrame:
    """The first ``n`` different questions of so many attempts, or fewer."""

    def pick(name: str, low: int, high: int):
        h = F.xxhash64(F.lit(f"{seed}|{domain}|{name}"), "attempt")
        return (F.lit(low) + F.pmod(h, F.lit(high - low + 1))).cast("bigint")

    base = spark.range(attempts).withColumnRenamed("id", "attempt")
    base = base.withColumns({"kind": pick("kind", 0, 3), "a": pick("a", 2, 60), "b": pick("b", 2, 60), "c": pick("c", 2, 12)})
    s = lambda c: F.col(c).cast("string")
    ask = lambda head, *parts: F.concat(F.lit(head), *[p if not isinstance(p, str) else F.lit(p) for p in parts])
    if domain == "maths":
        forms = [
            (ask("Calcule : ", s("a"), " + ", s("b")), F.col("a") + F.col("b")),
            (ask("Calcule : ", s("a"), " - ", s("b")), F.col("a") - F.col("b")),
            (ask("Calcule : ", s("a"), " * ", s("b")), F.col("a") * F.col("b")),
            (ask("Calcule : ", (F.col("a") * F.col("c")).cast("string"), " / ", s("c")), F.col("a")),
        ]
    elif domain == "algebre":
        ax = lambda e: ask("Trouve x : ", *e)
        forms = [
            (ax((s("c"), "x + ", s("b"), " = ", (F.col("c") * F.col("a") + F.col("b")).cast("string"))), F.col("a")),
            (ax((s("c"), "x - ", s("b"), " = ", (F.col("c") * F.col("a") - F.col("b")).cast("string"))), F.col("a")),
            (ax((s("c"), "(x + ", s("b"), ") = ", (F.col("c") * (F.col("a") + F.col("b"))).cast("string"))), F.col("a")),
            (ax(("x/", s("c"), " + ", s("b"), " = ", (F.col("a") + F.col("b")).cast("string"))), F.col("a") * F.col("c")),
        ]
    elif domain == "code":
        show = lambda e: ask("Que vaut ce calcul en Python ?\n", *e)
        forms = [
            (show((s("a"), " // ", s("c"))), F.floor(F.col("a") / F.col("c"))),
            (show((s("a"), " % ", s("c"))), F.pmod("a", "c")),
            (show((s("c"), " ** 2")), F.col("c") * F.col("c")),
            (show(("sum([", s("a"), ", ", s("b"), "])")), F.col("a") + F.col("b")),
        ]
    else:
        raise ValueError(f"no templates for {domain}")
    question, answer = F.lit(None).cast("string"), F.lit(None).cast("bigint")
    for k, (q, v) in enumerate(forms):
        question = F.when(F.col("kind") == k, q).otherwise(question)
        answer = F.when(F.col("kind") == k, v.cast("bigint")).otherwise(answer)
    made = base.select("attempt", F.lit(domain).alias("domain"), question.alias("question"), answer.alias("answer"))
    first = made.groupBy("domain", "question").agg(F.min_by("answer", "attempt").alias("answer"), F.min("attempt").alias("attempt"))
    return first.orderBy("attempt").limit(n).select("attempt", "domain", "question", "answer")
