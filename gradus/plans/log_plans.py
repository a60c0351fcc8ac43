"""Logs, versions, stages and caches that queries write in several runs, some of them killed, and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.plans.base import Registry, tables
from gradus.schemas import STRATEGIES
from gradus.sources.scratch import scratch
from gradus.streaming import stages
from gradus.streaming.append_log import AppendLog, run_available
from gradus.streaming.cache import ResultCache, case_digest
from gradus.streaming.versioned import VersionedLog

R = Registry()

# -- a log that is written once

_LOG = "event_id bigint, user_id bigint, event_type string, value double"


class Killed(Exception):
    """Stands for the end of a writer."""


def _kill(_: int) -> None:
    raise Killed


def _killed_run(*args, **options) -> None:
    """A run that ends by ``_kill``; any other end is an error."""
    try:
        run_available(*args, **options)
    except Exception as error:
        if "Killed" not in str(error):
            raise
    else:
        raise RuntimeError("the run was to be killed")


def _written_log(spark: SparkSession, sf_dir: str) -> AppendLog:
    """``events``, delivered in three parts that overlap, appended by five runs.

    The first run dies before its batch is published, the second one after that but before Spark notes the batch as done, the
    third repeats that batch and takes the second part, the fourth the last part, the fifth finds nothing new.
    """
    path, schema = scratch(spark, "append"), _LOG
    log = AppendLog(spark, f"{path}/log", schema)
    e = tables(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")

    def deliver(*quarters: int) -> None:
        e.where((F.col("event_id") % 4).isin(*quarters)).write.mode("append").parquet(f"{path}/inbox")

    deliver(0, 1)
    stream = spark.readStream.schema(schema).parquet(f"{path}/inbox")
    at = {"checkpoint": f"{path}/checkpoint", "key": "event_id"}
    _killed_run(stream, log, **at, run="first", before_entry=_kill)
    _killed_run(stream, log, **at, run="second", after_entry=_kill)
    deliver(1, 2)
    run_available(stream, log, **at, run="third")
    deliver(3, 0, 2)
    run_available(stream, log, **at, run="fourth")
    run_available(stream, log, **at, run="fifth")
    return log


@R.add("append_log", "SELECT event_id, user_id, event_type, value FROM events")
def append_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _written_log(spark, sf_dir).read()


@R.add(
    "append_log_runs",
    "SELECT CASE event_id % 4 WHEN 2 THEN 'third' WHEN 3 THEN 'fourth' ELSE 'second' END AS run, count(*) AS rows FROM events GROUP BY 1",
)
def append_log_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which run's entry holds how many rows: none is counted for a run that was killed before, or had nothing to do."""
    return _written_log(spark, sf_dir).ledger().groupBy("run").agg(F.sum("rows").alias("rows"))


# -- a log with versions

_BAD = "(event_type = 'error' AND value > 50)"
#: Steps are event ids: three appends, a checkpoint inside the last of them, a repair, and the repaired rows appended again.
_VERSIONS = {
    1: ("append", "event_id <= top // 3"),
    2: ("append", "event_id <= 2 * top // 3"),
    3: ("append", "true"),
    4: ("rollback", "event_id < 5 * top // 6"),
    5: ("repair", f"event_id < 5 * top // 6 AND NOT {_BAD}"),
    6: ("append", "event_id < 5 * top // 6"),
}


def _versioned_log(spark: SparkSession, sf_dir: str) -> VersionedLog:
    log = VersionedLog(spark, scratch(spark, "versions"), _LOG, "event_id")
    e = tables(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    top = e.agg(F.max("event_id")).first()[0]
    bounds = [-1, top // 3, 2 * top // 3, top]
    for low, high in zip(bounds, bounds[1:], strict=False):
        log.append(e.where((F.col("event_id") > low) & (F.col("event_id") <= high)))
    log.roll_back(5 * top // 6)
    bad = (F.col("event_type") == "error") & (F.col("value") > 50)
    before = log.versions()[-1]
    log.repair(bad)
    log.append(log.read(before).where(bad).withColumn("value", F.lit(50.0)))  # what was bad is done again
    return log


_OF_VERSION = " UNION ALL ".join(
    f"SELECT {v} AS version, '{kind}' AS kind, count(*) AS rows, sum(event_id)::BIGINT AS ids FROM events, t WHERE {which}"
    for v, (kind, which) in _VERSIONS.items()
)


@R.add("log_versions", f"WITH t AS (SELECT max(event_id) AS top FROM events) {_OF_VERSION}")
def log_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every version, read as it was after all of them were made."""
    log = _versioned_log(spark, sf_dir)
    out = None
    for v in log.versions():
        part = log.read(v).agg(F.count("*").alias("rows"), F.sum("event_id").alias("ids")).withColumn("version", F.lit(v))
        out = part if out is None else out.unionByName(part)
    return out.join(log.history().select("version", "kind"), "version").select(F.col("version").cast("int"), "kind", "rows", "ids")


@R.add(
    "log_repaired",
    f"""SELECT event_id, user_id, event_type, CASE WHEN {_BAD} THEN 50 ELSE value END AS value FROM events
WHERE event_id < 5 * (SELECT max(event_id) FROM events) // 6""",
)
def log_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _versioned_log(spark, sf_dir).read()


@R.add("log_as_of", "SELECT event_id, user_id, event_type, value FROM events WHERE event_id < (SELECT max(event_id) FROM events) // 2")
def log_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The version before the rollback, up to a step; segments behind that step are not read."""
    log = _versioned_log(spark, sf_dir)
    top = tables(spark, sf_dir, "events").agg(F.max("event_id")).first()[0]
    return log.read(3, before=top // 2)


# -- the loop over stages

_DOMAINS = ("click", "error", "purchase", "signup", "view")
_SEED = 42


def _stage_loop(spark: SparkSession, sf_dir: str) -> dict[int, stages.State]:
    """Four stages: a domain is an event type, a strategy a third of the users, a probe eight days."""
    e = tables(spark, sf_dir, "events")
    strategy = F.element_at(F.array(*[F.lit(s) for s in STRATEGIES]), (F.col("user_id") % 3 + 1).cast("int"))
    period = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int") + 1
    probes = e.groupBy(strategy.alias("strategy"), F.col("event_type").alias("domain"), period.alias("stage")).agg(
        (F.count_if(F.col("value") > 50) / F.count("*")).alias("score")
    )
    pool = lambda domain: e.where(F.col("event_type") == domain).select(F.col("event_id").alias("id"))
    start = {
        "memory": stages.first_memory(pool(_DOMAINS[0]), STRATEGIES, _DOMAINS[0], _SEED),
        "best": spark.createDataFrame([], "strategy string, domain string, best double"),
    }

    def step(state: stages.State, number: int) -> stages.State:
        old = probes.where((F.col("stage") == number) & F.col("domain").isin(*_DOMAINS[:number])).drop("stage")
        return stages.replay_stage(state, pool(_DOMAINS[number]), old, _DOMAINS[number], number, _SEED)

    return stages.fold(spark, scratch(spark, "stages"), range(1, len(_DOMAINS)), start, step)


def _stage_sql() -> str:
    """The same fold, one group of tables for each stage."""
    names = ", ".join(f"({i}, '{s}')" for i, s in enumerate(STRATEGIES))
    first = lambda n, d: f"SELECT id, row_number() OVER (ORDER BY md5('{_SEED}-{n}-pool|' || id), id) AS rank FROM e WHERE domain = '{d}'"
    out = [
        f"""e AS (SELECT event_id AS id, event_type AS domain, user_id % 3 AS u, value, least(3, (day(ts) - 1) // 8) + 1 AS stage FROM events),
st AS (SELECT * FROM (VALUES {names}) AS s(u, strategy)),
sc AS (SELECT strategy, domain, stage, count(*) FILTER (WHERE value > 50) / count(*) AS score FROM e JOIN st USING (u) GROUP BY ALL),
mem0 AS (SELECT strategy, '{_DOMAINS[0]}' AS domain, rank AS slot, id FROM ({first(0, _DOMAINS[0])}), st WHERE rank <= 24),
best0 AS (SELECT ''::VARCHAR AS strategy, ''::VARCHAR AS domain, 0::DOUBLE AS best WHERE false)"""
    ]
    for n, d in enumerate(_DOMAINS[1:], 1):
        b = n - 1
        seen = ", ".join(f"'{x}'" for x in _DOMAINS[:n])
        out.append(
            f"""pri{n} AS (SELECT k.strategy, k.domain, score, best AS best_before,
  CASE WHEN k.strategy = 'adaptive_replay' THEN 0.05::DOUBLE + greatest(0, coalesce(best - score, 0)) ELSE 1 END AS priority
  FROM (SELECT DISTINCT strategy, domain FROM mem{b}) k
  LEFT JOIN (SELECT * FROM sc WHERE stage = {n}) s ON k.strategy = s.strategy AND k.domain = s.domain
  LEFT JOIN best{b} o ON k.strategy = o.strategy AND k.domain = o.domain WHERE k.strategy <> 'no_replay'),
raw{n} AS (SELECT *, priority / sum(priority) OVER (PARTITION BY strategy) * 8 AS raw FROM pri{n}),
rst{n} AS (SELECT *, floor(raw) AS base, 8 - sum(floor(raw)) OVER (PARTITION BY strategy) AS rest FROM raw{n}),
alc{n} AS (SELECT strategy, domain, score, best_before, priority, (base + CASE WHEN row_number() OVER
  (PARTITION BY strategy ORDER BY round(raw - base, 12) DESC, domain) <= rest THEN 1 ELSE 0 END)::BIGINT AS slots FROM rst{n}),
drw{n} AS (SELECT m.strategy, m.domain, m.id FROM mem{b} m JOIN alc{n} a ON m.strategy = a.strategy AND m.domain = a.domain
  QUALIFY row_number() OVER (PARTITION BY m.strategy, m.domain ORDER BY md5('{_SEED}-{n}-replay-' || m.strategy || '|' || m.id), m.id) <= any_value(a.slots) OVER (PARTITION BY m.strategy, m.domain)),
bth{n} AS (SELECT strategy, id, '{d}' AS domain, 'current' AS source_type FROM ({first(n, d)}), st WHERE rank <= CASE strategy WHEN 'no_replay' THEN 40 ELSE 32 END
  UNION ALL SELECT strategy, id, domain, 'replay' FROM drw{n}),
pln{n} AS (SELECT strategy, row_number() OVER (PARTITION BY strategy ORDER BY md5('{_SEED}-{n}-plan-' || strategy || '|' || id), id, source_type) AS pos, id, domain, source_type FROM bth{n}),
mem{n} AS (SELECT * FROM mem{b} WHERE domain <> '{d}' UNION ALL SELECT strategy, domain, slot, id FROM
  (SELECT *, row_number() OVER (PARTITION BY strategy ORDER BY pos) AS slot FROM pln{n} WHERE source_type = 'current') WHERE slot <= 24),
best{n} AS (SELECT strategy, domain, max(best) AS best FROM (SELECT strategy, domain, best FROM best{b}
  UNION ALL SELECT strategy, domain, score FROM sc WHERE stage = {n} AND domain IN ({seen})) GROUP BY ALL)"""
        )
    return "WITH " + ",\n".join(out)


def _of_stages(table: str, columns: str) -> str:
    return _stage_sql() + " " + " UNION ALL ".join(f"SELECT {n} AS stage, {columns} FROM {table}{n}" for n in range(1, len(_DOMAINS)))


@R.add("stage_loop_plan", _of_stages("pln", "strategy, pos, id, domain, source_type"))
def stage_loop_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.union_of(_stage_loop(spark, sf_dir), "plan")


@R.add("stage_loop_allocation", _of_stages("alc", "strategy, domain, score, best_before, priority, slots"))
def stage_loop_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.union_of(_stage_loop(spark, sf_dir), "allocation")


@R.add("stage_loop_memory", _of_stages("mem", "strategy, domain, slot, id"))
def stage_loop_memory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stages.union_of(_stage_loop(spark, sf_dir), "memory")


# -- results kept by digest


def _graded(spark: SparkSession, sf_dir: str):
    """Documents graded twice; between the runs one in a hundred changes."""
    d = tables(spark, sf_dir, "documents").select("doc_id", "text")
    changed = d.withColumn("text", F.when(F.col("doc_id") % 100 == 0, F.concat("text", F.lit(" (revised)"))).otherwise(F.col("text")))
    cache = ResultCache(spark, scratch(spark, "cache"), "words bigint, status string")

    def grade(cases: DataFrame) -> DataFrame:
        words = F.size(F.filter(F.split("text", r"[ \n\t\r]+"), lambda w: w != "")).cast("bigint")
        return cases.select("digest", words.alias("words"), F.when(words < 100, "short").when(words > 1000, "long").otherwise("kept").alias("status"))

    digest = case_digest("words-1", F.col("text"))
    return cache, cache.run(d, digest, grade), cache.run(changed, digest, grade)


_CASES = """WITH d AS (SELECT doc_id, text, CASE WHEN doc_id % 100 = 0 THEN text || ' (revised)' ELSE text END AS now FROM documents),
g AS (SELECT doc_id, now, now NOT IN (SELECT text FROM d WHERE text IS NOT NULL) AS fresh,
  len(list_filter(regexp_split_to_array(now, '[ \\n\\t\\r]+'), lambda w: w <> '')) AS words FROM d)"""


@R.add(
    "incremental_cache",
    _CASES + " SELECT doc_id, words, CASE WHEN words < 100 THEN 'short' WHEN words > 1000 THEN 'long' ELSE 'kept' END AS status, fresh FROM g",
)
def incremental_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grades of all documents after the second run, with which of them it had to make."""
    return _graded(spark, sf_dir)[2].results.select("doc_id", "words", "status", "fresh")


@R.add(
    "incremental_cache_runs",
    _CASES + " SELECT 1 AS run, count(DISTINCT text) AS worked FROM d UNION ALL SELECT 2, count(DISTINCT now) FROM g WHERE fresh",
)
def incremental_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Different cases that each run worked on."""
    _, *runs = _graded(spark, sf_dir)
    return spark.createDataFrame([(i, r.worked) for i, r in enumerate(runs, 1)], "run int, worked bigint")
