"""Curriculum metrics over ``events``: a stage is eight days, an event type a domain, a strategy a third of the users.

An answer is right if the event's value is over a bound. Domains are learned in the order
of their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradus.operators import curriculum
from gradus.plans.base import Registry, tables
from gradus.sources import sinks

R = Registry()
BOUND = 50.0

_ACC = f"""
acc AS (
  SELECT 'strategy_' || (user_id % 3) AS strategy, least(3, (day(ts) - 1) // 8)::INT AS stage, event_type AS domain,
         count(*) AS total, count(*) FILTER (WHERE value > {BOUND}) AS correct
  FROM events GROUP BY 1, 2, 3),
dim AS (SELECT domain, least(3, row_number() OVER (ORDER BY domain) - 1)::INT AS first_stage FROM (SELECT DISTINCT event_type AS domain FROM events)),
m AS (
  SELECT strategy, stage, domain, first_stage, correct / total AS accuracy
  FROM acc JOIN dim USING (domain) WHERE stage >= first_stage),
d AS (
  SELECT strategy, domain, first_stage, arg_min(accuracy, stage) AS acquisition, arg_max(accuracy, stage) AS final,
         max(accuracy) AS best, max(stage) AS last_stage
  FROM m GROUP BY 1, 2, 3)
"""


def accuracy_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(strategy, stage, domain, total, correct)."""
    e = tables(spark, sf_dir, "events")
    keys = {
        "strategy": F.concat(F.lit("strategy_"), (F.col("user_id") % 3).cast("string")),
        "stage": F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int"),
        "domain": F.col("event_type"),
    }
    return e.groupBy(*[c.alias(n) for n, c in keys.items()]).agg(
        F.count("*").alias("total"), F.count_if(F.col("value") > BOUND).alias("correct")
    )


def dimension(accuracy: DataFrame) -> DataFrame:
    w = Window.orderBy("domain")  # as many rows as there are domains
    return accuracy.select("domain").distinct().withColumn("first_stage", F.least(F.lit(3), F.row_number().over(w) - 1))


def matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    acc = accuracy_long(spark, sf_dir)
    return curriculum.accuracy_matrix(acc, dimension(acc))


@R.add(
    "continual_metrics",
    f"""WITH {_ACC}
SELECT strategy, 100 * avg(final) AS average_final,
  100 * avg(CASE WHEN first_stage < 3 THEN greatest(0, best - final) END) AS average_forgetting,
  100 * avg(CASE WHEN first_stage < 3 AND acquisition > 0 THEN final / acquisition END) AS average_retention,
  100 * avg(CASE WHEN first_stage < 3 THEN final - acquisition END) AS average_backward_transfer
FROM d GROUP BY strategy""",
)
def continual_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.continual_metrics(matrix(spark, sf_dir))


@R.add(
    "domain_metrics",
    f"""WITH {_ACC}
SELECT strategy, domain, first_stage, acquisition, final, best, last_stage, greatest(0, best - final) AS forgetting,
  CASE WHEN acquisition > 0 THEN final / acquisition END AS retention, final - acquisition AS backward_transfer FROM d""",
)
def domain_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.domain_metrics(matrix(spark, sf_dir))


@R.add("accuracy_matrix", f"WITH {_ACC} SELECT domain, strategy, stage, first_stage, accuracy FROM m")
def accuracy_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matrix(spark, sf_dir).select("domain", "strategy", "stage", "first_stage", "accuracy")


_DOMAINS = ("click", "error", "purchase", "signup", "view")


@R.add(
    "percent_matrix",
    f"WITH {_ACC} SELECT strategy, stage, "
    + ", ".join(f"coalesce(format('{{:.6f}}', 100 * max(CASE WHEN domain = '{d}' THEN accuracy END)), '') AS {d}" for d in _DOMAINS)
    + " FROM m GROUP BY 1, 2",
)
def percent_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.matrix(matrix(spark, sf_dir), _DOMAINS)


@R.add(
    "percent_matrix_average",
    f"WITH {_ACC} SELECT strategy, stage, "
    + ", ".join(f"100 * max(CASE WHEN domain = '{d}' THEN accuracy END) AS {d}" for d in _DOMAINS)
    + ", 100 * avg(accuracy) AS average_seen FROM m GROUP BY 1, 2",
)
def percent_matrix_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.matrix(matrix(spark, sf_dir), _DOMAINS, text=False)


@R.add("seen_average", f"WITH {_ACC} SELECT strategy, stage, avg(accuracy) AS average_seen, count(accuracy) AS domains_seen FROM m GROUP BY 1, 2")
def seen_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curriculum.seen_average(matrix(spark, sf_dir))


@R.add(
    "reference_forgetting",
    f"""WITH {_ACC}
SELECT domain, strategy, stage, m.accuracy, r.accuracy AS reference_accuracy,
  greatest(0, r.accuracy - m.accuracy) AS forgetting, m.accuracy - r.accuracy AS gain
FROM m JOIN (SELECT domain, accuracy FROM m WHERE strategy = 'strategy_0' AND stage = first_stage) r USING (domain)""",
)
def reference_forgetting(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir)
    reference = m.where("strategy = 'strategy_0' and stage = first_stage")
    return curriculum.against_reference(m.select("domain", "strategy", "stage", "accuracy"), reference, "domain")


@R.add(
    "adaptive_priorities",
    f"""WITH {_ACC},
s AS (SELECT strategy, stage, domain, accuracy AS score,
  coalesce(max(accuracy) OVER (PARTITION BY strategy, domain ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), accuracy) AS best_before FROM m)
SELECT strategy, stage, domain, score, best_before, greatest(0, best_before - score) AS deficit,
  0.05 + greatest(0, best_before - score) AS priority, greatest(best_before, score) AS best_after FROM s""",
)
def adaptive_priorities(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = matrix(spark, sf_dir).withColumnRenamed("accuracy", "score").select("strategy", "stage", "domain", "score")
    return curriculum.adaptive_priorities(m)


@R.add(
    "adaptive_allocation",
    f"""WITH {_ACC},
s AS (SELECT strategy, stage, domain, accuracy AS score,
  coalesce(max(accuracy) OVER (PARTITION BY strategy, domain ORDER BY stage ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), accuracy) AS best_before FROM m),
p AS (SELECT strategy, stage, domain, 0.05::DOUBLE + greatest(0, best_before - score) AS priority FROM s),
r AS (SELECT *, priority / sum(priority) OVER (PARTITION BY strategy, stage) * 8 AS raw FROM p),
b AS (SELECT *, floor(raw) AS base, 8 - sum(floor(raw)) OVER (PARTITION BY strategy, stage) AS rest FROM r),
o AS (SELECT *, row_number() OVER (PARTITION BY strategy, stage ORDER BY round(raw - base, 12) DESC, domain) AS place FROM b)
SELECT strategy, stage, domain, (base + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS slots FROM o""",
)
def adaptive_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = adaptive_priorities(spark, sf_dir)
    return curriculum.allocate(p, ["strategy", "stage"], "priority", "domain", 8).select("strategy", "stage", "domain", "slots")


@R.add(
    "slot_allocation",
    """WITH w AS (SELECT event_type AS domain, count(*)::DOUBLE AS weight FROM events GROUP BY 1),
r AS (SELECT *, weight / sum(weight) OVER () * 40 AS raw FROM w),
b AS (SELECT *, floor(raw) AS base, 40 - sum(floor(raw)) OVER () AS rest FROM r),
o AS (SELECT *, row_number() OVER (ORDER BY round(raw - base, 12) DESC, domain) AS place FROM b)
SELECT domain, weight, (base + CASE WHEN place <= rest THEN 1 ELSE 0 END)::BIGINT AS slots FROM o""",
)
def slot_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = tables(spark, sf_dir, "events").groupBy(F.col("event_type").alias("domain")).agg(F.count("*").cast("double").alias("weight"))
    out = curriculum.allocate(w.withColumn("all", F.lit(0)), ["all"], "weight", "domain", 40)
    return out.select("domain", "weight", "slots")
