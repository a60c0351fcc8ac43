"""Evaluation figures over labelled documents, events and line items.

``labels.quality`` is whether an answer is right, ``documents.lang`` the domain and
``source`` the subtype; ``1 - labels.toxic`` plays the second model of a pair.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.functions.extraction import transition
from gradus.functions.numeric import percent, round2
from gradus.operators import aggregates, joins, paired
from gradus.plans.base import Registry, tables

R = Registry()

_G = """g AS (SELECT d.doc_id, d.lang AS domain, d.source AS subtype, l.quality = 1 AS before, l.toxic = 0 AS after, d.n_chars
  FROM documents d JOIN labels l USING (doc_id))"""


def graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    d, lab = tables(spark, sf_dir, "documents", "labels")
    return d.select("doc_id", F.col("lang").alias("domain"), F.col("source").alias("subtype"), "n_chars").join(
        lab.select("doc_id", (F.col("quality") == 1).alias("before"), (F.col("toxic") == 0).alias("after")), "doc_id"
    )


_SCOPE2 = "CASE WHEN grouping(domain) = 1 THEN 'global' WHEN grouping(subtype) = 1 THEN 'domain' ELSE 'subtype' END AS scope, CASE WHEN grouping(domain) = 1 THEN 'global' ELSE domain END AS domain, CASE WHEN grouping(subtype) = 1 THEN 'all' ELSE subtype END AS subtype"
_SCOPE1 = "CASE WHEN grouping(domain) = 1 THEN 'global' ELSE 'domain' END AS scope, CASE WHEN grouping(domain) = 1 THEN 'global' ELSE domain END AS domain"
_ACCURACY = "count(*) AS total, count(*) FILTER (WHERE before) AS correct, 100.0::DOUBLE * count(*) FILTER (WHERE before) / count(*) AS accuracy"


@R.add("accuracy_by_domain", f"WITH {_G} SELECT {_SCOPE1}, {_ACCURACY} FROM g GROUP BY GROUPING SETS ((), (domain))")
def accuracy_by_domain(spark, sf_dir):
    return aggregates.by_scope(graded(spark, sf_dir), "domain", None, *aggregates.accuracy(F.col("before")))


@R.add("accuracy_by_scope", f"WITH {_G} SELECT {_SCOPE2}, {_ACCURACY} FROM g GROUP BY GROUPING SETS ((), (domain), (domain, subtype))")
def accuracy_by_scope(spark, sf_dir):
    return aggregates.by_scope(graded(spark, sf_dir), "domain", "subtype", *aggregates.accuracy(F.col("before")))


def answers(spark, sf_dir):
    g = graded(spark, sf_dir)
    status = F.when(~F.col("before") & ~F.col("after"), "contradictory").when(F.col("n_chars") < 40, "missing").otherwise("answered")
    return g.select(
        "domain", "subtype", F.col("before").alias("strict_correct"), (F.col("before") & F.col("after")).alias("end_to_end"),
        F.col("after").alias("conclusion_correct"), status.alias("status"), (F.col("n_chars") > 4000).alias("truncated"), F.col("n_chars").alias("tokens"),
    )


@R.add(
    "answer_metrics",
    f"""WITH {_G} SELECT {_SCOPE2}, count(*) AS questions, count(*) FILTER (WHERE before) AS correct,
  100.0::DOUBLE * count(*) FILTER (WHERE before) / count(*) AS accuracy, count(*) FILTER (WHERE before AND after) AS formatted_correct,
  100.0::DOUBLE * count(*) FILTER (WHERE before AND after) / count(*) AS formatted_accuracy, count(*) FILTER (WHERE after) AS conclusion_correct,
  100.0::DOUBLE * count(*) FILTER (WHERE after) / count(*) AS conclusion_accuracy, count(*) FILTER (WHERE NOT before AND NOT after) AS contradictions,
  count(*) FILTER (WHERE n_chars < 40 AND (before OR after)) AS missing, count(*) FILTER (WHERE n_chars > 4000) AS truncated,
  sum(n_chars)::DOUBLE / count(*) AS mean_tokens
FROM g GROUP BY GROUPING SETS ((), (domain), (domain, subtype))""",
)
def answer_metrics(spark, sf_dir):
    return aggregates.by_scope(answers(spark, sf_dir), "domain", "subtype", *aggregates.answer_metrics())


@R.add("status_histogram", "SELECT event_type, user_id % 7 AS status, count(*) AS n FROM events GROUP BY 1, 2")
def status_histogram(spark, sf_dir):
    e = tables(spark, sf_dir, "events").withColumn("status", F.col("user_id") % 7)
    maps = aggregates.histogram(e, ["event_type"], "status")
    return maps.select("event_type", F.explode("histogram").alias("status", "n"))


@R.add(
    "micro_macro",
    """WITH d AS (SELECT l_returnflag AS run, l_linestatus AS domain, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS c FROM lineitem GROUP BY 1, 2)
SELECT run, sum(n)::BIGINT AS total, sum(c)::BIGINT AS correct, sum(c) / sum(n) AS micro_accuracy, avg(c / n) AS average_domain_accuracy FROM d GROUP BY run""",
)
def micro_macro(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("run"), F.col("l_linestatus").alias("domain"), "l_quantity")
    return aggregates.micro_macro(li, "domain", F.col("l_quantity") > 25, ["run"])


@R.add(
    "error_analysis",
    f"""WITH {_G} SELECT domain, subtype, count(*) AS total, count(*) FILTER (WHERE before) AS correct,
  100.0::DOUBLE * count(*) FILTER (WHERE before) / count(*) AS accuracy, count(*) FILTER (WHERE NOT after) AS to_review,
  coalesce(list_sort(list(doc_id) FILTER (WHERE NOT before)), []) AS failures FROM g GROUP BY 1, 2""",
)
def error_analysis(spark, sf_dir):
    return aggregates.error_analysis(graded(spark, sf_dir), ["domain", "subtype"], F.col("before"), F.col("doc_id"), ~F.col("after"))


@R.add(
    "seed_mean_std",
    """WITH r AS (SELECT l_returnflag AS domain, year(l_shipdate) AS seed, avg(l_quantity) AS q, 100.0::DOUBLE * count(*) FILTER (WHERE l_discount > 0.05) / count(*) AS share FROM lineitem GROUP BY 1, 2)
SELECT domain, count(*) AS runs, avg(q) AS q_mean, coalesce(stddev_samp(q), 0) AS q_std, avg(share) AS share_mean, coalesce(stddev_samp(share), 0) AS share_std, count(*) = 7 AS complete FROM r GROUP BY 1""",
)
def seed_mean_std(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")
    runs = li.groupBy(F.col("l_returnflag").alias("domain"), F.year("l_shipdate").alias("seed")).agg(
        F.avg("l_quantity").alias("q"), percent(F.count_if(F.col("l_discount") > 0.05), F.count("*")).alias("share")
    )
    return aggregates.mean_std(runs, ["domain"], ["q", "share"], runs=7)


_P = f"""{_G},
t AS (SELECT {_SCOPE1}, count(*) AS total, count(*) FILTER (WHERE before) AS before_correct, count(*) FILTER (WHERE after) AS after_correct,
  count(*) FILTER (WHERE NOT before AND after) AS gained, count(*) FILTER (WHERE before AND NOT after) AS lost,
  count(*) FILTER (WHERE before AND after) AS both_correct, count(*) FILTER (WHERE NOT before AND NOT after) AS both_incorrect
  FROM g GROUP BY GROUPING SETS ((), (domain)))"""
# P(X <= k) of a fair coin by its logarithm: lgamma gives the binomials.
_MCNEMAR = """CASE WHEN gained + lost = 0 THEN 1.0 ELSE least(1.0, 2 * list_sum([
  exp(lgamma(gained + lost + 1) - lgamma(i + 1) - lgamma(gained + lost - i + 1) - (gained + lost) * ln(2)) FOR i IN range(least(gained, lost) + 1)])) END"""


@R.add(
    "paired_transitions",
    f"""WITH {_P} SELECT *, 100.0::DOUBLE * before_correct / total AS before_accuracy, 100.0::DOUBLE * after_correct / total AS after_accuracy,
  100.0::DOUBLE * (gained - lost) / total AS delta_points, gained - lost AS net_gain FROM t""",
)
def paired_transitions(spark, sf_dir):
    return paired.transitions(graded(spark, sf_dir), F.col("before"), F.col("after"), "domain").drop("p_value")


@R.add("mcnemar_exact", f"WITH {_P} SELECT scope, domain, gained, lost, round({_MCNEMAR}, 6) AS p_value FROM t")
def mcnemar(spark, sf_dir):
    t = paired.transitions(graded(spark, sf_dir), F.col("before"), F.col("after"), "domain")
    return t.select("scope", "domain", "gained", "lost", F.round("p_value", 6).alias("p_value"))


@R.add(
    "changed_ids",
    f"""WITH {_G} SELECT {_SCOPE1}, list_sort(coalesce(list(doc_id) FILTER (WHERE NOT before AND after), [])) AS gained_ids,
  list_sort(coalesce(list(doc_id) FILTER (WHERE before AND NOT after), [])) AS lost_ids FROM g GROUP BY GROUPING SETS ((), (domain))""",
)
def changed_ids(spark, sf_dir):
    t = paired.transitions(graded(spark, sf_dir), F.col("before"), F.col("after"), "domain", "doc_id")
    return t.select("scope", "domain", "gained_ids", "lost_ids")


@R.add(
    "transition_classes",
    f"""WITH {_G} SELECT domain, CASE WHEN NOT before AND after THEN 'improved' WHEN before AND NOT after THEN 'regressed'
  WHEN before THEN 'correct_both' ELSE 'incorrect_both' END AS transition, count(*) AS n FROM g GROUP BY 1, 2""",
)
def transition_classes(spark, sf_dir):
    g = graded(spark, sf_dir)
    return g.groupBy("domain", transition(F.col("before"), F.col("after")).alias("transition")).agg(F.count("*").alias("n"))


_REPS, _SEED = 200, 42


@R.add(
    "bootstrap_ci",
    f"""WITH {_G},
k AS (SELECT domain, doc_id, after::INT - before::INT AS d, count(*) OVER (PARTITION BY domain) AS n, row_number() OVER (PARTITION BY domain ORDER BY after::INT - before::INT, doc_id) - 1 AS rank FROM g),
s AS (SELECT domain, n, doc_id AS draw, unnest(range({_REPS})) AS replicate FROM k),
p AS (SELECT domain, n, replicate, ('0x' || substr(md5('{_SEED}|' || replicate || '|' || draw), 1, 8))::BIGINT % n AS rank FROM s),
e AS (SELECT p.domain, p.n, replicate, 100.0::DOUBLE * sum(d) / p.n AS estimate FROM p JOIN k ON p.domain = k.domain AND p.rank = k.rank GROUP BY 1, 2, 3)
SELECT domain, n, list_sort(list(estimate))[{int(0.025 * (_REPS - 1)) + 1}] AS ci_low, list_sort(list(estimate))[{int(0.975 * (_REPS - 1)) + 1}] AS ci_high,
  round(avg(estimate), 9) AS mean_estimate FROM e GROUP BY 1, 2""",
)
def bootstrap_ci(spark, sf_dir):
    g = graded(spark, sf_dir).withColumn("d", F.col("after").cast("int") - F.col("before").cast("int"))
    out = paired.bootstrap_ci(g, "domain", "d", "doc_id", _REPS, _SEED)
    return out.withColumn("mean_estimate", F.round("mean_estimate", 9))


_WORD = "('0x' || substr(md5({tag}), 1, 15))::BIGINT"
_HEADS = (
    "list_sum(list_transform(range(least(20, (m + 59) // 60)), lambda i: bit_count("
    + _WORD.format(tag="tag || '|' || (j + 1) || '|' || i")
    + " & (CASE WHEN m < 1200 AND m % 60 > 0 AND i = least(20, (m + 59) // 60) - 1 THEN (1::BIGINT << (m % 60)::INT) - 1 ELSE 1152921504606846975 END))))"
)
_MANY = f"floor(m / 2.0::DOUBLE + ((hd - 600.0::DOUBLE + {_WORD.format(tag="tag || '|' || (j + 1) || '|20'")} / 1152921504606846976.0::DOUBLE - 0.5::DOUBLE) / sqrt(300.0::DOUBLE)) * sqrt(m::DOUBLE) / 2.0::DOUBLE + 0.5::DOUBLE)::BIGINT"


def _binomial_sql(name: str, source: str) -> str:
    """Rows of ``source`` (key..., n, part, whole, tag) with ``x``, the draw; a step for each binary digit."""
    return f"""{name}_r AS (
  SELECT domain, replicate, tag, whole, 0 AS j, part AS r, n AS m, 0::BIGINT AS below FROM {source}
  UNION ALL
  SELECT domain, replicate, tag, whole, j + 1, r * 2 - CASE WHEN r * 2 >= whole THEN whole ELSE 0 END, CASE WHEN r * 2 >= whole THEN h ELSE m - h END, below + CASE WHEN r * 2 >= whole THEN m - h ELSE 0 END
  FROM (SELECT *, CASE WHEN m <= 1200 THEN hd ELSE greatest(0, least(m, {_MANY})) END AS h FROM (SELECT *, {_HEADS}::BIGINT AS hd FROM {name}_r WHERE m > 0 AND j < 48))),
{name} AS (SELECT s.*, CASE WHEN part >= whole THEN n WHEN part <= 0 THEN 0 ELSE b.below END AS x
  FROM {source} s JOIN (SELECT domain, replicate, arg_max(below, j) AS below FROM {name}_r GROUP BY 1, 2) b USING (domain, replicate))"""


@R.add(
    "bootstrap_counts",
    f"""WITH RECURSIVE {_G},
c AS (SELECT domain, count(*) AS n, count(*) FILTER (WHERE before AND NOT after) AS lost, count(*) FILTER (WHERE before = after) AS same FROM g GROUP BY 1),
s1 AS (SELECT domain, replicate, n, lost AS part, n AS whole, lost, same, '{_SEED}|' || domain || '|' || replicate || '|-1' AS tag FROM c, range({_REPS}) t(replicate)),
{_binomial_sql("b1", "s1")},
s2 AS (SELECT domain, replicate, n - x AS n, same AS part, whole - lost AS whole, x AS lost, n AS total, '{_SEED}|' || domain || '|' || replicate || '|0' AS tag FROM b1),
{_binomial_sql("b2", "s2")},
e AS (SELECT domain, total AS n, 100.0::DOUBLE * ((n - x) - lost) / total AS estimate FROM b2)
SELECT domain, n, list_sort(list(estimate))[{int(0.025 * (_REPS - 1)) + 1}] AS ci_low, list_sort(list(estimate))[{int(0.975 * (_REPS - 1)) + 1}] AS ci_high,
  round(avg(estimate), 9) AS mean_estimate FROM e GROUP BY 1, 2""",
)
def bootstrap_counts(spark, sf_dir):
    g = graded(spark, sf_dir).withColumn("d", F.col("after").cast("int") - F.col("before").cast("int"))
    return paired.bootstrap_counts(g, "domain", "d", _REPS, _SEED).withColumn("mean_estimate", F.round("mean_estimate", 9))


@R.add(
    "paired_delta_over_seeds",
    """WITH r AS (SELECT year(l_shipdate) AS seed, l_returnflag AS domain, l_linenumber % 3 AS ratio, count(*) AS n, count(*) FILTER (WHERE l_quantity > 25) AS c FROM lineitem GROUP BY 1, 2, 3),
p AS (SELECT seed, domain, a.ratio AS ratio_after, 100.0::DOUBLE * a.c / a.n - 100.0::DOUBLE * b.c / b.n AS delta FROM r b JOIN r a USING (seed, domain) WHERE b.ratio = 0 AND a.ratio <> 0)
SELECT ratio_after, domain, count(*) AS runs, avg(delta) AS delta_mean, coalesce(stddev_samp(delta), 0) AS delta_std FROM p GROUP BY 1, 2""",
)
def paired_delta_over_seeds(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")
    runs = li.groupBy(F.year("l_shipdate").alias("seed"), F.col("l_returnflag").alias("domain"), (F.col("l_linenumber") % 3).alias("ratio")).agg(
        percent(F.count_if(F.col("l_quantity") > 25), F.count("*")).alias("acc")
    )
    pairs = joins.before_after(runs, ["seed", "domain"], "ratio", 0, ["acc"]).withColumn("delta", F.col("after_acc") - F.col("before_acc"))
    return aggregates.mean_std(pairs, ["ratio_after", "domain"], ["delta"])


@R.add(
    "rounded_deltas",
    f"""WITH {_G}, m AS (SELECT domain, round_even(100.0::DOUBLE * count(*) FILTER (WHERE before) / count(*), 2) AS a, round_even(100.0::DOUBLE * count(*) FILTER (WHERE after) / count(*), 2) AS b FROM g GROUP BY 1)
SELECT domain, round(round_even(b - a, 2), 6) AS accuracy_delta FROM m""",
)
def rounded_deltas(spark, sf_dir):
    """A difference of figures that were rounded before, rounded again."""
    m = graded(spark, sf_dir).groupBy("domain").agg(
        round2(percent(F.count_if("before"), F.count("*"))).alias("a"), round2(percent(F.count_if("after"), F.count("*"))).alias("b")
    )
    return m.select("domain", F.round(round2(F.col("b") - F.col("a")), 6).alias("accuracy_delta"))


@R.add(
    "wide_models",
    """SELECT o_orderkey % 5 AS domain, count(*) AS questions, count(*) FILTER (WHERE m1_v > 150000) AS m1_correct, count(*) FILTER (WHERE m2_v > 150000) AS m2_correct,
  count(*) FILTER (WHERE NOT m1_v > 150000 AND m2_v > 150000) AS improved, count(*) FILTER (WHERE m1_v > 150000 AND NOT m2_v > 150000) AS regressed
FROM (SELECT o_custkey AS q, min(o_orderkey) AS o_orderkey, max(CASE WHEN o_orderkey % 2 = 0 THEN o_totalprice END) AS m1_v, max(CASE WHEN o_orderkey % 2 = 1 THEN o_totalprice END) AS m2_v FROM orders GROUP BY 1)
WHERE m1_v IS NOT NULL AND m2_v IS NOT NULL GROUP BY 1""",
)
def wide_models(spark, sf_dir):
    """Two models' answers in one row, then counts and transitions from one pass."""
    o = tables(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("q"), F.when(F.col("o_orderkey") % 2 == 0, "m1").otherwise("m2").alias("model"), F.col("o_totalprice").alias("v"), "o_orderkey"
    )
    wide = joins.wide_by_model(o, ["q"], "model", ["m1", "m2"], ["v"])
    first = o.groupBy("q").agg(F.min("o_orderkey").alias("o_orderkey"))
    w = wide.join(first, "q").where("m1_v is not null and m2_v is not null")
    a, b = F.col("m1_v") > 150000, F.col("m2_v") > 150000
    return w.groupBy((F.col("o_orderkey") % 5).alias("domain")).agg(
        F.count("*").alias("questions"), F.count_if(a).alias("m1_correct"), F.count_if(b).alias("m2_correct"),
        F.count_if(~a & b).alias("improved"), F.count_if(a & ~b).alias("regressed"),
    )


@R.add(
    "group_signal",
    """WITH g AS (SELECT l_orderkey, count(*) AS size, count(*) FILTER (WHERE l_quantity > 25) AS correct, count(DISTINCT l_discount) AS rewards FROM lineitem GROUP BY 1)
SELECT count(*) AS groups, sum(size)::BIGINT AS generations, sum(correct)::BIGINT AS correct_generations, count(*) FILTER (WHERE correct > 0 AND correct < size) AS signal_groups,
  count(*) FILTER (WHERE correct = size) AS all_correct_groups, count(*) FILTER (WHERE correct = 0) AS none_correct_groups, count(*) FILTER (WHERE correct = 0 AND rewards > 1) AS format_only_groups FROM g""",
)
def group_signal(spark, sf_dir):
    li = tables(spark, sf_dir, "lineitem")
    return aggregates.signal_summary(aggregates.group_signal(li, "l_orderkey", F.col("l_quantity") > 25, "l_discount"))


@R.add(
    "nested_reward_sum",
    "SELECT l_orderkey, count(*) AS completions, round(sum(l_discount), 6) AS reward_total, max(l_discount) AS best_reward FROM lineitem GROUP BY 1",
)
def nested_reward_sum(spark, sf_dir):
    """Sums over an array column of rewards, without exploding it."""
    li = tables(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_list("l_discount").alias("rewards"))
    total = F.aggregate("rewards", F.lit(0.0), lambda a, x: a + x)
    return li.select("l_orderkey", F.size("rewards").cast("long").alias("completions"), F.round(total, 6).alias("reward_total"), F.array_max("rewards").alias("best_reward"))


@R.add(
    "length_stats",
    """SELECT lang, count(*) AS selected, count(*) FILTER (WHERE n_chars <= 4000) AS kept, min(n_chars) FILTER (WHERE n_chars <= 4000) AS shortest, max(n_chars) FILTER (WHERE n_chars <= 4000) AS longest,
  avg(n_chars) FILTER (WHERE n_chars <= 4000) AS mean_length, count(*) FILTER (WHERE n_chars <= 4000) / count(*) AS retention FROM documents GROUP BY 1""",
)
def length_stats(spark, sf_dir):
    return aggregates.length_stats(tables(spark, sf_dir, "documents"), F.col("n_chars"), F.col("n_chars") <= 4000, ["lang"])


@R.add(
    "resolved_coverage",
    """WITH s AS (SELECT event_type, CASE user_id % 4 WHEN 0 THEN 'correct' WHEN 1 THEN 'incorrect' WHEN 2 THEN 'ambiguous' ELSE 'missing' END AS status FROM events)
SELECT event_type, count(*) AS total, count(*) FILTER (WHERE status = 'correct') AS correct, count(*) FILTER (WHERE status = 'incorrect') AS incorrect,
  count(*) FILTER (WHERE status IN ('correct', 'incorrect')) AS resolved,
  100.0::DOUBLE * count(*) FILTER (WHERE status = 'correct') / nullif(count(*) FILTER (WHERE status IN ('correct', 'incorrect')), 0) AS accuracy_on_resolved,
  100.0::DOUBLE * count(*) FILTER (WHERE status IN ('correct', 'incorrect')) / count(*) AS coverage FROM s GROUP BY 1""",
)
def resolved_coverage(spark, sf_dir):
    e = tables(spark, sf_dir, "events")
    names = F.element_at(F.array(*map(F.lit, ("correct", "incorrect", "ambiguous", "missing"))), (F.col("user_id") % 4 + 1).cast("int"))
    return paired.resolved_and_coverage(e.select("event_type", names.alias("status")), "status", ["event_type"])


@R.add(
    "rescue_adjustment",
    f"""WITH {_G} SELECT domain, count(*) AS total, count(*) FILTER (WHERE before) AS correct, count(*) FILTER (WHERE NOT before AND after) AS rescued,
  count(*) FILTER (WHERE before OR after) AS indicative_correct, 100.0::DOUBLE * count(*) FILTER (WHERE before OR after) / count(*) AS indicative_accuracy FROM g GROUP BY 1""",
)
def rescue_adjustment(spark, sf_dir):
    return graded(spark, sf_dir).groupBy("domain").agg(*paired.rescued(F.col("before"), F.col("after")))


@R.add(
    "flag_cross_tab",
    """SELECT lang, count(*) AS total, count(*) FILTER (WHERE n_chars > 4000) AS truncated, count(*) FILTER (WHERE regexp_matches(text, '[0-9]')) AS has_number,
  count(*) FILTER (WHERE n_chars > 4000 AND NOT regexp_matches(text, '[0-9]')) AS no_final_truncated, count(*) FILTER (WHERE n_chars <= 4000 AND NOT regexp_matches(text, '[0-9]')) AS no_final_not_truncated
FROM documents GROUP BY 1""",
)
def flag_cross_tab(spark, sf_dir):
    long, number = F.col("n_chars") > 4000, F.col("text").rlike("[0-9]")
    flags = {"truncated": long, "has_number": number, "no_final_truncated": long & ~number, "no_final_not_truncated": ~long & ~number}
    return aggregates.cross_tab(tables(spark, sf_dir, "documents"), flags, ["lang"])


@R.add("distinct_counts", "SELECT count(*) AS n, count(DISTINCT doc_id) AS ids, count(DISTINCT text) AS texts, count(DISTINCT source) AS sources FROM documents")
def distinct_counts(spark, sf_dir):
    d = tables(spark, sf_dir, "documents")
    return d.agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("ids"), F.countDistinct("text").alias("texts"), F.countDistinct("source").alias("sources"))
