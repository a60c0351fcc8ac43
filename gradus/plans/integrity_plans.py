"""Joins, constraints, sets and filters over the star tables and documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import text
from gradus.operators import constraints, joins
from gradus.plans.base import Registry, tables
from gradus.sources import scans, sinks
from gradus.sources.scratch import scratch

R = Registry()
_FP = "sha256(lower(trim(regexp_replace(text, '[ \\n\\t\\r]+', ' ', 'g'), ' ')))"


@R.add("fingerprint_groups", f"SELECT {_FP} AS question_hash, count(*) AS n, min(doc_id) AS first_id FROM documents GROUP BY 1 HAVING count(*) > 1")
def fingerprint_groups(spark, sf_dir):
    d = tables(spark, sf_dir, "documents").withColumn("question_hash", text.fingerprint(F.col("text")))
    return d.groupBy("question_hash").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id")).where("n > 1")


@R.add("fingerprint_dedup", f"SELECT min(doc_id) AS doc_id, {_FP} AS question_hash FROM documents GROUP BY 2")
def fingerprint_dedup(spark, sf_dir):
    d = tables(spark, sf_dir, "documents")
    return d.groupBy(text.fingerprint(F.col("text")).alias("question_hash")).agg(F.min("doc_id").alias("doc_id"))


_WORDS = "list_filter(regexp_split_to_array(lower(text), '[ \\n\\t\\r]+'), lambda w: w <> '')"


@R.add(
    "benchmark_leaks",
    f"""WITH b AS (SELECT item_id, unnest([list_aggregate(w[i:i + 7], 'string_agg', ' ') FOR i IN range(1, len(w) - 6)]) AS h FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
d AS (SELECT doc_id, unnest([list_aggregate(w[i:i + 7], 'string_agg', ' ') FOR i IN range(1, len(w) - 6)]) AS h FROM (SELECT doc_id, {_WORDS} AS w FROM documents))
SELECT item_id, count(DISTINCT doc_id) AS documents FROM b JOIN d USING (h) GROUP BY 1""",
)
def benchmark_leaks(spark, sf_dir):
    d, b = tables(spark, sf_dir, "documents", "benchmark")
    return constraints.passage_leaks(d, b, "doc_id", "item_id", "text", words=8)


@R.add("split_leaks", f"SELECT {_FP} AS question_hash, list_sort(list(DISTINCT source)) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1")
def split_leaks(spark, sf_dir):
    return constraints.split_leaks(tables(spark, sf_dir, "documents"), "source", "text")


@R.add("answer_leaks", "SELECT d.doc_id, source FROM documents d JOIN labels USING (doc_id) WHERE source NOT IN ('src0', 'src1')")
def answer_leaks(spark, sf_dir):
    d, lab = tables(spark, sf_dir, "documents", "labels")
    shown = d.select("doc_id", "source").join(lab.select("doc_id", "quality"), "doc_id", "left")
    return constraints.answer_leaks(shown, "source", "quality", ("src0", "src1")).select("doc_id", "source")


@R.add("one_to_one_join", "SELECT o_orderkey, o_custkey, n FROM orders JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey")
def one_to_one_join(spark, sf_dir):
    o, li = tables(spark, sf_dir, "orders", "lineitem")
    counts = li.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    filled = o.select("o_orderkey", "o_custkey").join(counts.select("o_orderkey"), "o_orderkey", "left_semi")
    return joins.one_to_one(filled, counts, "o_orderkey", joins.INLINE)


@R.add("lookup_join", "SELECT o_custkey AS c_custkey, o_orderkey, c_mktsegment FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def lookup_join(spark, sf_dir):
    o, c = tables(spark, sf_dir, "orders", "customer")
    return joins.lookup(o.select(F.col("o_custkey").alias("c_custkey"), "o_orderkey"), c.select("c_custkey", "c_mktsegment"), "c_custkey")


@R.add("paired_records",
    """SELECT doc_id AS id, lang AS domain, quality = 1 AS base_correct, toxic = 0 AS base_format_ok, 'g' || quality AS base_status, toxic = 1 AS new_correct, quality = 0 AS new_format_ok, 'g' || toxic AS new_status,
  n_chars AS base_tokens, n_chars > 4000 AS base_truncated, n_chars + 1 AS new_tokens, n_chars > 5000 AS new_truncated FROM documents JOIN labels USING (doc_id)""")  # fmt: skip
def paired_records(spark, sf_dir):
    d, lab = tables(spark, sf_dir, "documents", "labels")
    b = d.join(lab, "doc_id").select(F.col("doc_id").alias("id"), F.col("lang").alias("domain"), "quality", "toxic", "n_chars")
    grades = lambda c, f: b.select("id", "domain", c.alias("correct"), f.alias("format_ok"), F.concat(F.lit("g"), c.cast("int")).alias("status"))
    gens = lambda extra, cap: b.select("id", (F.col("n_chars") + extra).alias("tokens"), (F.col("n_chars") > cap).alias("truncated"))
    q, t = F.col("quality"), F.col("toxic")
    return joins.paired_records(grades(q == 1, t == 0), grades(t == 1, q == 0), gens(0, 4000), gens(1, 5000), joins.INLINE)


@R.add("resume_anti_join", "SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R')")
def resume_anti_join(spark, sf_dir):
    o, li = tables(spark, sf_dir, "orders", "lineitem")
    done = li.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return joins.remaining(o.select("o_orderkey"), done, "o_orderkey", joins.INLINE)


@R.add("key_difference", """SELECT doc_id, 'left_only' AS side FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)
UNION ALL SELECT doc_id, 'right_only' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")  # fmt: skip
def key_difference(spark, sf_dir):
    return constraints.key_difference(*tables(spark, sf_dir, "documents", "labels"), "doc_id")


@R.add("partial_keys", "SELECT k, count(*) AS tables FROM (SELECT DISTINCT doc_id AS k, 1 AS t FROM documents UNION SELECT DISTINCT doc_id, 2 FROM labels UNION SELECT DISTINCT vec_id, 3 FROM embeddings) GROUP BY 1 HAVING count(*) < 3")
def partial_keys(spark, sf_dir):
    d, lab, e = tables(spark, sf_dir, "documents", "labels", "embeddings")
    return constraints.same_keys([d.select(F.col("doc_id").alias("k")), lab.select(F.col("doc_id").alias("k")), e.select(F.col("vec_id").alias("k"))], "k")


@R.add("override_join", "SELECT d.doc_id, CASE WHEN l.doc_id IS NOT NULL THEN l.quality ELSE d.n_chars % 2 END::INT AS grade, l.doc_id IS NOT NULL AS reviewed FROM documents d LEFT JOIN labels l USING (doc_id)")
def override_join(spark, sf_dir):
    d, lab = tables(spark, sf_dir, "documents", "labels")
    automatic = d.select("doc_id", (F.col("n_chars") % 2).cast("int").alias("grade"))
    return joins.override(automatic, lab.select("doc_id", F.col("quality").alias("grade")), "doc_id", ["grade"])


@R.add("ordered_lookup", "SELECT doc_id, row_number() OVER (ORDER BY doc_id DESC) AS pos, lang FROM documents WHERE doc_id < 10")
def ordered_lookup(spark, sf_dir):
    ids = spark.createDataFrame([(9 - i, i + 1) for i in range(10)], "doc_id bigint, pos int")
    return joins.in_given_order(tables(spark, sf_dir, "documents").select("doc_id", "lang"), ids, "doc_id")


@R.add("checkpoint_grid", "SELECT 'strategy_' || s.range AS strategy, t.range AS stage FROM range(3) s, range(4) t")
def checkpoint_grid(spark, sf_dir):
    s = spark.range(3).select(F.concat(F.lit("strategy_"), "id").alias("strategy"))
    return joins.checkpoint_grid(s, spark.range(4).withColumnRenamed("id", "stage"))


@R.add("duplicate_keys", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return constraints.duplicates(tables(spark, sf_dir, "events"), "user_id", "event_type")


@R.add("wrong_counts", """SELECT coalesce(lang, e) AS lang, coalesce(n, 0) AS rows, coalesce(x, 0) AS expected FROM (SELECT lang, count(*) AS n FROM documents GROUP BY 1) FULL JOIN (VALUES ('en', 100), ('xx', 5)) v(e, x) ON lang = e WHERE coalesce(n, 0) <> coalesce(x, 0)""")
def wrong_counts(spark, sf_dir):
    return constraints.wrong_counts(tables(spark, sf_dir, "documents"), "lang", {"en": 100, "xx": 5})


@R.add("domain_mismatches", "SELECT doc_id, lang, CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'en' END AS other_domain FROM documents WHERE doc_id % 2 = 1 AND lang <> 'en'")
def domain_mismatches(spark, sf_dir):
    d = tables(spark, sf_dir, "documents").select("doc_id", "lang")
    other = d.select("doc_id", F.when(F.col("doc_id") % 2 == 0, F.col("lang")).otherwise("en").alias("lang"))
    return constraints.domain_mismatches(d, other, "doc_id", "lang")


@R.add("protocol_mismatches", """WITH a AS (SELECT count(*) AS n, min(doc_id) AS low, max(lang) AS top FROM documents), b AS (SELECT count(*) AS n, min(doc_id) AS low, max(lang) AS top FROM documents WHERE lang <> 'fr')
SELECT 'n' AS field, a.n::VARCHAR AS "left", b.n::VARCHAR AS "right" FROM a, b WHERE a.n IS DISTINCT FROM b.n UNION ALL SELECT 'low', a.low::VARCHAR, b.low::VARCHAR FROM a, b WHERE a.low IS DISTINCT FROM b.low UNION ALL SELECT 'top', a.top, b.top FROM a, b WHERE a.top IS DISTINCT FROM b.top""")  # fmt: skip
def protocol_mismatches(spark, sf_dir):
    d = tables(spark, sf_dir, "documents")
    meta = lambda x: x.agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("lang").alias("top"))
    return constraints.field_mismatches(meta(d), meta(d.where("lang <> 'fr'")), ["n", "low", "top"])


@R.add("order_mismatches", "SELECT doc_id AS ord, doc_id AS cached, CASE WHEN doc_id % 100 = 7 THEN doc_id + 1 ELSE doc_id END AS dataset FROM documents WHERE doc_id % 100 = 7")
def order_mismatches(spark, sf_dir):
    d = tables(spark, sf_dir, "documents").select(F.col("doc_id").alias("ord"), F.col("doc_id").alias("id"))
    moved = d.select("ord", F.when(F.col("id") % 100 == 7, F.col("id") + 1).otherwise(F.col("id")).alias("id"))
    return constraints.order_mismatches(d, moved, "id", "ord")


@R.add("valid_cache", "SELECT event_id, digest FROM (SELECT event_id, md5(props) AS digest, md5(CASE WHEN event_id % 10 = 0 THEN '' ELSE props END) AS now FROM events) WHERE digest = now")
def valid_cache(spark, sf_dir):
    from gradus.streaming.resume import valid_cache as keep

    e = tables(spark, sf_dir, "events")
    cases = e.select("event_id", F.md5(F.when(F.col("event_id") % 10 == 0, "").otherwise(F.col("props"))).alias("digest"))
    return keep(e.select("event_id", F.md5("props").alias("digest")), cases, "event_id", "digest")


@R.add("routed_records", """SELECT doc_id, CASE WHEN n_chars < 300 THEN 'format_error' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS route, '' AS manual_prediction, '' AS manual_correct FROM documents JOIN labels USING (doc_id)""")
def routed_records(spark, sf_dir):
    d, lab = tables(spark, sf_dir, "documents", "labels")
    route = F.when(F.col("n_chars") < 300, "format_error").when(F.col("quality") == 1, "correct").otherwise("incorrect")
    return d.join(lab, "doc_id").select("doc_id", route.alias("route"), F.lit("").alias("manual_prediction"), F.lit("").alias("manual_correct"))


@R.add("review_queue", "SELECT doc_id FROM documents JOIN labels USING (doc_id) WHERE lang IN ('fr', 'de') OR (quality = 1) <> (toxic = 0) OR n_chars > 4000")
def review_queue(spark, sf_dir):
    d, lab = tables(spark, sf_dir, "documents", "labels")
    odd = F.col("lang").isin("fr", "de") | ((F.col("quality") == 1) != (F.col("toxic") == 0)) | (F.col("n_chars") > 4000)
    return d.join(lab, "doc_id").where(odd).select("doc_id")


@R.add("eligibility", "SELECT CASE WHEN n_chars < 100 THEN 'gold_unparsed' WHEN n_chars > 4000 THEN 'prompt_too_long' ELSE 'kept' END AS reason, count(*) AS n FROM documents GROUP BY 1")
def eligibility(spark, sf_dir):
    n = F.col("n_chars")
    reason = F.when(n < 100, "gold_unparsed").when(n > 4000, "prompt_too_long").otherwise("kept")
    return tables(spark, sf_dir, "documents").groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


@R.add("exclusion_filter", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1) AND lang = 'en'")
def exclusion_filter(spark, sf_dir):
    d, lab = tables(spark, sf_dir, "documents", "labels")
    return d.where("lang = 'en'").select("doc_id").join(lab.where("toxic = 1").select("doc_id"), "doc_id", "left_anti")


@R.add("ordered_unique", "SELECT user_id, list_transform(list_sort(list({'t': t, 'e': event_type})), lambda x: x.e) AS types FROM (SELECT user_id, event_type, min(event_id) AS t FROM events GROUP BY 1, 2) GROUP BY 1")
def ordered_unique(spark, sf_dir):
    firsts = tables(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.min("event_id").alias("event_id"))
    e = firsts.groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id", "event_type"))).alias("es"))  # a row for each type
    return e.select("user_id", F.col("es.event_type").alias("types"))


@R.add("transient_filter", "SELECT event_id FROM events WHERE event_type NOT IN ('error', 'timeout')")
def transient_filter(spark, sf_dir):
    return tables(spark, sf_dir, "events").where(~F.col("event_type").isin("error", "timeout")).select("event_id")


@R.add("blank_predictions", "SELECT count(*) FILTER (WHERE trim(p) IN ('', 'None')) AS missing, count(*) FILTER (WHERE trim(p) IN ('', 'None', 'null')) AS missing_or_null FROM (SELECT CASE user_id % 5 WHEN 0 THEN ' ' WHEN 1 THEN 'None' WHEN 2 THEN 'null' ELSE '7' END AS p FROM events)")
def blank_predictions(spark, sf_dir):
    u = F.col("user_id") % 5
    p = F.when(u == 0, " ").when(u == 1, "None").when(u == 2, "null").otherwise("7")
    e = tables(spark, sf_dir, "events").select(p.alias("p"))
    return e.agg(F.count_if(text.is_missing(F.col("p"))).alias("missing"), F.count_if(text.is_missing(F.col("p"), text.MISSING_OR_NULL)).alias("missing_or_null"))


@R.add("source_union", "SELECT 'documents' AS source, lang AS domain, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'benchmark', NULL, count(*) FROM benchmark UNION ALL SELECT 'conversations', role, count(*) FROM conversations GROUP BY role")
def source_union(spark, sf_dir):
    d, b, c = tables(spark, sf_dir, "documents", "benchmark", "conversations")
    u = d.select(F.lit("documents").alias("source"), F.col("lang").alias("domain"), "text").unionByName(b.select(F.lit("benchmark").alias("source"), "text"), allowMissingColumns=True)
    u = u.unionByName(c.select(F.lit("conversations").alias("source"), F.col("role").alias("domain"), "text"))
    return u.groupBy("source", "domain").agg(F.count("*").alias("n"))


def _row_text(*columns: str) -> str:
    return " || ".join(f"coalesce(length({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR, '-')" for c in sorted(columns))


@R.add(
    "source_lineage",
    f"""SELECT 'documents' AS source, 'default' AS config, 'train' AS official_split, count(*) AS total_rows,
  sum(('0x' || substr(md5({_row_text("doc_id", "text", "lang", "source", "n_chars")}), 1, 15))::BIGINT)::VARCHAR AS fingerprint FROM documents""",
)
def source_lineage(spark, sf_dir):
    from gradus.sources.scans import lineage

    return lineage(tables(spark, sf_dir, "documents"), "documents", "default", "train")


@R.add("csv_round_trip", "SELECT n_nationkey, n_name || chr(10) || '\"q\", x' AS n_name, n_regionkey FROM nation")
def csv_round_trip(spark, sf_dir):
    """Written with cells over two lines, in two files whose columns stand in different orders; read by name."""
    path = scratch(spark, "csv")
    n = tables(spark, sf_dir, "nation").withColumn("n_name", F.concat("n_name", F.lit('\n"q", x')))
    sinks.write_csv(n.where("n_nationkey < 9"), f"{path}/a", ["n_regionkey", "n_nationkey", "n_name"])
    sinks.write_csv(n.where("n_nationkey >= 9"), f"{path}/b", ["n_name", "n_regionkey", "n_nationkey"])
    return scans.csv_table(spark, [f"{path}/a", f"{path}/b"], "n_nationkey int, n_name string, n_regionkey int")


@R.add("json_round_trip", "SELECT o_orderkey, o_custkey, o_totalprice, o_orderpriority FROM orders")
def json_round_trip(spark, sf_dir):
    """A table of JSON lines that is written, added to, found complete and read with a unique key."""
    path, schema = scratch(spark, "json"), "o_orderkey bigint, o_custkey bigint, o_totalprice double, o_orderpriority string"
    o = tables(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderpriority")
    log = scans.json_lines_if_any(spark, path, schema)  # empty before the first unit of work
    sinks.write_json_lines(o.where("o_orderkey % 3 = 0"), path)
    sinks.append_json_lines(o.where("o_orderkey % 3 <> 0"), path)
    if not sinks.is_complete(spark, path):
        raise RuntimeError("a finished table has no marker")
    return scans.json_lines(spark, path, schema, "o_orderkey").unionByName(log)


@R.add("document_round_trip", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey = 1")
def document_round_trip(spark, sf_dir):
    """One row as an indented document, read as a whole file."""
    path = scratch(spark, "document")
    row = tables(spark, sf_dir, "region").where("r_regionkey = 1").select("r_regionkey", "r_name")
    spark.createDataFrame([(sinks.pretty_json(row),)], "value string").coalesce(1).write.text(path)
    return scans.json_document(spark, path, "r_regionkey int, r_name string")
