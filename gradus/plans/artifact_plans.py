"""Files, payloads and checks of runs: overwriting, rewriting, summaries, code and test payloads, exact values, guards."""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from gradus.functions import extraction, grading, text
from gradus.operators import aggregates, constraints, generation, joins, paired, sampling
from gradus.plans.base import Registry, tables
from gradus.plans.evaluation_plans import graded
from gradus.plans.selection_plans import _MIX, replay_mix
from gradus.schemas import SUMMARY
from gradus.sources import scans, sinks
from gradus.sources.scratch import scratch

R = Registry()


# -- files


@R.add("refused_overwrite", "SELECT lang, count(*) AS n, true AS refused FROM documents GROUP BY lang")
def refused_overwrite(spark, sf_dir):
    """A table that is written once; the second writer, who has something else, is refused and changes nothing."""
    path = scratch(spark, "once")
    d = tables(spark, sf_dir, "documents")
    sinks.write_new(d.groupBy("lang").agg(F.count("*").alias("n")), path)
    try:
        sinks.write_new(d.limit(0), path)
        refused = False
    except AnalysisException:
        refused = True
    return scans.json_lines(spark, path, "lang string, n bigint").withColumn("refused", F.lit(refused))


@R.add("log_rewritten", "SELECT event_id, NOT (event_type = 'error' AND value > 50) AS kept FROM events")
def log_rewritten(spark, sf_dir):
    """A log whose bad records go: the backup has all of them, the rewritten log the others."""
    path, schema = scratch(spark, "rewritten"), "event_id bigint, event_type string, value double"
    sinks.write_json_lines(tables(spark, sf_dir, "events").select("event_id", "event_type", "value"), f"{path}/log")
    log = scans.json_lines(spark, f"{path}/log", schema, "event_id")
    bad = (F.col("event_type") == "error") & (F.col("value") > 50)
    sinks.rewrite_filtered(log, ~bad, f"{path}/new", f"{path}/backup")
    kept = scans.json_lines(spark, f"{path}/new", schema, "event_id").select("event_id", F.lit(True).alias("kept"))
    return scans.json_lines(spark, f"{path}/backup", schema).select("event_id").join(kept, "event_id", "left").withColumn("kept", F.coalesce("kept", F.lit(False)))


@R.add("csv_by_blocks", "SELECT conv_id, turn, role, 'said \"' || role || '\",' || chr(10) || text AS text FROM conversations")
def csv_by_blocks(spark, sf_dir):
    """Cells with quotes, commas and line feeds, in files that many tasks read: blocks of a few kilobytes here."""
    path = scratch(spark, "blocks")
    c = tables(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.concat(F.lit('said "'), "role", F.lit('",\n'), "text").alias("text"))
    c.write.option("header", True).option("escape", '"').csv(path)
    name, block = "spark.sql.files.maxPartitionBytes", str(16 << 10)
    before = spark.conf.get(name)
    spark.conf.set(name, block)
    try:
        scanned = scans.csv_table(spark, path, "conv_id bigint, turn int, role string, text string", split=True)
        scanned.write.parquet(f"{path}-read")  # planned and read with these blocks
    finally:
        spark.conf.set(name, before)
    return spark.read.parquet(f"{path}-read")


_STRATEGIES = ("no_replay", "fixed_replay", "adaptive_replay")


@R.add(
    "stage_summary_scan",
    f"""WITH e AS (SELECT ['{"', '".join(_STRATEGIES)}'][user_id % 3 + 1] AS strategy, least(3, (day(ts) - 1) // 8) AS stage, event_type AS domain, value FROM events),
s AS (SELECT unnest(['{"', '".join(_STRATEGIES)}']) AS strategy)
SELECT s.strategy, 0 AS stage, domain, count(*) AS total, count(*) FILTER (WHERE value > 50) AS correct FROM e, s WHERE stage = 0 GROUP BY 1, 2, 3
UNION ALL SELECT strategy, stage, domain, count(*), count(*) FILTER (WHERE value > 50) FROM e WHERE stage > 0 GROUP BY 1, 2, 3""",
)
def stage_summary_scan(spark, sf_dir):
    """One summary of stage 0 for all strategies and one for each further stage of each, written as documents and scanned."""
    path = scratch(spark, "summaries")
    strategy = F.element_at(F.array(*[F.lit(s) for s in _STRATEGIES]), (F.col("user_id") % 3 + 1).cast("int"))
    stage = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int")
    e = tables(spark, sf_dir, "events").select(F.when(stage > 0, strategy).otherwise("shared").alias("strategy"), stage.alias("stage"), F.col("event_type").alias("domain"), "value")
    counts = e.groupBy("strategy", "stage", "domain").agg(F.count("*").alias("total"), F.count_if(F.col("value") > 50).alias("correct"))
    cell = F.struct("total", "correct", (F.col("correct") / F.col("total")).alias("accuracy"))
    summary = F.struct(
        F.sum("total").alias("total"), F.sum("correct").alias("correct"), (F.sum("correct") / F.sum("total")).alias("micro_accuracy"),
        F.map_from_entries(F.collect_list(F.struct("domain", cell))).alias("domains"),
    )
    for r in counts.groupBy("strategy", "stage").agg(F.to_json(summary).alias("text")).collect():  # ten summaries
        spark.createDataFrame([(r.text,)], "value string").coalesce(1).write.text(f"{path}/{r.strategy}-{r.stage}")
    paths = {(s, k): f"{path}/{s}-{k}" for s in _STRATEGIES for k in (1, 2, 3)}
    return scans.stage_summaries(spark, f"{path}/shared-0", paths, SUMMARY)


# -- programs and tests


@R.add(
    "code_blocks",
    """SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'x = ' || conv_id WHEN 1 THEN 'import m' || chr(10) || 'print(' || conv_id || ')'
  WHEN 2 THEN 'no code ' || conv_id ELSE 'y = ' || conv_id END AS code, turn % 4 <> 2 AS parses FROM conversations""",
)
def code_blocks(spark, sf_dir):
    """Programs in a closed fence, behind an explanation, behind an open fence, or none; and whether what is found parses."""
    n, shape = F.col("conv_id").cast("string"), F.col("turn") % 4
    response = (
        F.when(shape == 0, F.concat(F.lit("Here:\n```python\nx = "), n, F.lit("\n```\nand ```other```")))
        .when(shape == 1, F.concat(F.lit(" Sure.\nimport m\nprint("), n, F.lit(")\n")))
        .when(shape == 2, F.concat(F.lit("no code "), n))
        .otherwise(F.concat(F.lit("```\ny = "), n))
    )
    c = tables(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("response"))
    found = grading.on_distinct(c, ["response"], grading.code_block_udf, "code")
    return found.select("conv_id", "turn", "code", (grading.code_status_udf("code") == "ready").alias("parses"))


@R.add(
    "test_payloads",
    """SELECT conv_id, turn, CASE turn % 6 WHEN 2 THEN 'import ' || role WHEN 3 THEN 's' ELSE '' END AS setup,
  CASE turn % 6 WHEN 0 THEN ['assert f(' || conv_id || ')'] WHEN 1 THEN ['a', role] WHEN 2 THEN ['assert x'] WHEN 3 THEN [role] ELSE []::VARCHAR[] END AS tests,
  CASE turn % 6 WHEN 4 THEN 'invalid_json' WHEN 5 THEN 'no tests under ' || least(role, 'other') || ', ' || greatest(role, 'other') END AS problem FROM conversations""",
)
def test_payloads(spark, sf_dir):
    """Tests as a string, a list with blanks, under a known key, nested as objects, not as JSON, and not at all."""
    n, role, shape = F.col("conv_id").cast("string"), F.col("role"), F.col("turn") % 6
    payload = (
        F.when(shape == 0, F.concat(F.lit('" assert f('), n, F.lit(') "')))
        .when(shape == 1, F.concat(F.lit('["a", "  ", "'), role, F.lit('"]')))
        .when(shape == 2, F.concat(F.lit('{"cases": ["no"], "setup_code": "import '), role, F.lit('", "test_list": ["assert x"]}')))
        .when(shape == 3, F.concat(F.lit('{"inner": {"setup": " s ", "cases": [{"assertion": "'), role, F.lit('"}, {"z": 1}]}}')))
        .when(shape == 4, "{not json")
        .otherwise(F.concat(F.lit('{"'), role, F.lit('": 1, "other": "text"}')))
    )
    c = tables(spark, sf_dir, "conversations").select("conv_id", "turn", payload.alias("payload"))
    return grading.on_distinct(c, ["payload"], grading.normal_grading_udf, "g").select("conv_id", "turn", "g.setup", "g.tests", "g.problem")


@R.add(
    "test_readiness_audit",
    """SELECT conv_id, turn, CASE turn % 5 WHEN 0 THEN 'ready_for_sandbox' WHEN 1 THEN 'invalid_test_syntax' WHEN 2 THEN 'missing_tests' WHEN 3 THEN 'base_tests_present' ELSE 'missing_base_tests' END AS status,
  CASE turn % 5 WHEN 0 THEN 2 WHEN 1 THEN 3 WHEN 3 THEN 1 ELSE 0 END AS tests FROM conversations""",
)
def test_readiness_audit(spark, sf_dir):
    """Grading keys by whether their tests can be run, told by their syntax."""
    n, shape = F.col("conv_id").cast("string"), F.col("turn") % 5
    tests = (
        F.when(shape == 0, F.concat(F.lit('{"public": ["assert f('), n, F.lit(')"], "hidden": ["x = 1\\nassert x"], "setup": "import m"}')))
        .when(shape == 1, F.concat(F.lit('{"public": ["assert 1", "assert ("], "challenge": ["assert '), n, F.lit('"]}')))
        .when(shape == 2, '{"public": [], "setup": "import m"}')
        .when(shape == 3, F.concat(F.lit('{"test": "check('), n, F.lit(')"}')))
        .otherwise('{"test": ""}')
    )
    domain = F.when(shape < 3, "programmation").otherwise("programmation_avancee")
    c = tables(spark, sf_dir, "conversations").select("conv_id", "turn", domain.alias("domain"), tests.alias("payload"))
    return grading.on_distinct(c, ["domain", "payload"], grading.test_readiness_udf, "g").select("conv_id", "turn", "g.status", "g.tests")


@R.add(
    "case_hashes",
    """SELECT event_id, sha256('{"event_type": "' || event_type || '", "late": ' || CASE WHEN event_id % 5 = 0 THEN 'null' ELSE (value > 50)::VARCHAR END || ', "user_id": ' || user_id || '}') AS case_hash FROM events""",
)
def case_hashes(spark, sf_dir):
    """Fields are given in another order than that of their names."""
    late = F.when(F.col("event_id") % 5 != 0, F.col("value") > 50)
    fields = {"user_id": F.col("user_id"), "late": late, "event_type": F.col("event_type")}
    return tables(spark, sf_dir, "events").select("event_id", text.case_hash(fields).alias("case_hash"))


# -- answers


@R.add(
    "conclusion_rescue",
    """SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_linenumber % 4 = 3 THEN NULL WHEN l_suppkey % 3 = 0 THEN 'candidate_incorrect' WHEN l_suppkey % 3 = 1 THEN 'rescued_correct' ELSE 'verification_unavailable' END AS outcome FROM lineitem""",
)
def conclusion_rescue(spark, sf_dir):
    """Conclusions with one number against golds that are equal in value, differ, or can't be read; one in four has no candidate."""
    n, gold, shape = F.col("l_partkey") % 500 + 1, F.col("l_suppkey") % 3, F.col("l_linenumber") % 4
    number = F.when(shape == 0, n.cast("string")).otherwise(F.concat(n.cast("string"), F.lit(".0")))
    response = F.when(shape == 3, "So 1 and 2").otherwise(F.concat(F.lit("x\nTherefore, the total is "), number, F.lit(".")))
    expected = F.when(gold == 0, (n + 1).cast("string")).when(gold == 1, F.concat((n * 2).cast("string"), F.lit("/2"))).otherwise("((")
    li = tables(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), response.alias("r"), expected.alias("expected"))
    li = li.withColumn("candidate", extraction.conclusion_candidate(F.col("r"))[1])
    return grading.on_distinct(li, ["candidate", "expected"], grading.rescue_udf, "outcome").select("k", "i", "outcome")


@R.add(
    "exact_values",
    """WITH q AS (SELECT l_orderkey AS k, l_linenumber AS i, (l_partkey % 9 + l_suppkey % 7)::BIGINT * l_linenumber - (l_suppkey % 4)::BIGINT * (l_partkey % 6 + 1) AS n, (l_partkey % 6 + 1)::BIGINT AS d FROM lineitem)
SELECT k, i, CASE WHEN d // gcd(n, d) = 1 THEN (n // gcd(n, d))::VARCHAR ELSE (n // gcd(n, d)) || '/' || (d // gcd(n, d)) END AS value FROM q""",
)
def exact_values(spark, sf_dir):
    """Calculations as text, evaluated without rounding, each different one once."""
    s = lambda c, m, add=0: (F.col(c) % m + add).cast("string")
    expression = F.concat(F.lit("("), s("l_partkey", 9), F.lit(" + "), s("l_suppkey", 7), F.lit(")*"), F.col("l_linenumber").cast("string"), F.lit("/"), s("l_partkey", 6, 1), F.lit(" - "), s("l_suppkey", 4))
    li = tables(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), expression.alias("e"))
    return grading.on_distinct(li, ["e"], grading.exact_value_udf, "value").select("k", "i", "value")


_SHAPE = "'x ' || doc_id || CASE doc_id % 5 WHEN 0 THEN ' \\boxed {1}' WHEN 1 THEN chr(10) || ' Final answer : 4' WHEN 2 THEN ' so THE ANSWER IS 4' WHEN 3 THEN ' thusly \\boxed' ELSE ' the final answer is 2 \\boxed{' END"


@R.add(
    "answer_flags",
    f"""WITH r AS (SELECT doc_id, {_SHAPE} AS r FROM documents)
SELECT doc_id, regexp_matches(r, '\\\\boxed\\s*\\{{') AS has_boxed, regexp_matches(r, '(?im)^\\s*(REPONSE|RÉPONSE|FINAL_ANSWER|Final answer)\\s*:') AS has_final_marker,
  regexp_matches(r, '(?i)\\b(the (final )?answer is|la réponse est|therefore|thus)\\b') AS has_answer_phrase, doc_id % 3 = 0 AS flag FROM r""",
)
def answer_flags(spark, sf_dir):
    """What responses of five shapes show; every flag is true in some rows and false in others."""
    shape, flag = F.col("doc_id") % 5, F.col("doc_id") % 3
    tail = F.when(shape == 0, " \\boxed {1}").when(shape == 1, "\n Final answer : 4").when(shape == 2, " so THE ANSWER IS 4").when(shape == 3, " thusly \\boxed").otherwise(" the final answer is 2 \\boxed{")
    r = F.concat(F.lit("x "), F.col("doc_id").cast("string"), tail)
    said = F.when(flag == 0, " True\n").when(flag == 1, "yes").otherwise("false")
    d = tables(spark, sf_dir, "documents")
    return d.select(
        "doc_id", text.has_boxed(r).alias("has_boxed"), text.has_final_marker(r).alias("has_final_marker"), text.has_answer_phrase(r).alias("has_answer_phrase"), text.as_bool(said).alias("flag")
    )


# -- plans and guards


@R.add(
    "substituted_plan",
    f"""WITH {_MIX}, p AS (SELECT doc_id, lang, row_number() OVER (ORDER BY md5('42-order|' || kind || '|' || doc_id), doc_id, kind) AS presentation FROM m),
k AS (SELECT *, CASE WHEN lang <> 'en' THEN row_number() OVER (PARTITION BY lang <> 'en' ORDER BY presentation) END AS k FROM p),
n AS (SELECT doc_id AS new, row_number() OVER (ORDER BY doc_id DESC) AS k FROM documents WHERE lang = 'en')
SELECT presentation, coalesce(new, doc_id) AS doc_id, lang <> 'en' AS replaced FROM k LEFT JOIN n USING (k)""",
)
def substituted_plan(spark, sf_dir):
    """The mixed plan with every old-domain id replaced, in its place, by the next repeated id of the current domain."""
    plan = replay_mix(spark, sf_dir).select("doc_id", "lang", "presentation")
    last = tables(spark, sf_dir, "documents").where("lang = 'en'").orderBy(F.desc("doc_id")).limit(58).select("doc_id", (-F.col("doc_id")).alias("pos"))
    changed = sampling.substitute(plan, last, F.col("lang") != "en", "doc_id", "presentation")
    return changed.select("presentation", "doc_id", (F.col("lang") != "en").alias("replaced"))


_REQUIRED = {"documents": ["doc_id", "text", "question"], "labels": ["doc_id", "quality"], "pages": ["page_id", "url", "answer", "split"]}


@R.add(
    "missing_columns",
    "SELECT 'documents' AS tab, 'question' AS missing, count(*) AS rows FROM documents UNION ALL SELECT 'pages', m, n FROM (SELECT count(*) AS n FROM pages), (VALUES ('answer'), ('split')) v(m)",
)
def missing_columns(spark, sf_dir):
    """Columns that tables lack, with the rows that are concerned."""
    out = None
    for name, required in _REQUIRED.items():
        t = tables(spark, sf_dir, name)
        lacking = F.array(*[F.lit(c) for c in constraints.missing_columns(t, required)]).cast("array<string>")
        part = t.agg(F.count("*").alias("rows")).select(F.lit(name).alias("tab"), F.explode(lacking).alias("missing"), "rows")
        out = part if out is None else out.unionByName(part)
    return out


@R.add("guarded_repair", "SELECT event_id, event_type, value FROM events WHERE NOT (event_type = 'error' AND value > 50)")
def guarded_repair(spark, sf_dir):
    """Bad records go if they are as many as the run's summary says; with another number the repair is refused."""
    e = tables(spark, sf_dir, "events").select("event_id", "event_type", "value")
    bad = (F.col("event_type") == "error") & (F.col("value") > 50)
    by_type = {r.event_type: r.bad for r in e.groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("bad")).collect()}  # a row for each type
    constraints.require_count(e, bad, by_type["error"], "bad records")
    try:
        constraints.require_count(e, bad, by_type["error"] + 1, "bad records")
    except constraints.Violation:
        return e.where(~bad)
    raise RuntimeError("a wrong number was not refused")


_PROMPT = {"system": "You grade answers.", "style": "short"}


@R.add("prompts", f"SELECT conv_id, turn, '{json.dumps(_PROMPT)}' || chr(10) || chr(10) || text AS prompt FROM conversations")
def prompts(spark, sf_dir):
    return tables(spark, sf_dir, "conversations").select("conv_id", "turn", text.prompt(json.dumps(_PROMPT), F.col("text")).alias("prompt"))


@R.add("changed_rows", """SELECT d.lang AS domain, doc_id, CASE WHEN quality = 1 THEN 'lost' ELSE 'gained' END AS change FROM documents d JOIN labels l USING (doc_id) WHERE (quality = 1) <> (toxic = 0)""")
def changed_rows(spark, sf_dir):
    """Questions that one of two runs has right and the other wrong, a row each."""
    return paired.changes(graded(spark, sf_dir), F.col("before"), F.col("after"), "domain", "doc_id")


@R.add(
    "failed_rows",
    """SELECT lang AS domain, source AS subtype, doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS nr FROM documents JOIN labels USING (doc_id) WHERE quality <> 1""",
)
def failed_rows(spark, sf_dir):
    """Failures of every class of exercises, numbered, a row each."""
    return aggregates.failures(graded(spark, sf_dir), ["domain", "subtype"], F.col("before"), "doc_id")


@R.add("literal_expectations", "SELECT lang, n, least_rows, n >= least_rows AS enough FROM (VALUES ('en', 100), ('fr', 1000000), ('de', 1)) v(lang, least_rows) JOIN (SELECT lang, count(*) AS n FROM documents GROUP BY lang) USING (lang)")
def literal_expectations(spark, sf_dir):
    """A table written in code, held against counts of a given one."""
    expected = scans.literal_table(spark, [("en", 100), ("fr", 1_000_000), ("de", 1)], "lang string, least_rows bigint")
    counts = tables(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n"))
    return counts.join(F.broadcast(expected), "lang").select("lang", "n", "least_rows", (F.col("n") >= F.col("least_rows")).alias("enough"))


@R.add("registered_graders", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'ready' ELSE 'syntax_error' END AS status, '\\boxed{' || turn || '}' AS boxed FROM conversations")
def registered_graders(spark, sf_dir):
    """Graders called by name from SQL text."""
    grading.register(spark)
    turn = F.col("turn").cast("string")
    code = F.concat(F.lit("x = "), F.when(F.col("turn") % 2 == 0, turn).otherwise("("))
    answer = F.concat(F.lit("so \\boxed{"), turn, F.lit("} \\boxed{"))
    tables(spark, sf_dir, "conversations").select("conv_id", "turn", code.alias("code"), answer.alias("answer")).createOrReplaceTempView("gradus_answers")
    return spark.sql("SELECT conv_id, turn, code_status(code) AS status, last_boxed(answer) AS boxed FROM gradus_answers")


@R.add("markdown_report", "SELECT '| lang | n |' || chr(10) || '| --- | --- |' || chr(10) || string_agg('| ' || coalesce(lang, '') || ' | ' || n || ' |', chr(10) ORDER BY lang) AS report FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)")
def markdown_report(spark, sf_dir):
    counts = tables(spark, sf_dir, "documents").groupBy("lang").agg(F.count("*").alias("n")).orderBy("lang")
    return spark.createDataFrame([(sinks.markdown_table(counts),)], "report string")


# -- questions and checkpoints made from given rows

_N = "(('0x' || substr(md5('q|' || event_id), {at}, 3))::BIGINT % {size} + {low})"
_A, _B, _C, _X = (_N.format(at=1 + 3 * i, size=high - low + 1, low=low) for i, low, high in ((1, 2, 40), (2, 2, 30), (3, 2, 12), (4, 1, 25)))


@R.add(
    "generated_questions",
    f"""WITH t AS (SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN 'maths' WHEN event_type = 'purchase' THEN 'code' ELSE 'algebra' END AS domain,
  {_N.format(at=1, size=5, low=0)} AS k5, {_N.format(at=1, size=4, low=0)} AS k4, {_A} AS a, {_B} AS b, {_C} AS c, {_X} AS x FROM events),
q AS (SELECT event_id, domain,
  CASE domain WHEN 'maths' THEN 'Calculate ' || CASE k5 WHEN 0 THEN a || ' + ' || b WHEN 1 THEN a || ' - ' || b WHEN 2 THEN a || ' * ' || c WHEN 3 THEN '(' || a || ' + ' || b || ') * ' || c ELSE a || ' * ' || c || ' - ' || b END
  WHEN 'algebra' THEN 'Solve ' || CASE k4 WHEN 0 THEN c || 'x + ' || b || ' = ' || (c * x + b) WHEN 1 THEN c || 'x - ' || b || ' = ' || (c * x - b) WHEN 2 THEN c || '(x + ' || b || ') = ' || (c * (x + b)) ELSE 'x/' || c || ' + ' || b || ' = ' || (x + b) END
  ELSE 'What is ' || CASE k5 WHEN 0 THEN a || ' // ' || c WHEN 1 THEN a || ' % ' || c WHEN 2 THEN c || ' ** 2' WHEN 3 THEN a || ' // ' || c || ' + ' || b ELSE a || ' % ' || c || ' * ' || b END || '?' END AS question,
  CASE domain WHEN 'maths' THEN CASE k5 WHEN 0 THEN a + b WHEN 1 THEN a - b WHEN 2 THEN a * c WHEN 3 THEN (a + b) * c ELSE a * c - b END
  WHEN 'algebra' THEN CASE WHEN k4 < 3 THEN x ELSE x * c END
  ELSE CASE k5 WHEN 0 THEN a // c WHEN 1 THEN a % c WHEN 2 THEN c * c WHEN 3 THEN a // c + b ELSE a % c * b END END AS answer FROM t),
f AS (SELECT domain, question, min(event_id) AS seed, arg_min(answer, event_id) AS answer FROM q GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY seed) AS nr FROM f)
SELECT domain, question, answer, seed, nr, max(nr) OVER (PARTITION BY domain) = 120 AS complete FROM r WHERE nr <= 120""",
)
def generated_questions(spark, sf_dir):
    """120 different questions of each domain, from as many attempts as there are events."""
    kind = F.when(F.col("event_type").isin("click", "view"), "maths").when(F.col("event_type") == "purchase", "code").otherwise("algebra")
    attempts = tables(spark, sf_dir, "events").select(kind.alias("domain"), F.col("event_id").alias("seed"))
    question, answer = generation.questions(F.md5(F.concat(F.lit("q|"), F.col("seed").cast("string"))), F.col("domain"))
    made = attempts.withColumns({"question": question, "answer": answer})
    return generation.first_different(made, "domain", "question", "seed", 120).select("domain", "question", "answer", "seed", "nr", "complete")


@R.add(
    "checkpoint_cells",
    f"""WITH e AS (SELECT ['{"', '".join(_STRATEGIES)}'][user_id % 3 + 1] AS strategy, least(3, (day(ts) - 1) // 8) AS stage, value FROM events WHERE event_type = 'signup'),
g AS (SELECT DISTINCT strategy, unnest(range(5))::INT AS stage FROM e)
SELECT strategy, g.stage, count(value) AS events, count(*) FILTER (WHERE value > 50) AS correct FROM g LEFT JOIN e USING (strategy, stage) GROUP BY 1, 2""",
)
def checkpoint_cells(spark, sf_dir):
    """Every strategy that the table has at every stage of the curriculum, with what the table has of it; one stage has nothing."""
    strategy = F.element_at(F.array(*[F.lit(s) for s in _STRATEGIES]), (F.col("user_id") % 3 + 1).cast("int"))
    stage = F.least(F.lit(3), F.floor((F.dayofmonth("ts") - 1) / 8)).cast("int")
    e = tables(spark, sf_dir, "events").where("event_type = 'signup'").select(strategy.alias("strategy"), stage.alias("stage"), "value")
    counts = e.groupBy("strategy", "stage").agg(F.count("value").alias("events"), F.count_if(F.col("value") > 50).alias("correct"))
    grid = joins.checkpoint_grid(counts.select("strategy").distinct(), scans.literal_table(spark, [(i,) for i in range(5)], "stage int"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return grid.join(counts, ["strategy", "stage"], "left").select("strategy", "stage", zero("events"), zero("correct"))
