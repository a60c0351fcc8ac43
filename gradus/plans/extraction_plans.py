"""Extraction and text functions over documents and conversations.

The tables hold no graded answers, so short responses are made from them: the first
number forms of a document's id and length, in the shapes that the extractors know.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from gradus.functions import classify, extraction, rewards, text
from gradus.plans.base import Registry, tables

R = Registry()

# A response for every order: label forms, bare numbers, phrases, calculations, contradictions.
_RESPONSE_SQL = """r AS (SELECT o_orderkey AS k, o_custkey % 50 AS expected, CASE o_orderkey % 3 WHEN 0 THEN 'maths' WHEN 1 THEN 'algebre' ELSE 'code' END AS domain,
  CASE o_orderkey % 11
    WHEN 0 THEN 'REPONSE: ' || (o_custkey % 50) WHEN 1 THEN 'calcul' || chr(10) || 'RÉPONSE : x = -' || (o_custkey % 9) || '.0'
    WHEN 2 THEN '  ' || (o_custkey % 50) || '. ' WHEN 3 THEN 'Le résultat est ' || (o_custkey % 50) || '.'
    WHEN 4 THEN 'RESULTAT: ' || (o_custkey % 7) WHEN 5 THEN '2 + 3 = ' || (o_custkey % 50)
    WHEN 6 THEN 'je ne sais pas' WHEN 7 THEN 'REPONSE: 4' || chr(10) || 'x = ' || (o_custkey % 50)
    WHEN 8 THEN '**REPONSE: ' || (o_custkey % 50) || '**' WHEN 9 THEN 'REPONSE: 0.5' ELSE '' END AS response FROM orders)"""


def responses(spark, sf_dir):
    o = tables(spark, sf_dir, "orders")
    n = lambda m: (F.col("o_custkey") % m).cast("string")
    s = lambda *p: F.concat(*[F.lit(x) if isinstance(x, str) else x for x in p])
    forms = [
        s("REPONSE: ", n(50)), s("calcul\nRÉPONSE : x = -", n(9), ".0"), s("  ", n(50), ". "), s("Le résultat est ", n(50), "."),
        s("RESULTAT: ", n(7)), s("2 + 3 = ", n(50)), F.lit("je ne sais pas"), s("REPONSE: 4\nx = ", n(50)),
        s("**REPONSE: ", n(50), "**"), F.lit("REPONSE: 0.5"), F.lit(""),
    ]
    response = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        response = F.when(F.col("o_orderkey") % 11 == i, f).otherwise(response)
    domain = F.element_at(F.array(*map(F.lit, ("maths", "algebre", "code"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    return o.select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 50).alias("expected"), domain.alias("domain"), response.alias("response"))


_W = r"(-?[0-9]+)(?:\.0+)?"
_FIRST = lambda x, p, flags="": f"nullif(regexp_extract({x}, '{p}', 1{flags}), '')::BIGINT"
_LASTALL = lambda x, p: f"list_extract(regexp_extract_all({x}, '{p}', 1), -1)::BIGINT"
_LINE = "coalesce(list_extract(list_filter(list_transform(string_split(response, chr(10)), lambda y: trim(y, ' ')), lambda y: y <> ''), -1), '')"
_PHRASE = _FIRST(_LINE, rf"(?i)(?:est|is|affiche|vaut)\s+[`*]*{_W}[`*]*[.!]?\s*$")
_NUM = _FIRST("response", rf"^\s*(?:x\s*=\s*)?{_W}\s*[.!]?\s*$")


def _method(a: str, b: str | None, c: str) -> str:
    middle = f"WHEN {b} IS NOT NULL THEN 'numeric' " if b else ""
    return f"CASE WHEN {a} IS NOT NULL THEN 'explicit' {middle}WHEN {c} IS NOT NULL THEN 'fallback' ELSE 'not_found' END"


_V1 = _LASTALL("response", rf"(?i)(?:R[ÉE]PONSE|RESPONSE)\s*:\s*(?:x\s*=\s*)?{_W}")
_V2 = _LASTALL("response", rf"(?im)^\s*\**(?:R[ÉE]PONSE|RESPONSE)\**\s*:\s*(?:x\s*=\s*)?{_W}\s*[.!]?\s*$")
_V3 = _LASTALL("response", rf"(?im)^\s*\**(?:R[ÉE]PONSE|RESPONSE|R[ÉE]SULTAT|RESULTAT)\**\s*:\s*(?:x\s*=\s*)?{_W}\s*[.!]?\s*$")
_BARE = _FIRST(_LINE, rf"^{_W}[.!]?$")
_EQ = _FIRST(_LINE, rf"(?i)^x\s*=\s*{_W}[.!]?$")
_SUM = f"CASE WHEN domain = 'maths' THEN {_FIRST(_LINE, rf'^[0-9 ()+*/.-]+=\s*{_W}$')} END"
_REST3 = f"coalesce({_BARE}, {_EQ}, {_PHRASE})"
_REST4 = f"coalesce({_BARE}, {_EQ}, {_PHRASE}, {_SUM})"
_SMOKE = _LASTALL("response", rf"(?im)^\s*(?:R[ÉE]PONSE|RESPONSE|R[ÉE]SULTAT|RESULTAT)\s*:\s*{_W}\s*[.!]?\s*$")
_SMOKE_NUM = _FIRST("response", rf"^\s*{_W}\s*[.!]?\s*$")
_CLEAN = rf"regexp_replace({_LINE}, '^[ *`]+|[ *`]+$', '', 'g')"
_V5 = _FIRST(_CLEAN, rf"(?i)^(?:R[ÉE]PONSE|RESPONSE|R[ÉE]SULTAT|RESULTAT)\s*:\s*(?:x\s*=\s*)?{_W}[.!]?$")
_REST5 = (
    f"coalesce({_FIRST(_CLEAN, rf'^{_W}[.!]?$')}, {_FIRST(_CLEAN, rf'(?i)^x\s*=\s*{_W}[.!]?$')}, "
    f"CASE WHEN domain = 'maths' THEN {_FIRST(_CLEAN, rf'^[0-9 ()+*/.-]+=\s*{_W}$')} END, "
    + _FIRST(_CLEAN, rf"(?i)(?:est|is|affiche|vaut)\s+[`*]*{_W}[`*]*[.!]?\s*$") + ")"
)
_FORMS = {
    "v1": (f"coalesce({_V1}, {_NUM}, {_PHRASE})", _method(_V1, _NUM, _PHRASE)),
    "v2": (f"coalesce({_V2}, {_NUM}, {_PHRASE})", _method(_V2, _NUM, _PHRASE)),
    "v3": (f"coalesce({_V3}, {_REST3})", _method(_V3, None, _REST3)),
    "v4": (f"coalesce({_V3}, {_REST4})", _method(_V3, None, _REST4)),
    "v5": (f"coalesce({_V5}, {_REST5})", _method(_V5, None, _REST5)),
    "smoke": (f"coalesce({_SMOKE}, {_SMOKE_NUM})", _method(_SMOKE, _SMOKE_NUM, "NULL")),
}


def _extractor(name: str, make):
    value, method = _FORMS[name]

    @R.add(f"extract_{name}", f"WITH {_RESPONSE_SQL} SELECT k, {value} AS value, {method} AS method FROM r")
    def run(spark, sf_dir):
        r = responses(spark, sf_dir)
        made = make(F.col("response"), F.col("domain"))
        return r.select("k", made.value.alias("value"), made.method.alias("method"))

    return run


_extractor("v1", lambda r, d: extraction.extract_v1(r))
_extractor("v2", lambda r, d: extraction.extract_v2(r))
_extractor("v3", lambda r, d: extraction.extract_v3(r))
_extractor("v4", extraction.extract_v4)
_extractor("v5", extraction.extract_v5)
_extractor("smoke", lambda r, d: extraction.extract_smoke(r))

_FINAL_STATUS = """CASE o_orderkey % 11
    WHEN 0 THEN 'correct' WHEN 1 THEN CASE WHEN -(o_custkey % 9) = o_custkey % 50 THEN 'correct' ELSE 'incorrect' END
    WHEN 2 THEN 'correct' WHEN 3 THEN 'correct' WHEN 4 THEN CASE WHEN o_custkey % 7 = o_custkey % 50 THEN 'correct' ELSE 'incorrect' END
    WHEN 5 THEN CASE WHEN o_orderkey % 3 = 0 THEN 'correct' ELSE 'missing' END WHEN 6 THEN 'missing'
    WHEN 7 THEN CASE WHEN o_custkey % 50 = 4 THEN 'correct' ELSE 'contradictory' END WHEN 8 THEN 'correct' WHEN 9 THEN 'non_integer' ELSE 'missing' END"""


@R.add(
    "analyse_final",
    f"SELECT o_orderkey AS k, {_FINAL_STATUS} AS status, o_orderkey % 11 IN (0, 8) AS format_ok, o_orderkey % 11 IN (0, 8) AS end_to_end FROM orders",
)
def analyse_final(spark, sf_dir):
    a = extraction.analyse_final(F.col("response"), F.col("domain"), F.col("expected"))
    c = a.columns()
    return responses(spark, sf_dir).select("k", *[c[n].alias(n) for n in ("status", "format_ok", "end_to_end")])


@R.add(
    "analyse_reconciled",
    f"SELECT o_orderkey AS k, CASE WHEN s IN ('contradictory', 'non_integer') THEN 'ambiguous' ELSE s END AS status FROM (SELECT o_orderkey, {_FINAL_STATUS} AS s FROM orders)",
)
def analyse_reconciled(spark, sf_dir):
    a = extraction.analyse_reconciled(F.col("response"), F.col("domain"), F.col("expected"))
    return responses(spark, sf_dir).select("k", a.status.alias("status"))


@R.add(
    "extract_consistent",
    """SELECT o_orderkey AS k, CASE o_orderkey % 11 WHEN 0 THEN o_custkey % 50 WHEN 1 THEN -(o_custkey % 9) WHEN 4 THEN o_custkey % 7 WHEN 8 THEN o_custkey % 50 END AS value,
  o_orderkey % 11 IN (0, 1, 4, 8) AS consistent FROM orders""",
)
def extract_consistent(spark, sf_dir):
    value, good = extraction.extract_consistent(F.col("response"))
    return responses(spark, sf_dir).select("k", value.alias("value"), good.alias("consistent"))


@R.add(
    "reward_shapes",
    """WITH e AS (SELECT o_orderkey AS k, CASE WHEN o_orderkey % 5 > 0 THEN o_custkey % 40 END AS p, o_custkey % 50 AS e, o_orderkey % 2 = 0 AS f FROM orders)
SELECT k, coalesce((p = e)::INT::DOUBLE, 0) AS exact,
  CASE WHEN p IS NULL THEN 0 WHEN p = e THEN 1.0 + CASE WHEN f THEN 0.05 ELSE 0 END ELSE 0.4::DOUBLE * (1.0::DOUBLE / (1.0::DOUBLE + abs(p - e)::DOUBLE / greatest(1, abs(e)))) + CASE WHEN f THEN 0.05::DOUBLE ELSE 0 END END::DOUBLE AS graded,
  CASE WHEN p IS NULL OR NOT f THEN 0 WHEN p = e THEN 1.0 ELSE 0.05::DOUBLE / (1.0::DOUBLE + abs(p - e)) END::DOUBLE AS consistent_only,
  coalesce((p = e)::INT, 0) + 0.02::DOUBLE * f::INT AS with_format, coalesce((p = e)::INT::DOUBLE, 0) AS correctness_only FROM e""",
)
def reward_shapes(spark, sf_dir):
    o = tables(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("k"), F.when(F.col("o_orderkey") % 5 > 0, F.col("o_custkey") % 40).alias("p"), (F.col("o_custkey") % 50).alias("e"),
        (F.col("o_orderkey") % 2 == 0).alias("f"),
    )
    p, e, f = F.col("p"), F.col("e"), F.col("f")
    right = F.coalesce(p == e, F.lit(False))
    return o.select(
        "k", rewards.exact(p, e).alias("exact"), rewards.graded(p, e, f).alias("graded"), rewards.consistent_only(p, e, f).alias("consistent_only"),
        rewards.correct_and_format(right, f).alias("with_format"), rewards.correct_and_format(right, f, 0.0).alias("correctness_only"),
    )


@R.add(
    "subtype_rules",
    """WITH q AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE l_linenumber % 7 WHEN 0 THEN 'Calcule : (' || l_partkey || ' + 1) * 2' WHEN 1 THEN 'Calcule : ' || l_partkey || ' / 2 * 3'
  WHEN 2 THEN 'Calcule : ' || l_partkey || ' * 3' WHEN 3 THEN 'Calcule : ' || l_partkey || ' - 3' WHEN 4 THEN 'Calcule : ' || l_partkey || ' + 3' WHEN 5 THEN 'Calcule : 5' ELSE 'Calcule : 2 + 3 - 4' END AS q FROM lineitem)
SELECT k, i, CASE i % 7 WHEN 0 THEN 'operations_combinees' WHEN 1 THEN 'division' WHEN 2 THEN 'multiplication' WHEN 3 THEN 'soustraction' WHEN 4 THEN 'addition' WHEN 5 THEN 'addition' ELSE 'soustraction' END AS subtype,
  CASE i % 7 WHEN 0 THEN 'operations_combinees' WHEN 1 THEN 'multiplication' WHEN 2 THEN 'multiplication' WHEN 3 THEN 'soustraction' WHEN 4 THEN 'addition' WHEN 5 THEN 'autre' ELSE 'addition' END AS exercise_type FROM q""",
)
def subtype_rules(spark, sf_dir):
    part = F.col("l_partkey").cast("string")
    s = lambda *p: F.concat(F.lit("Calcule : "), *[F.lit(x) if isinstance(x, str) else x for x in p])
    forms = [s("(", part, " + 1) * 2"), s(part, " / 2 * 3"), s(part, " * 3"), s(part, " - 3"), s(part, " + 3"), s("5"), s("2 + 3 - 4")]
    q = F.lit(None).cast("string")
    for i, f in enumerate(forms):
        q = F.when(F.col("l_linenumber") % 7 == i, f).otherwise(q)
    li = tables(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), q.alias("q"))
    m = F.lit("maths")
    return li.select("k", "i", classify.subtype(F.col("q"), m).alias("subtype"), classify.exercise_type(F.col("q"), m).alias("exercise_type"))


@R.add(
    "error_categories",
    """WITH g AS (SELECT event_type, CASE user_id % 5 WHEN 0 THEN 'passed' WHEN 1 THEN 'failed_assertion' WHEN 2 THEN 'execution_error' WHEN 3 THEN 'syntax_error' ELSE 'execution_error' END AS status,
  CASE WHEN user_id % 5 = 2 THEN 'TypeError: bad: operand' WHEN user_id % 5 = 4 AND user_id % 2 = 0 THEN 'NameError' END AS error FROM events)
SELECT event_type, CASE WHEN status = 'failed_assertion' THEN 'incorrect_result' WHEN status = 'execution_error' THEN coalesce(nullif(trim(split_part(error, ':', 1)), ''), 'other_execution_error') ELSE status END AS category, count(*) AS n FROM g GROUP BY 1, 2""",
)
def error_categories(spark, sf_dir):
    u = F.col("user_id") % 5
    status = F.when(u == 0, "passed").when(u == 1, "failed_assertion").when(u == 3, "syntax_error").otherwise("execution_error")
    error = F.when(u == 2, "TypeError: bad: operand").when((u == 4) & (F.col("user_id") % 2 == 0), "NameError")
    e = tables(spark, sf_dir, "events").select("event_type", classify.error_category(status, error).alias("category"))
    return e.groupBy("event_type", "category").agg(F.count("*").alias("n"))


@R.add(
    "text_functions",
    r"""SELECT doc_id, sha256(text) AS text_sha, ('0x' || substr(sha256(text), 1, 8))::BIGINT AS stable_offset, len(list_filter(string_split(text, chr(10)), lambda x: trim(x, ' ') <> '')) AS n_lines,
  list_extract(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x, ' ')), lambda x: x <> ''), -1) AS last_line,
  regexp_matches(text, '\\boxed\s*\{') AS has_boxed, coalesce(try_cast(nullif(regexp_extract(source, '[0-9]+'), '') AS INT) BETWEEN 3 AND 5, false) AS level_kept, lower(trim(lang)) = 'true' AS flag FROM documents""",
)
def text_functions(spark, sf_dir):
    d, t = tables(spark, sf_dir, "documents"), F.col("text")
    return d.select(
        "doc_id", F.sha2(t, 256).alias("text_sha"), text.stable_offset(t).alias("stable_offset"), F.size(text.lines(t)).cast("long").alias("n_lines"),
        text.last(text.lines(t)).alias("last_line"), text.has_boxed(t).alias("has_boxed"), text.level_between(F.col("source")).alias("level_kept"), text.as_bool(F.col("lang")).alias("flag"),
    )


@R.add(
    "number_functions",
    """SELECT l_orderkey AS k, l_linenumber AS i, CASE WHEN l_quantity::INT % 2 = 0 THEN l_quantity::BIGINT // 2 END AS half, floor(-l_partkey / 7.0)::BIGINT AS floored, ((-l_partkey % 7) + 7) % 7 AS positive_rest,
  100.0::DOUBLE * l_linenumber / 7 AS share, CASE WHEN l_linenumber > 1 THEN l_quantity / (l_linenumber - 1) END AS safe, greatest(0, l_quantity - 25) AS deficit, upper(chr((97 + l_linenumber % 7)::INT)) AS letter,
  l_partkey * 1000 AS thousands FROM lineitem""",
)
def number_functions(spark, sf_dir):
    from gradus.functions import numeric

    li = tables(spark, sf_dir, "lineitem")
    choice = F.concat(F.lit("("), F.chr(F.lit(97) + F.col("l_linenumber") % 7), F.lit(")"))
    letter = F.coalesce(text.choice_letter(choice), F.upper(F.substring(choice, 2, 1)))
    commas = F.format_number(F.col("l_partkey") * 1000, 0)
    return li.select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), text.integral((F.col("l_quantity") / 2).cast("string")).alias("half"),
        numeric.floor_div(-F.col("l_partkey"), F.lit(7)).alias("floored"), F.pmod(-F.col("l_partkey"), F.lit(7)).alias("positive_rest"),
        numeric.percent(F.col("l_linenumber"), F.lit(7)).alias("share"), numeric.ratio(F.col("l_quantity"), F.col("l_linenumber") - 1).alias("safe"),
        numeric.clamp(F.col("l_quantity") - 25).alias("deficit"), letter.alias("letter"), text.normal_number(commas).cast("bigint").alias("thousands"),
    )


# Numbers of 1 to 20 decimals, most of them zero; the twin looks at the digits.
@R.add(
    "integral_numbers",
    """WITH n AS (SELECT l_orderkey AS k, l_linenumber AS i, (l_partkey - 100)::VARCHAR AS whole, rpad('', (l_orderkey % 20)::INT, '0') || CASE l_suppkey % 3 WHEN 0 THEN '' WHEN 1 THEN '0' ELSE '1' END AS digits FROM lineitem)
SELECT k, i, CASE WHEN replace(digits, '0', '') = '' THEN whole::BIGINT END AS value FROM n""",
)
def integral_numbers(spark, sf_dir):
    digits = F.concat(F.rpad(F.lit(""), (F.col("l_orderkey") % 20).cast("int"), F.lit("0")), F.element_at(F.array(*map(F.lit, ("", "0", "1"))), (F.col("l_suppkey") % 3 + 1).cast("int")))
    raw = F.concat((F.col("l_partkey") - 100).cast("string"), F.when(digits != "", F.concat(F.lit("."), digits)).otherwise(""))
    return tables(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), text.integral(raw).alias("value"))


@R.add(
    "boxed_functions",
    """SELECT conv_id, turn, CASE WHEN turn % 3 < 2 THEN role || '{' || turn || '}' END AS contents, CASE WHEN turn % 3 < 2 THEN '\\boxed{' || role || '{' || turn || '}}' END AS whole,
  CASE WHEN turn % 3 < 2 THEN '\\boxed{' || role || '{' || turn || '}}' ELSE '\\boxed {1}' END AS closing FROM conversations""",
)
def boxed_functions(spark, sf_dir):
    """The last box of responses with one, two and an open last box."""
    from gradus.functions import braces

    turn = F.col("turn").cast("string")
    good = F.concat(F.lit("x \\boxed{"), F.col("role"), F.lit("{"), turn, F.lit("}} y"))
    response = F.concat(F.lit("\\boxed {1} then "), F.when(F.col("turn") % 3 < 2, good).otherwise("\\boxed{open {brace}"))
    c = tables(spark, sf_dir, "conversations").select("conv_id", "turn", response.alias("r"))
    r = F.col("r")
    return c.select("conv_id", "turn", braces.boxed_contents(r).alias("contents"), braces.boxed_whole(r).alias("whole"), braces.boxed_any(r).alias("closing"))


@R.add(
    "hash_mark_answers",
    """SELECT o_orderkey, (o_custkey % 1000)::VARCHAR AS answer, 'total ' || o_custkey || ' is' AS reasoning,
  'total ' || o_custkey || ' is' || chr(10) || chr(10) || 'REPONSE: \\boxed{' || (o_custkey % 1000) || '}' AS final FROM orders""",
)
def hash_mark_answers(spark, sf_dir):
    """Answers behind ``####`` and reasoning without calculator marks, brought into the final form."""
    n, rest = F.col("o_custkey").cast("string"), (F.col("o_custkey") % 1000).cast("string")
    raw = F.concat(F.lit(" total <<1+"), n, F.lit("=2>>"), n, F.lit(" is\n#### "), rest, F.lit(" \n"))
    o = tables(spark, sf_dir, "orders").select("o_orderkey", text.answer_after_hashes(raw).alias("answer"), text.reasoning_without_marks(raw).alias("reasoning"))
    return o.withColumn("final", text.boxed_answer(F.col("reasoning"), F.col("answer")))


@R.add(
    "conclusion_categories",
    """SELECT l_orderkey AS k, l_linenumber AS i, CASE l_linenumber % 5 WHEN 0 THEN 'unique_numeric_candidate' WHEN 1 THEN 'ambiguous_multiple_numbers' WHEN 2 THEN 'no_explicit_conclusion' WHEN 3 THEN 'no_numeric_candidate' ELSE 'empty_response' END AS category,
  CASE WHEN l_linenumber % 5 = 0 THEN l_partkey::VARCHAR END AS candidate,
  CASE WHEN l_quantity > 45 THEN 'truncated' WHEN l_quantity > 40 THEN 'other_domain' ELSE CASE l_linenumber % 5 WHEN 0 THEN 'unique_numeric_candidate' WHEN 1 THEN 'ambiguous_multiple_numbers' WHEN 2 THEN 'no_explicit_conclusion' WHEN 3 THEN 'no_numeric_candidate' ELSE 'empty_response' END END AS route FROM lineitem""",
)
def conclusion_categories(spark, sf_dir):
    part, i = F.col("l_partkey").cast("string"), F.col("l_linenumber") % 5
    response = (
        F.when(i == 0, F.concat(F.lit("x\nTherefore, it is **"), part, F.lit("** bags."))).when(i == 1, F.concat(F.lit("So 3 and "), part))
        .when(i == 2, "Step 1: 42").when(i == 3, "Thus it holds.").otherwise(" \n ")
    )
    li = tables(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", response.alias("r"))
    category, candidate = extraction.conclusion_candidate(F.col("r"))
    domain = F.when(F.col("l_quantity") > 40, "algebre_avancee").otherwise("maths_appliques")
    route = extraction.recheck_route(F.col("l_quantity") > 45, domain, F.col("r"))
    return li.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), category.alias("category"), candidate.alias("candidate"), route.alias("route"))


@R.add("json_fields", "SELECT event_id, (props->>'k')::INT AS k, md5('{\"event_type\":\"' || event_type || '\",\"user_id\":' || user_id || '}') AS case_md5 FROM events")
def json_fields(spark, sf_dir):
    e = tables(spark, sf_dir, "events")
    parsed = F.from_json("props", "k int")
    return e.select("event_id", parsed["k"].alias("k"), F.md5(F.to_json(F.struct("event_type", "user_id"))).alias("case_md5"))


@R.add("truncation_flags", "SELECT conv_id, turn, length(text) >= 600 AND right(text, 1) NOT IN ('.', '?') AS truncated FROM conversations")
def truncation_flags(spark, sf_dir):
    c = tables(spark, sf_dir, "conversations")
    flag = extraction.is_truncated(F.char_length("text"), 600, F.ascii(F.right("text", F.lit(1))), (ord("."), ord("?")))
    return c.select("conv_id", "turn", flag.alias("truncated"))


@R.add("question_composition", "SELECT conv_id, string_agg('(' || chr((65 + turn)::INT) || ') ' || role, chr(10) ORDER BY turn) AS choices FROM conversations GROUP BY 1")
def question_composition(spark, sf_dir):
    c = tables(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role"))).alias("ts"))
    labels = F.transform("ts", lambda x: F.chr(F.lit(65) + x["turn"]))
    composed = text.compose_choices(F.lit(""), labels, F.col("ts.role"))
    return c.select("conv_id", F.substring(composed, 2, 1 << 30).alias("choices"))


# Answers a/b against expected c/d: equal by cross-multiplication, however they are written.
@R.add(
    "math_grades",
    """WITH q AS (SELECT o_orderkey, o_custkey % 9 + 1 AS a, o_orderkey % 4 + 1 AS b, o_custkey % 6 + 1 AS c, o_orderkey % 3 + 1 AS d FROM orders)
SELECT o_orderkey, CASE WHEN a * d = b * c THEN 'correct' ELSE 'incorrect' END AS status, a * d = b * c AS correct, '\\boxed{\\frac{' || a || '}{' || b || '}}' AS final_answer, 'boxed' AS extraction FROM q""",
)
def math_grades(spark, sf_dir):
    from gradus.functions.grading import graded_by_box

    a, b, c, d = ((F.col(k) % m + 1).cast("string") for k, m in (("o_custkey", 9), ("o_orderkey", 4), ("o_custkey", 6), ("o_orderkey", 3)))
    response = F.concat(F.lit("REPONSE: \\boxed{\\frac{"), a, F.lit("}{"), b, F.lit("}}"))
    answers = tables(spark, sf_dir, "orders").select("o_orderkey", F.concat(c, F.lit("/"), d).alias("expected"), response.alias("response"))
    return graded_by_box(answers, "expected", "response").select("o_orderkey", "status", "correct", "final_answer", "extraction")


@R.add(
    "label_grades",
    """WITH q AS (SELECT o_orderkey, o_custkey % 9 + 1 AS a, o_orderkey % 4 + 1 AS b, o_custkey % 6 + 1 AS c, o_orderkey % 3 + 1 AS d, o_orderkey % 5 = 0 AS mute FROM orders)
SELECT o_orderkey, CASE WHEN mute THEN 'missing_final' WHEN a * d = b * c THEN 'correct' ELSE 'incorrect' END AS status, NOT mute AND a * d = b * c AS correct, mute AS needs_review,
  CASE WHEN NOT mute THEN a || '/' || b END AS final_answer FROM q""",
)
def label_grades(spark, sf_dir):
    """Fractions a/b behind a label, or none, against c/d."""
    from gradus.functions.grading import grade_by_label_udf

    a, b, c, d = ((F.col(k) % m + 1).cast("string") for k, m in (("o_custkey", 9), ("o_orderkey", 4), ("o_custkey", 6), ("o_orderkey", 3)))
    response = F.when(F.col("o_orderkey") % 5 == 0, "I do not know what it could be").otherwise(F.concat(F.lit("so\nREPONSE: "), a, F.lit("/"), b))
    graded = tables(spark, sf_dir, "orders").select("o_orderkey", grade_by_label_udf(F.concat(c, F.lit("/"), d), response).alias("g"))
    return graded.select("o_orderkey", "g.status", "g.correct", "g.needs_review", "g.final_answer")


@R.add(
    "choice_grades",
    """WITH q AS (SELECT o_orderkey, chr((65 + o_custkey % 5)::INT) AS gold, chr((65 + o_orderkey % 6)::INT) AS said FROM orders)
SELECT o_orderkey, CASE WHEN said = 'F' THEN 'missing_choice' WHEN said = gold THEN 'correct' ELSE 'incorrect' END AS status, said = gold AS correct FROM q""",
)
def choice_grades(spark, sf_dir):
    """Choices A to E, and an F that is none."""
    from gradus.functions.grading import grade_choice_udf

    letter = lambda k, m: F.concat(F.lit("("), F.chr(F.lit(65) + F.col(k) % m), F.lit(")"))
    response = F.concat(F.lit("because\nREPONSE: "), letter("o_orderkey", 6))
    graded = tables(spark, sf_dir, "orders").select("o_orderkey", grade_choice_udf(letter("o_custkey", 5), response).alias("g"))
    return graded.select("o_orderkey", "g.status", "g.correct")


@R.add("code_status", "SELECT conv_id, turn, CASE WHEN turn % 2 = 0 THEN 'ready' ELSE 'syntax_error' END AS status FROM conversations")
def code_status(spark, sf_dir):
    """Programs by what can be said without running them."""
    from gradus.functions.grading import code_status_udf

    c = tables(spark, sf_dir, "conversations")
    code = F.concat(F.lit("```python\nx = "), F.when(F.col("turn") % 2 == 0, F.col("conv_id").cast("string")).otherwise("("), F.lit("\n```"))
    return c.select("conv_id", "turn", code_status_udf(code).alias("status"))


@R.add(
    "equation_checks",
    """WITH e AS (SELECT l_orderkey AS k, l_linenumber AS i, (l_partkey % 7)::BIGINT AS a, (l_suppkey % 9)::BIGINT AS b, l_quantity::BIGINT AS x, l_linenumber % 5 AS f, CASE WHEN l_orderkey % 4 = 0 THEN 1 ELSE 0 END AS off FROM lineitem)
SELECT k, i, CASE f WHEN 0 THEN 'addition' WHEN 1 THEN 'soustraction' WHEN 2 THEN 'distributivite' WHEN 3 THEN 'fraction' END AS form,
  CASE WHEN f < 4 THEN a <> 0 AND CASE f WHEN 3 THEN off = 0 ELSE off = 0 END END AS holds FROM e""",
)
def equation_checks(spark, sf_dir):
    from gradus.functions.equations import equation_form, solves

    li = tables(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), (F.col("l_partkey") % 7).alias("a"), (F.col("l_suppkey") % 9).alias("b"),
        F.col("l_quantity").cast("bigint").alias("x"), (F.col("l_linenumber") % 5).alias("f"), F.when(F.col("l_orderkey") % 4 == 0, 1).otherwise(0).alias("off"),
    )
    f, a, b, x, off = (F.col(c) for c in ("f", "a", "b", "x", "off"))
    text_ = (
        F.when(f == 0, F.format_string("Trouve x : %dx + %d = %d", a, b, a * x + b + off)).when(f == 1, F.format_string("Trouve x : %dx - %d = %d", a, b, a * x - b + off))
        .when(f == 2, F.format_string("%d(x + %d) = %d", a, b, a * (x + b) + off)).when(f == 3, F.format_string("x/%d + %d = %d", a, b, x + b + off)).otherwise("rien")
    )
    q = li.withColumn("q", text_).withColumn("v", F.when(f == 3, x * a).otherwise(x))
    return q.select("k", "i", equation_form(F.col("q")).alias("form"), solves(F.col("q"), F.col("v")).alias("holds"))
