"""Queries return all of their operator's result."""

from collections import Counter

import duckdb

from gradus.plans import catalog


def test_every_document_has_a_place(spark, sf_dir):
    rows = [(r.lang, r.n_chars, r.doc_id) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    got = {r.place: r.doc_id for r in catalog.QUERIES["composite_order"](spark, sf_dir).collect()}
    assert got == {i: x[2] for i, x in enumerate(sorted(rows), 1)} and len(got) == len(rows) > 50


def test_rollback_goes_to_the_last_checkpoint_of_the_log(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").collect()
    last = max(r.event_id for r in rows if r.event_type == "signup")
    got = [r.event_id for r in catalog.QUERIES["log_rollback"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(r.event_id for r in rows if r.event_id < last) and len(got) > 500


def test_every_turn_is_a_choice(spark, sf_dir):
    turns = {(r.conv_id, f"({chr(65 + r.turn)}) {r.role}") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()}
    got = {(r.conv_id, x) for r in catalog.QUERIES["question_composition"](spark, sf_dir).collect() for x in r.choices.split("\n")}
    assert got == turns and any(x.startswith("(H)") for _, x in got)


def test_sequential_ids_as_in_sql_over_9999_rows_and_nulls(spark, tmp_path):
    """Groups of more rows than four digits count, rows without an id, a language or a source."""
    long = spark.range(10_050).selectExpr("id * 7 AS doc_id", "'en' AS lang", "'a' AS source")
    odd = spark.createDataFrame([(None, "en", "a"), (None, "fr", "b"), (3, "fr", "b"), (-9, "fr", "b"), (4, None, "b"), (5, "fr", None)], "doc_id bigint, lang string, source string")
    long.unionByName(odd).write.parquet(f"{tmp_path}/documents.parquet")
    sql = catalog.ORACLE_SQL["sequential_ids"].replace("documents", f"read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    got = catalog.QUERIES["sequential_ids"](spark, str(tmp_path)).collect()
    assert Counter(map(tuple, got)) == Counter(duckdb.sql(sql).fetchall()) and len(got) == 10_056
