from pyspark.sql import functions as F

from gradus.llm import exact_dedup as module
from gradus.llm.exact_dedup import candidates, exact_dedup
from gradus.llm.line_dedup import drop_boilerplate


def test_exact_dedup_levels_and_cases(spark, monkeypatch):
    long = "p" * 200
    rows = [(1, "Ab"), (2, "aB"), (3, "ab "), (4, None), (5, ""), (6, long + "x"), (7, long + "y"), (8, long.upper() + "X"),
            (9, "É"), (10, "é"), (2, "aB"), (None, "ab")]
    schema = "doc_id bigint, text string, kept string, keep_id string, group_size string, __full string, extra string"
    docs = spark.createDataFrame([(i, t, "z", "z", "z", "z", "e") for i, t in rows], schema)
    assert exact_dedup(docs).columns == ["doc_id", "extra", "keep_id", "group_size", "kept"]  # results win over clashing columns
    for hot in (1, 2, 64):  # all groups by broadcast, some, none
        monkeypatch.setattr(module, "HOT_ROWS", hot)
        got = sorted(((r.doc_id or 0, r.keep_id, r.group_size, r.kept) for r in exact_dedup(docs).collect()))
        assert got == [
            (0, 2, 4, False), (1, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (3, 3, 1, True), (4, 5, 2, False), (5, 5, 2, True),
            (6, 8, 2, False), (7, 7, 1, True), (8, 8, 2, True), (9, 9, 1, True), (10, 10, 1, True)]
    assert exact_dedup(docs.limit(0)).collect() == []


def test_rows_outside_shared_keys_get_no_full_hash(spark):
    """At any number of shared keys: far more keys than the former limit of 200,000 would stand for a small map here."""
    n = 60_000
    docs = spark.range(n).select(
        F.col("id").alias("doc_id"),
        F.when(F.col("id") < n // 2, F.concat(F.lit("pair "), F.floor(F.col("id") / 2).cast("string")))
        .otherwise(F.concat(F.lit("single number "), F.col("id").cast("string"))).alias("text"),
    )
    hashed = candidates(docs).where("__full is not null").agg(F.count("*"), F.count_if(F.col("doc_id") < n // 2)).first()
    assert hashed[1] == n // 2 and hashed[0] - hashed[1] < 0.09 * n // 2
    # a map that is far too small lets more rows on, and changes no result
    for bits in (1 << 15, 1 << 28):
        got = exact_dedup(docs, max_bits=bits).agg(F.count_if("kept"), F.max("group_size"), F.count_if(F.col("group_size") == 2)).first()
        assert tuple(got) == (n // 2 + n // 4, 2, n // 2)


def test_rows_without_a_shared_length_are_not_hashed(spark, monkeypatch):
    """At any size of the map: not even their prefix."""
    rows = [(i, "x" * i) for i in range(300)] + [(1000 + i, "pair" + "y" * 400 + str(i // 2 % 5)) for i in range(20)] + [(2000, None), (2001, "X")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for bits in (1 << 15, 1 << 28):
        got = {r.doc_id: r for r in candidates(docs, max_bits=bits).collect()}
        assert {i for i, r in got.items() if r["__pre"] is not None} == {*range(1000, 1020), 0, 1, 2000, 2001}
        assert all(r["__full"] is None for i, r in got.items() if 1 < i < 1000)
    monkeypatch.setattr(module, "LONGEST", 100)  # longer texts all go on
    assert candidates(docs).where("__pre is null and __len < 100").count() == 98
    assert exact_dedup(docs).where("group_size > 1").count() == 24


def test_line_dedup_is_relative_to_the_host(spark):
    rows = [(i, "big", f"menu \nbody {i}\n\nend {i % 7}") for i in range(40)] + [(100 + i, None, f"menu\nother {i}") for i in range(25)]
    rows += [(200, "small", "menu\nx"), (201, "small", "menu\ny"), (202, "big", None), (203, "big", ""), (204, "big", "menu")]
    rows += [(300 + i, "copied", "one page\nthat was copied") for i in range(60)] + [(400 + i, "copied", f"page {i}") for i in range(20)]
    docs = spark.createDataFrame([(*r, 9, "z") for r in rows], "doc_id bigint, source string, text string, lines_total int, __bad string")
    for few in (0, 100):  # both joins
        got = {r.doc_id: r for r in drop_boilerplate(docs, ratio=0.5, min_pages=10, broadcast_lines=few).collect()}
        assert len(got) == len(rows)
        assert got[3].text == "body 3\n\nend 3" and (got[3].lines_total, got[3].lines_dropped) == (4, 1)
        assert got[101].text == "other 1" and got[200].text == "menu\nx"
        assert got[202].text is None and got[202].lines_total == 0
        assert got[300].text == "one page\nthat was copied", "copies of a page are one page"
        assert drop_boilerplate(docs).columns == ["doc_id", "source", "lines_total", "lines_dropped", "text"]
        assert got[203].text == "" and got[204].text == "" and got[204].lines_dropped == 1
    assert drop_boilerplate(docs.limit(0)).collect() == []
