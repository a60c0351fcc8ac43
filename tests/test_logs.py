"""Logs, versions, stage folds and caches: killed runs, failed publications, repeated work."""

import pytest
from pyspark.sql import functions as F

from gradus.plans import log_plans
from gradus.schemas import STRATEGIES
from gradus.sources import files
from gradus.streaming import stages
from gradus.streaming.append_log import AppendLog, resume_log, run_available
from gradus.streaming.cache import ResultCache, case_digest
from gradus.streaming.versioned import VersionedLog

SCHEMA = "id bigint, step bigint, status string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA)


def rows(df):
    return sorted(tuple(r) for r in df.select("id", "step", "status").collect())


# -- small files


def test_a_name_is_taken_once(spark, tmp_path):
    path = f"file://{tmp_path}/a/one.json"
    files.write_new(spark, path, "first é")
    with pytest.raises(FileExistsError):
        files.write_new(spark, path, "second")
    assert files.read_text(spark, path) == "first é"
    assert files.names(spark, f"file://{tmp_path}/a") == ["one.json"] and files.names(spark, f"file://{tmp_path}/none") == []


# -- append log


def test_killed_runs_lose_and_repeat_nothing(spark, tmp_path):
    path = f"file://{tmp_path}"
    log = AppendLog(spark, f"{path}/log", SCHEMA)
    frame(spark, [(i, i, "a") for i in range(50)]).write.parquet(f"{path}/in")
    stream = spark.readStream.schema(SCHEMA).parquet(f"{path}/in")
    at = {"checkpoint": f"{path}/cp", "key": "id"}
    log_plans._killed_run(stream, log, **at, before_entry=log_plans._kill)
    assert log.read().count() == 0 and len(files.names(spark, f"{path}/log/segments")) == 1
    log_plans._killed_run(stream, log, **at, run="two", after_entry=log_plans._kill)
    assert log.read().count() == 50
    frame(spark, [(i, i, "b") for i in range(40, 80)]).write.mode("append").parquet(f"{path}/in")
    run_available(stream, log, **at, run="three")
    run_available(stream, log, **at, run="four")
    assert rows(log.read()) == [(i, i, "a" if i < 50 else "b") for i in range(80)]
    assert {r.run: r.rows for r in log.ledger().groupBy("run").agg(F.sum("rows").alias("rows")).collect()} == {"two": 50, "three": 30}
    assert log.sweep() == 1 and log.read().count() == 80  # the segment of the first run


def test_a_batch_is_published_once(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", SCHEMA)
    one = frame(spark, [(1, 1, "a")])
    assert log.read().count() == 0 and log.ledger().count() == 0
    assert log.publish(one, 0) and not log.publish(one, 0)
    # another writer is faster, between the segment and the entry
    assert not log.publish(one, 1, before_entry=lambda: log.publish(frame(spark, [(2, 2, "b")]), 1))
    assert rows(log.read()) == [(1, 1, "a"), (2, 2, "b")] and log.sweep() == 0


def test_a_resumed_run_does_what_is_missing(spark, tmp_path):
    log = AppendLog(spark, f"file://{tmp_path}/log", SCHEMA)
    expected = frame(spark, [(i, i, "") for i in range(10)])
    seen = []

    def work(missing):
        seen.append(missing.count())
        done = missing.withColumn("status", F.when(F.col("id") % 3 == 0, "timeout").otherwise("done"))
        return done if len(seen) > 1 else done.where("status <> 'timeout'")  # transient failures are not kept

    for number in range(3):
        resume_log(expected, log, "id", number, work)
    assert seen == [10, 4, 0] and log.read().count() == 10


# -- versions


@pytest.fixture
def versioned(spark, tmp_path):
    log = VersionedLog(spark, f"file://{tmp_path}/v", SCHEMA, "step")
    log.append(frame(spark, [(i, i, "bad" if i == 3 else "ok") for i in range(10)]))
    log.append(frame(spark, [(i, i, "bad" if i == 17 else None) for i in range(10, 20)]))
    log.append(frame(spark, [(i, i, "ok") for i in range(20, 30)] + [(99, None, "ok")]))
    return log


def test_rollback_and_repair_write_only_what_changes(spark, versioned):
    log = versioned
    names = [s["name"] for s in log.manifest()["segments"]]
    assert log.roll_back(15) == 4
    now = log.manifest()["segments"]
    assert [s["name"] for s in now][0] == names[0] and names[1] not in [s["name"] for s in now]
    assert sorted(r[0] for r in rows_of(log)) == [*range(15), 99]
    assert log.repair(F.col("status") == "bad") == 5  # null is not bad
    assert sorted(r[0] for r in rows_of(log)) == [i for i in [*range(15), 99] if i != 3]
    assert sorted(r[0] for r in rows_of(log, 3)) == [*range(30), 99] and len(rows_of(log, 1)) == 10
    assert [tuple(r) for r in log.history().orderBy("version").select("version", "kind", "kept").collect()] == [
        (1, "append", 0), (2, "append", 1), (3, "append", 2), (4, "rollback", 1), (5, "repair", 2),
    ]
    assert log.repair(F.lit(False)) == 6 and log.manifest()["segments"] == log.manifest(5)["segments"]


def rows_of(log, version=None, **options):
    return log.read(version, **options).select("id", "step", "status").collect()


def test_a_failed_publication_leaves_the_old_version(spark, versioned, monkeypatch):
    before = rows_of(versioned)

    def fails(*_):
        raise OSError("no space")

    with monkeypatch.context() as m:
        m.setattr(files, "write_new", fails)
        for change in (lambda: versioned.roll_back(5), lambda: versioned.repair(F.col("id") < 9), lambda: versioned.append(frame(spark, [(1, 50, "x")]))):
            with pytest.raises(OSError):
                change()
            assert versioned.versions() == [1, 2, 3] and sorted(map(str, rows_of(versioned))) == sorted(map(str, before))
    versioned.roll_back(5)
    assert versioned.expire(1) > 3 and versioned.versions() == [4] and sorted(r.id for r in rows_of(versioned)) == [0, 1, 2, 3, 4, 99]


def test_of_two_writers_one_publishes(spark, versioned):
    stale = versioned.manifest()
    versioned.append(frame(spark, [(50, 50, "x")]))
    with pytest.raises(FileExistsError):
        versioned._publish(stale, "append", [], None)
    assert versioned.manifest()["kind"] == "append" and len(rows_of(versioned)) == 32


def test_reading_by_step_skips_segments(spark, versioned):
    read = versioned.read(before=12)
    assert sorted(r.id for r in read.collect()) == list(range(12)) and len({f.rsplit("/", 2)[1] for f in read.inputFiles()}) == 2


def test_logs_without_rows_or_checkpoint(spark, tmp_path, versioned):
    empty = VersionedLog(spark, f"file://{tmp_path}/e", SCHEMA, "step")
    assert rows_of(empty) == [] and empty.roll_back(None) == 0 and empty.repair(F.lit(True)) == 0 and empty.history().count() == 0
    assert empty.append(frame(spark, [])) == 1 and rows_of(empty) == []
    with pytest.raises(ValueError, match="no checkpoint"):
        versioned.roll_back(None)
    with pytest.raises(ValueError):
        versioned.manifest(77)


# -- stages


def test_a_fold_goes_on_behind_its_last_stage(spark, tmp_path):
    made = []

    def step(state, stage):
        if stage == "c" and made.count("c") == 0:
            made.append(stage)
            raise RuntimeError("killed")
        made.append(stage)
        return {"sum": state["sum"].select((F.col("n") * 2 + len(stage)).alias("n"))}

    start = {"sum": spark.createDataFrame([(1,), (5,)], "n bigint")}
    for killed in (True, False):
        if killed:
            with pytest.raises(RuntimeError):
                stages.fold(spark, f"file://{tmp_path}/f", "abc", start, step)
        else:
            out = stages.fold(spark, f"file://{tmp_path}/f", "abc", start, step)
    assert made == ["a", "b", "c", "c"]
    assert {n: sorted(r.n for r in t["sum"].collect()) for n, t in out.items()} == {1: [3, 11], 2: [7, 23], 3: [15, 47]}


def test_stage_loop_keeps_the_budget(spark, sf_dir):
    plan = log_plans.stage_loop_plan(spark, sf_dir).collect()
    for stage in range(1, 5):
        for strategy in STRATEGIES:
            mine = [r for r in plan if r.stage == stage and r.strategy == strategy]
            kinds = [r.source_type for r in mine]
            assert sorted(r.pos for r in mine) == list(range(1, 41))
            assert kinds.count("replay") == (0 if strategy == "no_replay" else 8)
            current = {r.domain for r in mine if r.source_type == "current"}
            assert current == {log_plans._DOMAINS[stage]} and not current & {r.domain for r in mine if r.source_type == "replay"}


# -- cache


def test_only_changed_cases_are_worked_on(spark, tmp_path):
    cache = ResultCache(spark, f"file://{tmp_path}/c", "grade bigint", buckets=16)
    seen = []

    def work(cases):
        seen.append(cases.count())
        return cases.where("coalesce(q, '') <> 'later'").select("digest", F.coalesce(F.length("q"), F.lit(-1)).cast("bigint").alias("grade"))

    cases = lambda *qs: spark.createDataFrame([(i, q) for i, q in enumerate(qs)], "id int, q string")
    digest = lambda protocol: case_digest(protocol, F.col("q"))
    first = cache.run(cases("a", "bb", "bb", None, "", "later"), digest("p1"), work)
    assert (first.worked, seen) == (4, [5]) and sorted((r.id, r.grade) for r in first.results.collect()) == [(0, 1), (1, 2), (2, 2), (3, -1), (4, 0)]
    old = {f for f in cache.read().inputFiles()}
    second = cache.run(cases("a", "bb", "ccc", None, "", "later"), digest("p1"), work)
    assert (second.worked, second.buckets, seen) == (1, 1, [5, 2]) and old < set(cache.read().inputFiles())
    assert {r.id: (r.grade, r.fresh) for r in second.results.collect()} == {0: (1, False), 1: (2, False), 2: (3, True), 3: (-1, False), 4: (0, False)}
    third = cache.run(cases("a", "bb"), digest("p2"), work)  # another protocol: nothing holds
    assert third.worked == 2 and all(r.fresh for r in third.results.collect())
    assert cache.run(cases("a"), digest("p2"), work).worked == 0


def test_a_run_that_dies_adds_nothing(spark, tmp_path, monkeypatch):
    cache = ResultCache(spark, f"file://{tmp_path}/c", "grade bigint")
    cases = spark.createDataFrame([(1, "a")], "id int, q string")
    work = lambda c: c.select("digest", F.lit(1).cast("bigint").alias("grade"))
    with monkeypatch.context() as m:
        m.setattr(files, "write_new", lambda *_: (_ for _ in ()).throw(OSError("killed")))
        with pytest.raises(OSError):
            cache.run(cases, case_digest("p", F.col("q")), work)
    assert cache.read().count() == 0 and cache.run(cases, case_digest("p", F.col("q")), work).worked == 1


def test_fields_of_a_digest_stay_apart(spark):
    df = spark.createDataFrame([("ab", "c"), ("a", "bc"), (None, "abc"), ("", "abc"), ("abc", None)], "a string, b string")
    assert df.select(case_digest("p", F.col("a"), F.col("b"))).distinct().count() == 5
