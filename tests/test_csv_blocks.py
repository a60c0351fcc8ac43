"""CSV cut at true record ends, whatever the blocks."""

import csv
import io
import random

import pytest

from gradus.functions import text
from gradus.sources import csv_blocks, scans


@pytest.fixture
def small_blocks(spark):
    name = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(name)
    yield lambda size: spark.conf.set(name, str(size))
    spark.conf.set(name, before)


def made(rng, rows, end):
    pieces = ["a", "é", ",", '"', "\n", " ", "x,y", '""', "long " * 9, "7"]
    cells = [(str(i), "".join(rng.choice(pieces) for _ in range(rng.randint(1, 12))), rng.choice(["k", "k\nk", 'q"q'])) for i in range(rows)]
    out = io.StringIO()
    writer = csv.writer(out, lineterminator="\n")
    writer.writerow(["id", "text", "kind\nof"])
    writer.writerows(cells)
    return cells, out.getvalue().replace("\n", end)


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("size", [40, 333, 100_000])
def test_records_are_those_of_one_reader(spark, tmp_path, small_blocks, size, end):
    cells, body = made(random.Random(size), 150, end)
    (tmp_path / "a.csv").write_bytes(body.encode())
    (tmp_path / "b.csv").write_bytes(("text,id\n\nonly,5\n").encode())
    small_blocks(size)
    got = scans.csv_table(spark, [f"file://{tmp_path}/a.csv", f"file://{tmp_path}/b.csv"], "id int, text string", split=True)
    if size == 40:
        assert spark.read.text(f"file://{tmp_path}/a.csv").rdd.getNumPartitions() > 20
    found = sorted((r.id, r.text) for r in got.collect())
    strip = lambda x: x.strip(" ") if not any(c in x for c in ',"\n') else x
    assert [(i, strip(t)) for i, t in found] == sorted([(int(i), strip(t)) for i, t, _ in cells] + [(5, "only")])
    plain = scans.csv_table(spark, f"file://{tmp_path}/a.csv", "id int, text string")
    assert sorted((r.id, r.text) for r in plain.collect()) == [r for r in found if r != (5, "only")]


def test_one_record_over_many_blocks(spark, tmp_path, small_blocks):
    long = "line\n" * 500
    (tmp_path / "a.csv").write_text(f'id,"long\nname",t\n1,"{long}",x\n\n2,,"{long}"\n3,"""",""\n')
    small_blocks(64)
    got = scans.csv_table(spark, f"file://{tmp_path}/a.csv", "id int, t string, `long\nname` string", split=True)
    rows = {r[0]: r for r in got.collect()}
    assert rows[1][1:] == ("x", long) and rows[2][1:] == (long, None) and rows[3][2] == '"' and len(rows) == 3


def test_bad_files_raise(spark, tmp_path, small_blocks):
    small_blocks(64)
    (tmp_path / "open.csv").write_text('id,t\n1,x\n2,"' + "never closed\n" * 20)
    (tmp_path / "type.csv").write_text("id,t\nno number,x\n")
    (tmp_path / "none.csv").write_text("id,t\n")
    for name, words in (("open", "an open quote"), ("type", "no number|MALFORMED")):
        with pytest.raises(Exception, match=words):
            scans.csv_table(spark, f"file://{tmp_path}/{name}.csv", "id int, t string", split=True).collect()
    assert scans.csv_table(spark, f"file://{tmp_path}/none.csv", "id int, t string", split=True).collect() == []


def test_layout_follows_the_parity():
    blocks = [("f", 0, 3, True, False), ("f", 10, 0, False, False), ("f", 20, 1, True, False), ("f", 30, 0, False, False), ("g", 0, 0, False, True)]
    assert csv_blocks.layout(blocks) == {
        ("f", 0): (False, 0, False), ("f", 10): (True, 0, False), ("f", 20): (True, 0, False), ("f", 30): (False, 20, False), ("g", 0): (False, 0, True),
    }


def test_fields_of_a_case_are_sorted(spark):
    import hashlib
    import json

    case = {"b": 'x "y"\n', "a": 3, "d": None, "c": True}
    df = spark.createDataFrame([(case["b"], case["a"], None, True)], "b string, a int, d string, c boolean")
    for names in ("bdac", "cabd"):
        got = df.select(text.sorted_json({n: df[n] for n in names}).alias("j"), text.case_hash({n: df[n] for n in names}).alias("h")).first()
        assert json.loads(got.j) == case and got.j == json.dumps(case, sort_keys=True)
        assert got.h == hashlib.sha256(json.dumps(case, sort_keys=True).encode()).hexdigest()
