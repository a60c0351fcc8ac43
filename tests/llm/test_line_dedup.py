from collections import Counter

import duckdb
import pytest

from gradus.llm.line_dedup import MIN_PAGES, OP7_SQL, RATIO
from gradus.llm.registry import QUERIES


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_lines_go_and_own_lines_stay(spark, sf):
    path = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{path}/documents.parquet").collect()
    texts = {(r.source, r.text) for r in rows}
    pages = Counter(s for s, _ in texts)
    on = Counter((s, x) for s, t in texts for x in {y.strip(" ") for y in (t or "").split("\n")} - {""})
    bad = {k for k, n in on.items() if n >= MIN_PAGES and n > RATIO * pages[k[0]]}
    got = {r.doc_id: r for r in QUERIES["op7_line_dedup"](spark, path).collect()}
    for r in rows:
        kept = [x for x in (r.text or "").split("\n") if not x.strip(" ") or (r.source, x.strip(" ")) not in bad]
        assert (got[r.doc_id].text or "") == "\n".join(kept)
    dropped = sum(r.lines_dropped for r in got.values())
    assert dropped > (100 if sf == "sf0.01" else 0) and sum(1 for r in got.values() if r.text) > 0.99 * sum(1 for r in rows if r.text)
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{path}/documents.parquet')")
    want = sorted(con.sql(f"select doc_id, source, lines_total, lines_dropped, text from ({OP7_SQL})").fetchall(), key=repr)
    assert sorted((tuple(r) for r in got.values()), key=repr) == want
