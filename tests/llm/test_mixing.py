import hashlib
import math
import re
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from gradus.llm import mixing
from gradus.llm.mixing import SEED, Target, draw, find_exponent, source_shares


def plain(rows, exponent, whole=None):
    """(doc_id, source, block) of the mix, by sorting every source as a whole."""
    words = lambda t: len(re.findall(r"[^ \t\n\x0b\f\r]+", t or ""))
    by = defaultdict(list)
    for doc_id, source, text in rows:
        by[source].append((doc_id, words(text), "" if doc_id is None else str(doc_id), hashlib.md5((text or "").encode()).hexdigest()))
    totals = {s: sum(d[1] for d in ds) for s, ds in by.items()}
    totals = {s: t for s, t in totals.items() if t}
    raw = {s: (t / sum(totals.values())) ** exponent for s, t in totals.items()}
    weight = {s: r / sum(raw.values()) for s, r in raw.items()}
    whole = whole or max(totals[s] / weight[s] for s in totals)
    out = []
    for s, t in totals.items():
        full, rest = divmod(math.floor(weight[s] * whole + 1e-6), t)
        place = lambda d: (int(hashlib.md5(f"{SEED}|{full}|{d[2]}|{d[3]}".encode()).hexdigest()[:13], 16), d[2], d[3])  # noqa: E731, B023
        spent, left = defaultdict(int), rest
        for d in by[s]:
            spent[place(d)] += d[1]
        inside = set()
        for key in sorted(spent):
            left -= spent[key]
            if left < 0:
                break
            inside.add(key)
        for d in by[s]:
            out += [(d[0], s, b) for b in range(full + (place(d) in inside))]
    return sorted(out, key=str)


@pytest.mark.parametrize("bins", [2000, 3])
def test_blocks_equal_a_plain_sort(spark, sf_dir, monkeypatch, bins):
    monkeypatch.setattr(mixing, "BIN_ROWS", bins)
    monkeypatch.setattr(mixing, "GROUP_BINS", 4 if bins == 3 else 256)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")
    rows = [tuple(r) for r in docs.collect()]
    for target in (Target(passes=1.7), Target(entropy=0.97), Target(passes=3.0, budget=20_000)):
        a = find_exponent(source_shares(docs), target)
        got = sorted(((r.doc_id, r.source, r["__block"]) for r in draw(docs, target).collect()), key=str)
        assert got == plain(rows, a, target.budget)


def test_exponent_meets_the_target(spark):
    tokens = {"a": 5000, "b": 700, "c": 90, None: 10}
    shares = spark.createDataFrame([(s, 1, t) for s, t in tokens.items()], "source string, docs bigint, tokens bigint")
    total = sum(tokens.values())

    def mix(a):
        raw = [(t / total) ** a for t in tokens.values()]
        return [r / sum(raw) for r in raw]

    a = find_exponent(shares, Target(entropy=0.8))
    assert -sum(w * math.log(w) for w in mix(a)) / math.log(4) == pytest.approx(0.8, abs=1e-9)
    a = find_exponent(shares, Target(passes=4.0, budget=10_000))
    assert max(w * 10_000 / t for w, t in zip(mix(a), tokens.values())) == pytest.approx(4.0, abs=1e-6)
    assert find_exponent(shares, Target(passes=1000.0)) == 0.0
    with pytest.raises(ValueError):
        find_exponent(shares, Target())


def test_nulls_repeats_empty_and_clashing_columns(spark):
    rows = [(1, None, "a b c", 1), (1, None, "a b c", 1), (None, "x", None, 2), (2, "x", "d", 2), (3, "empty", "", 3)]
    docs = spark.createDataFrame(rows, "doc_id bigint, source string, text string, tokens int")
    got = draw(docs, Target(passes=2.0))
    assert got.columns[:4] == docs.columns
    assert {(r.doc_id, r.source) for r in got.collect()} == {(1, None), (None, "x"), (2, "x")}
    assert draw(docs.limit(0), Target(passes=2.0)).collect() == []


def test_columns_named_like_those_inside(spark):
    inside = ["__s", "__bins", "__cut", "__block", "__place", "__tokens", "__source", "__key", "__full", "__rest", "__n", "__last", "__s2"]
    others = ["budget", "docs", "shares"]
    docs = spark.createDataFrame([(i, "ab"[i % 2], "x y z " * (i + 1)) for i in range(9)], "doc_id bigint, source string, text string")
    more = docs.select("*", *[F.lit(i).alias(c) for i, c in enumerate(inside + others)])
    got = draw(more, Target(passes=2.0))
    assert got.columns == [*docs.columns, *others, "__block", "__place", "__tokens"]
    plain_rows = draw(docs, Target(passes=2.0))
    assert sorted(map(tuple, got.select(*plain_rows.columns).collect())) == sorted(map(tuple, plain_rows.collect()))
