import re
from collections import Counter, defaultdict

import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from gradus.llm import toxicity_crf
from gradus.llm.bpe import default_path
from gradus.llm.common import documents, snapshot
from gradus.llm.line_dedup import MIN_PAGES, RATIO
from gradus.llm.mixing import find_exponent, source_shares

from .test_mixing import plain
from .test_simhash_dedup import roots

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = documents(spark, SF), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = snapshot(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def test_columns_stay(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "mixing", "bpe"]
    assert all(d.columns == stages[0].columns for d in stages[:-1])


def test_toxic_documents_go_and_clean_ones_stay(spark, stages):
    scored = toxicity_crf._Scorer(toxicity_crf.fit(spark, SF))
    rows = stages[0].collect()
    scores, _ = scored.score([r.text for r in rows])
    want = sorted(r.doc_id for r, s in zip(rows, scores) if s < toxicity_crf.THRESHOLD)
    assert sorted(r.doc_id for r in stages[1].collect()) == want
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    gone = {r.doc_id for r in rows} - set(want)
    assert sum(labels.get(d, 0) for d in gone) >= 20 and sum(1 for d in gone if labels.get(d) == 0) <= 1


def test_lines(stages):
    rows = stages[1].collect()
    texts = {(r.source, r.text) for r in rows}
    pages = Counter(s for s, _ in texts)
    on = Counter((s, x) for s, t in texts for x in {y.strip(" ") for y in t.split("\n")} - {""})
    bad = {k for k, n in on.items() if n >= MIN_PAGES and n > RATIO * pages[k[0]]}
    want = {
        r.doc_id: "\n".join(x for x in r.text.split("\n") if not x.strip(" ") or (r.source, x.strip(" ")) not in bad) for r in rows
    }
    got = stages[2].collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)
    assert sum(r.text != want[r.doc_id] for r in rows) > 50, "lines do go"


def test_near_copies(stages):
    """Against all pairs of five-word shingles: edited copies go, and what has no similar document stays."""
    rows = stages[2].collect()
    shingles = {}
    for r in rows:
        words = (r.text or "").encode().lower().split()
        shingles[r.doc_id] = frozenset(b" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))
    owners = defaultdict(list)
    for d in sorted(shingles):
        for x in shingles[d]:
            owners[x].append(d)
    pairs = []
    for d, own in shingles.items():
        for e, n in Counter(e for x in own for e in owners[x] if e < d).items():
            if n >= 0.8 * (len(own) + len(shingles[e]) - n):
                pairs.append((e, d))
    classes = roots(sorted(shingles), pairs)
    wanted = {d for d, c in classes.items() if d != c}
    gone = set(shingles) - {r.doc_id for r in stages[3].collect()}
    assert gone <= wanted, "no document goes without a similar one"
    edited = {d for d in wanted if not any(e < d and shingles[e] == shingles[d] for e in shingles if classes[e] == classes[d])}
    assert len(wanted - edited) > 50 and not (wanted - edited) - gone, "every exact copy goes"
    assert len(gone & edited) >= 0.9 * len(edited), "recall on edited copies alone"


def test_mix(stages):
    rows = [(r.doc_id, r.source, r.text) for r in stages[3].collect()]
    a = find_exponent(source_shares(stages[3]), corpus_pipeline.MIX)
    want = Counter(d for d, _, _ in plain(rows, a))
    assert Counter(r.doc_id for r in stages[4].collect()) == want
    assert set(want) == {r[0] for r in rows}, "every document is read once at least"


def test_ids(stages):
    tool = Tokenizer.from_file(default_path())
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    got = stages[5].collect()
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in stages[4].collect())
    known = defaultdict(list)
    for r in got:
        if r.doc_id not in known:
            known[r.doc_id] = tool.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert list(r.ids) == known[r.doc_id] and r.n_tokens == len(r.ids)


def test_run_and_empty_tables(spark, stages):
    ran = corpus_pipeline.run(spark, SF)
    assert Counter((r.doc_id, r.n_tokens) for r in ran.collect()) == Counter((r.doc_id, r.n_tokens) for r in stages[5].collect())
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.collect() == []
    odd = spark.createDataFrame([(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0)], stages[0].schema)
    for _, stage in corpus_pipeline.STAGES[:3]:
        odd = snapshot(stage(spark, odd, SF), "odd")
    assert [tuple(r)[:2] for r in odd.collect()] == [(1, "")]
    assert re.match("doc_id", stages[5].columns[0])
