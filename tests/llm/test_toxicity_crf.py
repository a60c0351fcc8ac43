import itertools

import numpy as np
import pytest

from gradus.llm.toxicity_crf import Crf, _Scorer, marginals, op8_toxicity_crf, score_toxicity, train


def brute(u, t):
    """P(toxic) by summing over all taggings."""
    n = len(u)
    weight = {
        y: np.exp(sum(u[i] * y[i] for i in range(n)) + sum(t[y[i - 1], y[i]] for i in range(n) if i) + np.log(np.exp(t[:, y[0]]).sum()))
        for y in itertools.product((0, 1), repeat=n)
    }
    z = sum(weight.values())
    return [sum(w for y, w in weight.items() if y[i]) / z for i in range(n)]


def test_marginals_equal_all_taggings():
    rng = np.random.default_rng(5)
    t = rng.normal(size=(2, 2))
    parts = [rng.normal(size=n) * 2 for n in (1, 0, 5, 9)]
    got = marginals(np.concatenate(parts), np.asarray([1, 0, 5, 9]), t)
    assert got == pytest.approx([p for u in parts if len(u) for p in brute(u, t)])


def test_blocks_do_not_change_marginals():
    """A long chain in blocks against plain message passing."""
    rng = np.random.default_rng(6)
    t = rng.normal(size=(2, 2))
    u = rng.normal(size=1000) * 3
    m = np.exp(t)
    f, b = np.zeros((1000, 2)), np.ones((1000, 2))
    for i in range(1000):
        f[i] = (f[i - 1] if i else np.ones(2)) @ m * [1, np.exp(u[i])]
        f[i] /= f[i].sum()
    for i in range(998, -1, -1):
        b[i] = m @ (b[i + 1] * [1, np.exp(u[i + 1])])
        b[i] /= b[i].sum()
    want = (f * b)[:, 1] / (f * b).sum(axis=1)
    rest = rng.normal(size=70)
    got = marginals(np.concatenate([rest, u]), np.asarray([70, 1000]), t)
    assert got[70:] == pytest.approx(want)


def test_learns_words_and_stems_and_points_at_them(spark):
    rng = np.random.default_rng(1)
    vocab = ["tala", "mire", "sonu", "peka", "lodi", "ruva", "kemo", "bati"]

    def doc(bad):
        ws = [vocab[i] + vocab[j] for i, j in rng.integers(0, 8, (40, 2))]
        if bad:
            ws[int(rng.integers(0, 40))] = ["zugrot,", "Vexoti" + vocab[int(rng.integers(0, 8))]][int(rng.integers(0, 2))]
        return " ".join(ws)

    model = train([(doc(i % 4 == 0), int(i % 4 == 0)) for i in range(300)])
    texts = [doc(False) for _ in range(40)] + [doc(True) for _ in range(20)] + ["Vexotiquux tala", None, ""]
    scores, spans = _Scorer(model).score(texts)
    assert (scores[:40] < 0.5).all() and (scores[40:61] >= 0.5).all() and (scores[61:] < 0.5).all()
    for text, found in zip(texts[40:61], spans[40:61]):
        assert any("zugrot" in text[a:b] or "Vexoti" in text[a:b] for a, b, _ in found)
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(texts)], "doc_id bigint, text string, score string")
    got = score_toxicity(docs, model).collect()
    assert [r.score for r in got] == pytest.approx(scores.tolist())
    assert score_toxicity(docs.limit(0), model).collect() == []
    assert _Scorer(Crf()).score(["tala"])[0][0] < 0.01 and train([("a", 0)]).weights == {}


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = op8_toxicity_crf(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    hits = sum(r.predicted and r.toxic for r in got)
    assert hits / max(1, sum(r.predicted for r in got)) > 0.95
    assert hits / sum(r.toxic for r in got) > 0.85
