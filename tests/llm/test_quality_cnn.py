import numpy as np

from gradus.llm.quality_cnn import CHUNK, WIDTH, Net, _forward, _gradients, _new, _padded, _Scorer, op3_quality_cnn, score_quality, train


def slow_score(net: Net, text) -> float:
    """The network by its definition: every window of the text, chunk by chunk."""
    data = _padded(text)
    responses = [
        sum(net.filters[k][data[i + k]] for k in range(WIDTH)) + net.bias for i in range(len(data) - WIDTH + 1)
    ]
    h = [
        np.tanh(np.maximum(np.max(responses[s : s + CHUNK], axis=0), 0) @ net.dense + net.dense_bias)
        for s in range(0, len(responses), CHUNK)
    ]
    x = np.concatenate([np.mean(h, axis=0), np.max(h, axis=0), np.min(h, axis=0)])
    return float(1 / (1 + np.exp(-(x @ net.out + net.out_bias)[0])))


def test_scores_cover_whole_texts():
    rng = np.random.default_rng(2)
    net = _new(rng)
    texts = [None, "", "a", "abcdef", "é" * 400, "".join(map(chr, rng.integers(32, 1000, 3000))), "x" * (CHUNK + WIDTH - 1)]
    got = _Scorer(net).score(texts)
    assert np.allclose(got, [slow_score(net, t) for t in texts], atol=1e-5)
    changed = texts[5][:-3] + "\x00\x00\x00"  # the last bytes count
    assert abs(_Scorer(net).score([changed])[0] - slow_score(net, changed)) < 1e-5


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = _new(rng)
    windows = rng.integers(97, 103, (5, CHUNK, WIDTH)).astype(np.uint8)
    owner, y = np.asarray([0, 0, 0, 1, 1]), np.asarray([1.0, 0.0])

    def loss():
        p = _forward(net, windows, owner, 2)[0]
        return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())

    for p, g in zip(net.parameters(), _gradients(net, windows, owner, y)):
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old = p[at]
        p[at] = old + 1e-5
        up = loss()
        p[at] = old - 1e-5
        down = loss()
        p[at] = old
        assert abs((up - down) / 2e-5 - g[at]) < 1e-4


def test_cases(spark):
    assert train([]).constant == 0.5 and train([("a", 1)]).constant == 1.0
    docs = spark.createDataFrame([(1, None, "s"), (1, "", "t"), (None, "abc", "u")], "doc_id bigint, text string, score string")
    got = score_quality(docs, _new(np.random.default_rng(0))).collect()
    assert len(got) == 3 and got[0].score == got[1].score and all(0 <= r.score <= 1 for r in got)
    assert score_quality(docs.limit(0), train([])).collect() == []


def test_held_out_documents(spark):
    d = "/root/testdata/sf0.1"
    got = op3_quality_cnn(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").where("held_out").collect()
    assert sum(r.predicted == r.quality for r in got) / len(got) > 0.95
    low = [r for r in got if not r.quality]
    assert sum(not r.predicted for r in low) / len(low) > 0.85
