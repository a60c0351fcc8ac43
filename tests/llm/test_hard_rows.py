"""Every operator over a table with very long, empty, null and repeated texts and clashing columns."""

import pytest
from pyspark.sql import functions as F

from gradus.llm import bpe, exact_dedup, line_dedup, media_jpeg, mixing, pii, quality_cnn, simhash_dedup, token_store, toxicity_crf

LONG = "Lorem ipsum, dolor 7!\n" * 60_000  # 1.3 million characters
RARE = "Ωμέγα \x00\x1c ﷺ 🙂‍🙂 \t" * 50


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, LONG), (2, LONG), (3, None), (4, ""), (4, ""), (None, "a b"), (5, RARE), (6, "x" * 300_000), (7, " \n \n")]
    df = spark.createDataFrame([(i, t, "s", 1, 1.0, "k") for i, t in rows], "doc_id bigint, text string, source string, __row int, score double, key string")
    return df.drop("__row")


def ids(df):
    return sorted((r[0] is None, r[0] or 0) for r in df.select("doc_id").collect())


ALL = [(False, 1), (False, 2), (False, 3), (False, 4), (False, 4), (False, 5), (False, 6), (False, 7), (True, 0)]


def test_every_row_gets_a_result(docs):
    coded = bpe.bpe_round_trip(docs)
    assert ids(coded) == ALL and coded.where("doc_id = 1").select(F.size("ids")).first()[0] > 300_000
    assert ids(exact_dedup.exact_dedup(docs)) == ALL
    assert ids(line_dedup.drop_boilerplate(docs)) == ALL
    assert ids(pii.replace_entities(docs, "k")) == ALL
    assert ids(quality_cnn.score_quality(docs, quality_cnn.train([("good text here", 1), ("bad bad", 0)] * 5, epochs=1))) == ALL
    assert ids(toxicity_crf.score_toxicity(docs, toxicity_crf.Crf())) == ALL
    assert ids(simhash_dedup.near_classes(docs)) == ALL
    payload = docs.select("doc_id", F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("payload"))
    read = media_jpeg.with_features(media_jpeg.with_media(payload)).where("status = 'ok'")
    assert ids(read) == ALL and read.where("doc_id = 1").first().images == 3
    stored = token_store.read_store(*token_store.write_store(docs.select("doc_id", "text")))
    assert ids(stored) == ALL


def test_long_copies_are_one_class(docs):
    kept = simhash_dedup.drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    assert ids(kept) == [(False, 1), (False, 3), (False, 5), (False, 6), (True, 0)]
    groups = {r.doc_id: r.group_size for r in exact_dedup.exact_dedup(docs).collect()}
    assert groups[1] == groups[2] == 2 and groups[3] == groups[4] == 3 and groups[7] == 1


def test_mix_of_hard_rows(docs):
    got = mixing.draw(docs, mixing.Target(passes=2.0))
    assert set(docs.columns) < set(got.columns) and {(False, 1), (False, 2), (False, 3), (False, 4)} <= set(ids(got))


@pytest.mark.parametrize(
    ("text", "found"),
    [
        ("1 " + "a." * 100_000, 0),
        ("1 a@" + "a." * 100_000, 0),
        ("1 " + "a@" * 100_000, 0),
        ("1 " + "x" * 1_000_000, 0),
        ("1 " + ".." * 100_000 + "ann@post.org", 1),
        ("token=" + "aB3/" * 50_000 + " end", 1),
        ("x" * 100_000 + "@post.org end", 1),
        ("Mr " + "A" + "b" * 100_000 + " end", 1),
        ("4" * 300_000 + " 12-" * 10_000, 0),
    ],
)
def test_pii_of_long_tokens(spark, text, found):
    got = pii.replace_entities(spark.createDataFrame([(1, text)], "doc_id bigint, text string"), "k").first()
    assert got.n_entities == found and (got.text == text) == (found == 0)
    if found:
        assert got.text.endswith(text[-4:]) and text[:400] not in got.text.replace("..", "")
