from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from gradus.llm.bpe import default_path
from gradus.llm.common import documents
from gradus.llm.mixing import Target, source_budgets


def test_ids_decode_back(spark, sf_dir):
    tool = Tokenizer.from_file(default_path())
    docs = documents(spark, sf_dir).limit(60)
    got = corpus_pipeline.encode_ids(spark, docs, sf_dir).collect()
    assert len(got) == 60 and all(r.decoded == tool.decode(list(r.ids), skip_special_tokens=False) for r in got)


def test_mix_drops_no_document(spark, sf_dir):
    rows = [(1, "a b", "en", "x", 3), (2, "", "en", "none", 0), (3, None, "en", "none", 0), (3, None, "en", "none", 0), (4, "", "en", None, 0)]
    docs = spark.createDataFrame(rows, documents(spark, sf_dir).schema.simpleString()[7:-1].replace(":", " "))
    for part, want in ((docs, [1, 2, 3, 3, 4]), (docs.where("doc_id > 1"), [2, 3, 3, 4])):
        assert sorted(r.doc_id for r in corpus_pipeline.mix_sources(spark, part, sf_dir).collect()) == want


def test_budgets_cover_sources_whose_doubles_are_coarse(spark):
    rows = [(str(i), 1, 56444782390 if i == 0 else 5) for i in range(49)]
    shares = spark.createDataFrame(rows, "source string, docs bigint, tokens bigint")
    plan = source_budgets(shares, Target(passes=1e12)).collect()
    assert len(plan) == 49 and all(r.budget >= r.tokens for r in plan)


def test_clashing_columns_are_carried(spark, sf_dir):
    """Columns named like those that operators use or return come out as they went in."""
    names = ["score", "spans", "lines_total", "__row", "__s", "__block", "fp", "component_id", "extra", "th", "a.b"]
    docs = documents(spark, sf_dir).limit(30)
    more = docs.select("*", *[F.concat(F.lit(c), F.col("doc_id").cast("string")).alias(c) for c in names])
    for _, stage in corpus_pipeline.STAGES[:4]:
        got = stage(spark, more, sf_dir)
        assert got.columns == more.columns
        rows = got.collect()
        assert rows and all(r[c] == f"{c}{r.doc_id}" for r in rows for c in names)
    assert corpus_pipeline.STAGES[4][1](spark, more, sf_dir).count() == 30
