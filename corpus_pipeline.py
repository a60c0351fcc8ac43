"""The corpus pipeline: five stages from raw documents to token ids.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; ``run`` writes each
result as Parquet in the shared folder and hands it, read again, to the next stage. All
but the last return the columns of ``documents``.

Defined results, for every stage: an empty table gives an empty one. A null or empty text is
not toxic, has no lines to lose and no tokens; all texts without words are one class of near
copies, of which the smallest doc_id stays; what stays is read once by the mix and has no ids.
A null source is a source of its own. Rows that repeat a doc_id and text are near copies; rows
without a doc_id stay only where their class has none. Very long texts are worked on whole.
Further columns of the table are carried on to the mix as they are, whatever their names: stages
see them as one column only.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm import bpe, line_dedup, mixing, simhash_dedup, simhash_wide, toxicity_crf
from gradus.llm.common import documents, drop_snapshot, snapshot

#: No source is read more often than this for each time the largest one is read; every
#: document is read once at least.
MIX = mixing.Target(passes=1.5)

#: Columns that stages read; all others are carried on.
COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _carrying(docs: DataFrame, stage: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The stage's rows with the columns of ``docs``; those that it doesn't know pass it as one."""
    others = [c for c in docs.columns if c not in COLUMNS]
    if not others:
        return stage(docs).select(*docs.columns)
    packed = docs.select(*COLUMNS, F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(others)]).alias("others"))
    return stage(packed).select(*[F.col(f"others.c{others.index(c)}").alias(c) if c in others else c for c in docs.columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the conditional random field scores at the threshold or above go."""
    model = toxicity_crf.fit(spark, sf_dir)
    return _carrying(docs, lambda d: toxicity_crf.score_toxicity(d, model).where(F.col("score") < toxicity_crf.THRESHOLD))


def drop_boilerplate_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that stand on too many documents of a source are removed; ``n_chars`` follows the text."""
    n_chars = F.char_length("text").cast(docs.schema["n_chars"].dataType)
    return _carrying(docs, lambda d: line_dedup.drop_boilerplate(d).withColumn("n_chars", n_chars))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near copies (similarity of five-word shingles 0.8 or more, verified) the document with the smallest doc_id stays."""
    return _carrying(docs, lambda d: simhash_dedup.drop_near_duplicates(d, classes=simhash_wide.similar_classes))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix reads them: one row for each block that takes them."""
    return _carrying(docs, lambda d: mixing.draw(d, MIX, keep_empty=True))


def encode_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, source, n_tokens, ids, decoded) of every row; ``decoded`` is the text of the ids."""
    coded = bpe.bpe_round_trip(docs.select("doc_id", "source", "text"))
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_boilerplate_lines),
    ("simhash_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("bpe", encode_ids),
]

#: A learned tagger and an iterated graph search have no SQL form; tests/llm/test_pipeline.py
#: holds every stage against a brute-force version of its own input.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, before = documents(spark, sf_dir), None
    for name, stage in STAGES[:-1]:
        docs = snapshot(stage(spark, docs, sf_dir), f"stage-{name}")
        if before is not None:  # nothing reads it any more
            drop_snapshot(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
QUERY_SQL: dict[str, str] = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
