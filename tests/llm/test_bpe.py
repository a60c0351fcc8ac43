import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gradus.llm.bpe import bpe_round_trip, default_path, encoder, op6_bpe


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(default_path())


def same(library, text):
    ids = library.encode(text, add_special_tokens=False).ids
    coder = encoder(default_path())
    _, decoded = coder.encode_decode([text])[0]
    assert coder.encode(text) == ids
    assert decoded == coder.decode(ids) == library.decode(ids, skip_special_tokens=False)


def test_words_of_every_token(library):
    coder = encoder(default_path())
    rng = random.Random(1)
    for token in rng.sample(sorted(coder.vocab), 4000):
        same(library, token.replace("</w>", ""))


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("aabbcdeéßΣσ'st n\t\x1c\x85 ́<|>endoftext019!?.中🙂"), max_size=60))
def test_odd_texts(library, text):
    same(library, text)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet=st.sampled_from("abot"), min_size=20, max_size=200))
def test_runs_of_letters(library, text):
    same(library, text)


def test_special_tokens(library):
    for text in ("<|endoftext|>", "a<|startoftext|>B <|endoftext|", "x<|ENDOFTEXT|>"):
        same(library, text)


def test_query(spark, sf_dir, library):
    want = {}
    for d in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        ids = library.encode(d.text or "", add_special_tokens=False).ids
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        want[d.doc_id] = (len(ids), sha(" ".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False)))
    assert {r[0]: tuple(r[1:]) for r in op6_bpe(spark, sf_dir).collect()} == want


def test_nulls_and_columns(spark):
    docs = spark.createDataFrame([(1, None, 5), (1, "", 6), (None, "Hello  there", 7)], "doc_id bigint, text string, ids int")
    got = bpe_round_trip(docs).collect()
    assert [(r.doc_id, len(r.ids), r.decoded) for r in got] == [(1, 0, ""), (1, 0, ""), (None, 2, "hello</w> there</w>")]
    assert bpe_round_trip(docs.limit(0)).collect() == []
