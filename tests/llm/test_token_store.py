import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradus.llm.bpe import default_path, encoder
from gradus.llm.token_store import LibraryEncoder, PerfectHash, _mix, op4_token_store, read_store, write_store


def test_perfect_hash_is_minimal_and_tells_strangers_apart():
    for n in (0, 1, 2, 63, 5000):
        keys = _mix(np.arange(n, dtype=np.uint64))
        table = PerfectHash.build(keys)
        assert sorted(table.slot(keys).tolist()) == list(range(n))
    with pytest.raises(ValueError, match="distinct"):
        PerfectHash.build(np.asarray([3, 3], np.uint64))


def test_pieces_equal_whole_texts():
    tool, mine = Tokenizer.from_file(default_path()), LibraryEncoder(default_path(), entries=4)
    texts = [None, "", " ", "Ab cd\nef  gh\t\x1cij|k <|endoftext|>x", "a <b> c|d it's", "é" * 300, "it 's 42,000"]
    for _ in range(2):
        got = [np.frombuffer(x, mine.type).tolist() for x in mine.encode(texts)]
        assert got == [tool.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_letters_that_fall_apart_into_letter_and_mark():
    tool = Tokenizer.from_file(default_path())
    texts = ["\u0130stanbul abc", "\u0958 abc", "x\u0958. abc", "\u0130, \u0958\u09dc.", "\ufb1d \u0130\u0130 abc\u0958, d."]
    want = [tool.encode(t, add_special_tokens=False).ids for t in texts]
    mine = LibraryEncoder(default_path())
    assert [np.frombuffer(x, mine.type).tolist() for x in mine.encode(texts)] == want
    assert [encoder(default_path()).encode(t) for t in texts] == want  # op6 cuts off stops in the same way


def test_query(spark, sf_dir):
    tool = Tokenizer.from_file(default_path())
    docs = sorted(spark.read.parquet(f"{sf_dir}/documents.parquet").collect(), key=lambda d: d.doc_id)
    want, start = {}, 0
    for d in docs:
        ids = np.asarray([*tool.encode(d.text or "", add_special_tokens=False).ids, 2], "<u4")
        want[d.doc_id] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    got = {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in op4_token_store(spark, sf_dir).collect()}
    assert got == want


def test_nulls_repeats_and_lookups(spark):
    rows = [(7, "b c", 1), (7, "a", 2), (7, "a", 2), (None, "x", 3), (None, None, 3), (3, "", 4), (-5, "hello there", 5)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, shard int")
    store, written, base = write_store(docs, shard_bytes=20, index_keys=2)
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in read_store(store, written, base).collect())
    # copies of a key lie in order of a hash of their text
    assert [g[1] for g in got] == [None, None, -5, 3, 7, 7, 7]
    assert sorted(g[2] for g in got[:2]) == [1, 2] and sorted(g[2] for g in got[4:]) == [2, 2, 3] and [g[2] for g in got[2:4]] == [3, 1]
    assert [g[0] for g in got] == [sum(x[2] for x in got[:i]) for i in range(7)]
    assert len(store[-5]) == 3 and store[3].tolist() == [2]
    assert sorted(store.find(7, i)[2] for i in range(3)) == [2, 2, 3] and store.find(7, 3) is None
    assert store.find(8) is None and sorted(store.find(None, i)[2] for i in range(2)) == [1, 2]
    with pytest.raises(KeyError):
        store[8]
    assert read_store(*write_store(docs.limit(0))).collect() == []


def test_a_key_of_many_rows_spreads_over_shards(spark):
    docs = spark.range(4000).select(F.when(F.col("id") % 3 > 0, 5).cast("bigint").alias("doc_id"), F.concat(F.lit("w"), "id").alias("text"))
    store, written, base = write_store(docs, shard_bytes=2000)
    sizes = [r["count"] for r in written.groupBy("shard").count().collect()]
    assert len(sizes) >= 8 and max(sizes) < 1600
    places = {(r.doc_id, r.none, r.copy) for r in written.collect()}
    assert len(places) == 4000 and max(c for _, n, c in places if n) == 1333
    assert read_store(store, written, base).agg(F.sum("n_tokens")).first()[0] == sum(r["count"] for r in written.collect())


@pytest.mark.parametrize("cut", ["tail", "trailer", "head"])
def test_a_shard_that_is_cut_off_is_an_error(spark, cut):
    docs = spark.createDataFrame([(i, "some words here") for i in range(50)], "doc_id bigint, text string")
    store, written, base = write_store(docs)
    name = f"{store.root.removeprefix('file://')}/shard-{store.find(7)[0]:05d}.ids"
    with open(name, "rb") as f:
        data = f.read()
    with open(name, "wb") as f:
        f.write({"tail": data[: len(data) // 2], "trailer": data[:-20], "head": data[8:]}[cut])
    with pytest.raises(ValueError, match="shard"):
        store[7]
    with pytest.raises(Exception, match="shard"):
        read_store(store, written, base).collect()


def test_table_of_pieces_is_bounded_by_characters():
    from gradus.llm.piece_table import LONG, PieceTable

    table = PieceTable(lambda new: [[p] for p in new], characters=1000)
    for i in range(50):
        texts = [f"w{i}a{j}" * 5 for j in range(9)] + ["q" * (LONG + 1) + str(i), "end."]
        assert table.look_up([" ".join(texts)]) == [[[t] if t != "end." else ["end", "."] for t in texts]]
        assert max(map(len, table.young)) <= LONG and sum(map(len, {**table.old, **table.young})) < 3000


def test_shards_follow_all_texts(spark):
    """Short texts first, long ones behind: all of them count."""
    docs = spark.createDataFrame([(i, "a " * (5 if i < 2500 else 2000)) for i in range(2600)], "doc_id bigint, text string").coalesce(1)
    store, written, _ = write_store(docs, shard_bytes=20_000)
    assert written.select("shard").distinct().count() >= 15 and read_store(store, written, _).count() == 2600
