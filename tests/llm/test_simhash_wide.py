import random

import numpy as np
import pytest

from gradus.llm import simhash_wide as wide
from gradus.llm.simhash_dedup import drop_near_duplicates, fingerprints

from .test_simhash_dedup import roots


def as_int(row):
    return sum(int(x) << (64 * i) for i, x in enumerate(row))


SHAPE = wide.Shape(17, 11)


def has_close_segment(a, b, shape=SHAPE):
    """Whether one of the segments differs by at most one bit."""
    mask = (1 << shape.segment_bits) - 1
    return any((((a ^ b) >> (k * shape.segment_bits)) & mask).bit_count() <= 1 for k in range(shape.segments))


def flipped(x, n, rng):
    for b in rng.sample(range(192), n):
        x ^= 1 << b
    return x


def test_first_word_is_the_plain_fingerprint():
    texts = [None, "", "a", "A b c d e f g", "\u00e9 " * 40, " ".join(map(str, range(900)))]
    got = wide.wide_fingerprints(texts, 3)
    assert got[:, 0].tolist() == fingerprints(texts, 5).tolist() and not got[:2].any()
    assert len({tuple(r) for r in got.tolist()}) == 5 and (np.unique(got[3]).size, np.unique(got[5]).size) == (3, 3)


def test_shapes_keep_the_chance():
    assert wide.shape_for(10) == wide.shape_for(1 << 26) == SHAPE and SHAPE.lanes == 3
    assert SHAPE.bits_for(0.8) == 39 and SHAPE.bits_for(0.95) < SHAPE.bits_for(0.9) < 39
    rng = np.random.default_rng(2)
    for rows in (1000, 1 << 30, 1 << 40):
        shape = wide.shape_for(rows)
        flips = rng.random((20_000, 64 * shape.lanes)) < wide.differing(0.8)
        cut = flips[:, : shape.segment_bits * shape.segments].reshape(len(flips), shape.segments, -1)
        found = (cut.sum(2) <= 1).any(1) & (flips.sum(1) <= shape.bits_for(0.8))
        assert found.mean() > 0.92


@pytest.mark.parametrize("limit", [4, 60, 1 << 15])
def test_candidates_are_all_pairs_or_span_them(spark, limit):
    """All pairs that agree in a segment up to one bit, with buckets compared at once, walked and dealt out again."""
    rng = random.Random(limit)
    fps = {rng.getrandbits(192) for _ in range(150)}
    few = set()
    for size in (12, 12, 120, 120):  # copies of one text, and copies of copies
        first = rng.getrandbits(192)
        seen = [first]
        for _ in range(size):
            seen.append(flipped(rng.choice([first, seen[-1]]), rng.randrange(1, 48), rng))
        fps |= set(seen)
        few |= set(seen) if size == 12 else set()
    fps |= {flipped(7 << 60, 1, random.Random(i)) for i in range(400)}  # more than a matrix takes
    fps = sorted(fps)
    close = [(a, b) for i, a in enumerate(fps) for b in fps[i + 1 :] if (a ^ b).bit_count() <= 39 and has_close_segment(a, b)]
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    rows = [(x.to_bytes(24, "little"), *(signed(x >> (64 * i) & (1 << 64) - 1) for i in range(3))) for x in fps]
    df = spark.createDataFrame([(bytearray(r[0]), *r[1:]) for r in rows], "fp binary, f0 bigint, f1 bigint, f2 bigint")
    found = wide.similar_links(df, SHAPE, 39, 24, limit).collect()
    got = [(int.from_bytes(r.a, "little"), int.from_bytes(r.b, "little")) for r in found]
    assert all((a ^ b).bit_count() == r.bits <= 39 for (a, b), r in zip(got, found, strict=True)) and len(set(got)) == len(got)
    assert roots(fps, got) == roots(fps, close)
    if limit > 60:  # small buckets give every pair
        pairs = {tuple(sorted(p)) for p in got}
        assert {p for p in close if few.issuperset(p)} <= pairs


def shingles(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_edited_copies_go_and_others_stay(spark):
    """Recall on copies of a similarity just above 0.8; none goes below it."""
    rng = random.Random(5)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(7)) for _ in range(5000)]
    docs, similar = [], set()
    for i in range(300):
        text = [rng.choice(words) for _ in range(250)]
        docs.append((i, " ".join(text)))
        if i % 2 == 0:  # changed words, each in five shingles: a similarity of 0.75 to 0.9
            edited = list(text)
            for at in rng.sample(range(250), rng.choice([3, 4, 5, 6, 7])):
                edited[at] = "changed" + str(rng.random())
            docs.append((1000 + i, " ".join(edited)))
            a, b = shingles(docs[-2][1]), shingles(docs[-1][1])
            if len(a & b) >= 0.8 * len(a | b):
                similar.add(1000 + i)
    df = spark.createDataFrame(docs, "doc_id bigint, text string")
    gone = {d for d, _ in docs} - {r.doc_id for r in drop_near_duplicates(df, classes=wide.similar_classes).collect()}
    assert gone <= similar and len(gone) >= 0.9 * len(similar) and 50 < len(similar) < 150


@pytest.mark.parametrize("limit", [100, 1 << 15])
def test_no_link_of_a_large_family_is_left_out(spark, limit):
    """A family of one passage: nearly all its rows are close in bits, but only twins are similar enough. Classes are those of
    all pairs that share a bucket, and of the family's bits."""
    rng = random.Random(11)

    def edit(words, n):
        words = list(words)
        for at in rng.sample(range(len(words)), n):
            words[at] = f"new{rng.random()}"
        return words

    first, docs = [f"w{i}" for i in range(250)], []
    for _ in range(200):
        one = edit(first, 4)
        docs += [one, edit(one, rng.choice([4, 5, 5, 6]))]
    rng.shuffle(docs)
    texts = [" ".join(d) for d in docs]
    prints = [as_int(x) for x in wide.wide_fingerprints(texts, 3)]
    sets = [shingles(t) for t in texts]
    pairs = [(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if (prints[i] ^ prints[j]).bit_count() <= 39 and has_close_segment(prints[i], prints[j])]
    linked = [(i, j) for i, j in pairs if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    assert len(pairs) > 20_000 and 100 < len(linked) < 0.02 * len(pairs)
    got = wide.similar_classes(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), bucket_limit=limit)
    assert {r.doc_id: r.component_id for r in got.collect()} == roots(range(len(texts)), linked)


def test_sketches_rule_out_no_similar_pair():
    rng = np.random.default_rng(3)
    for size in (1, 9, 300, 9000):
        sets = [rng.integers(-(1 << 62), 1 << 62, size) for _ in range(20)]
        sets += [np.unique(np.concatenate([s[size // 8 :], rng.integers(0, 1 << 62, size // 9)])) for s in sets]
        sketches = wide._sketches(sets)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets):
                assert wide._differ(sketches[i], sketches[j]) <= len(np.setxor1d(a, b))
    assert not wide._sketches([np.zeros(0, np.int64)]).any()


def test_a_chain_is_one_class_and_a_star_of_many_too(spark):
    """Neighbours of a chain are similar, its ends are not; copies of one text are similar to it alone."""
    words = [f"w{i}" for i in range(2000)]
    chain = [(i, " ".join(words[10 * i : 10 * i + 250])) for i in range(12)]
    star = [(100, " ".join(words[1000:1400]))]
    for i in range(150):
        text = words[1000:1400]
        for at in (7 * i % 390, (11 * i + 200) % 390, (13 * i + 90) % 390, (17 * i + 300) % 390):
            text[at] = f"new{i}-{at}"
        star.append((101 + i, " ".join(text)))
    df = spark.createDataFrame(chain + star, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in wide.similar_classes(df).collect()}
    assert {got[i] for i, _ in chain} == {0}
    assert sum(got[i] == 100 for i, _ in star) >= 0.97 * len(star)


def test_hard_rows(spark):
    rows = [(5, None, 1), (4, "", 1), (7, "a b c d", 1), (7, "a b c d", 1), (9, "A B c d", 1), (None, "q r s", 1), (2, "x " * 200_000, 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, fp int")
    got = sorted((r.doc_id or 0, r.component_id) for r in wide.similar_classes(df).collect())
    assert got == [(0, None), (2, 2), (4, 4), (5, 4), (7, 7), (7, 7), (9, 7)]
    kept = drop_near_duplicates(df, classes=wide.similar_classes)
    assert kept.columns == df.columns and sorted(r.doc_id or 0 for r in kept.collect()) == [0, 2, 4, 7]
    assert wide.similar_classes(df.limit(0)).collect() == [] and drop_near_duplicates(df.limit(0), classes=wide.similar_classes).collect() == []
