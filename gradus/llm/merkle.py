"""Merkle manifest of a table, built and checked by Pregel-style supersteps over RDDs.

Every row is a leaf; the leaves of a tree (a language) stand in the order of their ids, runs of
``FAN_OUT`` nodes have a parent, and the roots of all trees are the leaves of one tree above them.

Up: a node sends its digest to its parent; a parent that has heard all its children hashes them
and sends on, others wait. Down: a parent that knows its way to the root sends each child its own
siblings and that way. Leaves that share a parent get one message together. In the end a leaf is
folded with its siblings up to a root, from the digest it was built with or from one that is claimed.

A vertex never has more than ``FAN_OUT`` messages, however large a tree is, and every superstep
has an eighth of the vertices of the one before. Each superstep is written to the shared folder and
read again: lineage ends there, and a lost executor costs a part of one superstep. The driver holds a
row for each partition of the leaves and the root.

Places in a tree come from one sort by ranges of (tree, id, leaf, row): a partition numbers its own
rows and adds what stands before it, so a tree that holds most rows is dealt over many tasks.

Defined results: a field that is null counts as ``-``; rows without an id stand first in their
tree, rows without a tree are a tree of their own, before all others; rows that repeat an id stand in the
order of their digests; a tree of one leaf has the leaf as its root, and a table of one row too; an
empty table has no rows in its result. Texts are hashed whole. Other columns are ignored, whatever
their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

from pyspark import RDD
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import LOWER, UPPER, ascii_lower, documents, drop_snapshot, scratch_path, snapshot

FAN_OUT = 8
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Vertices that a partition of a superstep holds on average; small levels take few tasks.
VERTICES = 4096
_TOP = -1  # the tree above all trees

RESULT = "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def leaf_digest(fields: dict[str, Column]) -> Column:
    """SHA-256 of the fields, each ``-`` if null, else its length in UTF-8 bytes, ``:`` and the value."""
    parts = []
    for value in fields.values():
        text = value.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-")))
    return F.unhex(F.sha2(F.concat(*parts), 256))


def _hash(digests: bytes) -> bytes:
    """Digest of digests, which are taken as hexadecimal text."""
    return hashlib.sha256(digests.hex().encode()).digest()


# -- places of nodes: a vertex is (tree, level, place, leaves of its tree)


def _width(leaves: int, level: int) -> int:
    return -(-leaves // FAN_OUT**level)


def _parent(vertex: tuple, trees: int) -> tuple | None:
    """(parent, slot) of a vertex; None for the root of all."""
    tree, level, place, leaves = vertex
    if _width(leaves, level) == 1:
        if tree == _TOP or trees == 1:
            return None
        tree, level, place, leaves = _TOP, 0, tree, trees
    return (tree, level + 1, place // FAN_OUT, leaves), place % FAN_OUT


def _children(vertex: tuple) -> int:
    _, level, place, leaves = vertex
    return min(FAN_OUT, _width(leaves, level - 1) - FAN_OUT * place)


def _home(vertex: tuple) -> tuple:
    """Where a leaf waits for its way: at its parent, or at itself if it is a tree alone."""
    tree, _, place, leaves = vertex
    return vertex if leaves == 1 else (tree, 1, place // FAN_OUT, leaves)


def _runs(rows: Iterator[tuple]) -> Iterator[tuple]:
    """(first tree, its rows, last tree, its rows, trees, rows) of a sorted partition, if it has rows."""
    first = last = None
    trees = total = 0
    for tree, run in groupby(rows, key=lambda r: r[0]):
        n = sum(1 for _ in run)
        trees, total, last = trees + 1, total + n, (tree, n)
        first = first or last
    if first:
        yield (*first, *last, trees, total)


def _layout(parts: list[tuple[int, tuple]]) -> tuple[dict, int, int]:
    """For each partition: number of its first tree, leaves before it there, leaves of its first and of
    its last tree in all; then the number of trees and of leaves."""
    sizes: dict = {}  # of trees that begin or end a partition
    for _, (first, n, last, m, trees, _) in parts:
        sizes[first] = sizes.get(first, 0) + n
        if trees > 1:
            sizes[last] = sizes.get(last, 0) + m
    out, number, before, at = {}, -1, 0, object()
    for index, (first, n, last, m, trees, _) in parts:
        number, before = (number, before) if first == at else (number + 1, 0)
        out[index] = (number, before, sizes[first], sizes[last])
        before = before + n if trees == 1 else m
        number, at = number + trees - 1, last
    return out, number + 1, sum(p[1][5] for p in parts)


def _numbered(ordered: RDD) -> tuple[RDD, int, int]:
    """(vertex, id, tree, leaf, claimed) of rows in order, the number of trees and of leaves."""
    parts = ordered.mapPartitionsWithIndex(lambda i, rows: ((i, x) for x in _runs(rows))).collect()  # a row for each
    layout, trees, total = _layout(sorted(parts))

    def number(index: int, rows: Iterator[tuple]) -> Iterator[tuple]:
        if index not in layout:
            return
        tree, before, of_first, of_last = layout[index]
        runs = groupby(rows, key=lambda r: r[0])
        held = None  # a tree that lies between two others is whole here, and counted before it goes on
        for i, (_, run) in enumerate(runs):
            if held:
                yield from (((tree, 0, p, len(held)), *r[1:]) for p, r in enumerate(held))
                held, tree = None, tree + 1
            if i == 0:
                # the only tree of a partition is its first and its last one
                for p, r in enumerate(run, before):
                    yield (tree, 0, p, of_first), *r[1:]
                tree += 1
            else:
                held = list(run)
        if held:
            yield from (((tree, 0, p, of_last), *r[1:]) for p, r in enumerate(held))

    return ordered.mapPartitionsWithIndex(number), trees, total


# -- supersteps


def _kept(rdd: RDD, name: str, spark: SparkSession, parts: int) -> RDD:
    """``rdd`` written to the shared folder and read again, by ``parts`` tasks at most, however many files it has."""
    path = scratch_path(spark, name)
    rdd.saveAsPickleFile(path, 256)
    return spark.sparkContext.pickleFile(path).coalesce(parts)


def _upward(leaves: RDD, trees: int, total: int, most: int, spark: SparkSession) -> tuple[list[tuple[RDD, int]], bytes, tuple]:
    """The families (parent, children in order as (vertex, digest)) that each superstep completed, the digest of the
    root, and the root."""

    def send(vertex: tuple, digest: bytes) -> Iterator[tuple]:
        to = _parent(vertex, trees)
        if to:
            yield to[0], (to[1], vertex, digest)

    def step(family: tuple) -> Iterator[tuple]:
        """Complete: to the parent; else the messages wait."""
        vertex, got = family
        if len(got) == _children(vertex):
            return send(vertex, _hash(b"".join(m[2] for m in got)))
        return ((vertex, m) for m in got)

    complete = lambda family: len(family[1]) == _children(family[0])
    inbox, steps, nodes = leaves.flatMap(lambda r: send(r[0], r[2])), [], total
    while True:
        nodes = nodes // FAN_OUT + trees
        parts = min(most, 1 + nodes // VERTICES)
        met = inbox.groupByKey(parts).mapValues(lambda got: sorted(got))  # FAN_OUT messages at most
        met = _kept(met, "merkle-up", spark, parts)
        full = met.filter(complete)
        steps.append((full, parts))
        done = full.filter(lambda f: _parent(f[0], trees) is None).collect()  # the root, once
        if done:
            return steps, _hash(b"".join(m[2] for m in done[0][1])), done[0][0]
        inbox = met.flatMap(step)


def _downward(steps: list[tuple[RDD, int]], root: tuple, digest: bytes, spark: SparkSession) -> RDD:
    """(home, (digests of the leaves there, way to the root, digest of the tree's root)); a way is a list of
    (slot, digests of the siblings)."""

    def step(item: tuple) -> Iterator[tuple]:
        """(True, message to leaves) or (False, message to a vertex)."""
        vertex, (family, letters) = item
        family, letters = list(family), list(letters)
        if not family:  # belongs to an earlier superstep
            yield from ((False, (vertex, letter)) for letter in letters)
        for got, (way, subroot) in zip(family, letters, strict=False):
            if vertex[0] != _TOP and vertex[1] == 1:
                yield True, (vertex, (b"".join(m[2] for m in got), way, subroot))
                continue
            for slot, child, own in got:
                siblings = b"".join(m[2] for m in got if m[0] != slot)
                below = [(slot, siblings), *way]
                top = own if vertex[0] == _TOP and child[0] != _TOP else subroot
                if child[1] == 0 and child[0] != _TOP:
                    yield True, (child, (own, below, top))
                else:
                    yield False, (child, (below, top))

    mail, leaves = spark.sparkContext.parallelize([(root, ([], digest))], 1), []
    for families, parts in reversed(steps):
        out = _kept(families.cogroup(mail, parts).flatMap(step), "merkle-down", spark, parts)
        leaves.append(out.filter(lambda x: x[0]).map(lambda x: x[1]))
        mail = out.filter(lambda x: not x[0]).map(lambda x: x[1])
    return spark.sparkContext.union(leaves)


def fold(digest: bytes, way: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf gives with its siblings."""
    for slot, siblings in way:
        cut = 32 * slot
        digest = _hash(siblings[:cut] + digest + siblings[cut:])
    return digest


def _row(leaf: bytes, claimed: bytes | None, way: list, subroot: bytes, root: bytes, proofs: bool) -> tuple:
    proof = b"".join(s for _, s in way)
    folded = fold(leaf if claimed is None else claimed, way)
    row = (leaf.hex(), subroot.hex(), root.hex(), hashlib.sha256(proof.hex().encode()).hexdigest(), folded.hex(), folded == root)
    return (*row, [(slot, s.hex()) for slot, s in way]) if proofs else row


def manifest(
    docs: DataFrame,
    id_col: str = "doc_id",
    tree_col: str = "lang",
    fields: tuple[str, ...] = FIELDS,
    claimed: dict[str, Column] | None = None,
    where: Column | None = None,
    proofs: bool = False,
) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of every row.

    ``claimed`` replaces fields in the rows that meet ``where``: their folded root starts at the digest
    of the replaced row, everything else stays as it was built. With ``proofs`` the way of every leaf
    follows as an array of (slot, siblings); siblings are hexadecimal digests from left to right.
    """
    spark = docs.sparkSession
    given = {f: F.col(f) for f in fields}
    other = leaf_digest(given | (claimed or {})) if claimed else F.lit(None).cast("binary")
    rows = docs.select(
        F.col(tree_col).cast("string").alias("tree"),
        F.col(id_col).alias("id"),
        leaf_digest(given).alias("leaf"),
        (other if where is None else F.when(where, other)).alias("claimed"),
        F.monotonically_increasing_id().alias("row"),
    )
    rows = snapshot(rows, "leaves")
    most = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ("tree", "id", "leaf", "row")
    ordered = rows.repartitionByRange(most, *order).sortWithinPartitions(*order).drop("row")
    numbered, trees, total = _numbered(ordered.rdd.map(tuple))
    plain = numbered.map(lambda r: (r[0], r[1], bytes(r[2]), None if r[3] is None else bytes(r[3])))
    leaves = _kept(plain, "merkle-leaves", spark, min(most, 1 + total // VERTICES))
    drop_snapshot(rows)

    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, {RESULT}"
    schema += ", proof array<struct<slot:int,siblings:string>>" if proofs else ""
    if total <= 1:
        alone = leaves.map(lambda r: (r[1], *_row(r[2], r[3], [], r[2], r[2], proofs)))
        return spark.createDataFrame(alone, schema, verifySchema=False)
    steps, digest, root = _upward(leaves, trees, total, most, spark)
    ways = _downward(steps, root, digest, spark)

    def results(item: tuple) -> Iterator[tuple]:
        (_, _, _, n), (there, letters) = item
        for family, way, subroot in letters:
            for slot, key, leaf, claim in there:
                whole = way if n == 1 else [(slot, family[: 32 * slot] + family[32 * (slot + 1) :]), *way]
                yield (key, *_row(leaf, claim, whole, subroot, digest, proofs))

    waiting = leaves.map(lambda r: (_home(r[0]), (r[0][2] % FAN_OUT, *r[1:])))
    out = waiting.cogroup(ways, most).flatMap(results)
    return spark.createDataFrame(out, schema, verifySchema=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select(*FIELDS)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    return manifest(docs, claimed={"text": ascii_lower(F.col("text"))}, where=tampered)


# -- the SQL twin: levels are written out, as many as 8 ** LEVELS leaves and 8 ** TOP_LEVELS trees need

_LEVELS, _TOP_LEVELS = 8, 4


def _sql_field(name: str, value: str) -> str:
    return f"coalesce(octet_length(encode(({value})::VARCHAR))::VARCHAR || ':' || ({value})::VARCHAR, '-')"


def _sql() -> str:
    leaf = lambda text: "sha256(" + " || ".join(_sql_field(f, text if f == "text" else f) for f in FIELDS) + ")"
    lower = f"translate(text, '{UPPER}', '{LOWER}')"
    bits = "flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda x: list_transform(range(8), lambda i: (ascii(x) >> i::INT) & 1)))"
    step = "lambda c, b: xor(c >> 1, 3988292384 * (xor(c, b) & 1))"  # the CRC, bit by bit
    crc = f"xor(list_reduce(list_transform({bits}, lambda b: b::BIGINT), {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
    out = [
        f"""h AS (SELECT doc_id, lang, {leaf("text")} AS leaf, coalesce({crc} % 3 = 0, false) AS cut, {leaf(lower)} AS other FROM documents),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p,
  count(*) OVER (PARTITION BY lang) AS n, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS t FROM h),
l0 AS (SELECT t, p, n, leaf AS d FROM o)"""
    ]
    up = """{k}{b} AS (SELECT t, p // 8 AS p, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(w) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY p)) END AS d
  FROM (SELECT *, count(*) OVER (PARTITION BY t) AS w FROM {k}{a}) GROUP BY t, p // 8)"""
    out += [up.format(k="l", a=i, b=i + 1) for i in range(_LEVELS)]
    out += [f"u0 AS (SELECT 0 AS t, t AS p, 0 AS n, d FROM l{_LEVELS})"]
    out += [up.format(k="u", a=i, b=i + 1) for i in range(_TOP_LEVELS)]
    # siblings at each level, left and right of the node on the way
    side = """{k}s{i} AS (SELECT a.t, a.p, coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (WHERE b.p < a.p), '') AS lft,
  coalesce(string_agg(b.d, '' ORDER BY b.p) FILTER (WHERE b.p > a.p), '') AS rgt FROM {k}{i} a JOIN {k}{i} b ON a.t = b.t AND a.p // 8 = b.p // 8
  GROUP BY a.t, a.p)"""
    out += [side.format(k="l", i=i) for i in range(_LEVELS)] + [side.format(k="u", i=i) for i in range(_TOP_LEVELS)]
    out += ["w0 AS (SELECT *, '' AS proof, CASE WHEN cut THEN other ELSE leaf END AS f, p AS q, n AS m FROM o)"]
    walk = """{x}{b} AS (SELECT w.* REPLACE (proof || lft || rgt AS proof, CASE WHEN m = 1 THEN f ELSE sha256(lft || f || rgt) END AS f, q // 8 AS q, (m + 7) // 8 AS m)
  FROM {x}{a} w JOIN {k}s{i} s ON s.t = {t} AND s.p = w.q)"""
    out += [walk.format(x="w", a=i, b=i + 1, k="l", i=i, t="w.t") for i in range(_LEVELS)]
    out += [f"v0 AS (SELECT w.* REPLACE (t AS q, (SELECT count(*) FROM u0) AS m) FROM w{_LEVELS} w)"]
    out += [walk.format(x="v", a=i, b=i + 1, k="u", i=i, t="0") for i in range(_TOP_LEVELS)]
    last = f"""SELECT v.doc_id, leaf, s.d AS subroot, r.d AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = r.d AS verified
FROM v{_TOP_LEVELS} v JOIN l{_LEVELS} s ON s.t = v.t CROSS JOIN u{_TOP_LEVELS} r"""
    return "WITH " + ",\n".join(out) + "\n" + last


OP11_SQL = _sql()
