"""BPE encoding and decoding by dynamic programming over prefixes.

For every prefix of a word exactly one token can come last in its encoding. An automaton
over the vocabulary yields all tokens that end at a position; a token t that starts at s
is the last one of the prefix if t stands alone as a token and is compatible with the
last token of the prefix up to s. The tokens of the word are read off the back-pointers.
Each position looks at a handful of matches, so the cost is linear in the word, whatever
order the merges come in.

Two tokens u, v are compatible if encoding their joined text gives u, v again: no merge
may cross the seam while both sides are still being built. A cross merge of a node R on
the right spine of u and a node L on the left spine of v has rank q; it happens if R and
L are complete by then and neither has gone into its parent before (at equal rank the
pair further left goes first).

Words repeat, so pieces between blanks are encoded once for each Python worker and
looked up afterwards; the tables hold a bounded number of entries.

Defined results: a null text counts as empty; an empty text has no ids and decodes to an
empty string; special tokens in a text become their ids, as the tokenizers library does;
very long texts are encoded whole; rows that repeat are encoded each; empty tables give empty
results. Columns of the input named ``ids`` or ``decoded`` are replaced, all others but the
text are passed on, except that ``__text`` is reserved.
"""

from __future__ import annotations

import functools
import json
import re
import unicodedata
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import documents, map_batches, pieces, release
from gradus.llm.piece_table import ENTRIES, PieceTable

VOCABULARY = "word_bpe_49k.json"

def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte: itself where printable, else from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {b: chr(b) for b in plain}
    for b in range(256):
        if b not in letters:
            letters[b] = chr(256 + len(letters) - len(plain))
    return [letters[b] for b in range(256)]


class Coded(tuple):
    """(ids as bytes, their texts with a blank before each); sums are joined codings."""

    __slots__ = ()

    def __add__(self, other: Coded) -> Coded:
        return Coded((self[0] + other[0], self[1] + other[1]))


class PrefixEncoder:
    """Encoder and decoder of one vocabulary file in the tokenizers JSON format.

    Supported: byte-level BPE with a word-end suffix, NFC + white space + lower case
    before, a Split pattern and no decoder, as ``word_bpe_49k.json`` has.
    """

    def __init__(self, path: str, table_entries: int = ENTRIES):
        import ahocorasick
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        if model["type"] != "BPE" or not model["end_of_word_suffix"] or kinds != ["NFC", "Replace", "Lowercase"] or spec["decoder"]:
            raise ValueError(f"{path} is not a word-level BPE vocabulary of the supported form")
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        self.words = regex.compile(split["pattern"]["Regex"]).findall
        self.spaces = regex.compile(r"\s+")
        self.vocab: dict[str, int] = dict(model["vocab"])
        added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, sorted(added, key=len, reverse=True))))
        self.added = added
        self.token = [""] * (max([*self.vocab.values(), *added.values()]) + 1)
        for text, i in [*self.vocab.items(), *added.items()]:
            self.token[i] = text
        self.id_type = np.dtype("u2") if len(self.token) <= 1 << 16 else np.dtype("u4")
        self.letter = "H" if self.id_type.itemsize == 2 else "I"
        self.suffix = model["end_of_word_suffix"]
        self.letters = byte_letters()
        self.pair: dict[tuple[int, int], tuple[int, int]] = {}  # (left, right) -> (rank, merged)
        self.parts: dict[int, tuple[int, int, int]] = {}  # merged -> (left, right, rank)
        for rank, (left, right) in enumerate(model["merges"]):
            merged = self.vocab[left + right]
            self.pair[self.vocab[left], self.vocab[right]] = (rank, merged)
            self.parts.setdefault(merged, (self.vocab[left], self.vocab[right], rank))
        self._standing: dict[int, bool] = {}
        self._fits: dict[int, bool] = {}
        # The automaton's alphabet: byte letters, and one letter for the word's end.
        self.end = "\uffff"
        self.automaton = ahocorasick.Automaton()
        for text, i in self.vocab.items():
            key = text[: -len(self.suffix)] + self.end if text.endswith(self.suffix) else text
            if key != self.end and self.stands(i):
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()
        self.table = None
        self.table = PieceTable(lambda new: [self._encode_piece(p) for p in new], table_entries)

    # -- pair compatibility

    def _spine(self, token: int, right: bool) -> list[tuple[int, float, float]]:
        """(node, rank it is made at, rank it goes into its parent at) down one side."""
        out, gone = [], float("inf")
        while True:
            parts = self.parts.get(token)
            made = parts[2] if parts else -1
            out.append((token, made, gone))
            if not parts:
                return out
            token, gone = parts[1 if right else 0], made

    def _crossed(self, u: int, v: int, before: float) -> bool:
        """Whether a merge across the seam of u and v happens with a rank below ``before``."""
        right_side = self._spine(v, False)
        for r, made_r, gone_r in self._spine(u, True):
            for left, made_l, gone_l in right_side:
                hit = self.pair.get((r, left))
                if hit and made_r < hit[0] and made_l < hit[0] and hit[0] < gone_r and hit[0] <= gone_l and hit[0] < before:
                    return True
        return False

    def stands(self, token: int) -> bool:
        """Whether the token's own text is encoded as this one token."""
        if token not in self._standing:
            parts = self.parts.get(token)
            self._standing[token] = not parts or (
                self.stands(parts[0]) and self.stands(parts[1]) and not self._crossed(parts[0], parts[1], parts[2])
            )
        return self._standing[token]

    def _fit(self, key: int) -> bool:
        """Whether two tokens are compatible; ``key`` is left << 20 | right. Kept in a table."""
        if len(self._fits) > 2_000_000:
            self._fits.clear()
        good = self._fits[key] = not self._crossed(key >> 20, key & 0xFFFFF, float("inf"))
        return good

    # -- encoding

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word as the pre-tokenizer gives it: the unique last token of each prefix."""
        letters = self.letters
        key = "".join([letters[b] for b in word.encode()]) + self.end
        n = len(key)
        last = [-1] * n  # the last token of the prefix that ends at a letter
        back = [0] * n  # where that token starts
        known, solved = self._fits.get, -1
        for at, (size, token) in self.automaton.iter(key):
            if at == solved:
                continue
            start = at - size
            if start >= 0:
                before = last[start]
                if before < 0:
                    continue
                pair = before << 20 | token
                good = known(pair)
                if not (self._fit(pair) if good is None else good):
                    continue
            last[at], back[at], solved = token, start + 1, at
        ids = []
        while n:
            if last[n - 1] < 0:
                raise ValueError(f"the vocabulary cannot express {word!r}")
            ids.append(last[n - 1])
            n = back[n - 1]
        ids.reverse()
        return ids

    def _code(self, ids: list[int]) -> Coded:
        token = self.token
        return Coded((array(self.letter, ids).tobytes(), "".join([" " + token[i] for i in ids])))

    def _encode_piece(self, piece: str) -> Coded:
        if piece.isalpha() and piece.isascii():
            return self._code(self.encode_word(piece.lower()))
        out, at = Coded((b"", "")), 0
        marks = [(m.start(), m.end()) for m in self.special.finditer(piece)] if "<" in piece else []
        for start, end in [*marks, (len(piece), len(piece))]:
            text = unicodedata.normalize("NFC", piece[at:start])
            text = self.spaces.sub(" ", text).replace("Σ", "σ").lower()
            for word in self.words(text):
                out += (self.table and self.table.young.get(word)) or self._code(self.encode_word(word))
            if end > start:
                out += self._code([self.added[piece[start:end]]])
            at = end
        return out

    def encode_decode(self, texts: list[str | None]) -> list[tuple[bytes, str]]:
        """Of each text: its ids as bytes of ``id_type``, and what they decode to."""
        out = []
        for values in self.table.look_up(texts):
            out.append((b"".join([v[0] for v in values]), "".join([v[1] for v in values])[1:]))
        return out

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(self.encode_decode([text])[0][0], self.id_type).tolist()

    def decode(self, ids: list[int]) -> str:
        """What the library's decode gives: no decoder, so token texts joined by blanks."""
        return " ".join([self.token[i] for i in ids])


@functools.lru_cache(2)
def encoder(path: str) -> PrefixEncoder:
    return PrefixEncoder(path)


def bpe_round_trip(docs: DataFrame, id_col: str = "doc_id", path: str | None = None, decode: bool = True) -> DataFrame:
    """``docs`` without its text, with ``ids`` and (if asked for) ``decoded``, the text of these ids."""
    path = path or default_path()
    carried = [c for c in docs.columns if c not in ("text", "ids", "decoded")]
    fields = [docs.schema[c] for c in carried]
    from pyspark.sql import types as T

    schema = T.StructType([*fields, T.StructField("ids", T.ArrayType(T.IntegerType(), False))])
    if decode:
        schema.add("decoded", T.StringType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(path)
        for batch in pieces(batches, "__text", 2 << 20):
            got = coder.encode_decode(batch.column("__text").to_pylist())
            flat = np.frombuffer(b"".join([g[0] for g in got]), coder.id_type).astype(np.int32)
            ends = np.cumsum([0] + [len(g[0]) // coder.id_type.itemsize for g in got]).astype(np.int32)
            arrays = [batch.column(c) for c in carried] + [pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
            if decode:
                arrays.append(pa.array([g[1] for g in got], pa.string()))
            yield pa.RecordBatch.from_arrays(arrays, names=schema.names)
        release()

    return map_batches(docs.select(*carried, F.col("text").alias("__text")), run, schema)


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(documents(spark, sf_dir).select("doc_id", "text"))
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
