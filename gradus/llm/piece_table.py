"""A bounded table of encoded pieces, for encoders whose words do not depend on each other."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable
from itertools import islice

#: Entries, and characters of their pieces, of each of the two generations that a table holds.
ENTRIES = 250_000
CHARACTERS = 4_000_000
#: Longer pieces (addresses, encoded data) are looked up for their batch alone.
LONG = 100
STOPS = ".,"


def known_form(text: str | None) -> str:
    """The text in lower case, where lower-casing (character by character) is all that a
    normaliser of NFC and lower case would do; else the text as it is.
    """
    if not text or "<|" in text:  # special tokens are told apart by case
        return text or ""
    if text.isascii():
        return text.lower()
    if "Σ" in text or "İ" in text or not unicodedata.is_normalized("NFC", text):
        return text
    low = text.lower()
    return low if unicodedata.is_normalized("NFC", low) else text


def is_word(letters: str) -> bool:
    """Whether the normaliser leaves nothing but letters, so that ``letters`` (for which
    isalpha() holds) are one word of the pre-tokenizer: some letters fall apart into a letter
    and a mark in NFC, and the lower case of one does.
    """
    return "İ" not in letters and (unicodedata.is_normalized("NFC", letters) or unicodedata.normalize("NFC", letters).isalpha())


class PieceTable:
    """Looks up the pieces between blanks and line feeds of many texts at once.

    ``learn`` encodes pieces not seen before, given as a list; values are added with +
    where a full stop or comma behind letters has been cut off. Two generations of
    entries bound the memory: when the young one is full, by its entries or by the characters of their
    pieces, it becomes the old one. Values grow with their pieces, so they are bounded too.
    """

    def __init__(self, learn: Callable[[list[str]], list], entries: int = ENTRIES, characters: int = CHARACTERS):
        self.learn, self.entries, self.characters = learn, entries, characters
        self.young: dict = {}
        self.old: dict = {}
        self.held = 0  # characters of the young generation
        self.stops = dict(zip(STOPS, learn(list(STOPS)), strict=True))

    def look_up(self, texts: list[str | None]) -> list[list]:
        """The values of each text's pieces, in order."""
        if len(self.young) > self.entries or self.held > self.characters:
            self.old, self.young, self.held = self.young, {}, 0
        young, old, stops = self.young, self.old, self.stops
        split = [known_form(t).replace("\n", " ").split(" ") for t in texts]
        before = len(young)
        missing = [p for p in set().union(*split) if p not in young]
        new, stopped = [], []
        for p in missing:
            value = old.get(p)
            if value is not None:
                young[p] = value
            elif p[-1:] in stops and (word := p[:-1]).isalpha() and (word.isascii() or is_word(word)):
                stopped.append(p)
                if word not in young:
                    value = old.get(word)
                    if value is None:
                        new.append(word)
                    else:
                        young[word] = value
            else:
                new.append(p)
        if new:
            new = list(set(new))
            young.update(zip(new, self.learn(new), strict=True))
        for p in stopped:
            young[p] = young[p[:-1]] + stops[p[-1]]
        values = [[young[p] for p in s] for s in split]
        for p in list(islice(reversed(young), len(young) - before)):  # what this batch added
            if len(p) > LONG:
                del young[p]
            else:
                self.held += len(p)
        return values
