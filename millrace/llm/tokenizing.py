"""Whole-text encoding with the tokenizers library, word by word from a bounded cache.

Both vocabularies split a text into words that are encoded each on its own, so
a word's ids can be kept.  Texts with any character outside a range on which
the splitting pattern and the library certainly agree go to the library whole.
"""

from __future__ import annotations

import json
import re
import sys
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
from tokenizers import Tokenizer

#: The splitting patterns that these kinds of vocabulary were built with.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
WORD_ENDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: The letters and numbers among the characters not matched by UNSURE; re is twice as fast on them as on properties.
_LETTERS, _NUMBERS = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
UNSURE = re.compile(r"[^\t\n\r\x20-\x7e¡-ɏ]")


def byte_characters() -> dict[int, str]:
    """The character that byte-level vocabularies write each byte as: itself if it is visible, or the next one from 256 on."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = [b for b in range(256) if b not in visible]
    return {b: chr(b) for b in visible} | {b: chr(256 + k) for k, b in enumerate(hidden)}


_CHARACTERS = byte_characters()
_SPACE = _CHARACTERS[ord(" ")]
#: Parts of BYTE_LEVEL of which at most one can match at a place; re is faster if the commonest come first.
_CONTRACTIONS, _RUNS = r"'s|'t|'re|'ve|'m|'ll|'d|", r" ?\p{L}+| ?\p{N}+|"


def plain_pattern(pattern: str) -> re.Pattern:
    """The pattern for texts without UNSURE characters."""
    pattern = pattern.replace(_CONTRACTIONS + _RUNS, _RUNS + _CONTRACTIONS)
    for name, members in ((r"\p{L}", _LETTERS), (r"\p{N}", _NUMBERS)):
        pattern = pattern.replace(f"[{name}]", f"[{members}]")
        pattern = re.sub(r"(\[[^\]]*)" + re.escape(name), lambda m: m[1] + members, pattern)
        pattern = pattern.replace(name, f"[{members}]")
    return re.compile(pattern)


if array("I").itemsize != 4 or sys.byteorder != "little":
    raise ImportError("packed ids need 32-bit little-endian integers")
#: Words kept by a worker, and texts encoded together.
CACHED, TOGETHER = 1 << 20, 128


class WordCache:
    """Ids of words in two generations of half the limit each: what isn't used again in one goes with the next."""

    def __init__(self, limit: int = CACHED) -> None:
        self.half = limit // 2
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def look_up(self, words: list[str]) -> list[bytes | None]:
        found = list(map(self.young.get, words))
        if self.old and None in found:
            for i, x in enumerate(found):
                if x is None and (x := self.old.get(words[i])) is not None:
                    found[i] = self.young[words[i]] = x
        return found

    def add(self, found: dict[str, bytes]) -> None:
        if len(self.young) + len(found) > self.half:
            self.old, self.young = self.young, {}
        if len(found) <= self.half:
            self.young.update(found)


class WordEncoder:
    """Encodes texts exactly as ``Tokenizer.encode(text, add_special_tokens=False)``.

    Strings of special tokens inside a text are ordinary text.  ``encode``
    yields the ids of each text as packed little-endian unsigned 32-bit
    integers.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        normal, split = spec["normalizer"], spec["pre_tokenizer"]
        self.lower = False
        self.words = None
        if normal is None and split == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}:
            self.words = plain_pattern(BYTE_LEVEL).findall
        elif (
            split["type"] == "Sequence"
            and split["pretokenizers"][0] == {"type": "Split", "pattern": {"Regex": WORD_ENDS}, "behavior": "Removed", "invert": True}
            and [x["type"] for x in normal["normalizers"]] == ["NFC", "Replace", "Lowercase"]
        ):
            self.lower = True
            self.words = plain_pattern(WORD_ENDS).findall
        self.cache = WordCache()

    def _learn(self, words: set[str]) -> dict[str, bytes]:
        """The ids of the words, which are kept for a while.

        Both kinds of vocabulary hand a word to the model as one character for
        each of its bytes, so the model can be asked without the passes over
        whole texts around it.
        """
        tokenize = self.library.model.tokenize
        found = {}
        for w in words:
            # Most words are ASCII letters behind a space or none, of which only the space is written otherwise.
            if w.isascii() and (w.isalnum() or w[1:].isalnum() and w[0] == " "):
                written = w.replace(" ", _SPACE)
            else:
                written = w.encode().decode("latin-1").translate(_CHARACTERS)
            found[w] = array("I", [t.id for t in tokenize(written)]).tobytes()
        self.cache.add(found)
        return found

    def encode(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        group: list[str] = []
        for text in texts:
            group.append(text or "")
            if len(group) == TOGETHER:
                yield from self._encode_group(group)
                group = []
        yield from self._encode_group(group)

    def _encode_group(self, group: list[str]) -> Iterator[bytes]:
        # For each text the ids of its words, and the places and words of those that aren't known yet.
        split: list[tuple[list[bytes | None], list[tuple[int, str]]] | None] = []
        new: set[str] = set()
        for text in group:
            if self.words is None or UNSURE.search(text):
                split.append(None)
                continue
            words = self.words(text.lower() if self.lower else text)
            ids = self.cache.look_up(words)
            missing = [(i, words[i]) for i, x in enumerate(ids) if x is None] if None in ids else []
            new.update([w for _, w in missing])
            split.append((ids, missing))
        found = self._learn(new) if new else {}
        for text, pair in zip(group, split):
            if pair is None:
                yield np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
            else:
                ids, missing = pair
                for i, w in missing:
                    ids[i] = found[w]
                yield b"".join(ids)


@lru_cache(maxsize=4)
def word_encoder(path: str) -> WordEncoder:
    """This worker's encoder for the vocabulary file."""
    return WordEncoder(path)
