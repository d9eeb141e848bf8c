"""Vocabulary files whose tokens close words (byte-level BPE with an end-of-word mark): reading, normalising, splitting.

A text is worked on in chunks, the runs between ASCII blanks: normal form C, lower case and the split pattern never look across
a blank, so the tokens of a text are those of its chunks in order. Chunks repeat, so what is made of one is remembered.
"""

from __future__ import annotations

import gc
import json
import unicodedata
from collections.abc import Callable
from functools import cached_property, lru_cache
from sys import getsizeof

import regex
from tokenizers import Tokenizer

WORD_END = "</w>"
WORD_VOCABULARY = "word_bpe_49k.json"
# the file's own split pattern with blanks spelt out, as its library understands \s
SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\t-\r\x85\p{Z}\p{L}\p{N}]+")
SPLIT_LINES = regex.compile(SPLIT.pattern + r"|\n")
#: Bytes of an entry of a dictionary besides its key and value
SLOT = 100
BORDER = "\uffff"  # between words that are searched together; in no token


def public_path(name: str = WORD_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of_char() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for the letters from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


#: Up to here all tables of characters agree; chunks with others are normalised and split by the file's own library.
LATIN = "\u024f"


class Vocabulary:
    """Tokens as strings of atoms. An atom is a byte (its code point) or the last byte of a word (256 more)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            data = json.load(file)
        byte = _byte_of_char()
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        names = data["model"]["vocab"]
        self.size = 1 + max(max(names.values()), *self.special.values())
        self.spelling = [""] * self.size
        for name, token in [*names.items(), *self.special.items()]:
            self.spelling[token] = name
        self.atoms: list[str | None] = [None] * self.size
        for name, token in names.items():
            if name in self.special:
                continue
            ends = name.endswith(WORD_END)
            codes = [byte[c] for c in (name[: -len(WORD_END)] if ends else name)]
            if ends:
                codes[-1] += 256
            self.atoms[token] = "".join(map(chr, codes))
        self.token = {a: t for t, a in enumerate(self.atoms) if a is not None}
        self.path = path
        self.byte = {ord(c): b for c, b in byte.items()}
        self.rules = Tokenizer.from_file(path)
        self._cut = regex.compile("|".join(map(regex.escape, self.special)))
        self._tails: dict[int, list[tuple[int, float]]] = {}
        self._heads: dict[int, list[tuple[int, float]]] = {}
        self.fits = lru_cache(1 << 19)(self._fits)

    @cached_property
    def _merges(self) -> tuple[dict[tuple[int, int], int], dict[int, tuple[int, int]], list[int]]:
        """One merge per token: when a pair merges, which two make a token, and when. Read when first needed."""
        rank, parts, born = {}, {}, [-1] * self.size
        with open(self.path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        names = model["vocab"]
        for when, (left, right) in enumerate(model["merges"]):
            pair, made = (names[left], names[right]), names[left + right]
            rank[pair], parts[made], born[made] = when, pair, when
        return rank, parts, born

    def _edge(self, token: int, side: int, known: dict) -> list[tuple[int, float]]:
        """The pieces that stood at one edge of a token while it was built, each with the time of the merge that took it up."""
        if token not in known:
            _, parts, born = self._merges
            found, until = [], float("inf")
            piece = token
            while True:
                found.append((piece, until))
                if piece not in parts:
                    break
                until = born[piece]
                piece = parts[piece][side]
            known[token] = found
        return known[token]

    def _fits(self, left: int, right: int) -> bool:
        """Pair compatibility: whether the merges leave these two tokens side by side.

        They don't if two pieces that meet at the border could merge before both are taken up by their own side. At equal times
        the left-hand merge comes first: that of the left token before the border's, the border's before that of the right one.
        """
        heads, rank = self._edge(right, 0, self._heads), self._merges[0]
        for tail, tail_until in self._edge(left, 1, self._tails):
            for head, head_until in heads:
                when = rank.get((tail, head))
                if when is not None and when < tail_until and when <= head_until:
                    return False
        return True

    def pretokens(self, chunks: list[bytes], mark: bool = True) -> list[list[int | str]]:
        """For each chunk its words as strings of atoms (without ``mark`` as bytes), and special tokens, as found in the text, as ids."""
        if not chunks:
            return []
        texts = [c.decode() for c in chunks]
        whole = "\n".join(texts)
        if max(whole, default="") > LATIN or "<|" in whole:
            parts = [self._mixed(t) for t in texts]
            return parts if mark else [[p if isinstance(p, int) else reopened(p) for p in part] for part in parts]
        found: list[list[int | str]] = [[]]
        for word in SPLIT_LINES.findall((whole if whole.isascii() else unicodedata.normalize("NFC", whole)).lower()):
            if word == "\n":
                found.append([])
            else:
                plain = word if word.isascii() else word.encode().decode("latin-1")
                found[-1].append(closed(plain) if mark else plain)
        return found

    def _mixed(self, text: str) -> list[int | str]:
        found: list[int | str] = []
        at = 0
        for m in self._cut.finditer(text):
            found += self._words(text[at : m.start()])
            found.append(self.special[m[0]])
            at = m.end()
        return found + self._words(text[at:])

    def _words(self, text: str) -> list[str]:
        if max(text, default="") <= LATIN:
            return [closed(w.encode().decode("latin-1")) for w in SPLIT.findall(unicodedata.normalize("NFC", text).lower())]
        rules = self.rules
        return [closed(w.translate(self.byte)) for w, _ in rules.pre_tokenizer.pre_tokenize_str(rules.normalizer.normalize_str(text))]


def closed(plain: str) -> str:
    """A word's bytes as atoms, the last one marked."""
    return plain[:-1] + chr(ord(plain[-1]) + 256)


def reopened(atoms: str) -> str:
    return atoms[:-1] + chr(ord(atoms[-1]) - 256)


_LOADED: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """The vocabulary of a file, read once per worker. The file must lie at the same path on every machine."""
    if path not in _LOADED:
        _LOADED[path] = Vocabulary(path)
        gc.freeze()  # the tables stay: the collector need not walk through them again and again
        gc.set_threshold(200_000, 20, 100)
    return _LOADED[path]


class Memo:
    """Remembers what was made of chunks, in two generations of bounded size: what is asked again moves to the new one.

    A generation ends at ``room`` bytes, as Python counts what it holds, or at ``entries``.
    """

    def __init__(self, make: Callable[[list[bytes]], list], entries: int = 400_000, room: int = 80 << 20):
        self.make, self.entries, self.room = make, entries, room
        self.new: dict[bytes, object] = {}
        self.old: dict[bytes, object] = {}
        self.held = 0

    def all_of(self, chunks: list[bytes]) -> list:
        """What was made of each chunk, in order."""
        got = list(map(self.new.get, chunks))
        if None not in got:
            return got
        asked = {c for c, g in zip(chunks, got, strict=True) if g is None}
        missing = []
        mine: dict[bytes, object] = {}
        for c in asked:
            g = self.old.get(c)
            if g is None:
                missing.append(c)
            else:
                mine[c] = g
        mine.update(zip(missing, self.make(missing), strict=True))
        size = SLOT * len(mine) + sum(map(getsizeof, mine)) + sum(map(getsizeof, mine.values()))
        if len(self.new) + len(mine) > self.entries or self.held + size > self.room:
            self.old, self.new, self.held = self.new, {}, 0
        if len(mine) <= self.entries and size <= self.room:
            self.new.update(mine)
            self.held += size
        return [mine[c] if g is None else g for c, g in zip(chunks, got, strict=True)]
