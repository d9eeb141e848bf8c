"""Exact token counts at every prefix of a text, by dynamic programming, for truncation and budget questions.

For each place of a word the table holds the last token of the encoding of what lies before it, and how many tokens that takes. A
token that ends at a place belongs there if it is compatible with the last token at the place where it begins; just one is. A
prefix that ends inside a word closes it there, so its last token is one that carries the end-of-word mark. Sums over words give
the count at every prefix of the text.
"""

from __future__ import annotations

import re
import unicodedata
from itertools import islice

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text, per_text
from tallyloom.llm.wordbpe import BORDER, LATIN, Memo, Vocabulary, public_path, reopened, vocabulary

LIMIT = 2048
KNOWN_WORDS = 150_000
NONE, FIRST = -1, -2
CHUNK = re.compile(rb"[^\t-\r ]+")


class Counter:
    def __init__(self, words: Vocabulary):
        self.words = words
        self.automaton = ahocorasick.Automaton()
        self.length = [len(a or "") for a in words.atoms]
        self.longest = max(self.length)
        for atoms, token in words.token.items():
            if atoms[-1] < "Ā":  # the tokens that leave their word open
                self.automaton.add_word(atoms, token)
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}
        self.memo = Memo(self._chunks)

    def _open(self, words: list[str]) -> tuple[list[int], list[int], list[int]]:
        """For words that stay open, side by side: the last token and the number of tokens before each place; where each word begins."""
        text = BORDER.join(words)
        begins = np.cumsum([0, *(len(w) + 1 for w in words)]).tolist()
        last, count = [NONE] * (len(text) + 1), [0] * (len(text) + 1)
        for begin in begins[:-1]:
            last[begin] = FIRST
        length, fits = self.length, self.words.fits
        for end, token in self.automaton.iter(text):
            to = end + 1
            if last[to] == NONE:
                start = to - length[token]
                if last[start] == FIRST or fits(last[start], token):
                    last[to], count[to] = token, count[start] + 1
        return last, count, begins

    def _closed(self, plain: str, to: int, last: list[int], count: list[int], begin: int = 0) -> int:
        """Tokens of the first ``to`` places of a word that begins at ``begin`` of the table, as a word of their own."""
        token_of, fits = self.words.token, self.words.fits
        close = chr(ord(plain[to - 1]) + 256)
        for start in range(max(0, to - self.longest), to):
            token = token_of.get(plain[start : to - 1] + close)
            if token is not None and (not start or fits(last[begin + start], token)):
                return count[begin + start] + 1
        raise ValueError(f"the vocabulary can't spell {plain[:to]!r}")

    def words_of(self, words: list[str]) -> list[int]:
        """Tokens of each word."""
        plain = list(map(reopened, words))
        last, count, begins = self._open([p[:-1] for p in plain])
        return [self._closed(p, len(p), last, count, b) for p, b in zip(plain, begins, strict=False)]

    def word_prefixes(self, atoms: str) -> list[int]:
        """Tokens at each place from 1 on, the word closed there."""
        plain = reopened(atoms)
        last, count, _ = self._open([plain])
        return [self._closed(plain, to, last, count) for to in range(1, len(plain) + 1)]

    def _chunks(self, chunks: list[bytes]) -> list[int]:
        known, parts = self.known, self.words.pretokens(chunks)
        if len(known) >= KNOWN_WORDS:
            known.clear()
        new = []
        for w in {w for p in parts for w in p if w not in known and isinstance(w, str)}:
            if w in self.words.token:
                known[w] = 1
            else:
                new.append(w)
        known.update(zip(new, self.words_of(new), strict=True))
        return [sum([1 if isinstance(p, int) else known[p] for p in part]) for part in parts]

    def chunk(self, text: str) -> int:
        return self._chunks([text.encode()])[0]

    def chunk_prefixes(self, chunk: bytes) -> list[int]:
        """Tokens at each code point from 1 on, of any script: a prefix of a composed text is composed, and its split is that of the whole but for its end.

        Only chunks with marks to compose, special tokens, or letters whose small form depends on others count each prefix anew.
        """
        text = chunk.decode()
        small = [c.lower() for c in text]
        lower = "".join(small)
        rules = self.words.rules.normalizer
        simple = unicodedata.is_normalized("NFC", text) and not self.words._cut.search(text) and (max(text) <= LATIN or rules.normalize_str(text) == lower)
        if not simple:
            return [self.chunk(text[:to]) for to in range(1, len(text) + 1)]
        out, before, at = [], 0, 0
        for atoms in self.words.pretokens([chunk])[0]:
            plain = reopened(atoms).encode("latin-1").decode()
            begin = lower.index(plain, at)
            out += [before] * (begin - at)  # blanks beyond ASCII
            if plain[0] == "'" and len(plain) == 3:  # 're and its like: with a letter cut off they are no longer one word
                out += [before + self.chunk(plain[:to]) for to in (1, 2, 3)]
            else:
                steps = self.word_prefixes(atoms)
                out += [before + steps[to - 1] for to in np.cumsum([len(c.encode()) for c in plain])]
            before, at = out[-1], begin + len(plain)
        out += [before] * (len(lower) - at)
        if len(lower) == len(text):
            return out
        return [out[to - 1] for to in np.cumsum(list(map(len, small)))]

    def counts(self, raw: bytes) -> np.ndarray:
        """Tokens at the end of each chunk."""
        return np.cumsum(self.memo.all_of(raw.split()), dtype=np.int64)

    def prefixes(self, raw: bytes) -> np.ndarray:
        """Tokens at every prefix, from the empty one to the whole text, by code points."""
        steps, before, at = [np.zeros(1, np.int32)], 0, 0
        for m in CHUNK.finditer(raw):
            steps.append(np.full(m.start() - at, before, np.int32))
            steps.append(np.array(self.chunk_prefixes(m[0]), np.int32) + before)
            before, at = int(steps[-1][-1]), m.end()
        steps.append(np.full(len(raw) - at, before, np.int32))  # blanks: one byte each
        return np.concatenate(steps)

    def kept(self, raw: bytes, counts: np.ndarray, limit: int) -> int:
        """Code points of the longest prefix of at most ``limit`` tokens, without encoding the text again."""
        if not len(counts) or counts[-1] <= limit:
            return len(raw.decode())
        fit = int(np.searchsorted(counts, limit, "right"))
        crossing = next(islice(CHUNK.finditer(raw), fit, None))
        before = int(counts[fit - 1]) if fit else 0
        inside = np.flatnonzero(np.array([0, *self.chunk_prefixes(crossing[0])]) + before <= limit)
        return len(raw[: crossing.start()].decode()) + int(inside[-1])


_MADE: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _MADE:
        _MADE[path] = Counter(vocabulary(path))
    return _MADE[path]


def token_counts(docs: DataFrame, limit: int = LIMIT, path: str | None = None) -> DataFrame:
    """Documents to (doc_id, n_bytes, n_tokens, over_limit, kept_chars).

    kept_chars: code points of the longest prefix of at most ``limit`` tokens. A null or empty text has zeros. Repeated rows and
    rows without a doc_id stay; an empty table gives no rows.
    """
    path = path or public_path()

    def work(texts):
        table = counter(path)
        counts = [table.counts(t) for t in texts]
        total = [int(c[-1]) if len(c) else 0 for c in counts]
        kept = [table.kept(t, c, limit) for t, c in zip(texts, counts, strict=True)]
        return {"n_bytes": list(map(len, texts)), "n_tokens": total, "over_limit": [n > limit for n in total], "kept_chars": kept}

    schema = pa.schema([("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_()), ("kept_chars", pa.int64())])
    return per_text(id_and_text(docs), work, schema, "n_bytes long, n_tokens long, over_limit boolean, kept_chars long")


def prefix_table(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents to (doc_id, counts array<int>): the count at every prefix by code points; entry 0 is the empty prefix."""
    path = path or public_path()
    schema = pa.schema([("counts", pa.list_(pa.int32()))])
    return per_text(id_and_text(docs), lambda texts: {"counts": [counter(path).prefixes(t) for t in texts]}, schema, "counts array<int>")


def longest_within(counts, budget: int):
    """Column: code points of the longest stored prefix within a budget of tokens."""
    return F.array_max(F.transform(counts, lambda c, i: F.when(c <= budget, i)))
