"""Exact BPE encoding by backtracking over Aho-Corasick matches, and decoding through an offset table.

The automaton gives, at each place of a word, the tokens that start there. The encoder takes the longest that is compatible with
the token before it (``Vocabulary.fits``); where none is, it steps back, and that place is never entered again. A sequence
whose neighbours are all compatible is the one that the merges make, so the result is exact, and each place is left at most once
for each token that starts there: linear in the word's length.
"""

from __future__ import annotations

import hashlib
from struct import pack

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tallyloom.llm.common import id_and_text, per_text
from tallyloom.llm.wordbpe import BORDER, Memo, Vocabulary, public_path, vocabulary

GATHER = 1 << 16
KNOWN_WORDS = 250_000


class Encoder:
    def __init__(self, words: Vocabulary):
        self.words = words
        self.automaton = ahocorasick.Automaton()
        for atoms, token in words.token.items():
            self.automaton.add_word(atoms, token)
        self.automaton.make_automaton()
        self.length = [len(a or "") for a in words.atoms]
        self.memo = Memo(self._chunks)
        self.known: dict[str, bytes] = {}

    def words_of(self, words: list[str]) -> list[list[int]]:
        """The tokens of each word. The longest matches from left to right are right if all neighbours are compatible; else it searches."""
        length, fits = self.length, self.words.fits
        ends = np.cumsum([len(w) + 1 for w in words]).tolist()
        greedy: list[list[int]] = [[] for _ in words]
        at = 0
        for end, token in self.automaton.iter_long(BORDER.join(words)):
            while end >= ends[at]:
                at += 1
            greedy[at].append(token)
        return [g if sum([length[t] for t in g]) == len(w) and all(map(fits, g, g[1:])) else self._search(w) for w, g in zip(words, greedy, strict=True)]

    def _search(self, atoms: str) -> list[int]:
        length, fits, n = self.length, self.words.fits, len(atoms)
        starting: list[list[int]] = [[] for _ in range(n)]
        for end, token in self.automaton.iter(atoms):
            starting[end + 1 - length[token]].append(token)  # shorter ones first
        tokens: list[int] = []
        ends = [0]
        left = [len(starting[0])]
        barred = bytearray(n + 1)
        while ends[-1] < n:
            at, k = ends[-1], left[-1]
            here = starting[at]
            while k:
                k -= 1
                token = here[k]
                end = at + length[token]
                if not barred[end] and (not tokens or fits(tokens[-1], token)):
                    left[-1] = k
                    tokens.append(token)
                    ends.append(end)
                    left.append(len(starting[end]) if end < n else 0)
                    break
            else:
                barred[at] = 1
                if not tokens:
                    raise ValueError(f"the vocabulary can't spell {atoms!r}")
                tokens.pop()
                ends.pop()
                left.pop()
        return tokens

    def _chunks(self, chunks: list[bytes]) -> list[bytes]:
        known, parts = self.known, self.words.pretokens(chunks)
        if len(known) >= KNOWN_WORDS:
            known.clear()
        new = list({w for p in parts for w in p if w not in known and isinstance(w, str)})
        known.update(zip(new, (pack(f"<{len(ids)}I", *ids) for ids in self.words_of(new)), strict=True))
        return [b"".join([pack("<I", p) if isinstance(p, int) else known[p] for p in part]) for part in parts]

    def encode(self, raw: bytes) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        return b"".join(self.memo.all_of(raw.split()))


class OffsetTable:
    """All spellings end to end, each behind a blank, and where each begins; decoding copies ranges of it."""

    def __init__(self, words: Vocabulary):
        spelt = [b" " + s.encode() for s in words.spelling]
        self.bytes = np.frombuffer(b"".join(spelt), np.uint8)
        # all spellings together are far from 2^31 bytes, and so is what is decoded at a time
        self.start = np.cumsum([0, *map(len, spelt)]).astype(np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        out = []
        for at in range(0, len(ids), GATHER):
            some = ids[at : at + GATHER]
            begin, size = self.start[some], self.start[some + 1] - self.start[some]
            to = np.cumsum(size, dtype=np.int32)
            out.append(self.bytes[np.repeat(begin - to + size, size) + np.arange(to[-1], dtype=np.int32)].tobytes())
        return b"".join(out)[1:]


_MADE: dict[str, tuple[Encoder, OffsetTable]] = {}


def codec(path: str) -> tuple[Encoder, OffsetTable]:
    if path not in _MADE:
        _MADE[path] = Encoder(vocabulary(path)), OffsetTable(vocabulary(path))
    return _MADE[path]


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Documents to (doc_id, ids array<int>), as the file's library encodes them without added special tokens.

    A null or empty text has no ids. Repeated rows and rows without a doc_id stay; an empty table gives no rows.
    """
    path = path or public_path()

    def work(texts):
        return {"ids": [np.frombuffer(codec(path)[0].encode(t), "<u4").astype(np.int32) for t in texts]}

    return per_text(id_and_text(docs), work, pa.schema([("ids", pa.list_(pa.int32()))]), "ids array<int>")


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids) to (doc_id, text): spellings joined by blanks, as the library does for a file without a decoder. Null ids: null."""
    path = path or public_path()

    def run(batches):
        for batch in batches:
            texts = [None if x is None else codec(path)[1].decode(np.array(x, np.int64)).decode() for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """Encode and decode in one pass and keep counts and digests only: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    path = path or public_path()

    def work(texts):
        encoder, table = codec(path)
        out: dict[str, list] = {"n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
        for raw in texts:
            ids = encoder.encode(raw)
            out["n_tokens"].append(len(ids) // 4)
            out["ids_sha256"].append(hashlib.sha256(ids).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(table.decode(np.frombuffer(ids, "<u4"))).hexdigest())
        return out

    schema = pa.schema([("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    return per_text(id_and_text(docs), work, schema, "n_tokens long, ids_sha256 string, decoded_sha256 string")
