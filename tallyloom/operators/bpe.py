"""Byte-pair vocabularies learned from word counts, and encoding with them.

A plain vocabulary knows words and runs of punctuation; decoding sets its tokens apart by blanks, so texts come back as they
were only if no word was cut. A lossless one has symbols that carry the blank before them, all other white space as symbols of its own,
and bytes for letters that were never seen, so that its tokens, joined, are the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.functions.text import strip
from tallyloom.operators.corpus import word_counts
from tallyloom.session import bounded_batches, scratch_dir, spread

SPECIALS = ("[PAD]", "[UNK]", "[START]", "[END]")
# in arrays of symbols: letters are their code points, merged symbols follow; between words stands an edge
EDGE, MERGED = -1, 0x110000
BLOCK_LETTERS = 1 << 18
# ids that are spelt at a time, and how many merges run over arrays of letters
IDS_AT_ONCE, PASSES = 1 << 20, 256
ROUNDS_PER_CHECKPOINT = 8
LOOK_AHEAD = 256
# what a task remembers: so many words, and so many letters of words
MEMO_WORDS, MEMO_LETTERS = 200_000, 4_000_000
PLAIN, LOSSLESS = r"\w+|[^\w\s]+", r" ?\w+| ?[^\w\s]+|\s"
BYTES = tuple(f"<0x{b:02X}>" for b in range(256))


@dataclass
class Vocabulary:
    """Token -> id, and the merges in the order they were learned. Both are bounded by the vocabulary size."""

    tokens: dict[str, int] = field(default_factory=dict)
    merges: list[tuple[str, str]] = field(default_factory=list)
    lossless: bool = False

    def add(self, token: str) -> None:
        self.tokens.setdefault(token, len(self.tokens))

    def first(self, size: int) -> Vocabulary:
        """The smaller vocabulary that the same training would have stopped at."""
        tokens = {t: i for t, i in self.tokens.items() if i < size}
        return Vocabulary(tokens, [(a, b) for a, b in self.merges if a + b in tokens], self.lossless)


def _word_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words and their counts as rows of arrays: the code points of BLOCK_LETTERS letters or so, EDGE around each word."""
    words: list[str] = []
    counts: list[int] = []
    held = 0

    def block() -> pa.RecordBatch:
        codes = np.frombuffer("".join(words).encode("utf-32-le"), np.int32)
        ends = np.cumsum([len(w) + 1 for w in words])
        syms = np.full(len(codes) + len(words) + 1, EDGE, np.int32)
        inside = np.ones(len(syms), bool)
        inside[0] = inside[ends] = False
        syms[inside] = codes
        return pa.RecordBatch.from_pydict({"syms": [syms.tobytes()], "n": [np.array(counts, np.int64).tobytes()]})

    for batch in batches:
        for word, n in zip(batch["word"].to_pylist(), batch["n"].to_pylist()):
            words.append(word)
            counts.append(n)
            held += len(word)
            if held >= BLOCK_LETTERS:
                yield block()
                words, counts, held = [], [], 0
    if words:
        yield block()


def _merge(syms: np.ndarray, a: int, b: int, ab: int) -> np.ndarray:
    """Each a that b follows is made one symbol with it, from the left."""
    at = np.flatnonzero(syms == a)
    at = at[syms[at + 1] == b]
    if not len(at):
        return syms
    if a == b:  # of a run every second place
        start = np.maximum.accumulate(np.where(np.diff(at, prepend=-2) != 1, at, 0))
        at = at[(at - start) % 2 == 0]
    keep = np.ones(len(syms), bool)
    keep[at + 1] = False
    out = syms.copy()
    out[at] = ab
    return out[keep]


def _replayed(row: bytes, merges: list[tuple[int, int, int]]) -> np.ndarray:
    syms = np.frombuffer(row, np.int32)
    for merge in merges:
        syms = _merge(syms, *merge)
    return syms


def _pair_counts(blocks: DataFrame, merges: list[tuple[int, int, int]], names: list[str]) -> DataFrame:
    """How often each pair of neighbours occurs after some merges; ``names`` has the merged symbols."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n in zip(batch["syms"], batch["n"]):
                syms, counts = _replayed(row.as_py(), merges), np.frombuffer(n.as_py(), np.int64)
                left = np.flatnonzero((syms[:-1] != EDGE) & (syms[1:] != EDGE))
                word = np.cumsum(syms == EDGE)[left] - 1
                keys = syms[left].astype(np.int64) << 32 | syms[left + 1]
                found = pa.table({"pair": keys, "n": counts[word]}).group_by("pair", use_threads=False).aggregate([("n", "sum")])
                both = found["pair"].to_numpy()
                used, at = np.unique(np.concatenate([both >> 32, both & 0xFFFFFFFF]), return_inverse=True)
                spelt = pa.array([chr(x) if x < MERGED else names[x - MERGED] for x in used.tolist()], pa.string())
                a, b = (spelt.take(pa.array(half)) for half in (at[: len(both)], at[len(both) :]))
                yield pa.RecordBatch.from_arrays([a, b, found["n_sum"].combine_chunks()], ["a", "b", "n"])

    return blocks.mapInArrow(run, "a string, b string, n long").groupBy("a", "b").agg(F.sum("n").alias("n"))


def _merged_blocks(blocks: DataFrame, merges: list[tuple[int, int, int]]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, n in zip(batch["syms"], batch["n"]):
                yield pa.RecordBatch.from_pydict({"syms": [_replayed(row.as_py(), merges).tobytes()], "n": [n.as_py()]})

    return blocks.mapInArrow(run, blocks.schema)


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch["syms"]:
            codes = np.unique(np.frombuffer(row.as_py(), np.int32))
            yield pa.RecordBatch.from_pydict({"c": pa.array(codes[codes != EDGE], pa.int32())})


def _stored(rows: DataFrame, name: str) -> DataFrame:
    """Written once and read again; a checkpoint would make its rows twice."""
    to = scratch_dir(rows.sparkSession, f"bpe-{name}")
    rows.write.parquet(to)
    return rows.sparkSession.read.parquet(to)


def independent_prefix(ranked: list[tuple[str, str, int]], known: set[str], complete: bool) -> list[tuple[str, str]]:
    """How many of the best pairs may be merged in one round with the result of merging one at a time.

    Occurrences of (a, b) and (c, d) can only touch where b = c or d = a, so as long as no left symbol is
    also a right symbol the merges leave each other's counts alone. A pair that a merge creates, (x, ab)
    or (ab, y), occurs at most as often as (x, a) or (b, y). Neither may be in the prefix, so it is enough
    that the prefix is strictly more frequent than what follows. A merge that yields a token known before
    adds to that token's pairs, so it closes the round, as does a doubled symbol.
    """
    left: set[str] = set()
    right: set[str] = set()
    made: set[str] = set()
    size = 0
    for a, b, _ in ranked:
        closes = a == b or a + b in known or a + b in made
        if size and (closes or a in right or b in left):
            break
        left.add(a)
        right.add(b)
        made.add(a + b)
        size += 1
        if closes:
            break
    if size == len(ranked) and not complete:
        size -= 1
    while size > 1 and size < len(ranked) and ranked[size - 1][2] == ranked[size][2]:
        size -= 1
    return [(a, b) for a, b, _ in ranked[: max(1, size)]]


def piece_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """How often each piece of a lossless split occurs: words and punctuation with the blank before them, and single white space."""
    pieces = F.regexp_extract_all(text, F.lit(f"(?U){LOSSLESS}"), F.lit(0))
    return df.select(F.explode(pieces).alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("n"))


def train_bpe(df: DataFrame, vocab_size: int, specials: tuple[str, ...] = SPECIALS, text: str = "text", lossless: bool = False) -> Vocabulary:
    """Learn merges on the table of distinct words.

    The corpus is read once, for the word counts. The distinct words are kept as arrays of symbols; each round applies the
    merges since they were last written, counts the pairs and brings the few best to the driver. Several independent
    merges share a round. Ties go to the pair that sorts first. The arrays are written every few rounds.
    """
    vocab = Vocabulary(lossless=lossless)
    spaces: list[str] = []
    if lossless:
        counts = _stored(piece_counts(df, text), "pieces")
        # white space that stands alone never merges: as many rows as there are such characters
        alone = F.col("word").rlike(r"(?U)\A\s\z")
        spaces = [r["word"] for r in counts.where(alone).select("word").collect()]
        counts = counts.where(~alone)
        specials = (*specials, *BYTES)
    else:
        counts = word_counts(df, text)
    blocks = _stored(counts.select("word", "n").repartition(spread(df.sparkSession)).mapInArrow(_word_blocks, "syms binary, n binary"), "words")
    # an alphabet: bounded by the characters that exist
    letters = blocks.mapInArrow(_letters, "c int").distinct().collect()
    for token in [*specials, *sorted({*spaces, *(chr(r["c"]) for r in letters)})]:
        vocab.add(token)
    names: list[str] = []
    symbols: dict[str, int] = {}

    def symbol(token: str) -> int:
        if len(token) == 1:
            return ord(token)
        if token not in symbols:
            symbols[token] = MERGED + len(names)
            names.append(token)
        return symbols[token]

    rounds = 0
    merges: list[tuple[int, int, int]] = []
    while len(vocab.tokens) < vocab_size:
        room = vocab_size - len(vocab.tokens)
        limit = min(LOOK_AHEAD, room + 1)
        best = _pair_counts(blocks, merges, names).orderBy(F.desc("n"), "a", "b").limit(limit).collect()
        ranked = [(r["a"], r["b"], r["n"]) for r in best]
        if not ranked:
            break
        for a, b in independent_prefix(ranked, set(vocab.tokens), complete=len(ranked) < limit)[:room]:
            vocab.merges.append((a, b))
            vocab.add(a + b)
            merges.append((symbol(a), symbol(b), symbol(a + b)))
        rounds += 1
        if rounds % ROUNDS_PER_CHECKPOINT == 0 and len(vocab.tokens) < vocab_size:
            blocks, merges = _stored(_merged_blocks(blocks, merges), "words"), []
    return vocab


def merged(word: str, rank: dict[tuple[str, str], int]) -> list[str]:
    """The parts of a word: of the pairs there the one that was learned first is merged, wherever it occurs, and so on.

    Pairs wait in a heap, so that a long run of letters takes little more time a letter than a short one.
    """
    parts: list[str | None] = list(word)
    after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
    heap = [(r, i) for i in range(len(parts) - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
    heapify(heap)
    while heap:
        best, new = heap[0][0], set()
        while heap and heap[0][0] == best:
            i = heappop(heap)[1]
            j = after[i]
            if parts[i] is None or j == len(parts) or rank.get((parts[i], parts[j])) != best:
                continue
            parts[i], parts[j], after[i] = parts[i] + parts[j], None, after[j]
            if after[j] < len(parts):
                before[after[j]] = i
            new |= {before[i], i}
        for i in new:
            if i >= 0 and parts[i] is not None and after[i] < len(parts) and (r := rank.get((parts[i], parts[after[i]]))) is not None:
                heappush(heap, (r, i))
    return [p for p in parts if p is not None]


@cache
def _kinds() -> np.ndarray:
    """Of each character: 0 for white space, 1 in words, 2 for all others."""
    every, table = "".join(map(chr, range(0x110000))), np.full(0x110000, 2, np.uint8)
    for kind, shape in enumerate((r"\s+", r"\w+")):
        for m in re.finditer(shape, every):
            table[m.start() : m.end()] = kind
    return table


def _cut(texts: list[str], lossless: bool) -> tuple[np.ndarray, np.ndarray]:
    """The words of some texts as one array of code points, EDGE around each, and how many words lie before the end of each text."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.int32)
    ends = np.cumsum([len(t) for t in texts])
    kind = _kinds()[codes]
    starts = np.ones(len(codes), bool)
    starts[1:] = kind[1:] != kind[:-1]
    if lossless:  # a blank goes with what follows, all other white space stands alone
        starts[1:] &= codes[:-1] != 32
        starts |= kind == 0
        shown = np.ones(len(codes), bool)
    else:
        shown = kind > 0
    starts[ends[:-1][ends[:-1] < len(codes)]] = True
    starts &= shown
    word = np.cumsum(starts)
    syms = np.full(int(np.count_nonzero(shown)) + (int(word[-1]) if len(word) else 0) + 1, EDGE, np.int32)
    syms[(np.cumsum(shown) - 1 + word)[shown]] = codes[shown]
    return syms, np.concatenate([[0], word])[ends]


def _stretches(texts: pa.Array) -> Iterator[tuple[list[str], list[int]]]:
    """Texts, or parts of them that end with a word, with their places: BLOCK_LETTERS letters or so at a time."""
    part, at, held = [], [], 0
    border = re.compile(r"\s|(?<=\w)[^\w\s]|(?<=[^\w\s])\w")
    for i, t in enumerate(texts):
        rest = t.as_py() or ""
        start = 0
        while start < len(rest):
            m = border.search(rest, start + BLOCK_LETTERS) if len(rest) - start > BLOCK_LETTERS else None
            end = m.start() if m else len(rest)
            part.append(rest[start:end])
            at.append(i)
            held += end - start
            start = end
            if held >= BLOCK_LETTERS:
                yield part, at
                part, at, held = [], [], 0
    if part:
        yield part, at


class _Encoder:
    """Ids of words. It lives as long as a task, and with it the words it has met."""

    def __init__(self, vocab: Vocabulary, unknown: str):
        self.vocab, self.unk = vocab, vocab.tokens[unknown]
        self.rank = {pair: i for i, pair in enumerate(vocab.merges)}
        self.known: dict[str, bytes] = {}
        self.held = 0
        order = sorted(self.rank, key=self.rank.__getitem__)
        self.number: dict[str, int] = {}
        first: dict[str, int] = {}
        for i, (a, b) in enumerate(order):
            for token in (a, b, a + b):
                self.number.setdefault(token, ord(token) if len(token) == 1 else MERGED + len(self.number))
            first.setdefault(a, i)
            first.setdefault(b, i)
        # a merge whose result is part of an earlier one may call for that one again
        self.passes = [(self.number[a], self.number[b], self.number[a + b], first.get(a + b, len(order)) <= i) for i, (a, b) in enumerate(order)]
        self.names = {n: token for token, n in self.number.items()}

    def word(self, word: str) -> bytes:
        if word in self.known:
            return self.known[word]
        parts, tokens = merged(word, self.rank), self.vocab.tokens
        if self.held + len(word) > MEMO_LETTERS or len(self.known) >= MEMO_WORDS:
            self.known.clear()
            self.held = 0
        if self.vocab.lossless:  # a letter that was never seen is its bytes
            parts = [q for p in parts for q in ([p] if p in tokens else [BYTES[b] for b in p.encode()])]
        self.known[word] = np.array([tokens.get(p, self.unk) for p in parts], np.int32).tobytes()
        self.held += len(word)
        return self.known[word]

    def together(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of some texts, end to end, and how many each has: merges run over all their words, in the order they were learned."""
        whole, words = _cut(texts, self.vocab.lossless)
        syms, alone = whole, []
        for a, b, ab, again in self.passes:
            if again:
                at = np.flatnonzero(syms == a)
                at = at[syms[at + 1] == b]
                alone.append(np.cumsum(syms == EDGE)[at] - 1)
            syms = _merge(syms, a, b, ab)
        used = np.unique(syms)
        known = np.array([-2 if x == EDGE else self.vocab.tokens.get(self.names.get(x) or chr(x), -1) for x in used.tolist()], np.int32)
        ids = known[np.searchsorted(used, syms)]
        edges = np.flatnonzero(ids == -2)
        if self.vocab.lossless:
            alone.append(np.cumsum(syms == EDGE)[ids == -1] - 1)
        sizes = np.diff(edges) - 1
        ids[ids == -1] = self.unk
        if alone and len(one_by_one := np.unique(np.concatenate(alone))):
            borders, parts, done = np.flatnonzero(whole == EDGE), [], 0
            for w in one_by_one.tolist():
                letters = whole[borders[w] + 1 : borders[w + 1]].tobytes().decode("utf-32-le")
                parts += [ids[done : edges[w]], own := np.frombuffer(self.word(letters), np.int32)]
                sizes[w], done = len(own), edges[w + 1]
            ids = np.concatenate([*parts, ids[done:]])
        return ids[ids != -2], np.diff(np.concatenate([[0], np.cumsum(sizes)])[words], prepend=0)


def encode(text: Column, vocab: Vocabulary, unknown: str = "[UNK]") -> Column:
    """Text to token ids.

    One Arrow pass without a shuffle, ids of four bytes each and not objects. Up to PASSES merges run over arrays of the letters of many
    words; with more, each task remembers the words it has encoded (up to MEMO_LETTERS of them), so a frequent word costs one
    lookup. Joining exploded words to a table of encodings would shuffle every token twice.
    """
    coder = _Encoder(vocab, unknown)

    def run(texts: pa.Array) -> pa.Array:
        sizes, found = np.zeros(len(texts), np.int64), [np.zeros(0, np.int32)]
        if len(coder.passes) <= PASSES:
            for part, at in _stretches(texts):
                ids, each = coder.together(part)
                found.append(ids)
                np.add.at(sizes, at, each)
        else:
            shape = re.compile(LOSSLESS if vocab.lossless else PLAIN)
            for i, t in enumerate(texts):
                found.append(np.frombuffer(b"".join([coder.word(m.group()) for m in shape.finditer(t.as_py() or "")]), np.int32))
                sizes[i] = len(found[-1])
        ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        # a null text has null ids
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found)), mask=texts.is_null() if texts.null_count else None)

    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<int>")(text)


def decode(ids: Column, vocab: Vocabulary, skip: tuple[str, ...] = SPECIALS) -> Column:
    """Token ids to text, tokens set apart by blanks, or joined if the vocabulary is lossless; special tokens may be left out."""
    names = {i: t for t, i in vocab.tokens.items()}
    hidden, lossless = set(skip), vocab.lossless
    # spellings in the order of ids; the last one stands for ids that are not known
    last = max(names, default=-1) + 1
    if lossless:
        byte = {t: bytes([b]) for b, t in enumerate(BYTES)}
        spelt = [b"" if (t := names.get(i, "")) in hidden else byte.get(t) or t.encode() for i in range(last)] + [b""]
    else:
        spelt = [names.get(i, "").encode() + b" " for i in range(last)] + [b" "]
    gone = np.array([not lossless and names.get(i) in hidden for i in range(last + 1)], bool)

    def texts_of(rows: pa.Array) -> Iterator[str | None]:
        """Spellings of all tokens lie end to end, so a text is what lies between two places."""
        values = rows.flatten()
        at = values.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        at[(at < 0) | (at > last)] = last
        shown = ~gone[at]
        all_bytes = pa.array(spelt, pa.large_binary()).take(pa.array(at[shown]))
        offsets = np.frombuffer(all_bytes.buffers()[1], np.int64)[: len(all_bytes) + 1] if len(all_bytes) else np.zeros(1, np.int64)
        data = memoryview(all_bytes.buffers()[2] or b"") if len(all_bytes) else memoryview(b"")
        places = np.concatenate([[0], np.cumsum(shown)])
        sizes = rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        tokens = places[np.concatenate([[0], np.cumsum(sizes)])]
        for valid, a, b in zip(rows.is_valid().to_pylist(), tokens[:-1].tolist(), tokens[1:].tolist()):
            end = offsets[b] - (0 if lossless or a == b else 1)
            yield str(data[offsets[a] : end], "utf-8", "replace") if valid else None

    def run(rows: pa.Array) -> pa.Array:
        # a part of the rows at a time
        ends = np.cumsum(rows.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)) // IDS_AT_ONCE
        cuts = [0, *(np.flatnonzero(np.diff(ends)) + 1).tolist(), len(rows)]
        return pa.array((t for a, b in zip(cuts, cuts[1:]) for t in texts_of(rows.slice(a, b - a))), pa.string())

    run.__annotations__ = {"rows": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "string")(ids)


def roundtrip_audit(df: DataFrame, vocabs: dict[str, Vocabulary], text: str = "text") -> DataFrame:
    """Per tokenizer: OK only if encoding and decoding gives every text back as it was, stripped. Letters alone are counted besides.

    Each text is read once: all tokenizers take it in the same pass, and their ids stay inside it.
    """

    bounded_batches(df.sparkSession)

    def squeezed(c: Column) -> Column:
        # most white space is single blanks, which need no pattern
        return F.regexp_replace(F.replace(c, F.lit(" "), F.lit("")), r"(?U)\s+", "")

    back = df.select(F.col(text).alias("_text"), *[decode(encode(F.col(text), v), v, skip=()).alias(f"_back{i}") for i, v in enumerate(vocabs.values())])
    plain = back.select(
        strip(F.col("_text")).alias("_text"), squeezed(F.col("_text")).alias("_letters"),
        *[x for i in range(len(vocabs)) for x in (strip(F.col(f"_back{i}")).alias(f"_back{i}"), squeezed(F.col(f"_back{i}")).alias(f"_letters{i}"))])
    rows = plain.select(*[x for i in range(len(vocabs)) for x in (
        (F.col(f"_back{i}") == F.col("_text")).alias(f"_same{i}"), (F.col(f"_letters{i}") == F.col("_letters")).alias(f"_same_letters{i}"))])
    n = F.count(F.lit(1))
    each = [F.struct(
        F.lit(name).alias("tokenizer"), n.alias("n"), F.count_if(f"_same{i}").alias("n_same"), F.count_if(f"_same_letters{i}").alias("n_same_letters"),
        F.when(F.bool_and(F.coalesce(f"_same{i}", F.lit(False))), "OK").otherwise("BROKEN").alias("verdict")) for i, name in enumerate(vocabs)]
    # no rows, no report
    return rows.agg(n.alias("_n"), F.array(*each).alias("_each")).where("_n > 0").select(F.explode("_each").alias("_r")).select("_r.*")
