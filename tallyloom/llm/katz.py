"""A Katz backoff model: Good-Turing discounted counts of words and word pairs, exactly normalised, evaluated recursively per token.

    p(w | v) = d(c(v, w)) c(v, w) / c(v)     if the pair was seen in training
             = a(v) p(w)                     if only v was
             = p(w)                          else
    p(w)     = d(c(w)) c(w) / N              if the word was seen, and what that leaves over for all other words together

a(v) is what the discounts leave over after v, divided by p of all words not seen after v, both from the sums over all pairs.

Nearly every pair of words is rare, so rows of single pairs would be many times the text. Texts are cut into blocks of some
million tokens; what a block knows goes through the shuffle as sorted arrays, one for each range of hashes that it has entries in:

1. each block asks each range for its words and pairs, with its own training counts; the range adds up and answers in order;
   one of the asking blocks is told to be a pair's owner;
2. with the counts a block scores all tokens but the factor a(v), and adds up, for each v, what the pairs that it owns take away;
   ranges of v add that up over all blocks and answer the blocks that need it;
3. each block completes the scores of its documents.

A range holds a bounded number of entries, however often a word occurs, since a block asks once. Blocks, counts and sums are
written to the shared folder as tables partitioned by block and range, so that a lost executor costs its tasks only. Words and
pairs are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import crc_of_id, id_and_text, words
from tallyloom.llm.wordbpe import Memo
from tallyloom.session import scratch_dir

FOLDS, HELD_OUT = 7, 2
#: Counts over this are taken as they are, but for one part in N + 1, so that every context leaves something over.
RELIABLE = 5
BLOCK_TOKENS, RANGE_ENTRIES = 1_600_000, 2_000_000
END, START = (xxhash.xxh64_intdigest(mark, 1) for mark in (b"end", b"start"))

_HASHES = Memo(lambda found: list(map(xxhash.xxh64_intdigest, found)), 150_000)


def _packed(values: np.ndarray) -> bytes:
    """Bytes of like weight side by side, compressed."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpacked(data: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(size, -1).T).view(kind).ravel()


def _steps(keys: np.ndarray) -> bytes:
    """Sorted keys as the steps between them."""
    return _packed(np.diff(keys, prepend=np.uint64(0)))


def _keys(data: bytes) -> np.ndarray:
    return np.cumsum(_unpacked(data, np.uint64), dtype=np.uint64)


def _pair_key(v: np.ndarray, w: np.ndarray) -> np.ndarray:
    mixed = (v ^ (v >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + w
    mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return mixed ^ (mixed >> np.uint64(32))


def discounts(of: np.ndarray, n: float) -> np.ndarray:
    """d(0..RELIABLE + 1) from the numbers of entries with a count of 1, 2, ...: Good-Turing as Katz has it.

    Where the numbers are too few or too odd for that, d(r) = (r - D) / r with D = n1 / (n1 + 2 n2), or one half without any.
    """
    last = (RELIABLE + 1) * of[RELIABLE] / of[0] if of[0] else 1.0
    plain = of[0] / (of[0] + 2 * of[1]) if of[0] else 0.5
    d = np.zeros(RELIABLE + 2)
    for r in range(1, RELIABLE + 1):
        ratio = (r + 1) * of[r] / (r * of[r - 1]) if of[r - 1] else 0.0
        good = (ratio - last) / (1 - last) if last < 1 else 0.0
        d[r] = good if 0 < good < 1 else (r - min(plain, 0.999)) / r
    d[RELIABLE + 1] = 1 - 1 / (n + 1)
    return d


def _mass(d: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return d[np.minimum(counts, RELIABLE + 1)] * counts


BLOCKS = "block long, n_tokens long, doc_ids binary, named binary, held binary, lengths binary, tokens binary, vocabulary binary"


def blocks(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Texts to blocks: the words as places in the block's sorted vocabulary of hashes."""
    held = F.coalesce(crc_of_id(folds) == held_out, F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, size = TaskContext.get().partitionId() << 24, 0
        ids, marks, found = [], [], []

        def closed():
            vocabulary, place = np.unique(np.concatenate([np.array([END, START], np.uint64), *found]), return_inverse=True)
            doc_ids = np.array([0 if i is None else i for i in ids], np.int64)
            made = [
                block, size + len(ids), _packed(doc_ids), _packed(np.array([i is not None for i in ids], np.uint8)), _packed(np.array(marks, np.uint8)),
                _packed(np.array(list(map(len, found)), np.int64)), _packed(place[2:].astype(np.uint32)), _steps(vocabulary),
            ]
            kinds = [pa.int64(), pa.int64(), *[pa.binary()] * 6]
            return pa.RecordBatch.from_arrays([pa.array([m], k) for m, k in zip(made, kinds, strict=True)], names=[c.split()[0] for c in BLOCKS.split(", ")])

        for batch in batches:
            for doc, raw, mark in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(np.array(_HASHES.all_of(words(raw)), np.uint64))
                ids.append(doc), marks.append(mark)
                size += len(found[-1])
                if size >= BLOCK_TOKENS:
                    yield closed()
                    block, size = block + 1, 0
                    ids, marks, found = [], [], []
        if ids:
            yield closed()

    return id_and_text(docs).select("doc_id", "text", held.alias("held")).mapInArrow(run, BLOCKS)


class Block:
    """A block read again, with its distinct pairs in the order of their keys."""

    def __init__(self, row: dict):
        self.ids, self.named, self.held = _unpacked(row["doc_ids"], np.int64), _unpacked(row["named"], np.uint8), _unpacked(row["held"], np.uint8).astype(bool)
        self.words, lengths, tokens = _keys(row["vocabulary"]), _unpacked(row["lengths"], np.int64), _unpacked(row["tokens"], np.uint32)
        self.end, self.start = np.searchsorted(self.words, np.array([END, START], np.uint64))
        ends = np.cumsum(lengths)
        self.word = np.insert(tokens, ends, self.end).astype(np.int32)
        self.doc = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths + 1)
        both = np.insert(tokens, ends - lengths, self.start).astype(np.int64)
        both *= len(self.words)
        both += self.word
        pairs, place = np.unique(both, return_inverse=True)
        del both
        v, w = (x.astype(np.int32) for x in np.divmod(pairs, len(self.words)))
        del pairs
        keys = _pair_key(self.words[v], self.words[w])
        order = np.argsort(keys, kind="stable")
        self.keys, self.v, self.w = keys[order], v[order], w[order]
        back = np.empty(len(order), np.int32)
        back[order] = np.arange(len(order), dtype=np.int32)
        self.pair = back[place]
        self.learnt = ~self.held[self.doc]

    def training_counts(self) -> tuple[np.ndarray, np.ndarray]:
        count = lambda of, n: np.bincount(of[self.learnt], minlength=n)
        return count(self.word, len(self.words)), count(self.pair, len(self.keys))


def _by_range(keys: np.ndarray, bits: int) -> Iterator[tuple[int, slice]]:
    """The ranges of sorted keys that have entries."""
    if not len(keys):
        return
    of = (keys >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
    firsts = np.flatnonzero(np.diff(of, prepend=-1))
    for first, last in zip(firsts, [*firsts[1:], len(keys)], strict=True):
        yield int(of[first]), slice(first, last)


def _table(rows: list[tuple], fields: list[tuple[str, pa.DataType]]) -> pa.Table:
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.table([pa.array(c, k) for c, (_, k) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _ask(bits: int):
    fields = [("block", pa.int64()), ("level", pa.int32()), ("range", pa.int64()), ("keys", pa.binary()), ("counts", pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                block = Block(row)
                rows = []
                for level, (keys, counts) in enumerate(zip((block.words, block.keys), block.training_counts(), strict=True), 1):
                    rows += [(row["block"], level, part, _steps(keys[cut]), _packed(counts[cut].astype(np.uint32))) for part, cut in _by_range(keys, bits)]
                yield from _table(rows, fields).to_batches()

    return run, "block long, level int, range long, keys binary, counts binary"


ANSWER = [("block", pa.int64()), ("level", pa.int32()), ("range", pa.int64()), ("counts", pa.binary()), ("own", pa.binary()), ("stats", pa.list_(pa.int64()))]


def _answer(asked: pa.Table) -> pa.Table:
    """Add up one range: to each block the counts over all, and which entries are its own to add up; and the range's statistics."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["block"])
    keys = [_keys(r["keys"]) for r in rows]
    every, first, place = np.unique(np.concatenate(keys), return_index=True, return_inverse=True)
    counts = np.bincount(place, np.concatenate([_unpacked(r["counts"], np.uint32) for r in rows]), len(every)).astype(np.int64)
    own = np.zeros(len(place), np.uint8)
    own[first] = 1
    stats = [int(counts.sum()), int((counts > 0).sum()), *np.bincount(np.minimum(counts, RELIABLE + 2), minlength=RELIABLE + 3)[1 : RELIABLE + 2].tolist()]
    at, out = 0, []
    for r, k in zip(rows, keys, strict=True):
        cut = slice(at, at + len(k))
        out.append((r["block"], r["level"], r["range"], _packed(counts[place[cut]]), _packed(own[cut]), None))
        at += len(k)
    return _table([*out, (None, rows[0]["level"], rows[0]["range"], None, None, stats)], ANSWER)


STATE = [
    ("block", pa.int64()), ("range", pa.int64()), ("keys", pa.binary()), ("taken", pa.binary()), ("known", pa.binary()), ("wanted", pa.binary()),
    ("docs", pa.binary()), ("contexts", pa.binary()), ("doc_at", pa.binary()), ("context_at", pa.binary()),
]
STATE_SQL = "block long, range long, keys binary, taken binary, known binary, wanted binary, docs binary, contexts binary, doc_at binary, context_at binary"


def _score(stats: dict[int, list[int]], bits: int):
    """All of a block's scores but the factors a(v), and what its own pairs take away after each v."""
    n, distinct = stats[1][0], stats[1][1]
    d1, d2 = discounts(np.array(stats[1][2:], float), n), discounts(np.array(stats[2][2:], float), n)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        block, got = Block(row), {1: [], 2: []}
        for r in sorted(right.to_pylist(), key=lambda r: r["range"]):
            got[r["level"]].append(r)
        seen, pairs = (np.concatenate([_unpacked(r["counts"], np.int64) for r in got[level]]) for level in (1, 2))
        own = np.concatenate([_unpacked(r["own"], np.uint8) for r in got[2]]).astype(bool)
        p = _mass(d1, seen) / max(n, 1)
        p[seen == 0] = stats[0][0] / max(n, 1) if n else 1.0
        context = seen.copy()
        context[block.start] = seen[block.end]  # every training text begins and ends once
        after = context[block.v]
        with np.errstate(divide="ignore", invalid="ignore"):
            log_p = np.log10(p)
            score = np.where(pairs > 0, np.log10(_mass(d2, pairs) / after), log_p[block.w])
        back = (pairs == 0) & (after > 0)
        documents = len(block.ids)
        add = lambda values: np.bincount(block.doc, values, documents)
        base = np.log10((seen + 1) / (n + distinct + 1))
        done = np.stack([block.ids.view(np.float64), block.named, block.held, add(np.ones(len(block.doc))), add(seen[block.word] > 0), add(base[block.word]), add(score[block.pair])])
        # the factors that are still missing: how often each document needs each context
        missing = np.flatnonzero(back[block.pair])
        need, times = np.unique(block.doc[missing].astype(np.int64) * len(block.words) + block.v[block.pair[missing]], return_counts=True)
        doc_at, context_at = np.divmod(need, len(block.words))
        mine = own & (pairs > 0)
        taken, known = (np.bincount(block.v[mine], x[mine], len(block.words)) for x in (_mass(d2, pairs), p[block.w]))
        wanted = np.zeros(len(block.words), np.uint8)
        wanted[context_at] = 1
        ask = np.flatnonzero((taken > 0) | (wanted > 0))
        place = np.cumsum(wanted) - 1
        rows = [
            (row["block"], part, _steps(block.words[s]), _packed(taken[s]), _packed(known[s]), _packed(wanted[s]), None, None, None, None)
            for part, cut in _by_range(block.words[ask], bits)
            for s in [ask[cut]]
        ]
        rows.append((row["block"], -1, None, None, None, None, _packed(done.ravel()), _packed(context[wanted > 0]), _packed(doc_at.astype(np.uint32)), _packed(np.stack([place[context_at], times]).astype(np.uint32).ravel())))
        return _table(rows, STATE)

    return run


FACTOR = [("block", pa.int64()), ("range", pa.int64()), ("taken", pa.binary()), ("known", pa.binary())]


def _sum_contexts(asked: pa.Table) -> pa.Table:
    """Add up one range of contexts and answer the blocks that need some of them."""
    rows = sorted(asked.to_pylist(), key=lambda r: r["block"])
    keys = [_keys(r["keys"]) for r in rows]
    every, place = np.unique(np.concatenate(keys), return_inverse=True)
    taken, known = (np.bincount(place, np.concatenate([_unpacked(r[x], np.float64) for r in rows]), len(every)) for x in ("taken", "known"))
    at, out = 0, []
    for r, k in zip(rows, keys, strict=True):
        wanted = place[at : at + len(k)][_unpacked(r["wanted"], np.uint8) > 0]
        at += len(k)
        if len(wanted):
            out.append((r["block"], r["range"], _packed(taken[wanted]), _packed(known[wanted])))
    return _table(out, FACTOR)


RESULT = [("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
RESULT_SQL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _complete(n: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        done = _unpacked(row["docs"], np.float64).reshape(7, -1)
        got = sorted(right.to_pylist(), key=lambda r: r["range"])
        score = done[6].copy()
        if got:
            taken, known = (np.concatenate([_unpacked(r[x], np.float64) for r in got]) for x in ("taken", "known"))
            factor = np.log10((1 - taken / _unpacked(row["contexts"], np.int64)) / (1 - known))
            place, times = _unpacked(row["context_at"], np.uint32).reshape(2, -1)
            score += np.bincount(_unpacked(row["doc_at"], np.uint32), factor[place] * times, len(score))
        ids = pa.array(done[0].view(np.int64), pa.int64(), mask=done[1] == 0)
        columns = [ids, pa.array(done[2] > 0), *(pa.array(done[i].astype(np.int64)) for i in (3, 4)), pa.array(np.full(len(score), n, np.int64)), pa.array(done[5]), pa.array(score)]
        return pa.table(columns, names=[f for f, _ in RESULT])

    return run


def _stored(df: DataFrame, name: str) -> DataFrame:
    to = scratch_dir(df.sparkSession, name)
    df.write.parquet(to)
    return df.sparkSession.read.schema(df.schema).parquet(to)


def score(docs: DataFrame, folds: int = FOLDS, held_out: int = HELD_OUT) -> DataFrame:
    """Learn from the texts outside the held-out fold and score all: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    A null or empty text is its end token alone. A row without a doc_id is in no held-out fold. Repeated rows count and are scored
    as often as they are there. Without training texts every token is unknown, with probability 1. An empty table gives no rows.
    """
    cut = _stored(blocks(docs, folds, held_out), "katz-blocks")
    tokens = cut.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    bits = max(0, int(tokens // RANGE_ENTRIES)).bit_length()
    ask, schema = _ask(bits)
    answer_sql = "block long, level int, range long, counts binary, own binary, stats array<long>"
    answers = _stored(cut.mapInArrow(ask, schema).groupBy("level", "range").applyInArrow(_answer, answer_sql), "katz-counts")
    summed = [F.sum(F.get("stats", F.lit(i))).alias(f"s{i}") for i in range(RELIABLE + 3)]
    stats = {r["level"]: [int(x or 0) for x in r[1:]] for r in answers.where("block IS NULL").groupBy("level").agg(*summed).collect()}
    for level in (1, 2):
        stats.setdefault(level, [0] * (RELIABLE + 3))
    stats[0] = [_left_over(stats[1])]
    counts = answers.where("block IS NOT NULL").select("block", "level", "range", "counts", "own")
    state = _stored(cut.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_score(stats, bits), STATE_SQL), "katz-contexts")
    asked = state.where("range >= 0").select("block", "range", "keys", "taken", "known", "wanted")
    factors = asked.groupBy("range").applyInArrow(_sum_contexts, "block long, range long, taken binary, known binary")
    rest = state.where("range < 0").select("block", "docs", "contexts", "doc_at", "context_at")
    return rest.groupBy("block").cogroup(factors.groupBy("block")).applyInArrow(_complete(stats[1][0]), RESULT_SQL)


def _left_over(stats: list[int]) -> float:
    """Training tokens' worth of mass that the discounts of words leave to all unknown words."""
    n, of = stats[0], np.array(stats[2:], float)
    d = discounts(of, n)
    counts = np.arange(1, RELIABLE + 1)
    rare = of[:RELIABLE] * counts
    return float(((1 - d[1 : RELIABLE + 1]) * rare).sum() + (n - rare.sum()) / (n + 1))
