"""A linear-chain conditional random field that tags toxic spans, and document scores from its forward-backward marginals.

Words are tagged clean or toxic. A word's own potential is a sum of hashed weights of its spelling, beginnings and ending; the
transitions link neighbouring tags. Labels are given for documents only, so that words get theirs in two steps: in toxic
documents, words that are far more frequent there than in clean ones; then also words that the first model tags itself.
All words of clean documents are clean. Groups of near copies count about as one document.

The messages of a two-tag chain are products of 2 x 2 matrices. All texts of a batch form one chain that starts anew at each text;
it is cut into equal blocks, whose products are made side by side, handed from block to block, and spread again inside. So texts of
any length take the same few numpy steps.

A document's score is a logistic function of what its marginals sum up to: evidence, tagged words and the strongest one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from math import exp
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.common import crc_of_id, id_and_text

#: Labelled rows to fit on, at most: those of the smallest hashes of their ids. Only this bounded sample reaches the driver.
SAMPLE_ROWS = 5_000
#: Of a sampled text, at most so many consecutive words are learned from, at a place that its hash decides
SAMPLE_WORDS = 20_000
FOLDS, HELD_OUT = 4, 2
#: A word is tagged from the marginal on, a document from the score on
SPAN_AT, TOXIC_AT = 0.5, 0.3
#: Hashed features; beginnings and ending of a word that are features
BUCKETS, BEGINNINGS, ENDING = 1 << 18, (3, 4, 5, 6, 7, 8), 4
#: How far from chance (log-likelihood ratio) a word's share of toxic documents must be to label it at first
UNLIKELY = 15.0
#: Words whose potentials a worker keeps, and words that it tags together, at least
MEMO_WORDS, CHAIN_WORDS = 400_000, 1 << 20

_EDGE = re.compile(r"^\W+|\W+$")
_WORD = re.compile(r"\S+")


def normal(token: str) -> str:
    """A token without marks at its ends, in lower case."""
    return _EDGE.sub("", token.lower())


_MARKS = tuple((n, crc32(b"%d^" % n)) for n in BEGINNINGS)
_OWN, _END, _ANY = crc32(b"="), crc32(b"$"), crc32(b"word") % BUCKETS


def features(word: str) -> list[int]:
    """The hashed features of a normal word: itself, its beginnings, its ending, and being a word. As many for each; a repeated one is the word's own."""
    raw = word.encode()
    own = crc32(raw, _OWN) % BUCKETS
    size = len(word)
    if size <= BEGINNINGS[0]:
        return [own] * (len(BEGINNINGS) + 2) + [_ANY]
    parts = [crc32(word[:n].encode(), mark) % BUCKETS if size > n else own for n, mark in _MARKS]
    return [own, *parts, crc32(word[-ENDING:].encode(), _END) % BUCKETS if size > ENDING else own, _ANY]


def chain(x: np.ndarray, opens: np.ndarray, step: np.ndarray, start: np.ndarray) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray], np.ndarray, np.ndarray]:
    """Forward-backward over texts that lie end to end.

    ``x`` is the odds of each word by itself, ``opens`` marks first words, ``step`` the 2 x 2 transitions, ``start`` the weights
    of the first tag. Gives the messages (for either tag) of forward and backward passes, the logarithm of what each word
    multiplies the total by, and the marginal of the toxic tag.
    """
    n = len(x)
    if not n:
        return (x, x), (x, x), x, x
    size = max(1, int(np.sqrt(n)))
    blocks = -(-n // size)
    pad = size * blocks - n
    odds = np.concatenate([x, np.ones(pad)]).reshape(blocks, size).T.copy()
    first = np.concatenate([opens, np.ones(pad, bool)]).reshape(blocks, size).T.copy()
    moves = [[np.where(first, start[b], step[a, b]) * (odds if b else 1.0) for b in (0, 1)] for a in (0, 1)]
    (m00, m01), (m10, m11) = moves
    p00, p01, p10, p11 = np.ones(blocks), np.zeros(blocks), np.zeros(blocks), np.ones(blocks)
    for t in range(size):
        p00, p01 = p00 * m00[t] + p01 * m10[t], p00 * m01[t] + p01 * m11[t]
        p10, p11 = p10 * m00[t] + p11 * m10[t], p10 * m01[t] + p11 * m11[t]
        total = p00 + p01 + p10 + p11
        p00, p01, p10, p11 = p00 / total, p01 / total, p10 / total, p11 / total
    enter, leave = np.zeros((blocks, 2)), np.ones((blocks, 2))
    a0, a1 = 1.0, 0.0
    for b, (q00, q01, q10, q11) in enumerate(zip(p00.tolist(), p01.tolist(), p10.tolist(), p11.tolist())):
        enter[b] = a0, a1
        a0, a1 = a0 * q00 + a1 * q10, a0 * q01 + a1 * q11
        a0, a1 = a0 / (a0 + a1), a1 / (a0 + a1)
    c0, c1 = 1.0, 1.0
    for b in range(blocks - 1, -1, -1):
        leave[b] = c0, c1
        c0, c1 = p00[b] * c0 + p01[b] * c1, p10[b] * c0 + p11[b] * c1
        c0, c1 = c0 / (c0 + c1), c1 / (c0 + c1)
    f0, f1, g0, g1 = (np.empty((size, blocks)) for _ in range(4))
    logs = np.empty((size, blocks))
    u, v = enter[:, 0], enter[:, 1]
    for t in range(size):
        u, v = u * m00[t] + v * m10[t], u * m01[t] + v * m11[t]
        total = u + v
        u, v = u / total, v / total
        f0[t], f1[t], logs[t] = u, v, total
    u, v = leave[:, 0], leave[:, 1]
    for t in range(size - 1, -1, -1):
        g0[t], g1[t] = u, v
        u, v = m00[t] * u + m01[t] * v, m10[t] * u + m11[t] * v
        total = u + v
        u, v = u / total, v / total
    flat = lambda m: m.T.reshape(-1)[:n]
    forward, backward = (flat(f0), flat(f1)), (flat(g0), flat(g1))
    toxic = forward[1] * backward[1]
    return forward, backward, np.log(flat(logs)), toxic / (toxic + forward[0] * backward[0])


def least(function, x: np.ndarray, rounds: int, memory: int = 6) -> np.ndarray:
    """Limited-memory BFGS: ``function`` gives a value and its gradient."""
    value, slope = function(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        way, kept = slope.copy(), []
        for s, y, rho in reversed(past):
            a = rho * (s @ way)
            way -= a * y
            kept.append(a)
        if past:
            s, y, _ = past[-1]
            way *= (s @ y) / (y @ y)
        for (s, y, rho), a in zip(past, reversed(kept)):
            way += (a - rho * (y @ way)) * s
        length = 1.0 if past else 1.0 / max(1e-9, float(np.abs(slope).max()))
        for _ in range(12):
            to = x - length * way
            new, there = function(to)
            if new <= value - 1e-4 * length * (slope @ way):
                break
            length /= 2
        else:
            break
        s, y = to - x, there - slope
        if s @ y > 1e-10:
            past = [*past[-memory + 1 :], (s, y, 1 / (s @ y))]
        done = value - new < 1e-5 * abs(value)
        x, value, slope = to, new, there
        if done:
            break
    return x


@dataclass
class Field:
    """The weights of hashed features, transitions, and the logistic function of a document's sums."""

    weights: np.ndarray
    step: np.ndarray
    start: np.ndarray
    line: np.ndarray

    def odds(self, words: list[str]) -> np.ndarray:
        if not words:
            return np.ones(0)
        at = np.array([features(w) for w in words])
        return np.exp(np.clip(self.weights[at].sum(1), -30, 30))

    def score(self, sums: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(sums @ self.line, -30, 30)))


def sums_of(marginal: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For texts that begin at ``starts`` (the last entry is the end): one, the logs of evidence, of tagged words and of their share, the strongest."""
    n = np.diff(starts)
    some = n > 0
    out = np.zeros((len(n), 5))
    out[:, 0] = 1
    if some.any():
        at = starts[:-1][some]
        tagged = np.add.reduceat((marginal >= SPAN_AT).astype(float), at)
        out[some, 1] = np.log1p(np.add.reduceat(np.minimum(-np.log1p(-np.minimum(marginal, 1 - 1e-9)), 6.0) * (marginal >= SPAN_AT / 2), at))
        out[some, 2] = np.log1p(tagged)
        out[some, 3] = np.log1p(1000 * tagged / n[some])
        out[some, 4] = np.maximum.reduceat(marginal, at)
    return out


def _weights_of_copies(hashes: np.ndarray, starts: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """One over the number of sampled texts of one label that share the least hash of four neighbouring words: near copies mostly share it."""
    key = np.empty(len(toxic), np.uint64)
    for k, (a, z) in enumerate(zip(starts.tolist(), starts[1:].tolist())):
        mixed, n = hashes[a:z].astype(np.uint64), min(4, z - a)
        whole = np.zeros(z - a - n + 1, np.uint64)
        for i in range(n):
            whole = (whole ^ mixed[i : z - a - n + 1 + i]) * np.uint64(0xD6E8FEB86659FD93)
            whole ^= whole >> np.uint64(32)
        key[k] = whole.min()
    _, group, sizes = np.unique(np.stack([key, toxic.astype(np.uint64)]), axis=1, return_inverse=True, return_counts=True)
    return 1.0 / sizes[group.ravel()]


def _seeds(codes: np.ndarray, owner: np.ndarray, n_words: int, toxic: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Words that are far more frequent in toxic documents than chance allows, by the log-likelihood ratio."""
    pair = np.unique(owner * np.int64(n_words) + codes)
    doc, word = (pair // n_words).astype(np.int32), (pair % n_words).astype(np.int32)
    a = np.bincount(word, weight[doc] * toxic[doc], n_words)
    c = np.bincount(word, weight[doc] * ~toxic[doc], n_words)
    share = (weight * toxic).sum() / weight.sum()
    whole = np.maximum(a + c, 1e-12)
    part = lambda k, p: k * np.log(np.maximum(k, 1e-12) / (whole * p))
    return (a > whole * share) & (2 * (part(a, share) + part(c, 1 - share)) > UNLIKELY)


def fit(words: list[str], codes: np.ndarray, starts: np.ndarray, toxic: np.ndarray, rounds: int = 20, ridge: float = 0.1, chain_words: int = CHAIN_WORDS >> 2) -> Field:
    """The field of labelled texts: ``codes`` (numbers of the normal ``words``) of all of them end to end, beginning at ``starts``; none is empty.

    Without both labels there is nothing to tell apart: the share of toxic texts alone makes the score. Chains of ``chain_words``
    words, or of one text, are held at a time.
    """
    share = (toxic.sum() + 0.5) / (len(toxic) + 1)
    none = Field(np.zeros(BUCKETS), np.array([[1.0, 1e-9], [1.0, 1e-9]]), np.array([1.0, 1e-9]), np.array([np.log(share / (1 - share)), 0, 0, 0, 0]))
    if len(np.unique(toxic)) < 2:
        return none
    n_words = len(words)
    weight = _weights_of_copies(np.fromiter((crc32(w.encode()) for w in words), np.uint32, n_words)[codes], starts, toxic)
    at = np.empty((n_words, len(features(""))), np.int32)
    for i, w in enumerate(words):
        at[i] = features(w)
    used, place = np.unique(at, return_inverse=True)
    columns = [np.ascontiguousarray(c, np.int32) for c in place.reshape(at.shape).T]
    del at, place
    k = len(used)
    owner = np.repeat(np.arange(len(toxic)), np.diff(starts))
    bad = toxic[owner]
    tags = bad & _seeds(codes, owner, n_words, toxic, weight)[codes]
    del owner
    if not tags.any():
        return none
    # texts that are searched together
    cuts, held = [0], 0
    for i, n in enumerate(np.diff(starts).tolist()):
        if held and held + n > chain_words:
            cuts.append(i)
            held = 0
        held += n
    cuts.append(len(toxic))

    def parts():
        """Each group of texts: its words' places, which of them open a text, and the weight of each."""
        for a, z in zip(cuts, cuts[1:]):
            inside = starts[a : z + 1] - starts[a]
            opens = np.zeros(inside[-1], bool)
            opens[inside[:-1]] = True
            yield slice(starts[a], starts[z]), inside, opens, np.repeat(weight[a:z], np.diff(inside))

    def spread(theta):
        own = sum(theta[c] for c in columns)
        step = np.exp(np.array([[0.0, theta[k]], [theta[k + 1], theta[k + 2]]]))
        return own, np.exp(np.clip(own, -30, 30)), step, np.exp(np.array([0.0, theta[k + 3]]))

    def loss(theta):
        own, odds, step, start = spread(theta)
        value, expected, by_word = 0.0, np.zeros(4), np.zeros(n_words)
        for part, _, opens, each in parts():
            x = odds[codes[part]]
            forward, backward, logs, p = chain(x, opens, step, start)
            later = np.flatnonzero(~opens)
            # pair marginals of neighbours in one text
            l0, l1, r0, r1 = forward[0][later - 1], forward[1][later - 1], backward[0][later], x[later] * backward[1][later]
            j01, j10, j11 = l0 * step[0, 1] * r1, l1 * step[1, 0] * r0, l1 * step[1, 1] * r1
            scale = each[later] / (l0 * r0 + j01 + j10 + j11)
            expected += [j01 @ scale, j10 @ scale, j11 @ scale, each[opens] @ p[opens]]
            by_word += np.bincount(codes[part], each * p, n_words)
            value += each @ logs
        by_word -= tagged
        slope = sum(np.bincount(c, by_word, k) for c in columns)
        value -= tagged @ own + seen @ theta[k:] - ridge / 2 * theta @ theta
        return value, np.r_[slope, expected - seen] + ridge * theta

    def count():
        """What the tags hold of each word and of each transition."""
        by_word, pairs = np.zeros(n_words), np.zeros(4)
        for part, _, opens, each in parts():
            later, here = np.flatnonzero(~opens), tags[part]
            old, new, w = here[later - 1], here[later], each[later]
            pairs += [w @ (~old & new), w @ (old & ~new), w @ (old & new), each[opens] @ here[opens]]
            by_word += np.bincount(codes[part], each * here, n_words)
        return by_word, pairs

    tagged, seen = count()
    # the first guess: labelled words are toxic, all others clean
    guess = np.zeros(k + 4)
    guess[np.unique(columns[0][codes[tags]])], guess[columns[-1][0]] = 7.0, -3.0
    theta = least(loss, guess, rounds)
    found = tags.copy()
    _, odds, step, start = spread(theta)
    for part, _, opens, _ in parts():
        found[part] |= bad[part] & (chain(odds[codes[part]], opens, step, start)[3] >= SPAN_AT)
    if (found != tags).any():
        tags = found
        tagged, seen = count()
        theta = least(loss, theta, rounds)
    _, odds, step, start = spread(theta)
    sums = np.concatenate([sums_of(chain(odds[codes[part]], opens, step, start)[3], inside) for part, inside, opens, _ in parts()])
    weights = np.zeros(BUCKETS)
    weights[used] = theta[:k]
    return Field(weights, step, start, logistic(sums, toxic.astype(float), weight))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 25, ridge: float = 0.1) -> np.ndarray:
    """Weighted logistic regression by Newton's steps; the first column is not held down."""
    line = np.zeros(x.shape[1])
    hold = np.diag([1e-6] + [ridge] * (x.shape[1] - 1))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (p - y)) + hold @ line
        curve = (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]).T @ x + hold
        step = np.linalg.solve(curve, slope)
        line -= step * min(1.0, 2.0 / max(1e-9, float(np.abs(step).max())))
    return line


def train(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS, words: int = SAMPLE_WORDS) -> Field:
    """Fit on labelled rows outside the held-out fold, ``rows`` of them at most, ``words`` of each. Rows without an id, words or a label teach nothing."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (crc_of_id(FOLDS) != HELD_OUT))
    chosen = known.select("doc_id", "toxic").orderBy(F.xxhash64("doc_id"), "doc_id", "toxic").limit(rows)
    # the chosen labels are two numbers a row, a few hundred KB at most
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id").distinct()), "doc_id", "left_semi")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [t.split() for t in batch.column(1).to_pylist()]
            at = [crc32(f"{len(t)}".encode()) % max(1, len(t) - words + 1) for t in found]
            found = [list(map(normal, t[a : a + words])) for t, a in zip(found, at)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.string()))], names=["doc_id", "words"])

    split = id_and_text(texts).mapInArrow(cut, "doc_id long, words array<string>").where(F.size("words") > 0)
    got = split.join(F.broadcast(chosen), "doc_id").select("toxic", "words").limit(rows).toArrow()
    lists = got.column("words").combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    coded = lists.flatten().dictionary_encode()
    starts = np.r_[0, np.cumsum(lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64))]
    return fit(coded.dictionary.to_pylist(), coded.indices.to_numpy(), starts, got.column("toxic").to_numpy() == 1)


class _Potentials(dict):
    """Odds of tokens as they are written, made when first met."""

    def __init__(self, field: Field):
        self.weights = field.weights.tolist()

    def __missing__(self, token: str) -> float:
        self[token] = value = exp(min(30.0, max(-30.0, sum([self.weights[i] for i in features(normal(token))]))))
        return value


def _tag(field: Field, memo: _Potentials, texts: list[str]) -> tuple[list[float], list[int], list[list[dict]]]:
    """Score, number of words and toxic spans of each text."""
    if len(memo) > MEMO_WORDS:
        memo.clear()
    split = [t.split() for t in texts]
    starts = np.r_[0, np.cumsum([len(s) for s in split])].astype(np.int64)
    x = np.fromiter((memo[w] for s in split for w in s), float, int(starts[-1]))
    opens = np.zeros(len(x), bool)
    opens[starts[:-1][np.diff(starts) > 0]] = True
    marginal = chain(x, opens, field.step, field.start)[3]
    score = field.score(sums_of(marginal, starts))
    spans: list[list[dict]] = [[] for _ in texts]
    hits = np.flatnonzero(marginal >= SPAN_AT)
    owners = np.searchsorted(starts, hits, "right") - 1
    for k in np.unique(owners).tolist():
        places = [m.span() for m in _WORD.finditer(texts[k])]
        for w in (hits[owners == k] - starts[k]).tolist():
            p, (a, z) = float(marginal[starts[k] + w]), places[w]
            last = spans[k][-1] if spans[k] else None
            if last and last["word"] == w - 1:
                last.update(word=w, end=z, marginal=max(last["marginal"], p))
            else:
                spans[k].append({"word": w, "start": a, "end": z, "marginal": p})
    return score.tolist(), [len(s) for s in split], spans


SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("marginal", pa.float64())])
SCHEMA = "doc_id long, score double, n_words long, spans array<struct<start:long,end:long,marginal:double>>"


def tag(docs: DataFrame, field: Field) -> DataFrame:
    """One row per row of ``docs``: doc_id, score (0 to 1, higher for toxic), n_words and the toxic spans in code points, end exclusive.

    Neighbouring toxic words make one span, whose marginal is the greatest of theirs. A null or empty text has no words and no
    spans, and the score of a text without evidence; repeated rows all stay; an empty table gives no rows. Texts are tagged whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = _Potentials(field)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            at = 0
            while at < len(texts):
                to, held = at, 0
                while to < len(texts) and held < 6 * CHAIN_WORDS:
                    held += len(texts[to])
                    to += 1
                score, n_words, spans = _tag(field, memo, texts[at:to])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, to - at), pa.array(score, pa.float64()), pa.array(n_words, pa.int64()), pa.array([[{k: s[k] for k in ("start", "end", "marginal")} for s in x] for x in spans], pa.list_(SPAN))],
                    names=["doc_id", "score", "n_words", "spans"],
                )
                at = to

    return id_and_text(docs).mapInArrow(run, SCHEMA)
