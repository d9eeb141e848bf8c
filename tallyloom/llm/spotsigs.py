"""SpotSigs fingerprints: chains of content words that follow common-word anchors, compared as sets by pruned Jaccard.

A signature is an anchor and the next CHAIN words that are no anchors. A text's fingerprint is its set of signatures, hashed to 32
bits. Sets of sizes m <= n have a likeness of m / n at most, so sets are partitioned by size and compared with their neighbours only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tallyloom.llm.common import bounded_batches, id_and_text, per_text
from tallyloom.llm.wordbpe import Memo
from tallyloom.session import cut_lineage, spread

CHAIN, GAP = 2, 12
#: Common words of the four languages, after which chains begin.
ANCHORS = frozenset(
    "the a an and or but of to in on at by for with from is are was were be been it its that this as not he she they we you i "
    "der die das den dem des ein eine einen und oder aber von zu im mit auf für ist sind war sich nicht es er sie wir ihr "
    "le la les un une des et ou mais de du dans par pour avec sur est sont était ne pas que qui il elle nous vous "
    "el los las una y o pero del en con por para se es son fue no lo al su".split()
)
MARKS = ".,;:!?\"'()[]{}<>|*#%&$-_/«»„“”…"
ROWS_PER_RANGE = 4000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))


def _word_codes(words: list[bytes]) -> list[int]:
    """A word's hash, odd for anchors and even for content words; 0 for a run of marks only."""
    out = []
    for word in words:
        plain = word.decode().lower().strip(MARKS)
        out.append(xxhash.xxh64_intdigest(plain) >> 1 << 1 | (plain in ANCHORS) if plain else 0)
    return out


_MEMO = Memo(_word_codes, 200_000)


def _mixed(*parts: np.ndarray) -> np.ndarray:
    total = np.zeros(len(parts[0]), np.uint64)
    for part in parts:
        total = (total ^ part) * MIX[0]
        total ^= total >> np.uint64(29)
        total *= MIX[1]
    return (total >> np.uint64(32)).astype(np.uint32)


def signatures(raw: bytes) -> np.ndarray:
    """The sorted set of a text's signatures.

    Where the GAP words before hold no anchor (or the text has had none yet), each word stands in for one, so that lists and
    shouting are covered too. A text without any whole chain has the runs of CHAIN + 1 words over all its words, or its whole sequence if
    it has fewer; one without words has the empty set.
    """
    codes = np.fromiter(_MEMO.all_of(raw.split()), np.uint64)
    codes = codes[codes != 0]
    if not len(codes):
        return np.zeros(0, np.uint32)
    anchor = (codes & np.uint64(1)).astype(bool)
    at = np.arange(len(codes))
    content = codes[~anchor]
    begins = at - np.maximum.accumulate(np.where(anchor, at, -GAP - 1)) > GAP
    begins |= anchor
    follow = np.cumsum(~anchor)[begins]  # content words up to here, which is where the chain goes on
    whole = follow + CHAIN <= len(content)
    found, follow = codes[begins][whole], follow[whole]
    if len(found):
        return np.unique(_mixed(found, *(content[follow + i] for i in range(CHAIN))))
    runs = max(1, len(codes) - CHAIN)
    return np.unique(_mixed(*(codes[i : i + runs] for i in range(min(len(codes), CHAIN + 1)))))


def likeness(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard of two sorted sets; 0 if their sizes alone keep it under ``least``. Two empty sets are alike."""
    few, many = sorted((len(a), len(b)))
    if not many:
        return 1.0
    if few < least * many:
        return 0.0
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared / (few + many - shared)


def spelt(found: np.ndarray) -> str:
    return found.astype(">u4").tobytes().hex()


def fingerprints(docs: DataFrame) -> DataFrame:
    """Documents to (doc_id, signatures array<long>), sorted. A null or empty text has none; repeated rows all stay."""
    work = lambda texts: {"signatures": [signatures(t).astype(np.int64) for t in texts]}
    return per_text(id_and_text(docs), work, pa.schema([("signatures", pa.list_(pa.int64()))]), "signatures array<long>")


def near_pairs(docs: DataFrame, least: float = 0.8) -> tuple[DataFrame, DataFrame]:
    """Similar sets: (classes, pairs). classes: doc_id, class_id (rows of one set); pairs: a, b, likeness of class ids, a < b.

    A pair of likeness ``least`` shares a signature among the first n - ceil(least n) + 1 of each set, in one order of all signatures:
    rarest first. Those are the index; it is joined with itself partition by partition of set sizes, in which a set meets sets of
    its own and the next partition only. Candidates are cut by the bound on sizes before the sets are compared.
    """
    marked = fingerprints(docs).withColumn("set", F.xxhash64("signatures"))
    marked = cut_lineage(marked)
    classes = marked.groupBy("set").agg(F.min("doc_id").alias("class_id"), F.first("signatures").alias("signatures"), F.size(F.first("signatures")).alias("n"))
    classes = cut_lineage(classes.where("n > 0"))
    each = classes.select("set", "n", F.explode("signatures").alias("s"))
    often = each.groupBy("s").agg(F.count("*").alias("often"))
    rank = F.row_number().over(Window.partitionBy("set").orderBy("often", "s"))
    prefix = each.join(often, "s").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * least - 1e-9) + 1)
    part = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / least)) + 1e-9)
    index = prefix.where("often > 1").select("set", "n", "s", part.alias("part"))
    left = index.select(F.col("set").alias("a"), F.col("n").alias("an"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    right = index.select(F.col("set").alias("b"), F.col("n").alias("bn"), "s", "part")
    met = left.join(right, ["s", "part"]).where("(an < bn OR (an = bn AND a < b))").where(F.col("an") >= F.col("bn") * least - 1e-9)
    sets = classes.select("set", "class_id", "signatures")
    pairs = met.select("a", "b").distinct().join(sets.toDF("a", "ca", "sa"), "a").join(sets.toDF("b", "cb", "sb"), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    alike = shared / (F.size("sa") + F.size("sb") - shared)
    found = pairs.select(F.least("ca", "cb").alias("a"), F.greatest("ca", "cb").alias("b"), alike.alias("likeness")).where(F.col("likeness") >= least - 1e-12)
    return marked.join(classes.select("set", "class_id"), "set", "left").select("doc_id", "class_id"), found


def _ranges(docs: DataFrame) -> np.ndarray:
    """The first doc_id of each range; ranges have about equally many rows."""
    got = docs.agg(F.count("doc_id").alias("n"), F.min("doc_id").alias("least")).first()
    if not got["n"]:
        return np.zeros(0, np.int64)
    pieces = max(spread(docs.sparkSession), -(-got["n"] // ROWS_PER_RANGE))
    cuts = docs.agg(F.percentile_approx("doc_id", [i / pieces for i in range(pieces)], max(10_000, 20 * pieces)).alias("q")).first()["q"]
    return np.unique(np.array([got["least"], *cuts], np.int64))


def _row(doc, text: str, own: np.ndarray, next_text: str, other: np.ndarray) -> tuple:
    n = len(text)
    edited = text[: n - n // 2] + next_text[: n // 2]
    raw = edited.encode()
    found = signatures(raw)
    return doc, n, hashlib.sha256(raw).hexdigest(), spelt(own), spelt(found), likeness(own, found), likeness(own, other)


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
SQL = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
FLUSH_ROWS = 256


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * 7, TYPES, strict=True)], names=NAMES)


def compare_with_next(docs: DataFrame) -> DataFrame:
    """Each document beside its edited text (its last half replaced by the first half of the next document) and the next document.

    Next: by ascending doc_id; after the last comes the first. The table is dealt once, into ranges of doc_id; the first document of
    a range is sent to the range before as well. Rows of one doc_id follow each other by text. A row without a doc_id has no place
    in that order, and the empty text is its next. A null text is the empty one; an empty table gives no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = id_and_text(docs)
    firsts = _ranges(rows.select("doc_id"))

    @pandas_udf("array<int>")
    def places(ids):
        import pandas as pd

        at = np.searchsorted(firsts, ids.to_numpy(), "right") - 1
        heads = firsts[at] == ids.to_numpy()
        return pd.Series([[p, -1 - (p - 1) % len(firsts)] if h else [p] for p, h in zip(at.tolist(), heads.tolist(), strict=True)])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, None, []
        for batch in batches:
            for doc, text, place, copy in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if copy and held is None:
                    continue
                own = signatures(text.encode())
                if held is not None and place == now:
                    out.append(_row(*held, text, own))
                now, held = place, None if copy else (doc, text, own)
                if len(out) >= FLUSH_ROWS:
                    yield _batch(out)
                    out = []
        yield _batch(out)

    def alone(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.zeros(0, np.uint32)
        for batch in batches:
            yield _batch([_row(None, t, signatures(t.encode()), "", none) for t in batch.column(1).to_pylist()])

    unplaced = rows.where("doc_id IS NULL").mapInArrow(alone, SQL)
    if not len(firsts):
        return unplaced
    dealt = rows.where("doc_id IS NOT NULL").select("doc_id", "text", F.explode(places("doc_id")).alias("p"))
    dealt = dealt.select("doc_id", "text", F.when(F.col("p") < 0, -1 - F.col("p")).otherwise(F.col("p")).alias("place"), (F.col("p") < 0).alias("copy"))
    ordered = dealt.repartitionById(len(firsts), F.col("place")).sortWithinPartitions("place", "copy", "doc_id", "text")
    return ordered.mapInArrow(pairs, SQL).unionByName(unplaced)
