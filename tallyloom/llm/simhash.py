"""Near-duplicates by 64-bit SimHash of 3-word shingles, through an inverted index over positional bytes.

Two fingerprints that differ in at most two bits share at least six of their eight bytes at the same place. The index has a
posting list for each choice of six places and the bytes there: a pair that shares m positional bytes meets in C(m, 6) of the 28
lists, so a pair that meets at all has reached the guaranteed number of matches, and only then its bits are compared. (Lists of
single bytes, tallied per pair, would hold 1/256 of all rows each; counting pairs there grows with the square of the input.)
A list holds at most 65,536 fingerprints, because only two bytes are left free. Only distinct fingerprints enter the index.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from tallyloom.llm.common import bounded_batches, id_and_text, per_text, words
from tallyloom.llm.components import components
from tallyloom.session import cut_lineage

SHINGLE, SEED, DISTANCE = 3, 42, 2
KEPT_BYTES = 8 - DISTANCE
MASKS = np.array([sum(0xFF << 8 * place for place in places) for places in combinations(range(8), KEPT_BYTES)], np.uint64)
FLIPS = np.array([0, *(1 << i for i in range(16)), *(1 << i | 1 << j for i, j in combinations(range(16), 2))], np.int64)
CHUNK = 1 << 16
DENSE = 64


def fingerprint(raw: bytes, size: int = SHINGLE, seed: int = SEED) -> int:
    """A bit is set if it is set in over half of the shingles' hashes; without words 0, with too few the whole sequence counts."""
    found = words(raw)
    if not found:
        return 0
    shingles = map(b" ".join, zip(*(found[i:] for i in range(size)), strict=False)) if len(found) >= size else [b" ".join(found)]
    n = max(1, len(found) - size + 1)
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for at in range(0, n, CHUNK):
        ones += np.unpackbits(hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """Documents to (doc_id, fp): the fingerprint as a signed 64-bit integer."""
    return per_text(id_and_text(docs), lambda texts: {"fp": list(map(fingerprint, texts))}, pa.schema([("fp", pa.int64())]), "fp long")


def hex_digits(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _pairs(starts: np.ndarray, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i, j) inside the lists that begin at ``starts`` whose fingerprints differ in at most DISTANCE bits."""
    sizes = np.diff(np.r_[starts, len(fp)])
    small = np.repeat(np.where(sizes <= DENSE, sizes, 1), sizes)
    first = np.repeat(starts, sizes)
    rank = np.arange(len(fp)) - first
    for step in range(1, int(small.max(initial=1))):
        i = np.flatnonzero(rank + step < small)
        near = np.bitwise_count(fp[i] ^ fp[i + step]) <= DISTANCE
        yield i[near], i[near] + step
    for start, size in zip(starts[sizes > DENSE], sizes[sizes > DENSE], strict=True):
        yield from _dense(start, fp[start : start + size])


def _dense(start: int, fp: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """A long list: its fingerprints differ in two bytes only, so each looks up its 137 neighbours in a table of 65,536 places."""
    free = np.flatnonzero((fp[:, None] ^ fp[0]).view(np.uint8).any(0)) if len(fp) else []
    free = np.r_[free, np.setdiff1d(np.arange(8), free)][:2]
    data = fp.view(np.uint8).reshape(-1, 8)
    rest = data[:, free[0]].astype(np.int64) | data[:, free[1]].astype(np.int64) << 8
    place = np.full(1 << 16, -1)
    place[rest] = np.arange(len(fp))
    for flip in FLIPS[1:]:
        j = place[rest ^ flip]
        i = np.flatnonzero(j > np.arange(len(fp)))
        yield start + i, start + j[i]


def _linked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (place, key, fp) sorted by the first two, to linked pairs; a pair is told by the first choice of places that it shares."""
    held: list[np.ndarray] = []

    def told(place, key, fp):
        starts = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (key[1:] != key[:-1])])
        for i, j in _pairs(starts, fp):
            differ = fp[i] ^ fp[j]
            first = np.argmax((differ[:, None] & MASKS) == 0, axis=1) if len(i) else i
            i, j = i[first == place[i]], j[first == place[i]]
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(fp[i].view(np.int64)), pa.array(fp[j].view(np.int64))], names=["a", "b"])

    for batch in batches:
        now = [batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64), batch.column(2).to_numpy(zero_copy_only=False).view(np.uint64)]
        if held:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        last = np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))
        cut = last[-1] + 1 if len(last) else 0
        held = [x[cut:] for x in now]
        if cut:
            yield from told(*(x[:cut] for x in now))
    if held:
        yield from told(*held)


def links(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to linked pairs (a, b)."""
    places = F.array(*(F.struct(F.lit(i).alias("place"), F.col("fp").bitwiseAND(F.lit(int(m.view(np.int64)))).alias("key")) for i, m in enumerate(MASKS)))
    index = distinct.select("fp", F.explode(places).alias("k")).select("k.place", "k.key", "fp")
    dealt = index.repartition("place", "key").sortWithinPartitions("place", "key")
    return dealt.mapInArrow(_linked, "a long, b long")


def with_fingerprint(docs: DataFrame, name: str) -> DataFrame:
    """The same rows and columns, and the fingerprint of ``text`` as column ``name``; a null text is the empty one."""
    bounded_batches(docs.sparkSession)
    at, names = docs.columns.index("text"), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fps = pa.array([fingerprint(t or b"") for t in batch.column(at).cast(pa.binary()).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, fps], names=names)

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(name, LongType())]))


def groups(distinct: DataFrame) -> DataFrame:
    """Distinct fingerprints (fp) to (fp, root): those that chains of links connect have one root."""
    roots = components(links(distinct))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("root", "fp").alias("root"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Documents to (doc_id, fp, component_id): component_id is the least doc_id that chains of links reach, itself included.

    Null and empty texts have the fingerprint 0 and are linked like any other; repeated rows all stay; rows without a doc_id
    take part, and their component has the least id of the others (null if there is none). An empty table gives no rows.
    """
    marked = cut_lineage(fingerprints(docs))
    classes = cut_lineage(marked.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(classes.select("fp")))
    grouped = classes.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    least = grouped.groupBy("root").agg(F.min("first").alias("component_id"))
    of = grouped.join(least, "root").select("fp", "component_id")
    return marked.join(of, "fp", "left").select("doc_id", "fp", "component_id")
