"""Packing by power-of-two decomposition: a document's tokens are cut into pieces of binary lengths, and equal lengths are bucketed.

A document of n tokens gives n div 2048 pieces of 2048 and one piece for each bit of the rest, longest first. Each piece is a
sequence of its own, so no sequence crosses documents and none needs padding; a batch takes sequences of one length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from struct import pack as pack_ints
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyloom.llm.common import id_and_text
from tallyloom.llm.wordbpe import Memo, public_path, vocabulary
from tallyloom.session import cut_lineage

LIMIT = 2048
END = 1
KNOWN_WORDS = 250_000

#: Bytes of chunks that a worker remembers, in each of two generations
MEMO_BYTES = 80 << 20
_MEMOS: dict[tuple[str, int], Memo] = {}


def library_memo(path: str, room: int = MEMO_BYTES) -> Memo:
    """Ids of chunks as little-endian 32-bit integers, remembered per worker; each word goes through the library's merges once."""
    if (path, room) not in _MEMOS:
        words = vocabulary(path)
        merges = words.rules.model
        char = {b: c for c, b in words.byte.items()}
        known: dict[str, bytes] = {}

        def ids_of(word: int | str) -> bytes:
            found = known.get(word)
            if found is None:
                if isinstance(word, int):
                    ids = [word]
                else:  # printable ASCII stands for itself in the vocabulary's alphabet
                    ids = [t.id for t in merges.tokenize(word if word.isascii() and word.isprintable() else word.translate(char))]
                found = known[word] = pack_ints(f"<{len(ids)}I", *ids)
            return found

        def make(chunks: list[bytes]) -> list[bytes]:
            if len(known) >= KNOWN_WORDS:
                known.clear()
            return [b"".join(map(ids_of, part)) for part in words.pretokens(chunks, mark=False)]

        _MEMOS[path, room] = Memo(make, room=room)
    return _MEMOS[path, room]


def binary_lengths(n: int, limit: int = LIMIT) -> list[int]:
    """Pieces of ``limit``, a power of two, then the powers of two of the rest, longest first."""
    return [limit] * (n // limit) + [1 << bit for bit in range(limit.bit_length() - 2, -1, -1) if n % limit >> bit & 1]


def pack(docs: DataFrame, limit: int = LIMIT, path: str | None = None, with_ids: bool = False, memo_bytes: int = MEMO_BYTES) -> DataFrame:
    """Documents to one row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    Sequences are numbered from 0 without a gap, the longest first, so that those of one length are neighbours. Every document ends
    with the id 1, hence a null or empty text is one piece of length 1. Repeated rows and rows without a doc_id are packed like
    others; an empty table gives no rows. The pieces are written to the shared checkpoint folder before they are numbered, so that
    the numbers stay the same if an executor is lost.
    """
    path = path or public_path()
    end = np.array([END], "<u4").tobytes()
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "task", "slot"] + ["ids"] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, task, slots = library_memo(path, memo_bytes), TaskContext.get().partitionId(), Counter()
        for batch in batches:
            rows: list[tuple] = []
            ids: list = []
            for doc, raw in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist(), strict=True):
                whole = b"".join(memo.all_of(raw.split())) + end
                n, at = len(whole) // 4, 0
                for size in binary_lengths(n, limit):
                    piece = whole[4 * at : 4 * (at + size)]
                    rows.append((doc, at, size, crc32(piece), n, task, slots[size]))
                    if with_ids:
                        ids.append(np.frombuffer(piece, "<u4").astype(np.int32))
                    slots[size] += 1
                    at += size
            columns = [pa.array(c, pa.int64()) for c in (zip(*rows, strict=True) if rows else [[]] * 7)]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(ids, pa.list_(pa.int32()))] * with_ids, names=names)

    schema = ", ".join(f"{n} long" for n in names[:7]) + ", ids array<int>" * with_ids
    pieces = cut_lineage(id_and_text(docs).mapInArrow(cut, schema))
    counts = pieces.groupBy("length", "task").agg(F.count("*").alias("n"))  # a row per length and task
    before = F.sum("n").over(Window.partitionBy("length").orderBy("task")) - F.col("n")
    lengths = counts.groupBy("length").agg(F.sum("n").alias("all"))  # a row per length, twelve at most
    base = lengths.select("length", (F.sum("all").over(Window.orderBy(F.desc("length"))) - F.col("all")).alias("base"))
    first = counts.select("length", "task", before.alias("before")).join(base, "length").select("length", "task", (F.col("base") + F.col("before")).alias("first"))
    numbered = pieces.join(first, ["length", "task"])
    return numbered.select(*names[:5], (F.col("first") + F.col("slot")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), *names[7:])
