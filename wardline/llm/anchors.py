"""Repeated windows over a corpus: sampled anchors, candidate fragments, and what is common to both dedup operators.

A window is L consecutive units (words or bytes) of one document. Its anchor is the k-gram with the least hash among the
L-k+1 it holds, leftmost on ties: equal windows have equal anchors at equal offsets, wherever they lie. So

1. documents are dealt into chunks by id; each chunk sends the distinct hashes of its anchors to buckets, and learns
   which of them other chunks have too (counts are combined per chunk, so a hot passage sends one hash per chunk);
2. each chunk settles repeats inside itself and sends, for anchors shared with other chunks, only the first occurrence of
   each of its windows: fragments of text around the anchor, to the group of the anchor's gram, the first k units of the
   suffix sampled there;
3. each group finds which windows are equal and answers all but the first;
4. each chunk removes what it settled itself and what it was answered.

Hashes only choose candidates: equality is decided on the text. Chunks, buckets, and groups grow in number, not in size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import groups_for, small_batches
from .tokens import buffer_of

#: Bytes of text to a chunk, on average; a document is never cut, so the largest one bounds a chunk from below.
CHUNK_BYTES = 4_000_000
#: Units whose anchors are found at once; places within a piece must fit 24 bits.
PIECE = 1 << 20
#: There are as many blobs as pairs of chunks and groups, so their fixed cost counts: these are made once.
_ZIP, _UNZIP = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()


def chunked(docs: DataFrame, chunk_bytes: int = CHUNK_BYTES) -> tuple[DataFrame, int]:
    """docs (doc_id, text) with the chunk that doc_id is dealt to (rows without one: their text), and the number of chunks."""
    n = groups_for(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0, chunk_bytes, 32)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    own = F.when(F.col("doc_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("doc_id", F.lit(11)))
    return docs.select(F.pmod(own, F.lit(n)).cast("long").alias("chunk"), "doc_id", "text"), n


def anchor_runs(grams_of, first: np.ndarray, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of consecutive windows with one anchor: first window, number of windows, the anchor's place and hash.

    ``grams_of(a, b)`` are the hashes of the k-grams that begin at units a to b (those that leave their document are
    never used); ``first`` the unit at which each document begins, and the end. Units are read in pieces, so what is
    held for all of them is one entry per run; a piece's end also ends a run.
    """
    width = length - k + 1
    # The upper bits order by hash, the lower by place: the least is the leftmost of the least.
    mask = np.uint64((1 << 24) - 1)
    lows, counts, places, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    total = int(first[-1])
    for a in range(0, total, PIECE):
        d = np.arange(np.searchsorted(first, a, "right") - 1, np.searchsorted(first, min(total, a + PIECE), "left"))
        begin = np.maximum(first[d], a)
        n = np.maximum(np.minimum(first[d + 1] - length + 1, a + PIECE) - begin, 0)
        if not n.any():
            continue
        starts = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(begin, n)
        grams = grams_of(a, min(total - k + 1, a + PIECE + width - 1))
        run, have = (grams & ~mask) | np.arange(len(grams), dtype=np.uint64), 1
        while have * 2 <= width:
            run = np.minimum(run[:-have], run[have:])
            have *= 2
        if have < width:
            run = np.minimum(run[: len(run) - (width - have)], run[width - have :])
        at = (run[starts - a] & mask).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (np.diff(starts) != 1) | (np.diff(at) != 0)
        head = np.flatnonzero(new)
        lows.append(starts[head])
        counts.append(np.diff(np.append(head, len(starts))).astype(np.int32))
        places.append(a + at[head])
        hashes.append(grams[at[head]])
    return tuple(map(np.concatenate, (lows, counts, places, hashes)))


def pack(numbers: np.ndarray, data: bytes) -> bytes:
    """A table of 32-bit numbers, one row to a column of it, and bytes, as one compressed blob."""
    return _ZIP.compress(np.array(numbers.shape, np.int32).tobytes() + numbers.tobytes() + data)


def unpack(blob: bytes) -> tuple[np.ndarray, bytes]:
    raw = _UNZIP.decompress(blob)
    rows, n = np.frombuffer(raw, np.int32, 2).tolist()
    return np.frombuffer(raw, np.int32, rows * n, 8).reshape(rows, n), raw[8 + 4 * rows * n :]


def cut(numbers: np.ndarray, cuts: np.ndarray) -> pa.Array:
    """Stretches of numbers as binary values, at no cost per stretch."""
    return pa.Array.from_buffers(pa.binary(), len(cuts) - 1, [None, pa.py_buffer((cuts * numbers.itemsize).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(numbers))])


def joined(column) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all values of a binary column, and where each value begins (and the end)."""
    if not len(column):
        return np.zeros(0, np.uint64), np.zeros(1, np.int64)
    flat, offsets = buffer_of(column)
    return np.frombuffer(flat, np.uint64), offsets // 8


def _dealt(hashes: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order of hashes by bucket, the buckets that have some, and where each begins in that order (and the end)."""
    of = ((hashes >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
    order = np.argsort(of, kind="stable")
    of = of[order]
    head = np.flatnonzero(np.diff(of, prepend=-1))
    return order, of[head], np.append(head, len(of))


def by_bucket(hashes: np.ndarray, buckets: int):
    """(bucket, positions) of hashes dealt into buckets."""
    order, of, cuts = _dealt(hashes, buckets)
    cuts = cuts.tolist()
    for b, low, high in zip(of.tolist(), cuts, cuts[1:]):
        yield b, order[low:high]


def shared_hashes(chunks: DataFrame, distinct_anchors, buckets: int) -> DataFrame:
    """chunk, blob: the sorted hashes of anchors that a chunk and another one have.

    ``distinct_anchors`` maps a chunk's table to its distinct anchor hashes.
    """

    def send(key, table):
        hashes = distinct_anchors(table)
        order, of, cuts = _dealt(hashes, buckets)
        return pa.table({"bucket": pa.array(of, pa.int64()), "chunk": pa.array(np.full(len(of), key[0].as_py()), pa.int64()), "blob": cut(hashes[order], cuts)})

    sent = chunks.groupBy("chunk").applyInArrow(send, "bucket long, chunk long, blob binary")
    return sent.groupBy("bucket").applyInArrow(lambda key, table: meet(table), "chunk long, blob binary")


def meet(table) -> pa.Table:
    """chunk, blob: of each chunk's hashes in a bucket, those another chunk has too. All chunks are settled by one sort."""
    every, begin = joined(table["blob"])
    order = np.argsort(every, kind="stable")
    same = np.diff(every[order]) == 0
    twice = np.zeros(len(every), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    cuts = np.concatenate([[0], np.cumsum(twice)])[begin]
    some = np.diff(cuts) > 0
    return pa.table({"chunk": table["chunk"].filter(pa.array(some)), "blob": cut(every[twice], np.append(cuts[:-1][some], cuts[-1]))})


def resolve(docs: DataFrame, method, out_schema: str, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Runs the steps above; ``method`` has anchors, fragments, answer, and finish.

    - ``anchors(table)``: distinct anchor hashes of a chunk's documents;
    - ``fragments(table, shared)``: what the chunk settles itself, and (hashes, blob maker) of what to send for the shared hashes;
    - ``answer(blobs)``: for the blobs of a group, per blob the positions that are not first anywhere;
    - ``finish(table, answered)``: the result rows of a chunk.
    """
    small_batches(docs.sparkSession)
    chunks, n = chunked(docs, chunk_bytes)
    shared = shared_hashes(chunks, method.anchors, n)

    def spread(key, left, right):
        hashes = joined(right["blob"])[0]
        if not left.num_rows:
            return _sent([], key)
        own, of, blob = method.fragments(left, np.sort(hashes))
        return _sent([(b, False, blob(at)) for b, at in by_bucket(of, n)] + ([(key[0].as_py(), True, own)] if own else []), key)

    def answer(key, table):
        # What a chunk has settled itself passes through, so that no chunk does it twice.
        own = table["own"].to_numpy(zero_copy_only=False)
        rows = [(c, x) for c, x, o in zip(table["chunk"].to_pylist(), table["blob"].to_pylist(), own.tolist()) if o]
        table = table.filter(pa.array(~own)).sort_by("chunk")
        if table.num_rows:
            rows += [(c, x) for c, x in zip(table["chunk"].to_pylist(), method.answer(table["blob"].to_pylist())) if x is not None]
        return pa.table({"chunk": pa.array([c for c, _ in rows], pa.int64()), "blob": pa.array([x for _, x in rows], pa.binary())})

    def finish(key, left, right):
        return method.finish(left, right["blob"].to_pylist())

    sent = chunks.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(spread, "bucket long, chunk long, own boolean, blob binary")
    answers = sent.groupBy("bucket").applyInArrow(answer, "chunk long, blob binary")
    return chunks.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(finish, out_schema)


def _sent(rows: list[tuple[int, bool, bytes]], key) -> pa.Table:
    chunk = [key[0].as_py()] * len(rows)
    return pa.table(
        {
            "bucket": pa.array([b for b, _, _ in rows], pa.int64()), "chunk": pa.array(chunk, pa.int64()),
            "own": pa.array([o for _, o, _ in rows], pa.bool_()), "blob": pa.array([x for _, _, x in rows], pa.binary()),
        }
    )
