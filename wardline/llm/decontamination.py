"""Benchmark decontamination by size-partitioned MinHash containment search.

Test items are short, documents may be long, so a MinHash of a whole document says nothing about an item inside it.
Items are partitioned by their number of shingles; for each partition documents are cut into overlapping blocks whose
length is in proportion to the partition's largest item, so that a block which holds an item resembles it. Blocks and
items that agree in a band of their signatures are candidates, and every candidate is verified by the exact containment
of the item's shingles in the whole document's.

Everything about a document happens where the document is: nothing is shuffled, so no hot passage or source can land in
one task. Items come to the documents in blocks of bounded size, one pass of the documents for each block; the driver
holds one block at a time.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import WORD, small_batches, written
from .tokens import buffer_of, shingles, slices

K = 5
THRESHOLD = 0.8
#: Shingles of a cell; blocks are runs of cells.
CELL = 8
HASHES = 120
#: Shingles of a part of a large item, and the bands (of one minimum) of a part. A block that holds a part and nothing
#: else of it resembles it by two thirds, so it is missed with probability under one in ten million.
PART, PART_BANDS = 16, 16
#: Items, and bytes of their texts, that go to all documents at once: tens of MB of shingles and signatures.
ITEM_BLOCK, ITEM_BYTES = 20_000, 16_000_000
_FAR = np.uint32(0xFFFFFFFF)

_rng = np.random.default_rng(20_240_501)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)


def _hashed(hashes: np.ndarray, j: int) -> np.ndarray:
    return ((hashes * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32)


def partition(n: int) -> int:
    """The size partition of an item of ``n`` shingles: the cells of the largest item in it (1, 2, 3, 4, 6, 8, 12, ...)."""
    cells, size = -(-n // CELL), 1
    while size < cells:
        size = size + 1 if size < 4 else size * 3 // 2 if size & (size - 1) == 0 else size * 4 // 3
    return size


def rows_of(cells: int) -> int:
    """Minima in a band: one for the smallest partitions, whose items fill less of a block, else two."""
    return 1 if cells <= 2 else 2


def _keys(minima: np.ndarray, b: int, rows: int) -> np.ndarray:
    return minima[b] if rows == 1 else minima[2 * b] * np.uint32(0x9E3779B1) + minima[2 * b + 1]


def _bands(minima: np.ndarray, members: np.ndarray, rows: int):
    """Sorted keys, their items, and a table of keys' upper bits, per band; and the shift that gives these bits."""
    bits = max(16, len(members).bit_length() + 7)
    bands = []
    for b in range(len(minima) // rows):
        keys = _keys(minima, b, rows)
        order = np.argsort(keys, kind="stable")
        seen = np.zeros(1 << bits, bool)
        seen[keys >> np.uint32(32 - bits)] = True
        bands.append((keys[order], members[order], seen))
    return np.uint32(32 - bits), bands


def _minima(hashes: np.ndarray, begin: np.ndarray, most: int) -> np.ndarray:
    """The first ``most`` minima of runs of shingles that begin at ``begin``."""
    return np.stack([np.minimum.reduceat(_hashed(hashes, j), begin) for j in range(most)])


class Items:
    """The items of one block: distinct shingles and, by size partition, band keys.

    Items that fill several cells are in the index once more, by their parts: one that lies in a document in scattered
    pieces resembles no block as a whole, but one of its parts does.
    """

    def __init__(self, ids: list[int], texts: list[str]):
        flat, offsets = buffer_of(pa.array([t.encode() for t in texts], pa.binary()))
        hashes, begin = shingles(flat, offsets, K)
        self.ids = np.array(ids, np.int64)
        self.sets = [np.unique(hashes[begin[i] : begin[i + 1]]) for i in range(len(ids))]
        cells = np.array([partition(len(own)) if len(own) else 0 for own in self.sets], np.int64)
        self.parts = []
        for size in np.unique(cells[cells > 0]).tolist():
            members = np.flatnonzero(cells == size)
            own = [self.sets[i] for i in members]
            at = np.cumsum([0] + [len(x) for x in own[:-1]])
            self.parts.append((size, *_bands(_minima(np.concatenate(own), at, HASHES), members, rows_of(size))))
        large = np.flatnonzero(cells > PART // CELL)
        if len(large):
            # Parts follow each other in the text; the last one may be longer.
            at = np.concatenate([np.arange(begin[i], max(begin[i] + 1, begin[i + 1] - PART + 1), PART) for i in large])
            owner = np.repeat(large, [len(range(begin[i], max(begin[i] + 1, begin[i + 1] - PART + 1), PART)) for i in large])
            ends = np.minimum(at + PART, begin[owner + 1])
            take = np.concatenate([np.arange(a, b) for a, b in zip(at, ends)])
            sizes = np.cumsum(np.append(0, (ends - at)[:-1]))
            self.parts.append((PART // CELL, *_bands(_minima(hashes[take], sizes, PART_BANDS), owner, 1)))
        self.parts.sort(key=lambda x: x[0])
        self.longest = max([c for c, _, _ in self.parts], default=0) + 1


def candidates(items: Items, hashes: np.ndarray, begin: np.ndarray) -> set[tuple[int, int]]:
    """Pairs (document, item) of which some block and the item agree in a band.

    A run of shingles as long as an item of ``cells`` cells lies in one of the blocks of ``cells + 1`` cells that begin
    at every cell. Behind each document stand empty cells, so that no block holds shingles of two.
    """
    lengths = np.diff(begin)
    used = -(-lengths // CELL)
    wide = np.where(used > 0, used + items.longest, 0)
    total = int(wide.sum())
    if not total or not items.parts:
        return set()
    doc = np.repeat(np.arange(len(lengths)), wide)
    nth = np.arange(total) - np.repeat(np.cumsum(wide) - wide, wide)
    empty = nth >= used[doc]
    # Column c holds the shingles of cell c; the last shingle of a document fills up its last cell.
    at = begin[doc] + np.minimum(nth * CELL, lengths[doc] - 1)
    last = begin[doc + 1] - 1
    grid = hashes[np.minimum(at + np.arange(CELL)[:, None], last)]
    minima = np.empty((HASHES, total), np.uint32)
    for j in range(HASHES):
        minima[j] = _hashed(grid, j).min(axis=0)
    minima[:, empty] = _FAR
    found: set[tuple[int, int]] = set()
    width, runs = 1, minima
    for cells, shift, bands in items.parts:
        # Minima over runs of a power of two cells; two such runs cover a block.
        while width * 2 <= cells + 1:
            wider = np.full_like(runs, _FAR)
            np.minimum(runs[:, :-width], runs[:, width:], out=wider[:, :-width])
            wider[:, -width:] = runs[:, -width:]
            width, runs = width * 2, wider
        rest = cells + 1 - width
        block = runs if not rest else np.minimum(runs[:, :-rest], runs[:, rest:])
        for b, (keys, members, seen) in enumerate(bands):
            own = _keys(block, b, rows_of(cells))
            maybe = np.flatnonzero(seen[own >> shift])
            if not len(maybe):
                continue
            maybe = maybe[~empty[maybe]]
            low, high = np.searchsorted(keys, own[maybe], "left"), np.searchsorted(keys, own[maybe], "right")
            for x in np.flatnonzero(high > low):
                d = int(doc[maybe[x]])
                found.update((d, int(m)) for m in members[low[x] : high[x]])
    return found


def matches(items: Items, column, threshold: float) -> list[tuple[int, int, float]]:
    """(row, item, containment) of the texts of a column, each verified on the document's whole set."""
    hashes, begin = shingles(*buffer_of(column), K)
    out = []
    for d, i in sorted(candidates(items, hashes, begin)):
        own = items.sets[i]
        shared = int(np.isin(own, hashes[begin[d] : begin[d + 1]]).sum())
        if shared >= threshold * len(own) - 1e-9:
            out.append((d, i, shared / len(own)))
    return out


def _by_blocks(items: DataFrame, step):
    """``step(broadcast items)`` for one block of items after the other: the driver holds one block at a time.

    Items are distinct and have a word at least. A single block is left to the plan; the results of several are each
    written before the next block is gathered.
    """
    spark = items.sparkSession
    items = items.select(F.col("item_id").cast("long"), "text").filter(F.regexp_count("text", F.lit(WORD)) > 0).distinct()
    size = items.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    n = max(1, -(-size["n"] // ITEM_BLOCK), -(-(size["bytes"] or 0) // ITEM_BYTES))
    for i in range(n):
        part = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == i)
        rows = part.toArrow().sort_by([("item_id", "ascending"), ("text", "ascending")])
        sent = spark.sparkContext.broadcast((rows["item_id"].to_pylist(), rows["text"].to_pylist()))
        out = step(sent)
        if n == 1:
            yield out
        else:
            yield written(out, "decontamination")
            sent.destroy()


def search(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, containment: every pair with at least ``threshold`` of the item's distinct shingles in the document.

    ``docs`` has doc_id and text, ``items`` item_id and text; further columns do not matter. Null texts and texts without
    words match nothing; a text of fewer words than a shingle is one shingle, its whole sequence, and is found only in a
    document of just that sequence. Texts are read whole, however long. Repeated documents give repeated rows, repeated
    items (same id and text) do not. Empty tables give an empty result.
    """
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long"), "text")
    found = list(_by_blocks(items, lambda sent: docs.mapInArrow(_finder(sent, threshold), "doc_id long, item_id long, containment double")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _finder(sent, threshold: float):
    def find(batches):
        items = Items(*sent.value)
        kind = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("containment", pa.float64())])
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                ids = part["doc_id"]
                rows = [{"doc_id": ids[d].as_py(), "item_id": int(items.ids[i]), "containment": share} for d, i, share in matches(items, part["text"], threshold)]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return find


def decontaminate(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose text holds an item; all columns stay as they are, and nulls are kept."""
    small_batches(docs.sparkSession)
    now = [docs]

    def step(sent):
        def keep(batches):
            held = Items(*sent.value)
            for batch in batches:
                for part in slices(batch, "text", 1 << 20):
                    clean = np.ones(part.num_rows, bool)
                    clean[[d for d, _, _ in matches(held, part["text"], threshold)]] = False
                    yield part.filter(pa.array(clean))

        return now[-1].mapInArrow(keep, docs.schema)

    for out in _by_blocks(items, step):
        now.append(out)
    return now[-1]


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return search(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
