"""Hash-chained ledgers: sealing per chain, and a verification that finds the first break.

A digest covers a canonical string of type-tagged fields in fixed order; it is this engine's own form and not
byte-compatible with JSON digests of other programs. Sealing is sequential within a chain and parallel across chains: a
chain's entries are sorted where they are sealed and stream through, so a chain of any length needs one batch of memory.
"""

from __future__ import annotations

import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

GENESIS = "0" * 64
BODY = ("kind", "action", "decision", "reason", "payload_digest")


def body(fields: tuple[str, ...] = BODY, ts: str = "ts") -> Column:
    """The canonical string of an entry without its place in the chain: tag, length, and text of each field."""
    tagged = [F.when(F.col(c).isNull(), F.lit("n;")).otherwise(F.concat(F.lit("s"), F.length(F.col(c)).cast("string"), F.lit(":"), F.col(c), F.lit(";"))) for c in (ts, *fields)]
    return F.concat(*tagged)


def link(prev: Column, seq: Column, text: Column) -> Column:
    return F.sha2(F.concat(prev, F.lit("|"), seq.cast("string"), F.lit("|"), text), 256)


def _sealed(entries: DataFrame, chain: str, order: list[str], fields: tuple[str, ...]) -> DataFrame:
    """Entries with _head and _n, the head and length of their chain so far, sealed in order."""
    own = entries.select(F.col(chain).alias("_chain"), F.struct(*(F.col(c).alias(f"o{i}") for i, c in enumerate(order))).alias("_order"), body(fields).alias("_body"), "_head", "_n", "ts", *fields)
    dealt = own.repartition(F.col("_chain")).sortWithinPartitions("_chain", "_order", "_body").drop("_order")
    kept = T.StructType([T.StructField(chain, entries.schema[chain].dataType), *(T.StructField(n, t) for n, t in (("seq", T.LongType()), ("prev", T.StringType()), ("digest", T.StringType()))), *(entries.schema[c] for c in ("ts", *fields))])

    def sealing(batches):
        now, head, n = None, "", 0
        for batch in batches:
            seqs, prevs, digests = [], [], []
            for c, text, start, at in zip(*(batch[k].to_pylist() for k in ("_chain", "_body", "_head", "_n"))):
                if now is None or now[0] != c:
                    now, head, n = (c,), start, at
                seqs.append(n)
                prevs.append(head)
                head = hashlib.sha256(f"{head}|{n}|{text}".encode()).hexdigest()
                digests.append(head)
                n += 1
            made = [batch["_chain"], pa.array(seqs, pa.int64()), pa.array(prevs, pa.string()), pa.array(digests, pa.string())]
            yield pa.RecordBatch.from_arrays([*made, *(batch[c] for c in ("ts", *fields))], names=kept.names)

    return dealt.mapInArrow(sealing, kept)


def seal(entries: DataFrame, chain: str, order: list[str], fields: tuple[str, ...] = BODY) -> DataFrame:
    """chain, seq, prev, digest, ts, and the fields, each chain from its beginning; equal places are in order of their body."""
    return _sealed(entries.withColumns({"_head": F.lit(GENESIS), "_n": F.lit(0).cast("long")}), chain, order, fields)


def breaks(ledger: DataFrame, chain: str, line: str, fields: tuple[str, ...] = BODY) -> DataFrame:
    """chain, line, seq, kind of every break: malformed, else sequence, else link, else digest.

    The chain's line order is looked back once by a window; everything else is local to a row.
    """
    w = Window.partitionBy(chain).orderBy(line)
    bad = F.col("seq").isNull() | F.col("prev").isNull() | F.col("digest").isNull() | F.col("kind").isNull()
    seen = ledger.withColumn("_seq", F.coalesce(F.lag("seq").over(w) + 1, F.row_number().over(w) - 1)).withColumn("_prev", F.coalesce(F.lag("digest").over(w), F.lit(GENESIS)))
    kind = (
        F.when(bad, "malformed").when(F.col("seq") != F.col("_seq"), "sequence").when(F.col("prev") != F.col("_prev"), "link")
        .when(F.col("digest") != link(F.col("prev"), F.col("seq"), body(fields)), "digest")
    )
    return seen.withColumn("break_kind", kind).filter("break_kind IS NOT NULL").select(chain, line, "seq", "break_kind")


def verify(ledger: DataFrame, chain: str, line: str, heads: DataFrame | None = None, fields: tuple[str, ...] = BODY) -> DataFrame:
    """The first break of each broken chain. With known ``heads`` (chain, head) a cut or emptied tail is found too."""
    found = breaks(ledger, chain, line, fields).groupBy(chain).agg(F.min_by(F.struct("seq", "break_kind"), line).alias("b"))
    first = found.select(chain, F.col("b.seq").alias("seq"), F.col("b.break_kind").alias("break_kind"))
    if heads is None:
        return first
    last = ledger.groupBy(chain).agg(F.max_by("digest", line).alias("_last"))
    cut = heads.join(last, chain, "left").filter(~F.col("_last").eqNullSafe(F.col("head"))).join(first, chain, "left_anti")
    return first.unionByName(cut.select(chain, F.lit(None).cast("long").alias("seq"), F.lit("head").alias("break_kind")))


def head(ledger: DataFrame, chain: str) -> DataFrame:
    return ledger.groupBy(chain).agg(F.max_by("digest", "seq").alias("head"), F.count(F.lit(1)).alias("n"))


def tail(ledger: DataFrame, n: int = 20) -> DataFrame:
    return ledger.orderBy(F.desc("seq")).limit(n)


def append(ledger: DataFrame, entries: DataFrame, chain: str, order: list[str], fields: tuple[str, ...] = BODY) -> DataFrame:
    """The sealed entries that continue each chain from its head."""
    heads = head(ledger, chain).select(F.col(chain).alias("_c"), F.col("head").alias("_head"), F.col("n").alias("_n"))
    met = entries.join(heads, entries[chain].eqNullSafe(heads["_c"]), "left").drop("_c")
    return _sealed(met.withColumns({"_head": F.coalesce("_head", F.lit(GENESIS)), "_n": F.coalesce("_n", F.lit(0)).cast("long")}), chain, order, fields)
