"""Near-duplicate detection: MinHash with banding, verification, and connected components.

1. One pass over the texts gives each document its set size, a 128-bit fingerprint of its shingle set, a signature of
   universal-hash minima and a key per band of it. Documents of equal sets become one representative, the least id.
2. Representatives meet in band buckets. A bucket is not expanded into pairs: all its members are linked to its most
   popular member, the one whose buckets hold the most documents, as hubs of copied texts are.
3. Pairs are verified: first by signatures, then on full sets. Components of what is confirmed follow.
4. Buckets that still span several components are searched whole, in blocks, by signature; only pairs across components
   that may be links come out, and are verified on full sets. Components of all confirmed links are the result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import components
from .shared import small_batches, written
from .tokens import buffer_of, mix, shingles, slices

K = 4
PERCENT = 80
BANDS, ROWS = 25, 5
HASHES = BANDS * ROWS
#: Signatures of pairs at the threshold agree in fewer than this share of minima once in many thousands.
MAYBE = 0.64
#: Members of a bucket that are compared as one block.
BLOCK = 1_000
#: Least hashes of a set that go with a member into the search across components: sets below this size are there in full.
SKETCH = 512

_rng = np.random.default_rng(7_654_321)
_MUL = _rng.integers(1, 1 << 63, HASHES, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = _rng.integers(0, 1 << 63, HASHES, dtype=np.uint64)

_SIGNED = pa.schema(
    [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("fp1", pa.int64()), ("fp2", pa.int64()), ("bands", pa.list_(pa.int64())), ("sig", pa.binary())]
)


def _sets(column, k: int):
    """Distinct shingle hashes of all texts, sorted within each, and their begins."""
    hashes, begin = shingles(*buffer_of(column), k)
    n = np.diff(begin)
    doc = np.repeat(np.arange(len(n)), n)
    order = np.lexsort((hashes, doc))
    hashes = hashes[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])
    return hashes[new], np.concatenate([[0], np.cumsum(np.bincount(doc[new], minlength=len(n)))])


def _sign(k: int):
    def sign(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                hashes, begin = _sets(part["text"], k)
                n = np.diff(begin)
                full = np.flatnonzero(n)
                minima = np.zeros((HASHES, part.num_rows), np.uint32)
                fp = np.zeros((2, part.num_rows), np.uint64)
                if len(full):
                    at = begin[:-1][full]
                    for j in range(HASHES):
                        minima[j, full] = np.minimum.reduceat(((hashes * _MUL[j] + _ADD[j]) >> np.uint64(32)).astype(np.uint32), at)
                    fp[0, full] = np.add.reduceat(mix(hashes ^ np.uint64(0x5851F42D4C957F2D)), at)
                    fp[1, full] = np.add.reduceat(mix(hashes * np.uint64(0xD6E8FEB86659FD93)), at)
                keys = np.zeros((BANDS, part.num_rows), np.uint64)
                for b in range(BANDS):
                    h = np.full(part.num_rows, b + 1, np.uint64)
                    for r in range(ROWS):
                        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + minima[b * ROWS + r])
                    keys[b] = h
                bands = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.T.reshape(-1).view(np.int64)))
                low = np.ascontiguousarray(minima.T.astype(np.uint16))
                sig = pa.array([row.tobytes() for row in low], pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [part["doc_id"], pa.array(n.astype(np.int64)), pa.array(fp[0].view(np.int64)), pa.array(fp[1].view(np.int64)), bands, sig], schema=_SIGNED
                )

    return sign


def _shingle_sets(k: int):
    def sets(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 21):
                hashes, begin = _sets(part["text"], k)
                values = pa.ListArray.from_arrays(pa.array(begin.astype(np.int32)), pa.array(hashes.view(np.int64)))
                # Hashes are uniform and sorted: the first ones are a bottom-k sketch, or the full set.
                least = [hashes[a : min(b, a + SKETCH)].tobytes() for a, b in zip(begin[:-1].tolist(), begin[1:].tolist())]
                yield pa.RecordBatch.from_arrays([part["doc_id"], values, pa.array(least, pa.binary())], names=["id", "hashes", "least"])

    return sets


def _alike(batches):
    """Keeps the pairs whose signatures agree well enough."""
    for batch in batches:
        if not batch.num_rows:
            continue
        a, b = (np.frombuffer(b"".join(batch[c].to_pylist()), np.uint16).reshape(-1, HASHES) for c in ("sig_a", "sig_b"))
        near = (a == b).sum(axis=1) >= MAYBE * HASHES
        yield pa.RecordBatch.from_arrays([batch["a"], batch["b"]], names=["a", "b"]).filter(pa.array(near))


def _resemble(a: np.ndarray, b: np.ndarray, percent: int) -> int:
    """2: the pair is linked, 1: full sets must tell, 0: it is not; from bottom-k sketches, which for small sets are the
    full sets themselves."""
    shared = len(a) + len(b) - len(union := np.union1d(a, b))
    if max(len(a), len(b)) < SKETCH:
        return 2 if 100 * shared >= percent * len(union) else 0
    k = min(SKETCH, len(union))
    last = union[k - 1]
    both = np.intersect1d(a, b, assume_unique=True)
    share = np.searchsorted(both, last, "right") / k
    return 1 if share >= percent / 100 - 4.5 * np.sqrt(percent / 100 * (1 - percent / 100) / k) else 0


def _across(percent: int):
    """Of one block pair of a bucket: links between components that full sets confirm, as many as it takes to join them,
    and the pairs of larger sets, which are confirmed afterwards."""

    def search(key, blocks):
        side, ids, comp = (blocks[c].to_numpy() for c in ("side", "id", "comp"))
        sigs = np.frombuffer(b"".join(blocks["sig"].to_pylist()), np.uint16).reshape(-1, HASHES)
        least = [np.frombuffer(x, np.uint64) for x in blocks["least"].to_pylist()]
        joined: dict[int, int] = {}

        def root(c: int) -> int:
            while c in joined:
                c = joined[c]
            return c

        out = []
        left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
        for i in left.tolist():
            others = right[comp[right] != comp[i]]
            others = others[(side[others] != 2) | (others > i)]
            if not len(others):
                continue
            agree = (sigs[others] == sigs[i]).sum(axis=1)
            near = agree >= MAYBE * HASHES
            # The likeliest first: one link settles a component.
            for j in others[near][np.argsort(-agree[near], kind="stable")].tolist():
                x, y = root(int(comp[i])), root(int(comp[j]))
                if x == y:
                    continue
                verdict = _resemble(least[i], least[j], percent)
                if verdict:
                    out.append((min(ids[i], ids[j]), max(ids[i], ids[j]), verdict == 2))
                if verdict == 2:
                    joined[max(x, y)] = min(x, y)
        a, b, sure = (list(x) for x in zip(*out)) if out else ([], [], [])
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "sure": pa.array(sure, pa.bool_())})

    return search


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which the full sets pass the threshold, as u, v."""
    left = sets.select(F.col("id").alias("a"), F.col("hashes").alias("hashes_a")).hint("merge")
    right = sets.select(F.col("id").alias("b"), F.col("hashes").alias("hashes_b")).hint("merge")
    met = pairs.join(left, "a").join(right, "b")
    sizes = F.size("hashes_a") + F.size("hashes_b")
    met = met.select("a", "b", sizes.alias("sizes"), F.size(F.array_intersect("hashes_a", "hashes_b")).alias("shared"))
    return met.filter(100 * F.col("shared") >= percent * (F.col("sizes") - F.col("shared"))).select(F.col("a").alias("u"), F.col("b").alias("v"))


def _linked(docs: DataFrame, key: str, k: int, percent: int) -> DataFrame:
    """doc_id (the key), n_shingles and component (the least key of it) for every row of ``docs``, of which ``key`` is unique."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), "text")
    signed = written(docs.mapInArrow(_sign(k), "doc_id long, n_shingles long, fp1 long, fp2 long, bands array<bigint>, sig binary"), "near-signed")
    full = signed.filter("n_shingles > 0")
    # Written, so that the join below reads it from a shuffle: the rows of a hot group of copies are split over tasks.
    reps = written(full.groupBy("fp1", "fp2").agg(F.min("doc_id").alias("rep")), "near-reps")
    owner = written(full.select("doc_id", "fp1", "fp2").join(reps.hint("merge"), ["fp1", "fp2"]).select("doc_id", "rep"), "near-owner")
    one = full.join(owner.filter("doc_id = rep").select("doc_id"), "doc_id")
    banded = one.select(F.col("doc_id").alias("id"), F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    members = written(banded.join(shared, "key"), "near-members")
    popular = members.groupBy("id").agg(F.sum("n").alias("popularity"))
    met = written(popular.join(one.select(F.col("doc_id").alias("id"), "sig"), "id"), "near-met")
    # The ids grow with the input, so texts meet them in a merge join at every size.
    sets = docs.join(met.select(F.col("id").alias("doc_id")).hint("merge"), "doc_id", "left_semi")
    sets = written(sets.mapInArrow(_shingle_sets(k), "id long, hashes array<bigint>, least binary"), "near-sets")

    ranked = members.join(met.select("id", "popularity"), "id")
    hub = ranked.groupBy("key").agg(F.min(F.struct((-F.col("popularity")).alias("p"), "id")).alias("h")).select("key", F.col("h.id").alias("hub"))
    pairs = members.join(hub, "key").filter("id != hub").select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    sig_a, sig_b = met.select(F.col("id").alias("a"), F.col("sig").alias("sig_a")), met.select(F.col("id").alias("b"), F.col("sig").alias("sig_b"))
    likely = pairs.join(sig_a, "a").join(sig_b, "b").mapInArrow(_alike, "a long, b long")
    links = written(confirmed(likely, sets, percent), "near-links")
    first = components(links)

    labelled = met.join(first.withColumnRenamed("u", "id"), "id", "left").select("id", "sig", F.coalesce("v", "id").alias("comp"))
    labelled = labelled.join(sets.select("id", "least"), "id")
    open_keys = (
        members.join(labelled.select("id", "comp"), "id").groupBy("key")
        .agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.count(F.lit(1)).alias("m")).filter("low != high")
        .withColumn("blocks", F.ceil(F.col("m") / BLOCK).cast("int")).select("key", "blocks")
    )
    # A member goes to every pair of blocks that its own block is in; a block pair is one small group.
    own = F.pmod(F.xxhash64("id", F.lit(1)), F.col("blocks")).cast("int")
    dealt = (
        members.select("key", "id").join(open_keys, "key").withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        .select(
            "key", "id", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"),
            F.when(F.col("own") == F.col("other"), 2).otherwise(F.when(F.col("own") < F.col("other"), 0).otherwise(1)).alias("side"),
        )
        .join(labelled, "id")
    )
    more = dealt.groupBy("key", "i", "j").applyInArrow(_across(percent), "a long, b long, sure boolean")
    more = written(more.groupBy("a", "b").agg(F.max("sure").alias("sure")), "near-more")
    sure = more.filter("sure").select(F.col("a").alias("u"), F.col("b").alias("v"))
    late = written(confirmed(more.filter("not sure").select("a", "b"), sets, percent).unionByName(sure), "near-late")
    final = components(first.unionByName(late))

    placed = owner.join(final.select(F.col("u").alias("rep"), "v"), "rep", "left").select("doc_id", F.coalesce("v", "rep").alias("component"))
    return signed.select("doc_id", "n_shingles").join(placed, "doc_id", "left").withColumn("component", F.coalesce("component", "doc_id"))


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """``docs`` and a column that tells its rows apart: doc_id, or, if an id is null or repeated, a number written once."""
    if docs.groupBy("doc_id").count().filter("count > 1 OR doc_id IS NULL").isEmpty():
        return docs, "doc_id"
    key = "_key"
    while key in map(str.lower, docs.columns):
        key += "_"
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "near-keyed"), key


def near_duplicates(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Two texts are linked if ``100 * shared >= percent * united`` over their sets of distinct ``k``-word shingles (A-Z as
    a-z); fewer words make one shingle, the whole sequence. Null texts and texts without words have empty sets and are
    linked with nothing. Rows are nodes: rows that share an id are linked if their texts are, and rows without an id take
    part. component_id is the least id of the component, null if it has none; then one row of it is kept, else those of
    the least id. Bands find a pair at 0.8 with probability over 0.9999 (25 bands of 5), and surer above. Texts are read
    whole, however long. An empty table gives an empty result.
    """
    docs, key = _keyed(docs.select("doc_id", "text"))
    found = _linked(docs, key, k, percent)
    if key == "doc_id":
        return found.select("doc_id", "n_shingles", F.col("component").alias("component_id"), (F.col("doc_id") == F.col("component")).alias("kept"))
    found = found.withColumnRenamed("doc_id", key).join(docs.select(key, F.col("doc_id").cast("long").alias("doc_id")), key)
    least = found.groupBy("component").agg(F.min("doc_id").alias("component_id"), F.min(key).alias("_first"))
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull() & (F.col(key) == F.col("_first")))
    return found.join(least.hint("merge"), "component").select("doc_id", "n_shingles", "component_id", kept.alias("kept"))


def deduplicate(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """``docs`` with one row of each component, that of the least id (rows without one last); all columns as they are.

    Null and repeated ids, null texts, and empty tables as in ``near_duplicates``: each row is a node of its own.
    """
    keyed, key = _keyed(docs)
    found = _linked(keyed, key, k, percent)
    if key == "doc_id":
        kept = found.filter("doc_id = component").select("doc_id")
    else:
        ids = keyed.select(F.col(key).alias("_k"), F.col("doc_id").cast("long").alias("_id"))
        met = found.join(ids, F.col("doc_id") == F.col("_k"))
        kept = met.groupBy("component").agg(F.min(F.struct(F.col("_id").isNull().alias("a"), F.col("_id").alias("b"), F.col("_k").alias("c"))).alias("x")).select(F.col("x.c").alias(key))
    kept = kept.select(F.col(key).alias("_kept")).hint("merge")
    return keyed.join(kept, keyed[key] == kept["_kept"], "left_semi").select(*(keyed[c] for c in docs.columns))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
