"""Near duplicates: MinHash bands for candidates, odd sketches to verify them, full sets to confirm.

1. Every whole text becomes its set of distinct word shingles (64-bit hashes). From the set come BANDS * ROWS MinHash
   values, a key per band, and two odd sketches, bitmaps in which every folded value flips one bit, so that the bits in
   which two of them differ count where the sets differ: one of the MinHash values, which estimates the similarity of
   sets of any size, and one of all shingles. The latter never differs in more bits than the sets do in shingles, so it
   rejects only pairs that are surely not alike, and for sets up to some thousand shingles hardly any other is left.
   Texts with equal sets are one node from here on, however many there are.
2. Nodes that share a band key are candidates; band keys of one node only are left out from then on. In the first round each node is compared with the smallest node of each
   of its buckets, and only the pair with the closest sketches is confirmed: one pair per node. Confirmed links join
   nodes to components.
3. Then all pairs of nodes that share a bucket but not a component are compared by their sketches, in cells of a bounded
   number of nodes. Of a large bucket, the nodes of its largest component are dealt out once, and only the others are
   copied to each of these blocks. A cell gives out only pairs that join different components, one less than it holds components at
   most, besides the pairs of nodes that have FEW. They are confirmed, components are joined, and the cells of those
   buckets look again, until no pair is left; a node of which a pair has failed then gives out all its others. Nothing is capped: every pair of a bucket is alike,
   is rejected by its sketches or on its full sets, or lies inside one component.
4. Pairs are confirmed on the full sets by integer arithmetic: 100 * |A and B| >= 80 * |A or B|.

With 40 bands of 5 rows a pair at similarity 0.8 shares no band with probability 1.3e-7; the limit on the MinHash sketch
lies six standard deviations below 0.8.

Defined cases: a text with fewer words than a shingle is one shingle; NULL, empty and blank texts have no shingles and
no links; a row's component_id is the smallest doc_id of its component (rows without doc_id count only if it has no
other: then it is NULL and the row is kept); rows repeated under one doc_id belong to the components of their texts, each
row on its own.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import discard, release, small_batches, stored, text_or_empty, unused
from tsforge.llm.components import components
from tsforge.llm.words import mix, shingles

BANDS, ROWS = 40, 5
SKETCH_BITS = 512
PARITY_BITS = 2_048
MAX_ROUNDS = 100
THRESHOLD = 80  # per cent
SURELY_BELOW = 0.62  # estimated similarity under which a pair is not confirmed
CELL = 4_096
FEW = 16  # so many pairs of a node are given out at once: waiting for the first to fail would take another round
HASH_CHUNK = 2_048


def _multipliers(count: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and offsets of the MinHash functions, from a fixed rule."""
    raw = mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return (raw[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (raw[count:] >> np.uint64(32)).astype(np.uint32)


def min_hashes(hashed: np.ndarray, count: int = BANDS * ROWS) -> np.ndarray:
    factors, offsets = _multipliers(count)
    low = (hashed >> np.uint64(32)).astype(np.uint32)
    best = np.full(count, 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), HASH_CHUNK):
        values = low[at : at + HASH_CHUNK, None] * factors
        values += offsets
        # The product's high bits depend on all bits of the input, its low bits on few: fold them.
        values ^= values >> np.uint32(15)
        np.minimum(best, values.min(axis=0), out=best)
    return best


def band_keys(samples: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band number is part of it."""
    rows = samples.reshape(BANDS, ROWS).astype(np.uint64)
    key = mix(np.arange(1, BANDS + 1, dtype=np.uint64))
    for r in range(ROWS):
        key = mix(key * np.uint64(0x9E3779B97F4A7C15) + rows[:, r])
    return key.astype(np.int64)


def odd_sketch(samples: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity of the samples that fall on each bit, as 64-bit words."""
    place = mix(samples.astype(np.uint64) + (np.arange(len(samples), dtype=np.uint64) << np.uint64(32))) % np.uint64(bits)
    parity = (np.bincount(place.astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def parity_of(hashed: np.ndarray, bits: int = PARITY_BITS) -> np.ndarray:
    """Odd sketch of the whole set."""
    parity = (np.bincount((hashed % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)
    return np.packbits(parity, bitorder="little").view(np.int64)


def most_differing(estimate: float, samples: int = BANDS * ROWS, bits: int = SKETCH_BITS) -> int:
    """Differing bits expected of two sketches at this similarity."""
    return math.floor(bits / 2 * (1 - math.exp(-4 * samples * (1 - estimate) / bits)))


def _sketch_batches(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, keys, bands, sketches, parities = [], [], [], [], []
            for text in batch.column(1):
                hashed = shingles(text.as_py(), k)
                n.append(len(hashed))
                if len(hashed):
                    samples = min_hashes(hashed)
                    keys.append(set_key(hashed))
                    bands.append(band_keys(samples))
                    sketches.append(odd_sketch(samples))
                    parities.append(parity_of(hashed))
                else:
                    for column in (keys, bands, sketches, parities):
                        column.append(None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(2), batch.column(3), pa.array(n, pa.int64()),
                    pa.array(keys, pa.binary()), pa.array(bands, pa.list_(pa.int64())),
                    pa.array(sketches, pa.list_(pa.int64())), pa.array(parities, pa.list_(pa.int64())),
                ],
                ["doc_id", "t1", "t2", "n", "node", "bands", "sketch", "parity"],
            )

    return run


def set_key(hashed: np.ndarray) -> bytes:
    return hashlib.blake2b(hashed.tobytes(), digest_size=16).digest()


def _set_batches(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(t.as_py(), k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([set_key(s) for s in sets], pa.binary()),
                 pa.array([s.tobytes() for s in sets], pa.binary())],
                ["wanted", "node", "shingles"],
            )

    return run


def alike(a: np.ndarray, b: np.ndarray, threshold: int = THRESHOLD) -> bool:
    """Whether two sorted sets have at least `threshold` per cent of their union in common."""
    both = np.concatenate((a, b))
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return 100 * common >= threshold * (len(both) - common)


def _confirm_batches(threshold: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted: the set of u first, then those of its partners."""
        here, own = None, None
        for batch in batches:
            us, vs = [], []
            for u, v, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
                values = np.frombuffer(raw.as_py(), np.uint64)
                if v is None:
                    here, own = u, values
                elif here == u and alike(own, values, threshold):
                    us.append(u)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.binary()), pa.array(vs, pa.binary())], ["u", "v"])

    return run


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, threshold: int, text: str) -> DataFrame:
    """Those of the stored, distinct pairs (u, v) whose full sets are alike. A set is made again from one of its texts."""
    wanted = pairs.select(F.col("u").alias("node")).union(pairs.select(F.col("v").alias("node"))).distinct()
    picked = wanted.join(nodes.select("node", "pick"), "node").select(F.col("pick").alias("_key"), F.col("node").alias("wanted"))
    texts = docs.select(F.struct(*_row_key(text)).alias("_key"), text_or_empty(text).alias("_text"))
    # Rows repeated under one key have the same text: one of them will do.
    texts = picked.join(texts, "_key").dropDuplicates(["_key", "wanted"]).select("wanted", "_text")
    sets = texts.mapInArrow(_set_batches(k), "wanted binary, node binary, shingles binary")
    sets = stored(sets.filter("wanted = node").select("node", "shingles"), "shingle-sets")
    # A hot u has its partners in several chunks, each with its own copy of the set of u.
    salted = pairs.withColumn("chunk", F.pmod(F.xxhash64("v"), F.lit(64)).cast("int"))
    owners = salted.select(F.col("u").alias("node"), "chunk").distinct().join(sets, "node")
    partners = salted.withColumnRenamed("v", "node").join(sets, "node")
    rows = owners.select(F.col("node").alias("u"), F.lit(None).cast("binary").alias("v"), "shingles", "chunk").unionByName(
        partners.select("u", F.col("node").alias("v"), "shingles", "chunk")
    )
    dealt = rows.repartition("u", "chunk").sortWithinPartitions("u", "chunk", F.asc_nulls_first("v"))
    links = dealt.select("u", "v", "shingles").mapInArrow(_confirm_batches(threshold), "u binary, v binary")
    links = stored(links.distinct(), "links")
    discard(sets)
    release(docs.sparkSession)
    return links


def _differing(a: str, b: str) -> Column:
    words = [F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(SKETCH_BITS // 64)]
    total = words[0]
    for w in words[1:]:
        total = total + w
    return total


def _parity_differing(a: str, b: str) -> Column:
    counts = F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long"))
    return F.aggregate(counts, F.lit(0).cast("long"), lambda s, x: s + x)


def _sizes_allow(a: str, b: str, threshold: int) -> Column:
    return 100 * F.least(a, b) >= threshold * F.greatest(a, b)


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """bucket, node, leader (its smallest node) of the buckets with more than one node."""
    members = nodes.select("node", F.explode("bands").alias("bucket"))
    leaders = members.groupBy("bucket").agg(F.min("node").alias("leader"), F.count("*").alias("size"))
    return members.join(leaders.filter("size > 1").drop("size"), "bucket").select("bucket", "node", "leader")


def _first_pairs(nodes: DataFrame, shared: DataFrame, threshold: int, limit: int) -> DataFrame:
    """Per node the closest of the smallest nodes of its buckets."""
    met = shared.filter("node <> leader").select("node", "leader").distinct()
    own = nodes.select("node", F.col("n").alias("n1"), F.col("sketch").alias("s1"))
    other = nodes.select(F.col("node").alias("leader"), F.col("n").alias("n2"), F.col("sketch").alias("s2"))
    scored = met.join(own, "node").join(other, "leader").filter(_sizes_allow("n1", "n2", threshold))
    scored = scored.withColumn("apart", _differing("s1", "s2")).filter(F.col("apart") <= limit)
    best = scored.groupBy("node").agg(F.min(F.struct("apart", "leader")).alias("best"))
    pair = best.select(F.least("best.leader", "node").alias("u"), F.greatest("best.leader", "node").alias("v")).distinct()
    sides = [
        nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("parity").alias(f"p_{x}")) for x in "uv"
    ]
    return pair.join(sides[0], "u").join(sides[1], "v").filter(
        _parity_differing("p_u", "p_v") * (100 + threshold) <= (100 - threshold) * (F.col("n_u") + F.col("n_v"))
    ).select("u", "v")


def _cell_batches(threshold: int, limit: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            buckets, us, vs = [], [], []
            for bucket, row in zip(batch.column(0).to_pylist(), batch.column(1)):
                for a, b in joining_pairs(row.as_py(), threshold, limit):
                    buckets.append(bucket)
                    us.append(a)
                    vs.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(buckets, pa.int64()), pa.array(us, pa.binary()), pa.array(vs, pa.binary())],
                ["bucket", "u", "v"],
            )

    return run


def joining_pairs(cell: list[dict], threshold: int, limit: int) -> list[tuple[bytes, bytes]]:
    """Pairs of a cell that its sketches allow and that join its components, each pair two that were apart before.

    Where a node has FEW pairs, or one that has failed in an earlier round, all its pairs are given out; failed ones go
    later.
    """
    n = np.array([x["n"] for x in cell])
    side = np.array([x["side"] for x in cell])
    label = np.unique([x["label"] for x in cell], return_inverse=True)[1]
    sketch = np.array([x["sketch"] for x in cell], np.int64).view(np.uint64)
    parity = np.array([x["parity"] for x in cell], np.int64).view(np.uint64)
    out = []
    for i, own in enumerate(cell[:-1]):
        later = np.arange(i + 1, len(cell))
        # In a cell of two blocks only pairs across them: pairs inside a block have a cell of their own.
        keep = (label[later] != label[i]) & ((side[later] != side[i]) | (side[i] < 0))
        keep &= 100 * np.minimum(n[later], n[i]) >= threshold * np.maximum(n[later], n[i])
        later = later[keep]
        if len(later):
            # Alike sets differ in (100 - t) / (100 + t) of the sum of their sizes at most.
            apart = np.bitwise_count(parity[later] ^ parity[i]).sum(axis=1, dtype=np.int64)
            later = later[apart * (100 + threshold) <= (100 - threshold) * (n[later] + n[i])]
        if len(later):
            later = later[np.bitwise_count(sketch[later] ^ sketch[i]).sum(axis=1, dtype=np.int64) <= limit]
        if own["failed"] or len(later) <= FEW:
            out += [tuple(sorted((own["node"], cell[j]["node"]))) for j in later]
            continue
        while len(later):
            j = int(later[0])
            out.append(tuple(sorted((own["node"], cell[j]["node"]))))
            label[label == label[j]] = label[i]
            later = later[label[later] != label[i]]
    return out


def _next_pairs(
    nodes: DataFrame, members: DataFrame, labels: DataFrame, failed: DataFrame, threshold: int, limit: int, cell: int = CELL
) -> DataFrame:
    """bucket, u, v: nodes that share a bucket, lie in different components and may be alike; not all that join the same
    two components.

    A bucket of more than `cell` nodes is dealt out by its largest component: the nodes of that one go to one block each
    and meet the others, of which every block has a copy; among themselves they need not meet.
    """
    named = members.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n_label"))
    mixed = sizes.groupBy("bucket").agg(
        F.max(F.struct("n_label", "label")).alias("main"), F.sum("n_label").alias("size"), F.count("*").alias("n_labels")
    ).filter("n_labels > 1")
    large = F.col("size") > cell
    others = F.col("size") - F.col("main.n_label")
    mixed = mixed.select(
        "bucket", F.when(large, F.col("main.label")).alias("main"),
        F.when(large, F.ceil(F.col("main.n_label") / cell)).otherwise(0).cast("int").alias("main_blocks"),
        F.when(large, F.ceil(others / cell)).otherwise(1).cast("int").alias("other_blocks"),
    )
    both = failed.select(F.col("u").alias("node")).union(failed.select(F.col("v").alias("node"))).distinct()
    facts = nodes.select("node", "n", "sketch", "parity").join(both.withColumn("failed", F.lit(True)), "node", "left")
    dealt = named.join(mixed, "bucket").join(facts, "node").withColumn("hash", F.xxhash64("node"))
    in_main = F.col("label").eqNullSafe(F.col("main"))
    own = F.when(in_main, F.pmod("hash", F.greatest("main_blocks", F.lit(1)))).otherwise(F.pmod("hash", "other_blocks"))
    dealt = dealt.withColumn("own", own.cast("int"))

    def up_to(n: str) -> Column:
        return F.filter(F.sequence(F.lit(0), F.greatest(F.col(n) - 1, F.lit(0))), lambda i: i < F.col(n))

    def place(a: Column, b: Column, side: Column, across: bool) -> Column:
        return F.struct(F.lit(across).alias("across"), a.alias("a"), b.alias("b"), side.cast("int").alias("side"))

    # Blocks of the largest component against blocks of others; and blocks of others against each other.
    mains = F.transform(up_to("other_blocks"), lambda o: place(F.col("own"), o, F.lit(0), True))
    across = F.transform(up_to("main_blocks"), lambda m: place(m, F.col("own"), F.lit(1), True))
    among = F.transform(up_to("other_blocks"), lambda o: place(
        F.least(o, F.col("own")), F.greatest(o, F.col("own")), F.when(o == F.col("own"), -1).otherwise(F.col("own")), False
    ))
    dealt = dealt.withColumn("cell", F.explode(F.when(in_main, mains).otherwise(F.concat(across, among))))
    cells = dealt.groupBy("bucket", "cell.across", "cell.a", "cell.b").agg(
        F.collect_list(F.struct("node", "label", "n", "sketch", "parity", "failed", "cell.side")).alias("cell")  # some 2 * cell
    )
    found = cells.select("bucket", "cell").mapInArrow(_cell_batches(threshold, limit), "bucket long, u binary, v binary")
    return found.join(failed.select("u", "v"), ["u", "v"], "left_anti").select("bucket", "u", "v")


def _row_key(text: str) -> list[Column]:
    """doc_id and a 128-bit hash of the text: rows that agree in it are repeated rows."""
    whole = text_or_empty(text)
    doc_id = F.col("doc_id").cast("long").alias("doc_id")
    return [doc_id, F.xxhash64(F.lit(1), whole).alias("t1"), F.xxhash64(F.lit(2), whole).alias("t2")]


def _decided(docs: DataFrame, k: int, threshold: int, surely_below: float, text: str) -> DataFrame:
    """Per row of docs: doc_id, t1, t2, n_shingles, label (of its component; NULL without shingles), component_id."""
    small_batches(docs.sparkSession)
    doc_id, *hashes = _row_key(text)
    rows = docs.select(doc_id, text_or_empty(text).alias("_text"), *hashes)
    schema = (
        "doc_id long, t1 long, t2 long, n long, node binary, bands array<long>, sketch array<long>, parity array<long>"
    )
    signed = stored(rows.mapInArrow(_sketch_batches(k), schema), "sketches")
    nodes = stored(
        signed.filter("n > 0").groupBy("node").agg(
            F.min("doc_id").alias("doc_id"), F.min(F.struct("doc_id", "t1", "t2")).alias("pick"),
            *(F.first(c).alias(c) for c in ("n", "bands", "sketch", "parity")),
        ),
        "nodes",
    )
    shared = stored(shared_buckets(nodes), "shared-buckets")
    release(docs.sparkSession)
    members = shared.select("bucket", "node")
    limit = most_differing(surely_below)
    pairs = stored(_first_pairs(nodes, shared, threshold, limit), "pairs")
    links = failed = labels = None
    release(docs.sparkSession)
    for _ in range(MAX_ROUNDS):
        good = confirm(pairs, nodes, docs, k, threshold, text)
        bad = stored(pairs.join(good, ["u", "v"], "left_anti"), "failed-pairs")
        links, failed = (good, bad) if links is None else (links.union(good), failed.union(bad))
        if labels is None or not good.isEmpty():
            labels = stored(components(links), "labels")
        found = stored(_next_pairs(nodes, members, labels, failed, threshold, limit), "bucket-pairs")
        release(docs.sparkSession)
        if found.isEmpty():
            break
        pairs = stored(found.select("u", "v").distinct(), "pairs")
        # A bucket that gives no pair now never will: components only grow.
        members = stored(members.join(found.select("bucket").distinct(), "bucket", "left_semi"), "open-buckets")
    else:
        raise RuntimeError(f"pairs are still left after {MAX_ROUNDS} rounds")
    grouped = nodes.select("node", "doc_id").join(labels, "node", "left")
    grouped = grouped.withColumn("label", F.coalesce("label", "node"))
    ids = grouped.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = grouped.select("node", "label").join(ids, "label")
    return signed.select("doc_id", "t1", "t2", F.col("n").alias("n_shingles"), "node").join(
        of_node, "node", "left"
    ).select(
        "doc_id", "t1", "t2", "n_shingles", "label",
        F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
    )


def near_duplicates(
    docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, surely_below: float = SURELY_BELOW, text: str = "text"
) -> DataFrame:
    """Per row of docs: doc_id, n_shingles, component_id, kept (doc_id is the component's smallest)."""
    decided = _decided(docs, k, threshold, surely_below, text).select("doc_id", "n_shingles", "component_id")
    return decided.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(
    docs: DataFrame, k: int = 5, threshold: int = THRESHOLD, surely_below: float = SURELY_BELOW, text: str = "text"
) -> DataFrame:
    """The rows of docs that stay: one of each component (of its smallest doc_id), with all their columns."""
    decided = _decided(docs, k, threshold, surely_below, text)
    key, own = F.struct("doc_id", "t1", "t2"), unused(docs, "_key")
    # Rows without shingles stay; of one repeated row, one.
    group = F.struct("label", F.when(F.col("label").isNull(), key).alias("own"))
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), key.alias("key"))
    first = decided.groupBy(group.alias("_group")).agg(F.min(order).alias("first"))
    stay = first.select(F.col("first.key").alias(own))
    kept = docs.withColumn(own, F.struct(*_row_key(text))).join(stay, own, "left_semi")
    repeated = decided.groupBy(key.alias(own)).count().filter("count > 1").select(own)
    repeated = stored(repeated.join(stay, own, "left_semi"), "repeated-rows")
    if repeated.isEmpty():
        return kept.drop(own)
    once = kept.join(repeated, own, "left_semi").dropDuplicates([own])
    return kept.join(repeated, own, "left_anti").unionByName(once).drop(own)
