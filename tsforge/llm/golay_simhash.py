"""Near duplicates by SimHash fingerprints that differ in few bits, found through the binary Golay code.

1. Every whole text becomes a 64-bit fingerprint: the majority, bit by bit, of the XXH64 hashes of its word shingles.
   Texts with equal fingerprints are one node from here on, however many there are.
2. The Golay code of 23 bits is perfect: each word lies within 3 bits of exactly one codeword. The keys of a word are the
   codewords that the word itself and its 23 neighbours decode to, six at most. Two words that differ in two bits have a
   neighbour in common, and therefore a key.
3. A fingerprint is three segments of 22, 21 and 21 bits. Of three errors either some segment has none: then one of
   the keys "segment i exactly, codeword of the next segment" agrees, because a segment with all three errors has an
   errorless one behind it and before it, and the others have two at most. Or each segment has one: then "codeword
   of the first segment, an exact half of the second, an exact half of the third" agrees. That makes seven families of
   keys of 33 or 34 bits, 37 rows a fingerprint at most 42, none missed.
4. Nodes with a key in common meet in one group and are compared in full. A group gives out only the links that connect
   it, fewer than it has nodes. A group of more than CELL nodes is dealt out again first: three errors leave one of four
   blocks of its other bits untouched, so each node goes on under four finer keys. Fewer bits are left each time, and
   three bits make eight nodes at most, so that ends after a few rounds. No pair is lost to a cap.
5. Links become connected components.

Defined cases: a text with fewer words than a shingle is one shingle; NULL, empty and blank texts have fingerprint zero,
which links like any other; component_id is the smallest doc_id of the component (NULL if it has none); rows repeated
under one doc_id each have their row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import release, small_batches, stored, task_count, text_or_empty
from tsforge.llm.components import components
from tsforge.llm.words import words

SHINGLE = 3
SEED = 42
DISTANCE = 3
CELL = 8_192
HASH_CHUNK = 65_536

#: Fixed value: the generator polynomial x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 of the code.
GENERATOR = 0b110001110101
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """Majority bits of the hashes of all k-word shingles, as an unsigned number."""
    found = words(text)
    if not found:
        return 0
    joined = memoryview(b" ".join(found))
    ends = np.cumsum([len(w) + 1 for w in found]) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - k + 1)
    ends = ends[len(ends) - n :]
    ones = np.zeros(64, np.int64)
    for at in range(0, n, HASH_CHUNK):
        spans = zip(starts[at : min(n, at + HASH_CHUNK)].tolist(), ends[at : at + HASH_CHUNK].tolist())
        hashed = np.array([xxhash.xxh64_intdigest(joined[a:b], SEED) for a, b in spans], np.uint64)
        ones += np.unpackbits(hashed.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def _remainders(values: np.ndarray) -> np.ndarray:
    """Syndromes: remainders of 23-bit words divided by the generator."""
    rest = values.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = np.where(rest >> bit & 1, rest ^ (GENERATOR << (bit - 11)), rest)
    return rest


def _error_patterns() -> np.ndarray:
    """The error of up to three bits by its syndrome; each syndrome has exactly one."""
    bits = 1 << np.arange(23)
    errors = {0}
    for _ in range(3):
        errors |= {e | int(b) for e in errors for b in bits}
    errors = np.array(sorted(errors))
    out = np.zeros(2048, np.int64)
    out[_remainders(errors)] = errors
    return out


PATTERNS = _error_patterns()
#: The remainder of a word is the exclusive or of those of its parts.
LOW_REST, HIGH_REST = _remainders(np.arange(1 << 12)), _remainders(np.arange(1 << 11) << 12)
BIT_REST = _remainders(1 << np.arange(23))


def codewords(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of 23-bit words: (n, 24) codeword numbers, and which of them are there for the first time in their row."""
    values = values.astype(np.int64)
    rest = LOW_REST[values & 0xFFF] ^ HIGH_REST[values >> 12]
    flips = np.concatenate(([0], 1 << np.arange(23)))
    near = values[:, None] ^ flips
    rest = rest[:, None] ^ np.concatenate(([0], BIT_REST))
    found = np.sort((near ^ PATTERNS[rest]) >> 11, axis=1)
    fresh = np.ones(found.shape, bool)
    fresh[:, 1:] = found[:, 1:] != found[:, :-1]
    return found, fresh


def _bits(low: int, count: int) -> int:
    return ((1 << count) - 1) << low


def families() -> list[tuple[int, int]]:
    """(segment that is decoded, mask of the exact bits) of each family of keys."""
    out = [((i + 1) % 3, _bits(*SEGMENTS[i])) for i in range(3)]
    halves = [(_bits(low, n // 2), _bits(low + n // 2, n - n // 2)) for low, n in SEGMENTS[1:]]
    return out + [(0, b | c) for b in halves[0] for c in halves[1]]


FAMILIES = families()


def node_keys(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the node, family, key) of all keys of fingerprints."""
    segments = [codewords(nodes >> np.uint64(low) & np.uint64((1 << n) - 1)) for low, n in SEGMENTS]
    places, kinds, keys = [], [], []
    for family, (decoded, mask) in enumerate(FAMILIES):
        found, fresh = segments[decoded]
        place, column = np.nonzero(fresh)
        exact = nodes[place] & np.uint64(mask)
        places.append(place)
        kinds.append(np.full(len(place), family, np.int32))
        # The bits of the decoded segment are free for its codeword: keys of a family agree only if both parts do.
        keys.append(exact | found[place, column].astype(np.uint64) << np.uint64(SEGMENTS[decoded][0]))
    return np.concatenate(places), np.concatenate(kinds), np.concatenate(keys).view(np.int64)


def _fingerprint_batches(k: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], ["doc_id", "node"])

    return run


def _key_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes = batch.column(0).to_numpy().view(np.uint64)
        for at in range(0, len(nodes), 4_096):
            part = nodes[at : at + 4_096]
            place, family, key = node_keys(part)
            yield pa.RecordBatch.from_arrays(
                [pa.array(family), pa.array(key), pa.array(part[place].view(np.int64))], ["family", "key", "node"]
            )


def blocks_of(mask: int) -> list[int]:
    """Four masks that share out the bits that are not in this one, four of them at least."""
    free = [b for b in range(64) if not mask >> b & 1]
    return [sum(1 << int(b) for b in part) for part in np.array_split(free, DISTANCE + 1)]


def _finer_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of (key, mask, node) the keys with one block more of exact bits."""
    for batch in batches:
        keys, masks, nodes = (c.to_numpy().view(np.uint64) for c in batch.columns)
        out: list[list[np.ndarray]] = [[], [], []]
        for mask in np.unique(masks):
            here = masks == mask
            for block in blocks_of(int(mask)):
                wider = np.uint64(int(mask) | block)
                exact = nodes[here] & np.uint64(block)
                out[0].append(np.array([xxhash.xxh64_intdigest(x.tobytes(), SEED) for x in np.stack(
                    (keys[here], exact, np.full(len(exact), wider)), axis=1)], np.uint64))
                out[1].append(np.full(len(exact), wider))
                out[2].append(nodes[here])
        columns = [pa.array(np.concatenate(c).view(np.int64)) if c else pa.array([], pa.int64()) for c in out]
        yield pa.RecordBatch.from_arrays(columns, ["key", "mask", "node"])


def spanning_links(nodes: np.ndarray, distance: int = DISTANCE) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what is connected among distinct fingerprints: one less than nodes for each component."""
    left, us, vs = nodes, [], []
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            own = front.pop()
            near = np.bitwise_count(left ^ own) <= distance
            hits = left[near]
            if len(hits):
                us.append(np.full(len(hits), own))
                vs.append(hits)
                front.extend(hits)
                left = left[~near]
    empty = [np.zeros(0, np.uint64)]
    return np.concatenate(us or empty), np.concatenate(vs or empty)


def group_links(keys: np.ndarray, nodes: np.ndarray, pairwise: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Links inside the runs of equal keys: small runs by offsets, all at once, longer ones one by one."""
    first = np.flatnonzero(np.concatenate(([True], (keys[1:] != keys[:-1]).any(axis=1))))
    size = np.diff(np.append(first, len(keys)))
    us, vs = [], []
    small = np.repeat(size, size) <= pairwise
    for step in range(1, pairwise):
        a = np.flatnonzero(small[:-step] & (keys[step:] == keys[:-step]).all(axis=1))
        a = a[np.bitwise_count(nodes[a] ^ nodes[a + step]) <= DISTANCE]
        us.append(nodes[a])
        vs.append(nodes[a + step])
    for at, n in zip(first[size > pairwise], size[size > pairwise]):
        u, v = spanning_links(np.unique(nodes[at : at + n]))
        us.append(u)
        vs.append(v)
    return np.concatenate(us), np.concatenate(vs)


def _link_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (family or mask, key, node) come sorted; the last run of a batch waits for the next one."""
    held = np.zeros((0, 3), np.uint64)

    def links(rows: np.ndarray) -> pa.RecordBatch:
        u, v = group_links(rows[:, :2], rows[:, 2]) if len(rows) else (held[:0, 2],) * 2
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (u, v)], ["u", "v"])

    for batch in batches:
        rows = np.stack([c.to_numpy().astype(np.int64).view(np.uint64) for c in batch.columns], axis=1)
        rows = np.concatenate((held, rows))
        if not len(rows):
            continue
        earlier = np.flatnonzero((rows[:, :2] != rows[-1, :2]).any(axis=1))
        ends = int(earlier[-1]) + 1 if len(earlier) else 0
        held = rows[ends:]
        yield links(rows[:ends])
    yield links(held)


def _linked(groups: DataFrame, columns: list[str]) -> DataFrame:
    n = task_count(groups)
    dealt = groups.repartition(n, *columns).sortWithinPartitions(*columns)
    return dealt.select(*columns, "node").mapInArrow(_link_batches, "u long, v long").distinct()


def links(nodes: DataFrame, cell: int = CELL) -> DataFrame:
    """u, v: fingerprints of the stored, distinct nodes that differ in at most DISTANCE bits, as far as they connect."""
    cell = max(cell, 1 << DISTANCE)
    keys = nodes.select("node").mapInArrow(_key_batches, "family int, key long, node long")
    hot = keys.groupBy("family", "key").count().filter(F.col("count") > cell).select("family", "key")
    hot = stored(hot, "hot-keys")
    if hot.isEmpty():
        return stored(_linked(keys, ["family", "key"]), "links")
    out = stored(_linked(keys.join(hot, ["family", "key"], "left_anti"), ["family", "key"]), "links")
    masks = F.array(*(F.lit(mask - (1 << 64) if mask >> 63 else mask).cast("long") for _, mask in FAMILIES))
    open_ = keys.join(hot, ["family", "key"], "left_semi").select("key", masks[F.col("family")].alias("mask"), "node")
    while True:
        finer = stored(open_.mapInArrow(_finer_batches, "key long, mask long, node long").distinct(), "finer-keys")
        hot = stored(finer.groupBy("mask", "key").count().filter(F.col("count") > cell).select("mask", "key"), "hot-keys")
        out = out.union(stored(_linked(finer.join(hot, ["mask", "key"], "left_anti"), ["mask", "key"]), "links"))
        if hot.isEmpty():
            return out
        open_ = finer.join(hot, ["mask", "key"], "left_semi").select("key", "mask", "node")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, cell: int = CELL, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, fingerprint (16 hexadecimal digits), component_id."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("_text"))
    signed = stored(rows.mapInArrow(_fingerprint_batches(k), "doc_id long, node long"), "fingerprints")
    nodes = stored(signed.groupBy("node").agg(F.min("doc_id").alias("doc_id")), "nodes")
    found = links(nodes, cell)
    release(docs.sparkSession)
    labels = stored(components(found), "labels")
    named = nodes.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    ids = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    of_node = stored(named.join(ids, "label").select("node", "component_id"), "of-node")
    return signed.join(of_node, "node").select(
        "doc_id", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id"
    )
