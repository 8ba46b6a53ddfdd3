"""Exact duplicates by deterministic block naming.

Every text is cut into blocks of a fixed number of bytes. All distinct blocks of the corpus are numbered in sorted
order; then, level by level, adjacent pairs of numbers are numbered in the same way until one number is left of every
text. Numbers of different levels do not overlap, so two texts have the same number if and only if they are equal.

Blocks are sorted and joined by a 128-bit digest that is first proved to be one-to-one on the blocks at hand: if two
different blocks ever share one, another seed is taken. The names are therefore free of collisions, not only likely to
be. Only that proof moves the text, once, after copies inside a task have been merged.

Everything is DataFrame functions. Copies are merged before each shuffle; the joins back are plain equi-joins of narrow
rows, which adaptive execution splits for hot blocks.

Defined cases: a NULL text is an empty text, and empty texts are equal; whitespace runs ([\\x20\\x09-\\x0D]+) count as one
space, also at the ends; a NULL doc_id comes after all others (keep_id is NULL only if a group has no doc_id); of rows
repeated with the same doc_id and text exactly one stays; other columns play no part.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import ranked, stored, text_or_empty, unused

BLOCK_BYTES = 16_384
MAX_SEEDS = 8


def normalised(text: str = "text") -> Column:
    return F.regexp_replace(text_or_empty(text), r"[\x20\x09-\x0D]+", " ")


def _blocks(norm: Column, block_bytes: int) -> Column:
    raw = norm.cast("binary")
    last = F.greatest(F.ceil(F.octet_length(norm) / block_bytes).cast("int") - 1, F.lit(0))
    # The bytes are cut, not the characters: a position inside binary data needs no scan from the start.
    return F.transform(
        F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * block_bytes + 1, F.lit(block_bytes))
    )


def _digest(block: Column, seed: int) -> Column:
    return F.struct(
        F.xxhash64(F.lit(2 * seed), block).alias("d1"), F.xxhash64(F.lit(2 * seed + 1), block).alias("d2")
    )


def _distinct_digests(docs: DataFrame, text: str, block_bytes: int) -> tuple[DataFrame, int]:
    """The digests of all distinct blocks, and the seed under which no two blocks share one."""
    for seed in range(MAX_SEEDS):
        blocks = docs.select(F.explode(_blocks(normalised(text), block_bytes)).alias("block"))
        distinct = blocks.select(_digest(F.col("block"), seed).alias("d"), "block").distinct()
        digests = stored(
            distinct.groupBy("d.d1", "d.d2").agg(F.count("*").alias("variants")), "block-digests"
        )
        if digests.filter("variants > 1").isEmpty():
            return digests.drop("variants"), seed
    raise RuntimeError("no seed gives different blocks different digests")


def identities(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row per row of docs: _row, doc_id, sha (of the normalised text), identity."""
    digests, seed = _distinct_digests(docs, text, block_bytes)
    names = ranked(digests, ["d1", "d2"], "name")
    base = digests.count()

    norm = docs.select("doc_id", normalised(text).alias("norm"))
    rows = stored(
        norm.select(
            F.monotonically_increasing_id().alias("_row"),
            "doc_id",
            F.unhex(F.sha2("norm", 256)).alias("sha"),
            F.transform(_blocks(F.col("norm"), block_bytes), lambda b: _digest(b, seed)).alias("digests"),
        ).withColumn("n", F.size("digests")),
        "block-rows",
    )
    cells = rows.select("_row", "n", F.posexplode("digests").alias("at", "d")).select(
        "_row", "n", "at", F.col("d.d1").alias("d1"), F.col("d.d2").alias("d2")
    )
    cells = cells.join(names, ["d1", "d2"]).select("_row", "n", "at", "name")

    longest = rows.agg(F.max("n")).first()[0] or 1
    done = None
    for _ in range(math.ceil(math.log2(longest)) if longest > 1 else 0):
        cells = stored(cells, "block-names")
        ready = cells.filter("n = 1").select("_row", "name")
        done = ready if done is None else done.unionByName(ready)
        half = (
            cells.filter("n > 1")
            .groupBy("_row", (F.shiftright("at", 1)).alias("at"))
            .agg(
                F.max(F.when(F.col("at") % 2 == 0, F.col("name"))).alias("left"),
                F.coalesce(F.max(F.when(F.col("at") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"),
                F.max(F.ceil(F.col("n") / 2).cast("int")).alias("n"),
            )
        )
        half = stored(half, "block-pairs")
        pairs = stored(half.select("left", "right").distinct(), "block-distinct-pairs")
        names = ranked(pairs, ["left", "right"], "name", base)
        base += pairs.count()
        cells = half.join(names, ["left", "right"]).select("_row", "n", "at", "name")
    last = cells.select("_row", "name")
    done = last if done is None else done.unionByName(last)
    return rows.select("_row", "doc_id", "sha").join(done.withColumnRenamed("name", "identity"), "_row")


def exact_duplicates(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256."""
    named = stored(identities(docs, text, block_bytes), "block-identities")
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"), F.col("_row").alias("row"))
    groups = named.groupBy("identity").agg(F.min(order).alias("first"), F.count("*").alias("group_size"))
    return named.join(groups, "identity").select(
        "doc_id",
        F.col("first.id").alias("keep_id"),
        "group_size",
        (F.col("_row") == F.col("first.row")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def keep_first(docs: DataFrame, text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    decided = exact_duplicates(docs, text, block_bytes)
    counted = stored(
        decided.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count("*").alias("same")),
        "block-decisions",
    ).filter("kept")
    own, same = unused(docs, "_key"), unused(docs, "_same")
    key = F.struct("doc_id", F.sha2(normalised(text), 256).alias("text_sha256"))
    stay = counted.select(F.struct("doc_id", "text_sha256").alias(own), F.col("same").alias(same))
    found = docs.withColumn(own, key).join(stay, own)
    single = found.filter(F.col(same) == 1).select(*docs.columns)
    if counted.filter("same > 1").isEmpty():
        return single
    # Rows repeated under one doc_id: any of them may stay, as long as it is one.
    again = found.filter(F.col(same) > 1).dropDuplicates([own]).select(*docs.columns)
    return single.unionByName(again)
