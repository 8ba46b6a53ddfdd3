"""Order and completeness of landed pages that name their successor.

Pages form chains: each names the token of the next one. Chains are ranked by pointer jumping: every page knows a later
one and how many steps it is away; in each round it takes over the pointer of that one, so that pointers reach twice as
far. After log2(longest chain) equi-joins of narrow rows every page knows the end of its chain, whatever the order in
which pages landed. Pages still on the way after log2(pages) rounds lead into a cycle.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.session import stored


def page_chains(pages: DataFrame, keys: Sequence[str], token: str = "token", next_token: str = "next_token") -> DataFrame:
    """keys, token, chain, steps, missing, cycle for every distinct page.

    chain: token of the last page that is there (of a cycle: its least token); steps: pages after this one, NULL on the
    way into a cycle; missing: the token that the last page names although no such page landed. A NULL token is that of
    the first request; a page landed several times counts once, with the least next token.
    """
    own = F.struct(*keys, F.col(token).alias("token"))
    links = pages.groupBy(*keys, token).agg(F.min(next_token).alias("_next"))
    links = stored(links.select(own.alias("_id"), "_next"), "page-links")
    target = F.struct(*(F.col(f"_id.{k}").alias(k) for k in keys), F.col("_next").alias("token"))
    there = links.select(F.col("_id").alias("_to"))
    placed = links.withColumn("_to", F.when(F.col("_next").isNotNull(), target)).join(
        there.withColumn("_there", F.lit(True)), "_to", "left"
    )
    found = F.coalesce("_there", F.lit(False))
    state = stored(placed.select(
        "_id", F.when(found, F.col("_to")).alias("_to"), F.when(found, F.col("_to")).otherwise(F.col("_id")).alias("_end"),
        F.when(found, 1).otherwise(0).cast("long").alias("_steps"), F.when(found, F.least("_id", "_to")).otherwise(F.col("_id")).alias("_least"),
    ), "page-pointers")
    for _ in range(math.ceil(math.log2(max(2, links.count()))) + 1):
        if state.filter("_to is not null").isEmpty():
            break
        ahead = state.select(*(F.col(c).alias(f"{c}2") for c in state.columns))
        moved = state.filter("_to is not null").join(ahead, F.col("_to") == F.col("_id2")).select(
            "_id", F.col("_to2").alias("_to"), F.col("_end2").alias("_end"), (F.col("_steps") + F.col("_steps2")).alias("_steps"),
            F.least("_least", "_least2").alias("_least"),
        )
        state = stored(state.filter("_to is null").unionByName(moved), "page-pointers")
    # Pointers that are left end inside a cycle, whose pages have seen all of it.
    inside = state.select(F.col("_id").alias("_to"), F.col("_least").alias("_cycle"))
    done = state.join(inside, "_to", "left").withColumn("_cycled", F.col("_to").isNotNull())
    last = links.select(F.col("_id").alias("_end"), F.col("_next").alias("_missing"))
    chain = F.when(F.col("_cycled"), F.col("_cycle.token")).otherwise(F.col("_end.token"))
    return done.join(last, "_end", "left").select(
        *(F.col(f"_id.{k}").alias(k) for k in keys), F.col("_id.token").alias(token), chain.alias("chain"),
        F.when(~F.col("_cycled"), F.col("_steps")).alias("steps"), F.when(~F.col("_cycled"), F.col("_missing")).alias("missing"),
        F.col("_cycled").alias("cycle"),
    )


def chain_report(chains: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Per chain: its pages, the length of the longest way to its end, the missing token and whether it is a cycle."""
    return chains.groupBy(*keys, "chain", "cycle").agg(
        F.count("*").alias("pages"), (F.max("steps") + 1).alias("longest"), F.first("missing").alias("missing")
    )
