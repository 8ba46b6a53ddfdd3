"""Small inputs with every kind of awkward row, shared by the tests of the text operators."""

from __future__ import annotations

import random

from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    # Names that the operators use inside or return.
    T.StructField("n", T.LongType()),
    T.StructField("label", T.StringType()),
    T.StructField("kept", T.StringType()),
    T.StructField("start", T.DoubleType()),
    *(T.StructField(name, T.StringType()) for name in ("_key", "_Score", "_n_removed", "_spans", "_same")),
])


def prose(seed: int, words: int) -> str:
    rnd = random.Random(seed)
    out = []
    for _ in range(words):
        word = "".join(rnd.choice(["an", "er", "the", "ó", "st", "in", "ß", "on"]) for _ in range(rnd.randint(1, 4)))
        out.append(word + rnd.choice(["", "", "", "", ".", ",", ".\n"]))
    return " ".join(out)


def awkward() -> list[tuple[int | None, str | None]]:
    long = prose(1, 6_000)
    base = prose(2, 300)
    near = base.split(" ")
    near[150] = "changed"
    passage = prose(3, 90)
    return [
        (10, None), (11, ""), (12, " \n\t "), (13, "One."), (14, "one.  two\r\nthree"), (15, "ONE. two three"),
        (16, "日本語 のテキスト İΣς ▁ mark"), (17, "<|endoftext|> a  b\u00a0c"), (18, long), (19, long),
        (20, base), (21, " ".join(near)), (22, base.replace(" ", "  ")), (20, base), (23, base + " tail"),
        (24, prose(4, 60) + " " + passage + " " + prose(5, 60)), (25, prose(6, 60) + " " + passage + " " + prose(7, 60)),
        (None, "no id here"), (None, base), (26, "w" * 5_000), (27, "same " * 400), (28, base + "\n" + base),
        (29, "a"), (30, "a"), (20, "another text under the same id"), (-5, prose(8, 40)),
    ]


def frame(spark, rows=None):
    rows = awkward() if rows is None else rows
    return spark.createDataFrame([(i, t, 7, "x", "y", 0.5, *"abcde") for i, t in rows], SCHEMA).repartition(3)


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)
