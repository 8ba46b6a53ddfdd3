"""Repeated passages: runs of consecutive sentences that occurred before are removed.

A text is cut into sentences after . ! ? and line ends. Of every WINDOW words of a sentence one has a cut behind it: the one
with a comma or the like, or else of the smallest hash. Words alone decide, so a passage set into different surroundings
is cut alike but for its first and last WINDOW - 1 words: every stretch of over 50 words that two texts share, with line
ends at the same words, holds a run of at least MIN_WORDS words and is removed up to those edges. Every run of at least MIN_SENTENCES sentences with at least MIN_WORDS words counts. The shortest such run from
each sentence on and the shortest one up to the end of each sentence are the spans, two a sentence at most: together those
inside a longer run cover it, so that what any repeated run covers is found. A span's 128-bit hash covers its words (A-Z
lower-cased, white space aside). Spans are counted over the whole corpus;
the first occurrence, by (doc_id, place), stays and the sentences of every other occurrence are removed, with the
white space after them. What no repeated span covers is not touched.

Texts are cut and hashed in groups of some GROUP_BYTES, as one text with a line end between two of them. Spans meet in an
aggregation that merges a task's spans first, and in equi-joins of narrow rows, where a span with more than its share of
the rows is salted. Only texts that lose sentences are cut again.

Defined cases: NULL texts stay NULL and empty ones empty; texts with fewer sentences or words than a span have none;
rows repeated with the same doc_id and text are one document, each of them loses what it loses; a missing doc_id
comes before all others; of different texts under one doc_id the order is that of their hashes; other columns are kept.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tsforge.llm.common import discard, release, small_batches, stored, text_or_empty, unused
from tsforge.llm.words import LOWER, mix, word_hashes

MIN_SENTENCES = 2
MIN_WORDS = 30
WINDOW = 8
GROUP_BYTES = 1 << 19
HOT_ROWS = 10_000

_ENDS, _PAUSES = (np.isin(np.arange(256), list(signs)) for signs in (b".!?", b",;:"))
_ODD_FACTORS = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)


def inner_cuts(hashed: np.ndarray, stop: np.ndarray, pause: np.ndarray) -> np.ndarray:
    """Whether a cut is behind the word because it comes first in some WINDOW words of one sentence."""
    cut = np.zeros(len(hashed), bool)
    if len(hashed) >= WINDOW:
        # 31 bits of the hash, then the place, which settles ties and is read back from the least of a window.
        rank = (mix(hashed) >> np.uint64(33) << np.uint64(32)) | np.arange(len(hashed), dtype=np.uint64)
        rank |= (~pause).astype(np.uint64) << np.uint64(63)
        width = 1
        while width < WINDOW:
            step = min(width, WINDOW - width)
            rank = np.minimum(rank[:-step], rank[step:])
            width += step
        number = np.cumsum(stop) - stop
        rank = rank[number[WINDOW - 1 :] == number[: 1 - WINDOW]]
        cut[(rank & np.uint64(0xFFFFFFFF)).astype(np.int64)] = True
    return cut


def sentences(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a UTF-8 text: hash and first byte of each word, first word of each sentence (and the number of words)."""
    data = np.frombuffer(raw, np.uint8)
    blank = np.ones(len(data) + 2, np.int8)
    blank[1:-1] = (data == 32) | ((data >= 9) & (data <= 13))
    starts, ends = np.flatnonzero(np.diff(blank)).reshape(-1, 2).T
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(1, np.int64)
    hashed = word_hashes().of(raw.translate(LOWER).split())
    last = data[ends - 1]
    stop = _ENDS[last]
    breaks = np.cumsum(data == 10)
    stop[:-1] |= breaks[ends[:-1] - 1] != breaks[starts[1:]]
    stop[-1] = True
    firsts = np.concatenate(([0], np.flatnonzero(stop | inner_cuts(hashed, stop, _PAUSES[last])) + 1))
    return hashed, starts, firsts[:-1], firsts


def _powers(factor: int, n: int) -> np.ndarray:
    out = np.full(n + 1, factor, np.uint64)
    out[0] = 1
    return np.cumprod(out, out=out)


def spans(
    hashed: np.ndarray, bounds: np.ndarray, n_halves: int = 2, rows: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First sentence, end sentence and hash halves (n x n_halves) of each span, in the order of first and end sentence.

    rows, in ascending order, tells which text each sentence belongs to; without it all are of one text.
    """
    n = len(bounds) - 1
    place = np.arange(n)
    low, high = (0, n) if rows is None else (np.searchsorted(rows, rows), np.searchsorted(rows, rows, "right"))
    until = np.maximum(np.searchsorted(bounds, bounds[:-1] + MIN_WORDS), place + MIN_SENTENCES)
    end = place + 1
    since = np.minimum(np.searchsorted(bounds, bounds[1:] - MIN_WORDS, "right") - 1, end - MIN_SENTENCES)
    onward, back = until <= high, since >= low
    pairs = np.concatenate((place[onward] * (n + 1) + until[onward], since[back] * (n + 1) + end[back]))
    first, end = np.divmod(np.unique(pairs), n + 1)
    halves = np.empty((len(first), n_halves), np.uint64)
    a, b = bounds[first], bounds[end]
    for half, factor in enumerate(_ODD_FACTORS[:n_halves]):
        # Sum of word * factor^place, all modulo 2^64; an odd factor has an inverse.
        powers, down = _powers(factor, len(hashed)), _powers(pow(factor, -1, 2**64), len(hashed))
        sums = np.zeros(len(hashed) + 1, np.uint64)
        np.cumsum(mix(hashed ^ np.uint64(factor)) * powers[:-1], out=sums[1:])
        halves[:, half] = mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))
    return first, end, halves.view(np.int64)


def _groups(texts: pa.Array) -> Iterator[tuple[int, list[bytes]]]:
    """The texts in turn, some GROUP_BYTES at a time (or one longer text), with the number of the first one."""
    group: list[bytes] = []
    begin, size = 0, 0
    for row, text in enumerate(texts.cast(pa.binary())):
        if group and size + len(text.as_buffer()) > GROUP_BYTES:
            yield begin, group
            group, begin, size = [], row, 0
        group.append(text.as_py())
        size += len(group[-1])
    if group:
        yield begin, group


def group_spans(texts: list[bytes], n_halves: int = 2) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of the spans of all texts: text, number among the spans of that text, hash halves."""
    hashed, starts, firsts, bounds = sentences(b"\n".join(texts))
    begins = np.cumsum([0] + [len(text) + 1 for text in texts[:-1]])
    rows = np.searchsorted(begins, starts[firsts], "right") - 1
    first, _, halves = spans(hashed, bounds, n_halves, rows)
    row = rows[first]
    return row, np.arange(len(row)) - np.searchsorted(row, row), halves


def _span_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = batch.column(2).to_numpy()
        for begin, texts in _groups(batch.column(0)):
            row, number, halves = group_spans(texts)
            row += begin
            ids = batch.column(1).take(pa.array(row, pa.int64()))
            columns = (marks[row] + number, halves[:, 0], halves[:, 1])
            yield pa.RecordBatch.from_arrays(
                [ids, *(pa.array(x, pa.int64()) for x in columns)], ["doc_id", "place", "h1", "h2"]
            )


def _half_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, texts in _groups(batch.column(0)):
            halves = group_spans(texts, 1)[2]
            yield pa.RecordBatch.from_arrays([pa.array(halves[:, 0], pa.int64())], ["h1"])


def _doc_id() -> Column:
    return F.col("doc_id").cast("long").alias("doc_id")


def _mark(text: str) -> Column:
    """31 bits of the text's hash, above 32 bits for the number of a span: tells texts of one doc_id apart."""
    return F.shiftleft(F.shiftrightunsigned(F.xxhash64(text_or_empty(text)), 33), 32)


def _salted_join(rows: DataFrame, keyed: DataFrame, on: list[str], how: str) -> DataFrame:
    """rows joined to a stored table with one row a key and the number of its rows in `times`.

    A key with more than HOT_ROWS rows and a 1,000th of all is dealt to several tasks, by a salt. Such keys, fewer than
    1,000, are the only thing broadcast.
    """
    share = max(HOT_ROWS, (keyed.agg(F.sum("times")).first()[0] or 0) // 1000)
    copies = F.ceil(F.col("times") / share)
    hot = keyed.filter(F.col("times") > share).select(*on, copies.alias("_copies"))
    salt = F.coalesce(F.pmod(F.xxhash64("doc_id", "place"), "_copies"), F.lit(0)).cast("int").alias("_salt")
    dealt = rows.join(F.broadcast(hot), on, "left").select(*rows.columns, salt)
    kept = keyed.drop("times").columns
    spread = keyed.select(*kept, F.explode(F.sequence(F.lit(0), (copies - 1).cast("int"))).alias("_salt"))
    return dealt.join(spread, [*on, "_salt"], how).drop("_salt")


def repeated_spans(docs: DataFrame, text: str = "text") -> DataFrame:
    """_key (doc_id and mark of a text), _spans: numbers of all its spans that occurred before."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(text_or_empty(text).alias("_text"), _doc_id(), _mark(text).alias("mark"))
    # Made twice rather than stored: spans take more room than their texts.
    found = rows.mapInArrow(_span_batches, "doc_id long, place long, h1 long, h2 long")
    at = F.struct("doc_id", "place")
    # Half the hash finds the spans that may recur: most do not, and only the others go on with both halves.
    first = rows.select("_text").mapInArrow(_half_batches, "h1 long")
    halves = stored(first.groupBy("h1").agg(F.count("*").alias("times")).filter("times > 1"), "halves")
    release(spark)
    some = stored(_salted_join(found, halves, ["h1"], "left_semi"), "recurring")
    discard(halves)
    release(spark)
    # Spans of repeated rows share their places, so that none of them lies after the first.
    counted = some.groupBy("h1", "h2").agg(F.min(at).alias("low"), F.count("*").alias("times"))
    again = stored(counted.filter("times > 1"), "again")
    later = _salted_join(some, again, ["h1", "h2"], "inner").filter(~at.eqNullSafe(F.col("low")))
    number = F.col("place").bitwiseAND(F.lit((1 << 32) - 1))
    key = F.struct("doc_id", (F.col("place") - number).alias("mark")).alias("_key")
    hits = later.groupBy(key).agg(F.collect_set(number.cast("int")).alias("_spans"))  # of one text
    hits = stored(hits, "hits")
    discard(some)
    discard(again)
    del found, first, halves, some, counted, again, later
    release(spark)
    return hits


def covered(hashed: np.ndarray, bounds: np.ndarray, numbers: list[int]) -> np.ndarray:
    """Which sentences lie in the spans of these numbers."""
    first, end, _ = spans(hashed, bounds, 0)
    change = np.zeros(len(bounds), np.int64)
    np.add.at(change, first[numbers], 1)
    np.add.at(change, end[numbers], -1)
    return np.cumsum(change[:-1]) > 0


def _removal_batches(names: list[str], text: str, spans_in: str, added: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, removed, cuts = [], [], []
            for whole, numbers in zip(batch.column(text), batch.column(spans_in)):
                value, runs = whole.as_py(), numbers.as_py()
                where: list[list[int]] = []
                gone = 0
                if runs:
                    raw = value.encode()
                    hashed, starts, at, bounds = sentences(raw)
                    out = covered(hashed, bounds, runs)
                    gone = int(out.sum())
                    edges = np.append(starts[at], len(raw))
                    flips = np.flatnonzero(np.diff(np.concatenate(([0], out.astype(np.int8), [0]))))
                    where = [[int(edges[a]), int(edges[b])] for a, b in flips.reshape(-1, 2)]
                    inner = [x for pair in where for x in pair]
                    bounds_ = [0, *inner, len(raw)]
                    value = b"".join(raw[a:b] for a, b in zip(bounds_[::2], bounds_[1::2])).decode()
                texts.append(value)
                removed.append(gone)
                cuts.append(where)
            columns = [pa.array(texts, pa.string()) if n == text else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays(
                [*columns, pa.array(removed, pa.int32()), pa.array(cuts, pa.list_(pa.list_(pa.int64())))],
                [*names, *added],
            )

    return run


def cleaned(
    docs: DataFrame, text: str = "text", removed: str = "_n_removed", where: str = "_removed_bytes"
) -> DataFrame:
    """All rows and columns of docs with the text cleaned, and two new columns: the number of sentences removed, and their
    places ([from, to) in UTF-8)."""
    own, found_spans = unused(docs, "_key"), unused(docs, "_spans")
    hits = repeated_spans(docs, text).withColumnsRenamed({"_key": own, "_spans": found_spans})
    found = docs.withColumn(own, F.struct(_doc_id(), _mark(text).alias("mark"))).join(hits, own, "left")
    schema = T.StructType([*docs.schema.fields]).add(removed, T.IntegerType())
    schema = schema.add(where, T.ArrayType(T.ArrayType(T.LongType())))
    return found.drop(own).mapInArrow(_removal_batches(docs.columns, text, found_spans, [removed, where]), schema)


def remove_repeats(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with repeated passages removed from the texts."""
    return cleaned(docs, text, unused(docs, "_n_removed"), unused(docs, "_removed_bytes")).select(*docs.columns)
