"""Phrase collocations: contiguous phrases whose parts go together more often than chance, per language.

1. Candidates are phrases of 2 to LONGEST words with at least `least` occurrences, and so is every part of one. PRUNED
   passes over the texts therefore only prune: a bitmap of fixed size marks the hashes of words, the next ones those of
   phrases of two and three words, that occur often enough; each leaves out what the one before has not. Tasks give out
   sorted blocks of hashes and counts, cut at ranges of the hash, and the blocks of a range are merged. Hashes that
   collide let more through, never less.
2. The last pass counts the phrases that are left exactly, by their words: an occurrence is numbered from the numbers of
   its two overlapping parts, and summed by spelling, so no hash decides. The empty phrase counts all words of a
   language.
3. The counts are laid out as two sorted streams, in prefix order (first word first) and in suffix order (last word
   first). Walking through one of them, the phrases that a phrase begins with have just gone by: their counts wait on a
   stack of at most LONGEST + 1 entries. That gives, without a lookup, the count of the left part of every cut in prefix
   order, of the right part in suffix order, and the largest count of a phrase longer by one word on either side.
   Streams are dealt out by ranges, so a frequent first word is spread over many tasks; a task gets the few phrases that
   its first one begins with along with its range (LONGEST + 1 a task at most; the only rows that pass the driver).
4. Both walks meet in one aggregation by phrase. A phrase goes if one longer by a word is as frequent as `share` per cent
   of it; that decides for all longer ones, because counts only fall as phrases grow. Scores are exact decimals.

Memory: a task holds some TOKENS words and a whole text, PRUNED bitmaps of BITMAP_BITS bits, and one range of hashes.

Defined cases: NULL, empty and blank texts have no words, a NULL language is `und`; rows are counted as often as they
occur, whatever their doc_id; equal scores rank by count, then by phrase; languages without candidates have no rows.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Callable, Iterator, Sequence
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.llm.common import release, small_batches, stored, task_count, text_or_empty
from tsforge.llm.words import LOWER, mix, word_hashes

LONGEST = 5
PRUNED = 3
LEAST = 100
TOP = 2_000
TOKENS = 1_000_000
BITMAP_BITS = 1 << 26

#: A-Z lower-cased; ends of pieces become line ends, tabs spaces.
_SIGNS = bytes(10 if c in b".,;:!?\n\x0b\x0c\r" else 32 if c == 9 else LOWER[c] for c in range(256))
_BREAK, _NOTHING = 0, 1


def numbered(tokens: list[bytes]) -> tuple[np.ndarray, list[bytes]]:
    """Tokens as numbers (0: end of a piece), and the words by number."""
    numbers: defaultdict[bytes, int] = defaultdict(count(_NOTHING + 1).__next__, {b"\n": _BREAK, b"": _NOTHING})
    out = np.fromiter(map(numbers.__getitem__, tokens), np.int64, len(tokens))
    return out[out != _NOTHING], list(numbers)


def distinct_pairs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of pairs of numbers (the first one shifted by 32 bits): the distinct ones, sorted, the first place of each, and
    which one stands at each place.

    Pairs and their places are sorted as one number, which takes a fraction of sorting the places by the pairs.
    """
    high, low = keys >> 32, keys & 0xFFFFFFFF
    bits = (len(keys) - 1).bit_length()
    low_bits = int(low.max()).bit_length()
    if int(high.max()).bit_length() + low_bits + bits > 63:
        return np.unique(keys, return_index=True, return_inverse=True)
    both = (high << low_bits | low) << bits | np.arange(len(keys))
    both.sort()
    place, both = both & ((1 << bits) - 1), both >> bits
    fresh = np.concatenate(([True], both[1:] != both[:-1]))
    of = np.empty(len(keys), np.int64)
    of[place] = np.cumsum(fresh) - 1
    first = place[fresh]
    return keys[first], first, of


def token_buffers(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, np.ndarray, list[bytes]]]:
    """Of rows (lang, text): language, numbers and words of about TOKENS tokens at a time."""
    held: dict[str, list[bytes]] = {}
    for batch in batches:
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            tokens = held.setdefault(lang, [])
            tokens += text.as_py().encode().translate(_SIGNS).replace(b"\n", b" \n ").split(b" ")
            tokens.append(b"\n")
            if len(tokens) >= TOKENS:
                yield lang, *numbered(held.pop(lang))
        if sum(map(len, held.values())) >= 2 * TOKENS:
            for lang in list(held):
                yield lang, *numbered(held.pop(lang))
    for lang, tokens in held.items():
        yield lang, *numbered(tokens)


def marked(bitmap: bytes, hashed: np.ndarray) -> np.ndarray:
    at = hashed % np.uint64(len(bitmap) * 8)
    return (np.frombuffer(bitmap, np.uint8)[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1


def _word_marks(lang: str, words: list[bytes]) -> np.ndarray:
    """Hashes of the words of one language, by number."""
    return mix(word_hashes().of(words) ^ np.uint64(word_hashes()[lang.encode() + b"\n"]))


def phrase_levels(numbers: np.ndarray, hashed: np.ndarray, bitmaps: Sequence[bytes]) -> Iterator[tuple[np.ndarray, ...]]:
    """For each length from 1 to LONGEST: (first place of each distinct phrase, its hash, its count).

    A phrase is left out if the bitmap of its length does not have it, or if one of its parts is left out.
    """
    at, marks = np.flatnonzero(numbers > _NOTHING), hashed[_NOTHING + 1 :]
    of = numbers[at] - (_NOTHING + 1)
    for length in range(1, LONGEST + 1):
        if not len(at):
            return
        if length == 1:
            first = np.zeros(len(marks), np.int64)
            first[of[::-1]] = np.arange(len(of))[::-1]
        else:
            distinct, first, of = distinct_pairs(keys)
            marks = mix(marks[distinct >> 32] * np.uint64(0x9E3779B97F4A7C15) + hashed[numbers[at[first] + length - 1]])
        place, times = at[first], np.bincount(of)
        if length <= len(bitmaps):
            keep = marked(bitmaps[length - 1], marks)
            renumbered, here = np.cumsum(keep) - 1, keep[of]
            at, of, marks, place, times = at[here], renumbered[of[here]], marks[keep], place[keep], times[keep]
        yield place, marks, times
        # A phrase longer by a word: this one here and one of the same length at the next place.
        follows = np.flatnonzero(at[1:] == at[:-1] + 1)
        at, keys = at[follows], of[follows] << 32 | of[follows + 1]


def _ranges(marks: np.ndarray, parts: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sorted hashes: the numbers of the ranges that they lie in, of `parts` equal ones, and where these begin and end."""
    part = (marks >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)
    first = np.flatnonzero(np.concatenate(([True], part[1:] != part[:-1]))) if len(part) else np.zeros(0, np.int64)
    return part[first].astype(np.int64), np.append(first, len(part))


def _block_batches(bitmaps: Sequence[bytes], parts: int) -> Callable:
    """Sorted blocks of hashes and counts of the phrases one word longer than the last bitmap's, cut at ranges of the hash."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in token_buffers(batches):
            levels = phrase_levels(numbers, _word_marks(lang, words), bitmaps)
            for _, marks, times in islice(levels, len(bitmaps), len(bitmaps) + 1):
                order = np.argsort(marks)
                marks, times = marks[order], times[order].astype(np.uint32)
                own, edges = _ranges(marks, parts)
                cut = [(marks[a:b].tobytes(), times[a:b].tobytes()) for a, b in zip(edges[:-1], edges[1:])]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(own, pa.int64()), *(pa.array([c[i] for c in cut], pa.binary()) for i in (0, 1))],
                    ["part", "marks", "times"],
                )

    return run


def _merge_batches(least: int) -> Callable:
    """Of blocks sorted by range: the bits of the hashes that occur at least `least` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, marks, times = None, [], []

        def merged() -> pa.RecordBatch:
            keys, of = np.unique(np.frombuffer(b"".join(marks), np.uint64), return_inverse=True)
            sums = np.bincount(of, np.frombuffer(b"".join(times), np.uint32), len(keys))  # exact below 2^53
            bits = np.unique(keys[sums >= least] % np.uint64(BITMAP_BITS))
            return pa.RecordBatch.from_arrays([pa.array(bits.view(np.int64))], ["bit"])

        for batch in batches:
            for part, m, t in zip(*(c.to_pylist() for c in batch.columns)):
                if part != own:
                    yield merged()
                    own, marks, times = part, [], []
                marks.append(m)
                times.append(t)
        yield merged()

    return run


def _bitmap(texts: DataFrame, bitmaps: Sequence[bytes], least: int) -> bytes:
    """Bitmap of the hashes that occur at least `least` times; its size is fixed, whatever their number."""
    n = task_count(texts, 8 << 20)  # a range of hashes is merged in memory
    blocks = texts.mapInArrow(_block_batches(bitmaps, n), "part long, marks binary, times binary")
    dealt = blocks.repartition(n, "part").sortWithinPartitions("part")
    cells = dealt.mapInArrow(_merge_batches(least), "bit long").groupBy(F.shiftright("bit", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, cast(bit & 63 as int))")).alias("bits")
    )
    out = np.zeros(BITMAP_BITS // 64, np.int64)
    found = cells.toArrow()  # BITMAP_BITS / 64 rows at most
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.tobytes()


def _phrase_batches(bitmaps: Sequence[bytes], parts: int) -> Callable:
    """Blocks of phrases and counts, cut at ranges of the hash; the empty phrase counts words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for lang, numbers, words in token_buffers(batches):
            spelled = pa.array(words, pa.binary()).cast(pa.string())
            total = int((numbers != _BREAK).sum())
            levels = phrase_levels(numbers, _word_marks(lang, words), bitmaps)
            found = [(pa.array([""][: total], pa.string()), np.zeros(min(1, total), np.uint64), np.full(min(1, total), total))]
            for length, (place, marks, times) in enumerate(levels, 1):
                ends = pa.array(np.arange(len(place) + 1, dtype=np.int32) * length)
                taken = spelled.take(pa.array(numbers[place[:, None] + np.arange(length)].ravel()))
                found.append((pc.binary_join(pa.ListArray.from_arrays(ends, taken), " "), marks, times))
            phrases = pa.concat_arrays([f[0].cast(pa.string()) for f in found])
            marks, times = (np.concatenate([f[i] for f in found]) for i in (1, 2))
            order = np.argsort(marks, kind="stable")
            own, edges = _ranges(marks[order], parts)
            ends = pa.array(edges.astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(own, pa.int64()), pa.array([lang] * len(own), pa.string()),
                    pa.ListArray.from_arrays(ends, phrases.take(pa.array(order))),
                    pa.ListArray.from_arrays(ends, pa.array(times[order], pa.int64())),
                ],
                ["part", "lang", "phrases", "times"],
            )

    return run


def _sum_batches(least: int) -> Callable:
    """Of blocks sorted by range: the phrases with at least `least` occurrences."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: int | None = None
        sums: dict[str, Counter] = {}

        def summed() -> Iterator[pa.RecordBatch]:
            for lang, counts in sums.items():
                kept = [(p, n) for p, n in counts.items() if n >= least or not p]
                words = pa.array([p.split(" ") if p else [] for p, _ in kept], pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(kept), pa.string()), words, pa.array([n for _, n in kept], pa.int64())],
                    ["lang", "words", "f"],
                )

        for batch in batches:
            for part, lang, phrases, times in zip(*(c.to_pylist() if i < 2 else c for i, c in enumerate(batch.columns))):
                if part != own:
                    yield from summed()
                    own, sums = part, {}
                counts = sums.setdefault(lang, Counter())
                for phrase, n in zip(phrases.as_py(), times.as_py()):
                    counts[phrase] += n
        yield from summed()

    return run


def walk(rows: Iterator[tuple], above: dict) -> Iterator[tuple]:
    """Of rows (part, lang, words, f) in that order: (lang, words, f, counts of what it begins with, largest extension).

    `above` has by part the (lang, words, f) its first row begins with; for them f and counts are None.
    """
    stack: list[list] = []  # words, f, largest count of an extension, whether it is a row of this part
    part = lang = None

    def closed(entry: list, depth: int) -> tuple:
        under = [e[1] for e in stack[:depth]]
        return lang, entry[0], entry[1] if entry[3] else None, under if entry[3] else None, entry[2]

    for at, its_lang, words, f in rows:
        if at != part or its_lang != lang:
            while stack:
                yield closed(stack.pop(), len(stack))
            lang = its_lang
            if at != part:
                part = at
                stack = [[w, n, 0, False] for x, w, n in above.get(at, ()) if x == lang]
        while stack and words[: len(stack[-1][0])] != stack[-1][0]:
            yield closed(stack.pop(), len(stack))
        if stack and len(stack[-1][0]) == len(words) - 1:
            stack[-1][2] = max(stack[-1][2], f)
        stack.append([words, f, 0, True])
    while stack:
        yield closed(stack.pop(), len(stack))


def _walk_batches(above: dict) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
        held = []
        names = ["lang", "words", "f", "under", "longer"]
        kinds = [pa.string(), pa.list_(pa.string()), pa.int64(), pa.list_(pa.int64()), pa.int64()]

        def packed() -> pa.RecordBatch:
            columns = zip(*held) if held else [[]] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names)

        for row in walk(rows, above):
            held.append(row)
            if len(held) >= 10_000:
                yield packed()
                held.clear()
        yield packed()

    return run


def counted_parts(counts: DataFrame) -> DataFrame:
    """lang, words, f, under (counts of the shorter phrases that it begins with, shortest first), longer (largest count of
    an extension by one word); what a task found of phrases of another task's range has a row with f NULL."""
    n = task_count(counts)
    order = ["lang", "words"]
    dealt = counts.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id())
    dealt = stored(dealt.select("part", "lang", "words", "f"), "phrase-stream")
    first = dealt.groupBy("part").agg(F.min(F.struct(*order)).alias("first"))
    sizes = F.sequence(F.lit(0), F.size("first.words") - 1)
    heads = first.filter(F.size("first.words") > 0).select("part", "first.lang", "first.words", F.explode(sizes).alias("size"))
    heads = heads.select("part", "lang", F.slice("words", 1, F.col("size")).alias("words"))
    above: dict[int, list[tuple]] = {}
    for row in heads.join(counts, order).orderBy("part", F.size("words")).collect():  # LONGEST a part at most
        above.setdefault(row["part"], []).append((row["lang"], list(row["words"]), row["f"]))
    streams = dealt.repartition(n, "part").sortWithinPartitions("part", *order)
    return streams.mapInArrow(
        _walk_batches(above), "lang string, words array<string>, f long, under array<long>, longer long"
    )


def frequent_phrases(docs: DataFrame, least: int = LEAST, text: str = "text", lang: str = "lang") -> DataFrame:
    """lang, words, f of all phrases of 0 (every word of the language) to LONGEST words with f >= least; stored."""
    small_batches(docs.sparkSession, 100)  # blocks of phrases are wider than texts
    texts = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), text_or_empty(text).alias("text"))
    texts = texts.filter(F.length("text") > 0)
    bitmaps: list[bytes] = []
    for _ in range(PRUNED):
        bitmaps.append(_bitmap(texts, bitmaps, least))
        release(docs.sparkSession)
    n = task_count(texts, 8 << 20)
    found = texts.mapInArrow(_phrase_batches(bitmaps, n), "part long, lang string, phrases array<string>, times array<long>")
    dealt = found.repartition(n, "part").sortWithinPartitions("part")
    return stored(dealt.mapInArrow(_sum_batches(least), "lang string, words array<string>, f long"), "phrase-counts")


def collocations(
    docs: DataFrame, least: int = LEAST, share: int = 100, top: int = TOP, text: str = "text", lang: str = "lang"
) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` phrases of each language."""
    counts = frequent_phrases(docs, least, text, lang)
    onward = counted_parts(counts).withColumnRenamed("under", "lefts").withColumn("rights", F.lit(None).cast("array<long>"))
    turned = counts.withColumn("words", F.reverse("words"))
    back = counted_parts(turned).withColumn("words", F.reverse("words")).withColumnRenamed("under", "rights")
    both = onward.unionByName(back.withColumn("lefts", F.lit(None).cast("array<long>")))
    facts = both.groupBy("lang", "words").agg(
        F.max("f").alias("a"), F.max("longer").alias("longer"),
        F.first("lefts", ignorenulls=True).alias("lefts"), F.first("rights", ignorenulls=True).alias("rights"),
    )
    kept = facts.filter((F.size("words") >= 2) & (F.col("longer") * 100 < F.col("a") * share))
    kept = kept.withColumn("n", F.col("lefts")[0])
    # lefts[k] is the count of the first k words, rights[m - k] that of the others.
    wide = "cast(cast({} as decimal(19, 0)) * cast({} as decimal(19, 0)) as decimal(38, 0))"
    cut = F.expr(
        "array_min(transform(sequence(1, size(words) - 1), k -> named_struct('score',"
        f" (cast(1000 as decimal(4, 0)) * {wide.format('a', 'n')})"
        f" div {wide.format('lefts[k]', 'rights[size(words) - k]')},"
        " 'k', k, 'l', lefts[k], 'r', rights[size(words) - k])))"
    )
    scored = kept.withColumn("cut", cut).select(
        "lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score"
    )
    best = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = scored.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= top)
    return ranked.select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", "score")
