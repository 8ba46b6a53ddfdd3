"""Packing of token pieces into as few sequences as possible, by exact complements and best fit.

1. Every text is encoded, gets an end id and, if longer than a sequence, is cut into full pieces, the first one taking
   the remainder. Pieces are stored with their ids; a piece knows its task and its rank among the task's pieces of the
   same length.
2. Only the number of pieces of each length matters for the plan. That histogram has at most one entry per possible
   length, whatever the input. The plan takes lengths from long to short and fills the gap a piece leaves exactly: by
   one piece of that length, else by a pair, else by a triple whose lengths add up to it, looked up in indexes of the
   lengths still available; a combination is consumed as often as its counts allow. What is left is packed by best fit,
   decreasing, again in counts. The plan is a list of (pattern, how often); its size depends on the number of lengths.
3. A piece's rank among all pieces of its length follows from the counts of the tasks before its own, and the plan says
   which sequence and offset that rank has. No piece is shuffled for it; a length that holds a third of all pieces is
   ranked in as many tasks as it lies in.

Defined cases: a NULL text is empty; an empty text is a piece with only the end id; repeated rows and rows without
doc_id are packed like all others; an empty table gives no piece.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tsforge.llm.common import small_batches, stored, text_or_empty
from tsforge.llm.fast_ids import word_ids

SEQUENCE = 2_048
END_ID = 0
PIECES = (
    "doc_id long, piece int, start long, length int, ids_crc32 long, ids binary, part int, nth long"
)


def cut(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of n ids: full ones, the first taking the remainder."""
    first = (n % size or size) if n > size else n
    return [(0, first), *((s, size) for s in range(first, n, size))]


def _piece_rows(tokenizer_path: str, end_id: int, size: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encoder = word_ids(tokenizer_path)
        width = 2 if encoder.code == "H" else 4
        end, part = end_id.to_bytes(width, "little"), TaskContext.get().partitionId()
        ranks: Counter[int] = Counter()
        names = [x.split()[0] for x in PIECES.split(", ")]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int32(), pa.int64()]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = encoder.encode(text.as_py()) + end
                for piece, (start, length) in enumerate(cut(len(ids) // width, size)):
                    own = ids[start * width : (start + length) * width]
                    wide = np.frombuffer(own, f"<u{width}").astype("<u4").tobytes()
                    rows.append((doc_id, piece, start, length, zlib.crc32(wide), own, part, ranks[length]))
                    ranks[length] += 1
            columns = zip(*rows) if rows else [[] for _ in names]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    return run


def plan_sequences(histogram: dict[int, int], size: int) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, number of such sequences); a bounded computation on counts."""
    left = np.zeros(size + 1, np.int64)
    for length, count in histogram.items():
        left[length] = count
    plan: list[tuple[tuple[int, ...], int]] = []

    def consume(pattern: tuple[int, ...]) -> None:
        need = Counter(pattern)
        times = min(int(left[x]) // k for x, k in need.items())
        for x, k in need.items():
            left[x] -= k * times
        plan.append((pattern, times))

    def there(pattern: tuple[int, ...]) -> bool:
        return all(left[x] >= k for x, k in Counter(pattern).items())

    def pair(total: int, most: int) -> tuple[int, int] | None:
        """Two available lengths with this sum, the longer first and at most `most`."""
        a = np.arange(-(-total // 2), min(most, total - 1) + 1)
        hits = a[(left[a] > 0) & (left[total - a] > 0)]
        for x in hits[::-1]:
            if there((int(x), total - int(x))):
                return int(x), total - int(x)
        return None

    for length in range(size, 0, -1):
        if left[length] and length == size:
            consume((length,))
        gap = size - length
        while left[length] and 0 < gap <= length and left[gap] and there((length, gap)):
            consume((length, gap))
        while left[length] and (two := pair(gap, length)) and there((length, *two)):
            consume((length, *two))
        # Sums of pairs that are there, then the third length.
        if left[length] and gap >= 3:
            sums = _pair_sums(left, gap)
            for c in range(min(length, gap - 2), 0, -1):
                while left[length] and left[c] and sums[gap - c]:
                    two = pair(gap - c, c)
                    if two is None or not there((length, c, *two)):
                        break
                    consume((length, c, *two))
    return plan + _best_fit(left, size)


def _pair_sums(left: np.ndarray, most: int) -> np.ndarray:
    """Which totals up to `most` are the sum of two available lengths."""
    flags = (left[: most + 1] > 0).astype(np.float64)
    n = 1 << (2 * most + 1).bit_length()
    return np.fft.irfft(np.fft.rfft(flags, n) ** 2, n)[: most + 1] > 0.5


def _best_fit(left: np.ndarray, size: int) -> list[tuple[tuple[int, ...], int]]:
    """Best fit, decreasing, on counts: groups of equal open sequences instead of single ones."""
    open_: dict[int, list[list]] = defaultdict(list)  # by gap: [pattern, count]
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], count: int) -> None:
        gap = size - sum(pattern)
        if not open_[gap]:
            insort(gaps, gap)
        open_[gap].append([pattern, count])

    for length in range(size, 0, -1):
        rest = int(left[length])
        while rest:
            at = bisect_left(gaps, length)
            if at == len(gaps):
                fit = size // length
                if whole := rest // fit:
                    put((length,) * fit, whole)
                if rest % fit:
                    put((length,) * (rest % fit), 1)
                break
            gap = gaps[at]
            group = open_[gap][-1]
            fit = min(gap // length, rest)
            used = min(group[1], rest // fit)
            group[1] -= used
            if not group[1]:
                open_[gap].pop()
                if not open_[gap]:
                    gaps.pop(at)
            put(group[0] + (length,) * fit, used)
            rest -= used * fit
    return [(p, n) for groups in open_.values() for p, n in groups]


def plan_table(plan: list[tuple[tuple[int, ...], int]]) -> dict[str, np.ndarray]:
    """For each run of ranks of a length: first rank, first sequence, offset; ranks in a run go to successive sequences."""
    taken: Counter[int] = Counter()
    rows, sequence = [], 0
    for pattern, times in plan:
        offset = 0
        for length in pattern:
            rows.append((length, taken[length], sequence, offset))
            taken[length] += times
            offset += length
        sequence += times
    rows.sort()
    names = ("length", "rank", "sequence", "offset")
    return {n: np.array([r[i] for r in rows], np.int64) for i, n in enumerate(names)}


def _placer(table: dict[str, np.ndarray], columns: list[str]) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = np.searchsorted(table["length"], np.arange(table["length"].max(initial=0) + 2))
        for batch in batches:
            length = batch.column("length").to_numpy()
            rank = batch.column("rank").to_numpy()
            at = np.zeros(len(length), np.int64)
            for one in np.unique(length):  # at most as many as there are lengths
                here = length == one
                a, b = bounds[one], bounds[one + 1]
                at[here] = a + np.searchsorted(table["rank"][a:b], rank[here], side="right") - 1
            out = {c: batch.column(c) for c in columns}
            out["sequence_id"] = pa.array(table["sequence"][at] + rank - table["rank"][at], pa.int64())
            out["offset"] = pa.array(table["offset"][at], pa.int64())
            yield pa.RecordBatch.from_pydict(out)

    return run


def pack(
    docs: DataFrame, tokenizer_path: str, size: int = SEQUENCE, end_id: int = END_ID, text: str = "text",
    with_ids: bool = True,
) -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and its packed ids if wanted."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    pieces = stored(rows.mapInArrow(_piece_rows(tokenizer_path, end_id, size), PIECES), "pieces")
    counts = pieces.groupBy("part", "length").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("part", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    histogram = {r[0]: r[1] for r in pieces.groupBy("length").agg(F.count("*")).collect()}  # at most `size` rows
    table = plan_table(plan_sequences(histogram, size))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *(["ids"] if with_ids else [])]
    ranked = pieces.select(*columns, "part", "nth").join(bases, ["part", "length"])
    ranked = ranked.withColumn("rank", F.col("nth") + F.col("base")).select(*columns, "rank")
    kinds = dict(pieces.dtypes) | {"sequence_id": "long", "offset": "long"}
    schema = ", ".join(f"`{c}` {kinds[c]}" for c in (*columns, "sequence_id", "offset"))
    return ranked.mapInArrow(_placer(table, columns), schema)


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed ids of each whole sequence, pieces in order (a sequence is at most `size` ids)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.unhex(F.lit("")), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"))
