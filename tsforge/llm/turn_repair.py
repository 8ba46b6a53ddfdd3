"""Conversation repair: the cheapest edits that turn the rows of a conversation into the order system?, (user, assistant)+.

1. `damaged` spoils rows by a rule, `turns` puts all rows in order, names each row's first fault and cuts the rows of a
   conversation into chunks of at most `chunk` rows. Order and chunks come from ranges of (conversation, turn, role,
   text), so a conversation of any length spreads over many tasks. Equal rows are one row with a number of copies first.
2. The edits are a Viterbi search over four states: what was put out last (nothing, s, u or a). Run from the end, it
   gives the least cost that is left for each row and state. Chunks run side by side: all but a conversation's last one
   start from a speculative vector. A chunk's result is right when the vector that it started from and the one its
   successor came to differ by a constant only: all that follows then differs by the same constant. Fix-up passes run
   the other chunks again from their successor's vector until none is left. As a rule one pass does: paths meet after a
   few rows. Where they never do (rows that can only go leave states apart for ever), the chunks left after PASSES
   passes are run from the four unit vectors, and the 4 x 4 matrices of least costs are multiplied along the
   conversation in steps that double in length.
3. Stitched costs: each chunk knows the cost left behind its end, up to a constant. Walking forward, the first letter of
   D, I, K, R that lies on a cheapest path is the next one of the ASCII-least audit; a letter and a state give the next
   state. Chunks are walked from all four states at once; the four ends of each are composed along the conversation,
   again in doubling steps, and the walk from the right state gives audit and rows.
4. Repaired rows are hashed in order. SHA-256 has to see a conversation's text in one pass, so that last step streams it
   through one task, row by row, with nothing held; all else of a long conversation is spread.

Defined cases: in the rule for damage a NULL id or turn is one space, and so is a NULL role or text; NULL turns come
first, rows of the same turn are ordered by role and text; NULL is a conversation id like any other; turn gaps beyond a
long are NULL. Deletes of blank and duplicate rows come before inserts at the same place, as the least audit wants.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tsforge.llm.common import small_batches, stored, task_count

CHUNK = 1_024
PASSES = 4
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
SPACE = " \t\n\x0b\x0c\r"

#: States: nothing put out yet, s, u or a put out last.
NOTHING, S, U, A = range(4)
INSERTED = np.array([U, U, A, U])
#: Class of a row's role by its initial: s, u, a, other. The state after keeping a row of it, -1 where that is not allowed.
KEPT = np.array([[S, U, -1, -1], [-1, U, -1, -1], [-1, -1, A, -1], [-1, U, -1, -1]]).T  # [class, state]
REROLED = np.array([U, U, A, U])
#: Left after the last row: inserts that are still needed.
LAST = np.array([0, 2 * INSERT, INSERT, 0])
FAR = 1 << 40

#: A row's code: class of its role, + 4 if truncated, + 8 if it has to go.
_CLASS, _IS_TRUNCATED, _FORCED = 3, 4, 8

KEY = ["conv", "at"]


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the rows that are left, spoiled by crc32(`conv_id:turn`) % 20."""
    name = F.concat_ws(":", *(F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")))
    kind = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("role", "text"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), kind.alias("kind")).filter("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.translate("text", ".!?", "")).otherwise(
            F.col("text")).alias("text"),
        F.when(F.col("kind") == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def _place_batches(chunk: int) -> Callable:
    """Of sorted rows: the range they lie in, the number of their chunk in range and conversation, the place in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        last: object = ()
        count = 0
        for batch in batches:
            places = []
            for conv in batch.column("conv").to_pylist():
                count = count + 1 if conv == last else 0
                last = conv
                places.append(count)
            at, place = np.divmod(np.array(places, np.int64), chunk)
            added = [pa.array(np.full(len(at), part, np.int32)), pa.array(at), pa.array(place)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], [*batch.schema.names, "part", "chunk", "place"])

    return run


def _text_hash(*columns: str) -> list[Column]:
    return [F.xxhash64(F.lit(i), *columns).alias(f"h{i}") for i in (1, 2)]


def turns(rows: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Stored rows in order: conv (struct of conv_id), turn, role, text, copies, part, chunk, place, h1, h2, blank,
    truncated."""
    merged = rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    facts = merged.select(
        F.struct("conv_id").alias("conv"), "turn", "role", "text", "copies", *_text_hash("role", "text"),
        (end == "").alias("blank"), (~end.isin(".", "!", "?")).alias("truncated"),
    )
    order = ["conv", F.asc_nulls_first("turn"), "role", "text"]
    dealt = facts.repartitionByRange(task_count(rows), *order).sortWithinPartitions(*order)
    kinds = ", ".join(f"{n} {t}" for n, t in dealt.dtypes)
    return stored(dealt.mapInArrow(_place_batches(chunk), f"{kinds}, part int, chunk long, place long"), "turns")


def _repeats(rows: DataFrame) -> DataFrame:
    """conv, h1, h2, salt, first (turn) of texts that a conversation has under several turns.

    One row for each salt that occurs, so that the join with a text of very many turns is spread.
    """
    same = rows.groupBy("conv", "h1", "h2").agg(
        F.min(F.struct(F.col("turn").isNotNull().alias("is"), "turn")).alias("first"), F.count("*").alias("times"),
        F.collect_set(_salt()).alias("salts"),  # 32 at most
    )
    return stored(
        same.filter("times > 1").select("conv", "h1", "h2", "first.turn", F.explode("salts").alias("salt")), "repeats"
    )


def _salt() -> Column:
    return F.pmod(F.xxhash64("turn"), F.lit(32)).cast("int")


def coded(rows: DataFrame) -> DataFrame:
    """rows without texts, with `duplicate` and `code`."""
    narrow = rows.drop("text").withColumn("salt", _salt())
    first = _repeats(rows).withColumnRenamed("turn", "first").withColumn("again", F.lit(True))
    joined = narrow.join(first, ["conv", "h1", "h2", "salt"], "left")
    later = F.col("again").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    initial = F.left("role", F.lit(1))
    kind = F.when(initial == "s", 0).when(initial == "u", 1).when(initial == "a", 2).otherwise(3)
    joined = joined.withColumn("duplicate", ~F.col("blank") & later)
    forced = F.col("blank") | F.col("duplicate")
    code = kind + F.when(forced, _FORCED).when(F.col("truncated"), _IS_TRUNCATED).otherwise(0)
    return joined.withColumn("code", code.cast("int")).drop("salt", "again", "first", "h1", "h2")


def _counts(rows: DataFrame) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated."""
    first = F.when(F.col("code") < _FORCED, 1).otherwise(0)
    wide = "decimal(20, 0)"
    span = F.max("turn").cast(wide) - F.min("turn").cast(wide) + 1 - F.count_distinct("turn").cast(wide)
    return rows.groupBy("conv").agg(
        F.when(F.count("turn") > 0, span).otherwise(F.lit(0)).alias("gaps"),
        F.sum(F.when(F.col("blank"), F.col("copies")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("copies") - first)).alias("duplicate"),
        F.sum(F.when((F.col("code") >= _IS_TRUNCATED) & (F.col("code") < _FORCED), 1).otherwise(0)).alias("truncated"),
    )


def chunked(rows: DataFrame) -> DataFrame:
    """Stored, one row a chunk: conv, at (its number in the conversation), n_chunks, part, chunk, codes, copies."""
    entry = F.struct("place", "code", "copies")
    lists = rows.groupBy("conv", "part", "chunk").agg(F.sort_array(F.collect_list(entry)).alias("rows"))
    parts = rows.groupBy("conv", "part").agg((F.max("chunk") + 1).alias("chunks"))
    # As many rows a conversation as there are ranges, at most.
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("conv")
    starts = parts.select(
        F.struct("conv", "part").alias("_key"), F.coalesce(F.sum("chunks").over(before), F.lit(0)).alias("start"),
        F.sum("chunks").over(whole).alias("n_chunks"),
    )
    placed = lists.withColumn("_key", F.struct("conv", "part")).join(starts, "_key")
    return stored(
        placed.select(
            "conv", (F.col("start") + F.col("chunk")).alias("at"), "n_chunks", "part", "chunk",
            F.col("rows.code").alias("codes"), F.col("rows.copies").alias("copies"),
        ), "chunks",
    )


class Costs:
    """The rows of several chunks side by side, aligned at their ends, and the least costs left before each of them."""

    def __init__(self, codes: list[np.ndarray], copies: list[np.ndarray], ends: np.ndarray) -> None:
        self.n, self.size = len(codes), max(map(len, codes), default=0)
        # Places before a chunk's first row: rows of no cost that have to go.
        self.code = np.full((self.n, self.size), -1, np.int64)
        self.extra = np.zeros((self.n, self.size), np.int64)
        for i, (c, m) in enumerate(zip(codes, copies)):
            if len(c):
                self.code[i, -len(c) :] = c
                self.extra[i, -len(c) :] = m - 1
        self.ends = ends
        self.left = np.empty((self.size + 1, *ends.shape), np.int64)
        self.left[self.size] = inserted(ends)
        for at in range(self.size - 1, -1, -1):
            delete, keep, rerole, extra = self.steps(at)
            self.left[at] = inserted(np.minimum(delete, np.minimum(keep, rerole)) + extra)
            blank = self.code[:, at] < 0
            self.left[at][blank] = self.left[at + 1][blank]

    def steps(self, at: int) -> tuple[np.ndarray, ...]:
        """Costs left if the row is deleted, kept or gets another role; and those of its copies."""
        after, code = self.left[at + 1], self.code[:, at]
        free, cut = code & _CLASS, TRUNCATED * (code & _IS_TRUNCATED > 0)[:, None]
        forced = (code >= _FORCED)[:, None]
        target = KEPT[free]
        keep = np.where(forced | (target < 0), FAR, np.take_along_axis(after, np.maximum(target, 0), 1) + cut)
        rerole = np.where(forced, FAR, after[:, REROLED] + REROLE + cut)
        return after + DELETE, keep, rerole, DELETE * self.extra[:, at, None]

    def walk(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """From each chunk's state: letter of each row, inserts before it, state after the last row."""
        letters = np.zeros((self.n, self.size), "S1")
        inserts = np.zeros((self.n, self.size), np.int64)
        row = np.arange(self.n)
        state = states.copy()
        for at in range(self.size):
            delete, keep, rerole, extra = self.steps(at)
            here = self.left[at]
            real = self.code[:, at] >= 0
            goes = (delete + extra)[row, state] == here[row, state]
            for _ in range(2):  # an insert, and one more, before a row that stays
                more = real & ~goes & (here[row, INSERTED[state]] + INSERT == here[row, state])
                inserts[more, at] += 1
                state = np.where(more, INSERTED[state], state)
                goes = (delete + extra)[row, state] == here[row, state]
            stays = real & ~goes
            kept = stays & ((keep + extra)[row, state] == here[row, state])
            letters[real & goes, at], letters[kept, at], letters[stays & ~kept, at] = b"D", b"K", b"R"
            state = np.where(kept, KEPT[self.code[:, at] & _CLASS, state], np.where(stays, REROLED[state], state))
        return letters, inserts, state


def inserted(costs: np.ndarray) -> np.ndarray:
    """Costs if rows may be inserted first: one, and one more."""
    for _ in range(2):
        costs = np.minimum(costs, costs[..., INSERTED] + INSERT)
    return costs


def _arrays(column: pa.Array) -> list[np.ndarray]:
    return [np.array(x.as_py(), np.int64) for x in column]


def _several(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """Slices of a batch, chunks of like length together."""
    batch = batch.take(pa.array(np.argsort([len(x) for x in batch.column("codes")], kind="stable")))
    for at in range(0, batch.num_rows, rows):
        yield batch.slice(at, rows)


def _vector_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _several(batch):
            ends = np.array(part.column("ends").to_pylist(), np.int64).reshape(-1, 4)
            costs = Costs(_arrays(part.column("codes")), _arrays(part.column("copies")), ends)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv"), part.column("at"), part.column("ends"), pa.array(costs.left[0].tolist(), pa.list_(pa.int64()))],
                ["conv", "at", "ends", "starts"],
            )


def _run(chunks: DataFrame, conv: str) -> DataFrame:
    """conv, at, ends, starts: costs left before the first row of each chunk, given those after its last one."""
    rows = chunks.select(*KEY, "codes", "copies", "ends")
    return rows.mapInArrow(_vector_batches, f"conv {conv}, at long, ends array<long>, starts array<long>")


def _numbers(values: np.ndarray | list[int]) -> Column:
    return F.array(*(F.lit(int(x)).cast("long") for x in values))


def _parallel(a: str, b: str) -> Column:
    """Whether two vectors differ by a constant only."""
    same = [F.col(a)[i] - F.col(b)[i] == F.col(a)[0] - F.col(b)[0] for i in range(1, 4)]
    return same[0] & same[1] & same[2]


def _doubled(values: DataFrame, combine: str) -> DataFrame:
    """(conv, at, m) -> m combined with those of all later chunks of the conversation, in doubling steps.

    `combine` is SQL over a (this chunk's) and b (of the chunks that follow).
    """
    step = 1
    longest = values.agg(F.max("at")).first()[0] or 0
    while step <= longest:
        ahead = values.select("conv", (F.col("at") - step).alias("at"), F.col("m").alias("b"))
        joined = values.withColumnRenamed("m", "a").join(ahead, KEY, "left")
        values = stored(joined.select(*KEY, F.expr(f"if(b is null, a, {combine})").alias("m")), "doubled")
        step *= 2
    return values


#: Least-cost product of 4 x 4 matrices, row by row in an array of 16.
_PRODUCT = (
    "transform(sequence(0, 15), t -> array_min(transform(sequence(0, 3),"
    f" j -> least({FAR}L, a[t div 4 * 4 + j] + b[j * 4 + t % 4]))))"
)
#: The state after each state: that after the earlier chunks (b), then this one (a).
_COMPOSED = "transform(b, s -> a[s])"


def _matrix_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _several(batch, 64):
            codes, copies = _arrays(part.column("codes")), _arrays(part.column("copies"))
            units = np.where(np.eye(4, dtype=bool), 0, FAR)
            # One run from each unit vector; by row: cost from a state to each state at the end.
            columns = [Costs(codes, copies, np.tile(u, (len(codes), 1))).left[0] for u in units]
            matrix = np.stack(columns, axis=2).reshape(-1, 16)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv"), part.column("at"), pa.array(matrix.tolist(), pa.list_(pa.int64()))], ["conv", "at", "m"]
            )


def _next(vectors: DataFrame) -> DataFrame:
    """conv, at, coming: the vector that the successor of chunk `at` came to."""
    return vectors.select("conv", (F.col("at") - 1).alias("at"), F.col("starts").alias("coming"))


def stitched(chunks: DataFrame, passes: int = PASSES) -> DataFrame:
    """conv, at, ends, starts, extra: vectors of all chunks, right up to a constant, and that constant against the
    successor's vector (0 for the last chunk)."""
    conv = chunks.schema["conv"].dataType.simpleString()
    guess = F.when(F.col("at") == F.col("n_chunks") - 1, _numbers(LAST)).otherwise(_numbers([0] * 4))
    vectors = stored(_run(chunks.withColumn("ends", guess), conv), "vectors")
    several = chunks.filter("n_chunks > 1")
    known = vectors.join(_next(vectors), KEY, "left")
    wrong = stored(known.filter(F.col("coming").isNotNull() & ~_parallel("coming", "ends")).select(*KEY, "coming"), "open")
    done = 0
    while not wrong.isEmpty():
        if done < passes:
            todo = several.join(wrong, KEY).withColumnRenamed("coming", "ends")
            again = _run(todo, conv)
        else:
            again = _by_matrices(several, wrong, conv)
        rest = vectors.join(again.select(*KEY), KEY, "left_anti") if done >= passes else vectors.join(wrong, KEY, "left_anti")
        vectors = stored(rest.unionByName(again), "vectors")
        known = vectors.join(_next(vectors), KEY, "left")
        wrong = stored(known.filter(F.col("coming").isNotNull() & ~_parallel("coming", "ends")).select(*KEY, "coming"), "open")
        done += 1
    return stored(known.withColumn("extra", F.coalesce(F.col("coming")[0] - F.col("ends")[0], F.lit(0).cast("long"))), "stitched")


def _by_matrices(several: DataFrame, wrong: DataFrame, conv: str) -> DataFrame:
    """Vectors of all chunks of the conversations that have wrong ones."""
    chunks = several.join(wrong.select("conv").distinct(), "conv", "left_semi")
    rows = chunks.select(*KEY, "codes", "copies")
    own = stored(rows.mapInArrow(_matrix_batches, f"conv {conv}, at long, m array<long>"), "matrices")
    products = _doubled(own, _PRODUCT)
    last = f"array({', '.join(map(str, LAST))})"
    starts = products.select(
        *KEY, F.expr(f"transform(sequence(0, 3), i -> array_min(transform(sequence(0, 3), j -> m[i * 4 + j] + {last}[j])))")
        .cast("array<long>").alias("starts"),
    )
    ends = starts.select("conv", (F.col("at") - 1).alias("at"), F.col("starts").alias("ends"))
    whole = starts.join(ends, KEY, "left")
    return whole.select(*KEY, F.coalesce("ends", _numbers(LAST)).alias("ends"), "starts")


def _map_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _several(batch):
            ends = np.array(part.column("ends").to_pylist(), np.int64).reshape(-1, 4)
            costs = Costs(_arrays(part.column("codes")), _arrays(part.column("copies")), ends)
            after = np.stack([costs.walk(np.full(costs.n, s))[2] for s in range(4)], axis=1)
            yield pa.RecordBatch.from_arrays(
                [part.column("conv"), part.column("at"), pa.array(after.tolist(), pa.list_(pa.int64()))], ["conv", "at", "m"]
            )


def entries(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """conv, at, state: the state in which the least audit comes to each chunk but a conversation's first."""
    conv = chunks.schema["conv"].dataType.simpleString()
    several = chunks.filter((F.col("n_chunks") > 1) & (F.col("at") < F.col("n_chunks") - 1))
    rows = several.select(*KEY, "codes", "copies").join(vectors.select(*KEY, "ends"), KEY)
    maps = stored(rows.mapInArrow(_map_batches, f"conv {conv}, at long, m array<long>"), "state-maps")
    # Composed from the front: numbers run backwards, so that "later" means "before".
    top = maps.agg(F.max("at")).first()[0] or 0
    composed = _doubled(maps.withColumn("at", F.lit(top) - F.col("at")), _COMPOSED)
    return composed.select("conv", (F.lit(top + 1) - F.col("at")).alias("at"), F.col("m")[NOTHING].alias("state"))


def _audit_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv", "at", "part", "chunk", "audit", "illegal", "first", "last", "letters", "inserts", "state", "tail"]
    for batch in batches:
        for part in _several(batch):
            ends = np.array(part.column("ends").to_pylist(), np.int64).reshape(-1, 4)
            codes, copies = _arrays(part.column("codes")), _arrays(part.column("copies"))
            costs = Costs(codes, copies, ends)
            state = part.column("state").to_numpy()
            letters, inserts, after = costs.walk(state)
            last = part.column("last").to_pylist()
            audits, illegal, heads, tails, all_letters, all_inserts, closing = [], [], [], [], [], [], []
            for i, (c, m) in enumerate(zip(codes, copies)):
                own, more = letters[i, costs.size - len(c) :], inserts[i, costs.size - len(c) :]
                end = int(LAST[after[i]] // INSERT) if last[i] else 0
                pieces = ["I" * int(n) + x.decode() + "D" * int(k - 1) for x, n, k in zip(own, more, m)]
                audits.append("".join(pieces) + "I" * end)
                kind = c & _CLASS
                fine = ((kind[:-1] == 0) & (kind[1:] == 1)) | ((kind[:-1] == 1) & (kind[1:] == 2)) | ((kind[:-1] == 2) & (kind[1:] == 1))
                illegal.append(int((~fine).sum() + (m - 1).sum()))
                heads.append(int(kind[0]))
                tails.append(int(kind[-1]))
                all_letters.append(own.tobytes().decode())
                all_inserts.append(more.tolist())
                closing.append(end)
            longs = pa.int64()
            yield pa.RecordBatch.from_arrays(
                [
                    *(part.column(n) for n in ("conv", "at", "part", "chunk")), pa.array(audits, pa.string()),
                    pa.array(illegal, longs), pa.array(heads, longs), pa.array(tails, longs), pa.array(all_letters, pa.string()),
                    pa.array(all_inserts, pa.list_(longs)), part.column("state"), pa.array(closing, longs),
                ], names,
            )


def audited(chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """Stored, per chunk: its part of the audit, illegal pairs, and letter and inserts of each row."""
    conv = chunks.schema["conv"].dataType.simpleString()
    state = entries(chunks, vectors)
    rows = chunks.join(vectors.select(*KEY, "ends"), KEY).join(state, KEY, "left").select(
        "conv", "at", "part", "chunk", "codes", "copies", "ends", F.coalesce("state", F.lit(NOTHING).cast("long")).alias("state"),
        (F.col("at") == F.col("n_chunks") - 1).alias("last"),
    )
    schema = (
        f"conv {conv}, at long, part int, chunk long, audit string, illegal long, first long, last long, letters string,"
        " inserts array<long>, state long, tail long"
    )
    return stored(rows.mapInArrow(_audit_batches, schema), "audits")


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by conversation and place; a row of tag 0 has the edits of a chunk, those of tag 1 its texts."""
    conv: object = ()
    done: list[tuple] = []
    digest, any_line, state, letters, inserts, tail = hashlib.sha256(), False, NOTHING, "", [], 0
    kinds = None

    def line(role: str, text: str) -> None:
        nonlocal any_line
        digest.update((("\n" if any_line else "") + role + ":" + text).encode())
        any_line = True

    def insert(times: int) -> None:
        nonlocal state
        for _ in range(times):
            state = int(INSERTED[state])
            line("user" if state == U else "assistant", "")

    def packed() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array([d[0] for d in done], kinds), pa.array([d[1] for d in done], pa.string())], ["conv", "repaired_sha256"]
        )

    for batch in batches:
        kinds = batch.schema.field("conv").type
        columns = (batch.column(n).to_pylist() for n in ("conv", "tag", "place", "role", "letters", "inserts", "tail"))
        for number, (its, tag, place, role, own, more, end) in enumerate(zip(*columns)):
            if its != conv:
                if conv != ():
                    insert(tail)
                    done.append((conv, digest.hexdigest()))
                conv, digest, any_line, state, tail = its, hashlib.sha256(), False, NOTHING, 0
            if tag == 0:
                letters, inserts, tail = own, more, end
                continue
            insert(inserts[place])
            letter = letters[place]
            if letter == "K":
                state = {"s": S, "u": U, "a": A}[role[0]]
                line(role, batch.column("text")[number].as_py())
            elif letter == "R":
                state = int(REROLED[state])
                line("user" if state == U else "assistant", batch.column("text")[number].as_py())
        if done:
            yield packed()
            done = []
    if conv != ():
        insert(tail)
        done.append((conv, digest.hexdigest()))
        yield packed()


def digests(rows: DataFrame, audits: DataFrame) -> DataFrame:
    """conv, repaired_sha256."""
    nothing = F.lit(None)
    order = ["conv", "part", "chunk", "tag", "place"]
    texts = rows.select(
        "conv", "part", "chunk", F.lit(1).alias("tag"), "place", "role", "text", nothing.cast("string").alias("letters"),
        nothing.cast("array<long>").alias("inserts"), nothing.cast("long").alias("tail"),
    )
    edits = audits.select(
        "conv", "part", "chunk", F.lit(0).alias("tag"), F.lit(0).cast("long").alias("place"), nothing.cast("string").alias("role"),
        nothing.cast("string").alias("text"), "letters", "inserts", "tail",
    )
    conv = rows.schema["conv"].dataType.simpleString()
    both = texts.unionByName(edits).repartition(task_count(rows), "conv").sortWithinPartitions(*order)
    return both.select("conv", "tag", "place", "role", "text", "letters", "inserts", "tail").mapInArrow(
        _digest_batches, f"conv {conv}, repaired_sha256 string"
    )


def repaired(rows: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """Per conversation of rows (conv_id, turn, role, text, copies): conv, gaps, blank, duplicate, truncated, illegal,
    cost, audit, repaired_sha256."""
    small_batches(rows.sparkSession)
    ordered = turns(rows, chunk)
    marked = stored(coded(ordered), "codes")
    chunks = chunked(marked)
    vectors = stitched(chunks, passes)
    audits = audited(chunks, vectors)
    cost = vectors.groupBy("conv").agg(
        (F.sum("extra") + F.max(F.when(F.col("at") == 0, F.col("starts")[NOTHING]))).alias("cost")
    )
    # The pair across the end of a chunk counts with the chunk.
    following = audits.select("conv", (F.col("at") - 1).alias("at"), F.col("first").alias("following"))
    legal = F.concat("last", "following").isin("01", "12", "21")
    across = F.when(F.col("following").isNotNull() & ~legal, 1).otherwise(0)
    lines = audits.join(following, KEY, "left").groupBy("conv").agg(
        F.sum(F.col("illegal") + across).alias("illegal"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "audit"))), lambda x: x["audit"]), "").alias("audit"),
    )
    return _counts(marked).join(cost, "conv").join(lines, "conv").join(digests(ordered, audits), "conv")


def repair_report(conversations: DataFrame, chunk: int = CHUNK, passes: int = PASSES) -> DataFrame:
    """Every conv_id of the rows before damage, and what `repaired` says of those after it."""
    everyone = conversations.groupBy("conv_id").agg(F.lit(1).alias("_one")).select(F.struct("conv_id").alias("conv"))
    found = everyone.join(repaired(damaged(conversations), chunk, passes), "conv", "left")
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    missing = F.col("audit").isNull()
    return found.select(
        F.col("conv.conv_id").alias("conv_id"),
        *(F.when(missing, F.lit(0)).otherwise(F.expr(f"try_cast({n} as bigint)")).cast("long").alias(n) for n in numbers),
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashlib.sha256().hexdigest())).alias("repaired_sha256"),
    )
