"""SentencePiece encoding and decoding by streaming Viterbi.

The text is read character by character. Scores are kept only for the last `longest` boundaries, the longest piece's
length; ids are committed and forgotten as soon as every surviving path goes through one boundary: at once where no
piece found so far reaches over it, and else, when the pending stretch grows, by following the paths of the surviving
boundaries back to where they meet. A paused or very long text thus needs the memory of a few words.

Where no piece of the model can reach over the start of a word, words are independent of each other; their ids are
kept in a bounded cache per worker, and only new words are searched.

Defined cases: NULL and empty texts have no ids and decode to the empty text; every other text decodes to itself, except
that the mark U+2581 written in a text comes back as a space; rows are treated one by one, so repeated rows, missing
doc_ids and other columns do not matter.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import small_batches, text_or_empty, worker_state
from tsforge.llm.piece_model import PieceModel, marked, piece_model, segments

CACHED_WORDS = 250_000
CACHED_LENGTH = 48


class StreamingEncoder:
    """Feed text in any portions, get committed ids. Boundaries are counted from the last committed one."""

    def __init__(self, model: PieceModel) -> None:
        self.model = model
        self.widest = 0  # longest pending stretch seen
        self.reset()

    def reset(self) -> None:
        self.scores = [0.0]  # best score of a path to each pending boundary
        self.starts = [0]  # where the last piece of that path starts
        self.pieces = [-1]  # its id; of an unknown character -1
        self.pending = ""
        self.open: list[tuple[int, dict]] = []  # (start, trie node) of pieces that may still grow

    def _path(self, end: int) -> list[int]:
        ids: list[int] = []
        while end:
            start, piece = self.starts[end], self.pieces[end]
            if piece >= 0:
                ids.append(piece)
            else:
                ids += reversed(self.model.character_ids(self.pending[start]))
            end = start
        ids.reverse()
        return ids

    def _commit(self, at: int, out: list[int]) -> None:
        out += self._path(at)
        base = self.scores[at]
        self.scores = [0.0, *(x - base for x in self.scores[at + 1 :])]
        self.starts = [0, *(x - at for x in self.starts[at + 1 :])]
        self.pieces = [-1, *self.pieces[at + 1 :]]
        self.pending = self.pending[at:]
        self.open = [(s - at, node) for s, node in self.open]

    def _meeting(self) -> int:
        """The last boundary that the paths of all boundaries a piece may still start or end at share."""
        alive = {len(self.scores) - 1, *(s for s, _ in self.open)}
        while len(alive) > 1:
            top = max(alive)
            alive.remove(top)
            alive.add(self.starts[top])
        return alive.pop()

    def feed(self, text: str) -> list[int]:
        """Reads text; the ids that no further text can change."""
        model, trie, unknown = self.model, self.model.trie, self.model.unknown_score
        longest, out = 4 * model.longest, []
        self.pending += text
        scores, starts, pieces = self.scores, self.starts, self.pieces
        for c in text:
            single = len(scores) - 1
            self.open.append((single, trie))
            best, start, piece = None, single, -1
            grown = []
            for s, node in self.open:  # by start: the longest last piece first
                child = node.get(c)
                if child is None:
                    continue
                if type(child) is dict:
                    grown.append((s, child))
                    child = child.get("")
                    if child is None:
                        continue
                score = scores[s] + child[1]
                if best is None or score > best:
                    best, start, piece = score, s, child[0]
            if best is None or (c not in model.pieces and scores[single] + unknown > best):
                best, start, piece = scores[single] + unknown, single, -1
            self.open = grown
            scores.append(best)
            starts.append(start)
            pieces.append(piece)
            # With no piece that can still grow, all paths lead through here. Else look where they meet.
            at = 0
            if not grown:
                at = single + 1
            elif single >= longest:
                at = self._meeting()
            if at:
                self.widest = max(self.widest, single + 1)
                self._commit(at, out)
                scores, starts, pieces = self.scores, self.starts, self.pieces
        return out

    def finish(self) -> list[int]:
        ids = self._path(len(self.scores) - 1)
        self.reset()
        return ids

    def encode(self, text: str) -> list[int]:
        """All ids of one (marked) text."""
        return self.feed(text) + self.finish()


class WordPieces(dict):
    """Ids of independent words; two bounded generations."""

    def __init__(self, path: str) -> None:
        self.model = piece_model(path)
        self.encoder = StreamingEncoder(self.model)
        self.older: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            # No piece reaches from the last letter to the sign after it: both parts are words of their own.
            if len(word) > 2 and word[-1] in ".,;:!?" and word[-2:] not in self.model.neighbours:
                ids = self[word[:-1]] + self[word[-1]]
            else:
                ids = array("I", self.encoder.encode(word)).tobytes()
        if len(word) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids

    def encode(self, text: str) -> bytes:
        return b"".join([self[w] for w in segments(marked(text), self.model.words_apart)])


def word_pieces(path: str) -> WordPieces:
    return worker_state(f"words:{path}", lambda: WordPieces(path))


def _encode_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_pieces(path)
        for batch in batches:
            ids = [words.encode(t.as_py()) for t in batch.column(1)]
            offsets = np.cumsum([0, *(len(x) // 4 for x in ids)]).astype(np.int32)
            values = pa.array(np.frombuffer(b"".join(ids), np.int32))
            lists = pa.ListArray.from_arrays(pa.array(offsets), values)
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["doc_id", "ids"])

    return run


def encode_pieces(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_encode_batches(model_path), "doc_id long, ids array<int>")


def _decode_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = piece_model(path)
        for batch in batches:
            texts = [model.decode(x.as_py() or []) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())],
                                             ["doc_id", "ids", "text"])

    return run


def decode_pieces(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id, ids, text."""
    small_batches(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(
        _decode_batches(model_path), "doc_id long, ids array<int>, text string"
    )


def _round_trip_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, model = word_pieces(path), piece_model(path)
        for batch in batches:
            rows = []
            for text in batch.column(1):
                ids = words.encode(text.as_py())
                back = model.decode(memoryview(ids).cast("I"))
                rows.append((len(ids) // 4, zlib.crc32(ids), hashlib.sha256(back.encode()).hexdigest()))
            n, crcs, shas = zip(*rows) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(crcs, pa.int64()), pa.array(shas, pa.string())],
                ["doc_id", "n_ids", "ids_crc32", "decoded_sha256"],
            )

    return run


def round_trip(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of the ids as little-endian unsigned 32-bit integers) of the encoded text, and
    decoded_sha256 of what these ids decode to; encoded and decoded in one pass."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(
        _round_trip_batches(model_path), "doc_id long, n_ids long, ids_crc32 long, decoded_sha256 string"
    )
