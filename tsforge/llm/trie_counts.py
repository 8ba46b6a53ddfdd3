"""Token counts by dynamic programming on a trie of pre-tokens.

Distinct pre-tokens (words with their leading mark) are put into a trie. Every node holds the unigram forward score of
the prefix it stands for and the number of tokens of the best segmentation, computed once from the scores of its
ancestors, so words that share a prefix share the work; where a pre-token ends, the count is its terminal count. A
document's count is the sum over its pre-tokens. The trie lives in the Python worker and is emptied when it has
MAX_NODES nodes; counts do not depend on that.

Defined cases: NULL and empty texts have 0 tokens; rows are counted one by one, so repeated rows, missing doc_ids and other
columns do not matter.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tsforge.llm.common import small_batches, text_or_empty, worker_state
from tsforge.llm.piece_model import marked, piece_model, segments

MAX_NODES = 500_000
MAX_TERMINALS = 400_000
KEPT_LENGTH = 48


class CountTrie(dict):
    """Terminal counts by pre-token; a missing one is inserted into the trie."""

    def __init__(self, path: str) -> None:
        self.model = piece_model(path)
        # Pieces by their last character first, to be walked from a node towards the root.
        self.reversed: dict = {}
        for piece, (_, score) in self.model.pieces.items():
            node = self.reversed
            for c in reversed(piece):
                node = node.setdefault(c, {})
            node[""] = score
        self.reset()

    def reset(self) -> None:
        self.clear()
        self.children: list[dict[str, int]] = [{}]
        self.scores = [0.0]
        self.counts = [0]

    def _unknown_tokens(self, c: str) -> int:
        return len(self.model.character_ids(c))

    def _extend(self, word: str, depth: int, path: list[int]) -> int:
        """A new node for word[:depth + 1] below the path of its ancestors."""
        c, scores, counts = word[depth], self.scores, self.counts
        best = count = None
        node, start = self.reversed, depth + 1
        while start > 0:
            start -= 1
            node = node.get(word[start])
            if node is None:
                break
            piece = node.get("")
            if piece is not None:
                score = scores[path[start]] + piece
                if best is None or score >= best:  # starts come later to earlier: of equals the longest piece
                    best, count = score, counts[path[start]] + 1
        unknown = scores[path[depth]] + self.model.unknown_score
        if best is None or (c not in self.model.pieces and unknown > best):
            best, count = unknown, counts[path[depth]] + self._unknown_tokens(c)
        self.children[path[depth]][c] = len(scores)
        self.children.append({})
        scores.append(best)
        counts.append(count)
        return len(scores) - 1

    def insert(self, word: str) -> int:
        node, path = 0, [0]
        for depth, c in enumerate(word):
            child = self.children[node].get(c)
            node = self._extend(word, depth, path) if child is None else child
            path.append(node)
        return self.counts[node]

    def __missing__(self, word: str) -> int:
        if len(self.scores) >= MAX_NODES or len(self) >= MAX_TERMINALS:
            self.reset()
        if len(word) > KEPT_LENGTH:
            return self._count_long(word)
        count = self.insert(word)
        self[word] = count
        return count

    def _count_long(self, word: str) -> int:
        """The same recurrence without nodes: only the scores of the last boundaries are kept."""
        longest = self.model.longest
        scores, counts = [0.0], [0]  # for the boundaries from `first` on
        first = 0
        for end, c in enumerate(word, 1):
            best = count = None
            node, start = self.reversed, end
            while start > first:
                start -= 1
                node = node.get(word[start])
                if node is None:
                    break
                piece = node.get("")
                if piece is not None and (best is None or scores[start - first] + piece >= best):
                    best, count = scores[start - first] + piece, counts[start - first] + 1
            unknown = scores[-1] + self.model.unknown_score
            if best is None or (c not in self.model.pieces and unknown > best):
                best, count = unknown, counts[-1] + self._unknown_tokens(c)
            scores.append(best)
            counts.append(count)
            if len(scores) > 4 * longest:
                cut = len(scores) - longest - 1
                first += cut
                del scores[:cut], counts[:cut]
        return counts[-1]

    def count(self, text: str) -> tuple[int, int]:
        """Pre-tokens and tokens of a text."""
        words = segments(marked(text), self.model.words_apart)
        return len(words), sum([self[w] for w in words])


def count_trie(path: str) -> CountTrie:
    return worker_state(f"trie:{path}", lambda: CountTrie(path))


def _count_batches(path: str) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = count_trie(path)
        for batch in batches:
            both = [trie.count(t.as_py()) for t in batch.column(1)]
            columns = [pa.array([x[i] for x in both], pa.int64()) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["doc_id", "n_pretokens", "n_tokens"])

    return run


def token_counts(docs: DataFrame, model_path: str, text: str = "text") -> DataFrame:
    """doc_id, n_pretokens, n_tokens."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty(text).alias("text"))
    return rows.mapInArrow(_count_batches(model_path), "doc_id long, n_pretokens long, n_tokens long")
