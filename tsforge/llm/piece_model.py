"""Pieces and scores of a SentencePiece file, as a unigram model.

Score of a segmentation: the sum of its pieces' scores in the file. A character that no piece covers is unknown; it
costs 10 less than the lowest score and is written as its UTF-8 bytes where the file has byte pieces. Of equally good
segmentations the one whose last piece is longest wins, at every boundary. A space is written as the mark U+2581, and
one mark is put before a non-empty text.
"""

from __future__ import annotations

import re
from typing import Any

from tsforge.llm.common import worker_state

MARK = "▁"
UNKNOWN_PENALTY = 10.0
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


class PieceModel:
    def __init__(self, path: str) -> None:
        from sentencepiece import SentencePieceProcessor

        source = SentencePieceProcessor(model_file=path)
        self.pieces: dict[str, tuple[int, float]] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.unknown = source.unk_id()
        for i in range(source.get_piece_size()):
            piece = source.id_to_piece(i)
            if source.is_byte(i):
                value = int(_BYTE.fullmatch(piece)[1], 16)
                self.bytes[value] = i
                self.surface.append(bytes([value]))
            elif source.is_control(i) or source.is_unknown(i) or source.is_unused(i):
                self.surface.append(b"")
            else:
                self.pieces[piece] = (i, source.get_score(i))
                self.surface.append(piece.replace(MARK, " ").encode())
        self.longest = max(map(len, self.pieces), default=1)
        self.unknown_score = min((s for _, s in self.pieces.values()), default=0.0) - UNKNOWN_PENALTY
        # Forward trie for the search from a start: nested dicts, "" holds (id, score); a piece that no other piece
        # goes on from is that pair itself.
        self.trie: dict[str, Any] = {}
        for piece, entry in self.pieces.items():
            node = self.trie
            for c in piece[:-1]:
                below = node.get(c)
                if not isinstance(below, dict):
                    below = node[c] = {} if below is None else {"": below}
                node = below
            last = node.get(piece[-1])
            if last is None:
                node[piece[-1]] = entry
            else:
                last[""] = entry
        #: Neighbouring characters inside pieces; no piece reaches over any other pair.
        self.neighbours = {p[i : i + 2] for p in self.pieces for i in range(len(p) - 1)}
        # A mark inside a piece is preceded by marks only: then no piece spans the start of a marked word.
        self.words_apart = all(MARK not in p.lstrip(MARK) for p in self.pieces)

    def character_ids(self, c: str) -> list[int]:
        """Ids of a character that is no piece."""
        if c in self.pieces:
            return [self.pieces[c][0]]
        return [self.bytes.get(b, self.unknown) for b in c.encode()] if self.bytes else [self.unknown]

    def decode(self, ids: list[int]) -> str:
        """The text of ids; the mark put before it is taken off."""
        text = b"".join([self.surface[i] for i in ids]).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def marked(text: str) -> str:
    return MARK + text.replace(" ", MARK) if text else ""


def segments(text: str, words_apart: bool) -> list[str]:
    """Parts of a marked text between which no piece can lie: each starts with a mark and has only leading marks."""
    if not words_apart:
        return [text] if text else []
    if MARK + MARK not in text:
        return [MARK + w for w in text.split(MARK)[1:]] if text.startswith(MARK) else _cut(text)
    return _cut(text)


def _cut(text: str) -> list[str]:
    return [x for x in re.split(f"(?<=[^{MARK}])(?={MARK})", text) if x]


def piece_model(path: str) -> PieceModel:
    """The worker's copy of the model."""
    return worker_state(f"pieces:{path}", lambda: PieceModel(path))
