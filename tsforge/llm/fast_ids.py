"""Token ids of whole texts with a tokenizers file, word by word.

A byte-level or lower-casing BPE tokenizer never joins across a space that follows a non-space, so the ids of a text
are those of its words in a row. Words recur, so their ids are kept in a bounded cache per Python worker and only new
words reach the tokenizer. Where the file's own splitting differs from the two known kinds, and for texts outside the
plain range, the whole text goes to the tokenizer. The ids are the same either way; the tests compare them.
"""

from __future__ import annotations

import json
import os
import re
from array import array

from tsforge.llm.common import worker_state

CACHED_WORDS = 500_000
CACHED_LENGTH = 48

#: White space other than space and newline.
_OTHER_SPACE = re.compile(r"[^\S \n]")
#: Beyond Latin letters normal forms and lower case may depend on neighbours.
_NOT_PLAIN = re.compile("[İɐ-\U0010ffff]")
_ENDS = frozenset(".,;:!?")
_SAFE_CUT = re.compile(r"(?<=\S)(?=[ \n])")


def _byte_characters() -> dict[int, str]:
    """Byte-level alphabet: printable bytes stand for themselves, the others for code points from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table = {b: chr(b) for b in kept}
    for n, b in enumerate(b for b in range(256) if b not in table):
        table[b] = chr(256 + n)
    return table


def _uneven(text: str) -> bool:
    """Whether white space is anything but lone spaces and lone newlines."""
    doubled = "  " in text or "\n\n" in text or " \n" in text or "\n " in text
    return doubled or _OTHER_SPACE.search(text) is not None


class WordIds(dict):
    """Ids (packed little-endian) by word; keeps the recent two generations of a bounded number of words."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings are ordinary text
        self.model = self.tokenizer.model
        self.older: dict[str, bytes] = {}
        self.code = "H" if self.tokenizer.get_vocab_size() <= 1 << 16 else "I"
        self.letters = {ord(chr(b)): c for b, c in _byte_characters().items()}
        self.kind = self._kind()

    def _kind(self) -> str:
        told = json.loads(self.tokenizer.to_str())
        norm, pre, kind = told.get("normalizer"), told.get("pre_tokenizer") or {}, told["model"]["type"]
        if kind != "BPE":
            return "whole"
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre["add_prefix_space"]:
            return "spaced"  # a space belongs to the word after it
        steps = [x["type"] for x in norm.get("normalizers", ())] if norm else []
        parts = [x["type"] for x in pre.get("pretokenizers", ())]
        if steps == ["NFC", "Replace", "Lowercase"] and parts == ["Split", "ByteLevel"]:
            if pre["pretokenizers"][0]["pattern"].get("Regex", "").endswith(r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"):
                return "lower"  # white space is dropped
        return "whole"

    def _whole(self, text: str) -> bytes:
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _letters(self, word: str) -> bytes:
        plain = word.isascii() and word[0] != " "
        spelled = word if plain else word.encode().decode("latin-1").translate(self.letters)
        return array(self.code, [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def __missing__(self, key: str) -> bytes:
        if key in self.older:
            ids = self.older[key]
        elif self.kind == "lower":
            ids = self._lower_word(key)
        else:
            ids = self._spaced_word(key)
        if len(key) <= CACHED_LENGTH:
            if len(self) >= CACHED_WORDS:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def _lower_word(self, key: str) -> bytes:
        if not key:
            return b""
        if key.isalpha():
            return self._letters(key)
        if key[-1] in _ENDS and key[:-1].isalpha():
            return self[key[:-1]] + self[key[-1]]
        return self._whole(key)

    def _spaced_word(self, key: str) -> bytes:
        """key: a word that a space precedes, or, after a carriage return, a text of its own."""
        bare = key[:1] == "\r"
        core = key[1:] if bare or key[:1] == "\n" else key
        if key[:1] == "\n":
            return self["\r\n"] + (self["\r" + core] if core else b"") if key != "\n" else self["\r\n"]
        if core.isalpha():
            return self._letters(core if bare else " " + core)
        if len(core) > 1 and core[-1] in _ENDS and core[:-1].isalpha():
            return self[key[:-1]] + self["\r" + core[-1]]
        return self._whole(core if bare else " " + core)

    def encode(self, text: str | None) -> bytes:
        """The ids of a text without special tokens; None counts as empty."""
        if not text:
            return b""
        if self.kind == "lower":
            if _NOT_PLAIN.search(text):
                return self._whole(text)
            return b"".join([self[p] for p in text.lower().replace("\n", " ").split(" ")])
        if self.kind == "whole":
            return self._whole(text)
        if _uneven(text):
            return b"".join([self["\r" + p] for p in _SAFE_CUT.split(text)])
        parts = text.replace("\n", " \n").split(" ")
        head = self["\r" + parts[0]] if parts[0] else b""
        return head + b"".join([self[p] for p in parts[1:]])


def word_ids(path: str) -> WordIds:
    """The worker's encoder for this file."""
    return worker_state(f"ids:{path}", lambda: WordIds(path), alone=True)
