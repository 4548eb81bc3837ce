"""Token ids from a public tokenizer file, with a bounded memory of pieces.

The vocabulary splits a text before each single space that is followed by a non-space, around
single line ends, and then by its own pattern; no merge crosses such a cut. So the ids of a piece are remembered, and each
distinct word goes through the tokenizers library's model once in a worker's memory. Texts with a
piece whose cut is not certain (special tokens, characters outside the plain Latin range, runs of
white space that begin with a space) go to the library whole.
"""

from __future__ import annotations

import json
import os

import numpy as np
import regex

END_ID = 2
#: Pieces and words that came twice, and those that came once, in one Python worker's memory; a full memory is emptied.
PIECES, FRESH = 300_000, 150_000

# The vocabulary's split pattern.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: What makes the cuts uncertain, beside a space before white space.
UNSURE = r"[^\t\n\r\x20-\x7e¡-¬®-ɏ]|<\|endoftext\|>"
_STATE: dict = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_names() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: visible Latin-1 ones stand
    for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest)}


def _known_splits(path: str) -> bool:
    """Whether the file splits texts by :data:`PATTERN` on bytes and has no other rules."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    before = spec.get("pre_tokenizer") or {}
    plain = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    special = {t["content"] for t in spec.get("added_tokens", [])}
    model = spec.get("model", {})
    return bool(plain and not spec.get("normalizer") and special <= {"<|endoftext|>"} and model.get("type") == "BPE" and not model.get("dropout"))


class Encoder:
    """Ids of texts. A file with other rules than the known ones goes through the library alone."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.known = _known_splits(path)
        self.names = byte_names()
        self.packed = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.split, self.unsure = regex.compile(PATTERN), regex.compile(UNSURE)
        self.pieces: dict[str, bytes] = {"": b""}
        self.fresh: dict[str, bytes] = {}
        self.tokenize, self.space = self.model.tokenize, self.names[32]
        # a line end is a piece of its own, unless it is in one of these runs of white space
        self.uncut = ("\n\n\n", "\n\n ", "\n\t", "\t\n", "\r")
        self.ends = {mark: self._word(mark) for mark in ".,;:!?"} if self.known else {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def _word(self, word: str) -> bytes:
        """Ids of a word: remembered ones, or those of the library's model."""
        found = self.pieces.get(word) or self.fresh.get(word)
        if not found:
            # most words are ASCII letters, perhaps after a space, which has a name of its own
            named = word.replace(" ", self.space) if word.isascii() and word[-1].isalpha() else word.encode().decode("latin-1").translate(self.names)
            packed = self.packed
            found = self.fresh[word] = b"".join([packed[t.id] for t in self.tokenize(named)])
        return found

    def _piece(self, part: str) -> bytes:
        """Ids of a piece that is not in the lasting memory; one that came before goes there."""
        found = self.fresh.pop(part, None)
        if found is not None:
            if len(self.pieces) >= PIECES:
                self.pieces.clear()
                self.pieces[""] = b""
            self.pieces[part] = found
            return found
        if len(self.fresh) >= FRESH:
            self.fresh.clear()
        letters = part[0] == " " or part[0].isalpha()
        if letters and part[1:].isalpha():
            return self._word(part)
        if letters and part[1:-1].isalpha() and part[-1] in self.ends:
            found = self._word(part[:-1]) + self.ends[part[-1]]
        else:
            found = b"".join([self._word(w) for w in self.split.findall(part)])
        self.fresh[part] = found
        return found

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers, without the end id."""
        if not text:
            return b""
        if not self.known or "\0" in text or ("\n" in text and any(run in text for run in self.uncut)) or text.endswith("\n\n"):
            return self.whole(text)
        parts = text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")
        got = list(map(self.pieces.get, parts))
        if None not in got:
            return b"".join(got)
        if text[-1] == " " or any(pair in text for pair in ("  ", " \n", " \t", " \r")):
            return self.whole(text)
        new = [k for k, ids in enumerate(got) if ids is None]
        if self.unsure.search("\n".join([parts[k] for k in new])):
            return self.whole(text)
        piece = self._piece
        for k in new:
            got[k] = piece(parts[k])
        return b"".join(got)


def encoder(path: str) -> Encoder:
    """One encoder for each worker process and file."""
    if path not in _STATE:
        _STATE[path] = Encoder(path)
    return _STATE[path]
