"""Token ids of texts, by a tokenizer file of the ``tokenizers`` library.

A lower-casing tokenizer that drops white space and treats each run of letters, each
digit and each run of other signs apart gives a piece the same ids wherever it stands.
For such a tokenizer the ids of pieces are kept, and only pieces not yet seen go through
the library; so it is with whole chunks between blanks and line feeds. Chunks outside Latin-1
go through the library whole, as do all texts with special tokens and all texts of tokenizers
of another kind.

Defined results: an empty text has no ids; callers give null texts as empty; very long texts are encoded whole; equal texts have equal ids, in
any order and in any process.
"""

from __future__ import annotations

import functools
import json
import os
import re
import struct

# The settings of a tokenizer for which pieces can be encoded apart.
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = ["NFC", "Replace", "Lowercase"]
# The same pieces in lower-case Latin-1 text.
LETTERS, NUMBERS, SPACES = "a-zªµºß-öø-ÿ", "0-9²³¹¼½¾", "\t-\r \x85\xa0"
PIECES = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{NUMBERS}]|[^{SPACES}{LETTERS}{NUMBERS}]+")
KEPT, KEPT_LENGTH = 400_000, 40


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class _Kept(dict):
    """From strings to their ids as little-endian 32-bit integers; holds KEPT at most."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, key: str) -> bytes:
        ids = self.encode(key)
        if len(self) < KEPT and len(key) <= KEPT_LENGTH:
            self[key] = ids
        return ids


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark runs a task for each core
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        self.special = [t["content"] for t in kind["added_tokens"]]
        steps = (kind["normalizer"] or {}).get("normalizers", [])
        split = (kind["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.apart = [s["type"] for s in steps] == NORMALIZERS and split[0].get("pattern") == {"Regex": SPLIT} and split[0].get("invert") is True
        if self.apart:
            self.light = Tokenizer.from_file(path)
            self.light.normalizer = normalizers.Sequence([])
            self.light.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
            self.pieces, self.chunks = _Kept(self._piece), _Kept(self._chunk)

    def _whole(self, text: str) -> bytes:
        return _packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _piece(self, piece: str) -> bytes:
        if piece.isascii() and piece.isprintable():  # stands for itself in the byte-level alphabet
            return _packed([t.id for t in self.light.model.tokenize(piece)])
        return _packed(self.light.encode(piece, add_special_tokens=False).ids)

    def _chunk(self, chunk: str) -> bytes:
        if _is_latin(chunk):
            return b"".join(map(self.pieces.__getitem__, PIECES.findall(chunk.lower())))
        return self._whole(chunk)

    def __call__(self, text: str) -> bytes:
        """The ids of ``text`` as little-endian unsigned 32-bit integers."""
        if not self.apart or any(s in text for s in self.special):
            return self._whole(text)
        return b"".join(map(self.chunks.__getitem__, text.replace("\n", " ").split(" ")))


def _is_latin(text: str) -> bool:
    if text.isascii():
        return True
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return False
    return True


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process, kept between tasks."""
    return Encoder(path)
