"""Ids of a word-end BPE tokenizer, for packing and for token files.

Where the tokenizer's file says that white space is dropped, text is composed and
lower-cased, and words are split from signs and merged each by itself, a text's
ids are those of its parts between ASCII blanks, in order. Parts repeat; a worker
keeps the ids of those that it has met and asks the library for new ones only.
Any other tokenizer file is left to the library as a whole.
"""

from __future__ import annotations

import json
import os
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Parts that a worker keeps; beyond it, the store starts anew. Longer parts than KEPT_BYTES aren't kept. Results don't depend on either.
STORE, KEPT_BYTES = 1_000_000, 200
#: A pattern by which letters, and the signs behind them, are a piece each; such parts need no search.
APART = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
SIGNS = b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: The normaliser that parts rely on.
NORMALISER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}


def piece_pattern(settings: dict) -> str | None:
    """The file's pattern of words, digits and signs; None if parts between blanks can't be encoded each by itself."""
    steps = (settings["pre_tokenizer"] or {}).get("pretokenizers", [])
    split = steps[0] if len(steps) == 2 else {}
    bytes_after = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}
    plain = (
        settings["normalizer"] == NORMALISER and split.get("type") == "Split" and split["behavior"] == "Removed" and split["invert"] and "Regex" in split["pattern"]
        and {k: v for k, v in steps[1].items() if k != "trim_offsets"} == bytes_after
        and settings["model"]["type"] == "BPE" and not settings["model"]["dropout"] and not settings["truncation"] and not settings["padding"]
        and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) and len(t["content"].split()) == 1 for t in settings["added_tokens"])
        and not any(t["content"][:2].upper() != t["content"][:2].lower() for t in settings["added_tokens"])  # lower-casing makes no such beginning
    )
    return split["pattern"]["Regex"] if plain else None


class _Store(dict):
    """part -> its ids as little-endian unsigned 32-bit bytes; new parts are encoded when asked for."""

    def __init__(self, tokenizer):
        import regex

        super().__init__()
        self.tokenizer, self.merge = tokenizer, tokenizer.model.tokenize
        settings = json.loads(tokenizer.to_str())
        self.pattern = piece_pattern(settings)
        #: How special tokens begin: a part that holds such a beginning goes to the library.
        self.marks = tuple({t["content"][:2].encode() for t in settings["added_tokens"]})
        #: Whether parts asked for may hold such a beginning.
        self.wary = True
        #: Signs that may stand behind a word, if the pattern sets them apart.
        self.signs = SIGNS if self.pattern == APART else None
        self.split = regex.compile(self.pattern or "").findall
        self.pieces: dict[str, bytes] = {}
        # Byte-level alphabet: printable bytes stand for themselves, the others for the characters from 256 on, in order.
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in shown]
        self.alphabet = {b: chr(b) for b in shown} | {b: chr(256 + n) for n, b in enumerate(hidden)}

    def encode(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def marked(self, data: bytes) -> bool:
        return any(m in data for m in self.marks)

    def _merge(self, piece: str) -> bytes:
        """Ids of a lower-case piece of Latin-1 characters: the library's merges alone."""
        letters = piece if piece.isascii() and piece.isprintable() else "".join(map(self.alphabet.__getitem__, piece.encode()))
        ids = array("I", [t.id for t in self.merge(letters)])
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def _piece(self, piece: str) -> bytes:
        ids = self.pieces.get(piece)
        if ids is None:
            ids = self._merge(piece)
            if len(piece) <= KEPT_BYTES:
                self.pieces[piece] = ids
        return ids

    def __missing__(self, part: bytes) -> bytes:
        text, word = part.decode(), part.rstrip(self.signs).decode() if self.signs else ""
        if self.wary and self.marked(part):
            ids = self.encode(text)
        elif word.isalpha() and (word.isascii() or max(word) < "Ā"):
            ids = self._piece(word.lower())
            if len(word) < len(text):
                ids += self._piece(text[len(word) :])
        elif max(text) >= "Ā" or min(text) < "!":  # characters that normalisation may change
            ids = self.encode(text)
        else:
            ids = b"".join(map(self._piece, self.split(text.lower())))  # normalisation lower-cases before it splits
        if len(part) <= KEPT_BYTES:
            self[part] = ids
        return ids


class WordIds:
    """ids(texts): for each text its ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.known = _Store(Tokenizer.from_file(path))

    def ids(self, texts: list[str | None]) -> list[bytes]:
        known, out = self.known, []
        if known.pattern is None:
            return [known.encode(t or "") for t in texts]
        for t in texts:
            if len(known) > STORE:
                known.clear()
                known.pieces.clear()
            data = (t or "").encode()
            # Special tokens are matched before lower-casing; without their signs, case makes no difference.
            known.wary = known.marked(data)
            parts = data.split() if known.wary else data.lower().split()
            out.append(b"".join(map(known.__getitem__, parts)))
        return out


_loaded: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """One tokenizer a worker."""
    if path not in _loaded:
        _loaded[path] = WordIds(path)
    return _loaded[path]


def slices(batch: pa.RecordBatch, column: str = "text", chars: int = 4_000_000):
    """A batch in slices of about so many characters, so that memory holds with long texts; never fewer than a row."""
    if batch.num_rows:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        block = np.cumsum(lengths) // chars
        for at in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(block)) + 1):
            yield batch.slice(at[0], len(at))
