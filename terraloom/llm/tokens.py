"""Token ids of whole texts, made by the tokenizers library where the documents are read.

A text is cut where the tokenizer itself always cuts, each distinct piece is encoded once, and a text's ids are its pieces' ids
in a row. Texts in which a cut could fall elsewhere, and by default texts that spell a special token, are encoded whole. A piece that is a
word of common letters, with or without marks after it, goes straight to the library's merge model, which is what the tokenizer would do
with it. Pieces are kept up to a fixed number per Python worker; beyond it they are encoded anew, so memory stays bounded.
"""

from __future__ import annotations

import os
import re
import struct

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Pieces kept per worker, and the longest that is kept.
KEPT, LONGEST = 1_000_000, 40
#: Characters that str.split() takes for white space and the tokenizer doesn't.
_ODD = re.compile("[\x1c-\x1f]")
#: Runs of white space that byte-level vocabularies don't cut into single characters.
_RUN = re.compile(r"\s\s\s|\s\s\Z")
#: Letters whose lower case is one letter by any rule, then marks that no vocabulary joins to letters.
_MARKS = ",.!?;:#*$%&|()"
_PLAIN = re.compile(f"( ?)([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([{_MARKS}]*)")
_made: dict[tuple[str, bool, bool], Encoder] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies use for each byte: itself if it is printable, else one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Pieces(dict):
    """Ids of pieces; a piece that isn't there is encoded, and kept while there is room."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        ids = self.encode(piece)
        if len(self) < KEPT and len(piece) <= LONGEST:
            self[piece] = ids
        return ids


class Encoder:
    """Ids of texts as little-endian unsigned 16-bit numbers."""

    def __init__(self, path: str, blank_joins: bool, special_as_text: bool = True):
        """blank_joins: a blank belongs to the word after it (byte-level vocabularies), rather than being dropped with capitals."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of this vocabulary don't fit in 16 bits")
        self.blank_joins = blank_joins
        starts = sorted({re.escape(t.content[:2]) for t in self.tokenizer.get_added_tokens_decoder().values()})
        self.special = re.compile("|".join(starts)) if starts and not special_as_text else None
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.blank = self.letters[32]
        self.kept = _Pieces(self._piece)
        self.line = self._whole("\n")
        #: Pieces that begin with a blank, by what follows it, and those that begin with a line end.
        self.after = _Pieces(lambda rest: self.line + (self.kept[rest[1:]] if rest[1:] else b"") if rest[:1] == "\n" else self._piece(" " + rest))

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u2").tobytes()

    def _cut(self, piece: str) -> bytes:
        return self.after[piece[1:]] if piece[:1] == " " else self.kept[piece]

    def _merged(self, letters: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(letters)]
        return struct.pack(f"<{len(ids)}H", *ids)

    def _piece(self, piece: str) -> bytes:
        # Most pieces are words of basic letters; they are told apart without the pattern.
        blank, rest = (" ", piece[1:]) if piece[:1] == " " else ("", piece)
        word = rest.rstrip(_MARKS)
        if not (word.isascii() and word.isalpha()):
            if _PLAIN.fullmatch(piece) is None:
                return self._whole(piece)
        if len(word) < len(rest):
            return self._cut(blank + word) + self.kept[rest[len(word) :]]
        if not self.blank_joins and word != word.lower():
            return self.kept[word.lower()]
        if word.isascii():
            return self._merged(self.blank + word if blank else word)
        return self._merged((blank + word).encode().decode("latin-1").translate(self.letters))

    def _text(self, text: str) -> bytes:
        if self.special is not None and self.special.search(text):
            return self._whole(text)
        if self.blank_joins:
            # Before a single blank or line end, the pattern of byte-level vocabularies always cuts; after a line end, too.
            if _RUN.search(text):
                return self._whole(text)
            first, *rest = text.replace("\n", " \n").split(" ")
            return (self.kept[first] if first else b"") + b"".join(map(self.after.__getitem__, rest))
        return self._whole(text) if _ODD.search(text) else b"".join(map(self.kept.__getitem__, text.split()))

    def encode(self, texts: list[str]) -> list[bytes]:
        return [self._text(t) for t in texts]


def encoder(path: str, blank_joins: bool, special_as_text: bool = False) -> Encoder:
    """The worker's own encoder for a vocabulary file; by default a special token's spelling in a text gives that token, as in the library."""
    key = (path, blank_joins, special_as_text)
    if key not in _made:
        _made[key] = Encoder(*key)
    return _made[key]
