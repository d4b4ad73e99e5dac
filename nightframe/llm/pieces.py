"""Encoding text piece by piece with a byte-level BPE tokenizer, each distinct piece once.

Byte-level BPE first cuts a text by a pattern whose pieces hold a space only at their start, so
between a character that is no white space and a space there is always a cut, whatever stands around
it. Encoding the parts between such cuts one by one gives the ids of the whole text; as texts repeat
their words, nearly every part comes from a dictionary.
"""

from __future__ import annotations

import re
from array import array

from tokenizers import Tokenizer

#: Distinct parts kept per worker process, twice: a full dictionary becomes the old one, and what is
#: met again moves from there to the new one.
KEPT = 450_000
_WIDE = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S)(?= )")
#: Letters and numbers end before punctuation and line ends, punctuation before line ends, and one line
#: end alone before a letter, so these cuts are safe too.
_FINER = re.compile(r"(?<=[^\W_])(?=[.,;:!?\n])|(?<=[.,;:!?])(?=\n)|(?<=\S\n)(?=[^\W\d_])")


def parts(text: str) -> list[str]:
    """The parts between safe cuts; joined they are the text."""
    if not text:
        return []
    if _WIDE.search(text):
        return _CUT.split(text)
    first, *rest = text.split(" ")
    spaced = [" " + p for p in rest]
    return [first, *spaced] if first else spaced


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable Latin-1 itself, the rest from 256 on in order."""
    shown = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = byte_letters()


class Encoder(dict):
    """part -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.old: dict[str, bytes] = {}

    def __missing__(self, part: str) -> bytes:
        """One run of letters, with or without a space before it, is one pre-token and goes to the
        tokenizer's merges directly; all else is cut finer, and encoded where that cuts nothing."""
        ids = self.old.get(part)
        if ids is None:
            if (part[1:] if part[0] == " " else part).isalpha():
                shown = part.replace(" ", _LETTERS[32]) if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
                ids = array("I", [token.id for token in self.merge(shown)]).tobytes()
            elif len(own := _FINER.split(part)) > 1:
                ids = b"".join(map(self.__getitem__, own))
            else:
                ids = array("I", self.tokenizer.encode(part, add_special_tokens=False).ids).tobytes()
        self[part] = ids
        return ids

    def tidy(self) -> None:
        """To be called now and then: a full dictionary becomes the old one."""
        if len(self) > KEPT:
            self.old = dict(self)
            self.clear()

    def ids(self, text: str) -> bytes:
        self.tidy()
        return b"".join(map(self.__getitem__, parts(text)))

    def count(self, text: str) -> int:
        return len(self.ids(text)) // 4


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One encoder per file and worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
