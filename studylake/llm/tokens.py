"""Token ids of whole texts by the tokenizers library, with a memo for the stretches between blanks.

Both vocabularies split a text before they merge, and no piece of that split reaches from a mark or letter into a following
blank. So a text may be cut there, each stretch encoded alone, and the ids joined: the same ids as for the whole text
(tests compare them). Words repeat, so most stretches are found in the memo, whose size is bounded.
"""

from __future__ import annotations

import re
import struct
from array import array
from functools import lru_cache

#: White space of the vocabularies' patterns.
WS = "\t-\r \x85\xa0  -     　"
#: Some letters and marks between which the patterns always split; other characters stay with their stretch.
LETTERS, MARKS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff", r".,;:!?*#$%&|"
STRETCH = re.compile(rf"[{WS}]*(?:[{LETTERS}]+(?=[{WS}{MARKS}]|\Z)|[{MARKS}]+(?=[{WS}{LETTERS}]|\Z)|[^{WS}]+)|[{WS}]+")
BARE = re.compile(rf"[{LETTERS}]+(?=[{WS}{MARKS}]|\Z)|[{MARKS}]+(?=[{WS}{LETTERS}]|\Z)|[^{WS}]+")
MEMO = 800_000


@lru_cache(maxsize=4)
def tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(path)
    found.encode_special_tokens = True  # their strings in a text are ordinary text
    return found


def path_of(name: str) -> str:
    """Where a public vocabulary lies on this machine; each executor asks for itself."""
    import public_tokenizers

    return public_tokenizers.path(name)


#: A stretch that is one piece of the patterns' split (a line's end before it is another), in letters that lower case and normalisation treat one by one.
ONE = re.compile(rf"(\n?)( ?[{LETTERS}]+)")


def _bytes_as_letters() -> list[str]:
    """The byte-level alphabet: bytes that print stand for themselves, the others for the characters from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(rest)) for b in range(256)]


class _Memo(dict):
    """Two generations: when the young one is full it becomes the old one, and what is used again comes back from there."""

    def __init__(self, found, lower: bool):
        self.encode, self.merge, self.lower, self.old = found.encode, found.model.tokenize, lower, {}
        self.letters = str.maketrans(dict(enumerate(_bytes_as_letters())))
        self.line = self.packed("\n")

    def packed(self, text: str) -> bytes:
        ids = self.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def ids(self, stretch: str) -> bytes:
        line, blank, word = b"", stretch[:1] == " ", stretch
        if blank:
            word = stretch[1:]
        if word.isascii() and word.isalpha():  # its bytes are its letters
            word = word.lower() if self.lower else "\u0120" + word if blank else word
        elif m := ONE.fullmatch(stretch):
            word = m[2].strip().lower() if self.lower else m[2]
            word, line = word.encode().decode("latin-1").translate(self.letters), self.line if m[1] else b""
        else:
            return self.packed(stretch)
        # Straight to the library's merges, without its split of the text.
        found = self.merge(word)
        return line + (found[0].id.to_bytes(4, "little") if len(found) == 1 else array("I", [t.id for t in found]).tobytes())

    def __missing__(self, stretch: str) -> bytes:
        found = self.old.get(stretch)
        if found is None:
            found = self.ids(stretch)
        if len(self) >= MEMO:
            self.old = dict(self)
            self.clear()
        self[stretch] = found
        return found


@lru_cache(maxsize=4)
def encoder(name: str):
    """text -> its ids as little-endian unsigned 32-bit integers."""
    found = tokenizer(path_of(name))
    memo, cut = _Memo(found, name.startswith("word")), (BARE if name.startswith("word") else STRETCH).findall
    get = memo.__getitem__
    return lambda text: b"".join(map(get, cut(text)))
