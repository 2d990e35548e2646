"""Pre-tokens: cutting a text at safe spaces, and remembering what each piece encodes to."""

from __future__ import annotations

import re
from collections.abc import Callable

import regex

#: The public split pattern for which cutting at spaces is right; any other is matched over the whole text. Fixed value.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: A space before something that isn't white space always begins a match of the split pattern, whatever stands before.
_SAFE = re.compile(r" (?=\S)")
#: With one of these in a text, cutting at every space would cut inside a run of white space.
_UNSAFE = re.compile(r" (?:\s|\Z)")
#: Pieces longer than this are encoded each time.
_LONG = 64
#: Marks that end many words, each a match of its own there.
_ENDS = (",", ".")


class PieceMemo(dict):
    """Piece -> encoded ids as bytes. A key stands for a space and itself, or after NUL for what follows as it is.

    Two generations of `limit` entries: memory is bounded, and what is in use stays.
    """

    def __init__(self, encode_match: Callable[[str], bytes], pattern: str, limit: int = 280_000):
        super().__init__()
        found = regex.compile(pattern)
        self.encode_match, self.limit, self.older, self.by_spaces = encode_match, limit, {}, pattern == SPLIT
        self.split: Callable[[str], list[str]] = found.findall if not found.groups else lambda text: [m[0] for m in found.finditer(text)]

    def __missing__(self, key: str) -> bytes:
        ids = self.older.get(key)
        if ids is None:
            if key.isalpha():  # a space and letters are one match
                ids = self.encode_match(" " + key)
            elif key[-1:] in _ENDS and key[:-1].isalpha():
                ids = self[key[:-1]] + self["\0" + key[-1]]
            else:
                piece = key[1:] if key[:1] == "\0" else " " + key
                matches = self.split(piece)
                ids = self.encode_match(piece) if len(matches) == 1 else b"".join([self[m[1:] if m[0] == " " and m[1:2] != "\0" else "\0" + m] for m in matches])
        if len(key) <= _LONG:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = ids
        return ids

    def text(self, text: str) -> bytes:
        """The ids of a whole text. Same as encoding it at once, since the pieces begin where matches begin."""
        if not self.by_spaces or "\0" in text:
            return b"".join(map(self.encode_match, self.split(text)))
        pieces = _SAFE.split(text) if _UNSAFE.search(text) else text.split(" ")
        pieces[0] = "\0" + pieces[0]
        return b"".join(map(self.__getitem__, pieces))
