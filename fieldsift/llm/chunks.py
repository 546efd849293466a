"""Cuts texts at single spaces, where byte-level pre-tokens never join, and caches what each chunk encodes to."""

from __future__ import annotations

import re
from collections.abc import Callable

#: A space beside other white space or at an end of the text: there the plain split isn't safe.
_ODD = re.compile(r" (?:(?=\s)|\Z|(?<=\s )|(?<=\A ))")  # begins with the space, which the search then looks for alone
_SAFE = re.compile(r"(?<=\S) (?=\S)")


def space_chunks(text: str) -> list[str]:
    """Chunks of text; each but the first stands for itself with one space before it.

    A single space between two non-spaces always begins a pre-token of the pattern, so chunks encode apart.
    """
    return _SAFE.split(text) if _ODD.search(text) else text.split(" ")


class ChunkCache(dict):
    """chunk -> encode(" " + chunk), bounded: it empties itself when it holds more than about max_bytes."""

    def __init__(self, encode: Callable[[str], bytes], max_bytes: int = 120_000_000):
        super().__init__()
        self.encode, self.max_bytes, self.held = encode, max_bytes, 0

    def __missing__(self, chunk: str) -> bytes:
        found = self.encode(" " + chunk)
        size = len(chunk) + len(found)
        if size < 4096:  # a longer chunk hardly comes again
            self.held += size + 200  # two objects and their place in the table
            if self.held > self.max_bytes:
                self.clear()
                self.held = size + 200
            self[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """The ids of text as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        parts = space_chunks(text)
        return self.encode(parts[0]) + b"".join(map(self.__getitem__, parts[1:]))
