"""Words of many texts at once, as codes of a dictionary, cut from bytes in numpy."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: What `fold` puts between words, and between pieces that no phrase crosses.
SPACE, BREAK = 32, 10
#: Bytes of text cut into words at a time; a longer text goes in slices.
CHUNK_BYTES = 4_000_000


def fold(apart: str, breaks: str = "") -> bytes:
    """A table for bytes.translate: A-Z as small letters, of these the class `apart` as SPACE, the class `breaks` as BREAK; bytes above 0x7F stay."""
    space, cut = re.compile(apart), re.compile(breaks) if breaks else None
    table = bytearray(range(256))
    for b in range(128):
        low = b + 32 if 65 <= b <= 90 else b
        table[b] = BREAK if cut and cut.match(chr(low)) else SPACE if space.match(chr(low)) else low
    return bytes(table)


class Words:
    """Words of one chunk: a code each, the dictionary of the codes, and where the words stand in the folded bytes."""

    def __init__(self, folded: bytes):
        raw = np.frombuffer(folded, np.uint8)
        inside = (raw != SPACE) & (raw != BREAK)
        edges = np.diff(inside.view(np.int8), prepend=np.int8(0), append=np.int8(0))
        self.starts, self.ends = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
        offsets = np.zeros(len(self.starts) + 1, np.int32)
        np.cumsum(self.ends - self.starts, out=offsets[1:])
        words = pa.StringArray.from_buffers(len(self.starts), pa.py_buffer(offsets), pa.py_buffer(raw[inside])).dictionary_encode()
        self.codes, self.dictionary = words.indices.to_numpy().astype(np.int64), words.dictionary
        self.raw = raw

    def __len__(self) -> int:
        return len(self.codes)

    def piece(self) -> np.ndarray:
        """The number of breaks before each word."""
        return np.searchsorted(np.flatnonzero(self.raw == BREAK), self.starts)


def slices(text: bytes, most: int = CHUNK_BYTES, gap: re.Pattern = re.compile(rb"[\n ]"), reach: int = 0):
    """Slices of a folded text, cut between words, each with the number of its bytes before the next slice begins; `reach` words of the next one follow them."""
    at = 0
    while at < len(text) or not at:
        cut = gap.search(text, at + most)
        cut = cut.start() + 1 if cut else len(text)
        end = cut
        for _ in range(reach if cut < len(text) else 0):
            word = re.compile(rb"[\n ]*[^\n ]+").match(text, end)
            end = word.end() if word else end
        yield text[at:end], cut - at
        at = max(cut, 1)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of strings; none for null."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]
