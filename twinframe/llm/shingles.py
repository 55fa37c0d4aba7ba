"""Hashes of word shingles, for many texts at once in numpy."""

from __future__ import annotations

import numpy as np

from .common import utf8

WORDS = 5
#: Words and bytes hashed at a time; a longer text goes in overlapping parts.
PART_WORDS, PART_BYTES = 25_000, 300_000
BASE = 0x9E3779B97F4A7C15
EMPTY = np.zeros(0, np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit sways every output bit."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASE))
powers = {}


def power(base: int, n: int) -> np.ndarray:
    """base to the powers 0..n-1, modulo 2 to the 64."""
    if len(powers.get(base, ())) < n:
        steps = np.full(n, base & (1 << 64) - 1, np.uint64)
        steps[0] = 1
        powers[base] = np.cumprod(steps, dtype=np.uint64)
    return powers[base][:n]


def hashed(parts: list[tuple[int, bytes, int]], words: int) -> tuple[np.ndarray, np.ndarray]:
    """The owner and hash of each shingle of parts (owner, words joined by single spaces, number of words)."""
    data = np.frombuffer(b" ".join(p[1] for p in parts), np.uint8)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTES[data] * power(BASE, len(data)), out=sums[1:])
    spaces = np.flatnonzero(data == 32)
    starts, ends = np.concatenate([[0], spaces + 1]), np.append(spaces, len(data))
    count = np.array([p[2] for p in parts])
    many = np.maximum(count - words + 1, 1)
    base = np.cumsum(count) - count
    owner = np.repeat(np.array([p[0] for p in parts]), many)
    first = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many - base, many)
    last = np.minimum(first + words - 1, np.repeat(base + count - 1, many))
    begin, end = starts[first], ends[last]
    return owner, mix((sums[end] - sums[begin]) * power(pow(BASE, -1, 1 << 64), len(data))[begin] + (end - begin).astype(np.uint64))


def sets_of(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its shingles; with fewer words, that of all its words; without, none."""
    found: list[list[np.ndarray]] = [[] for _ in texts]
    parts: list[tuple[int, bytes, int]] = []
    size = 0

    def flush() -> None:
        nonlocal size
        if parts:
            owner, h = hashed(parts, words)
            cuts = np.flatnonzero(np.diff(owner)) + 1
            for i, run in zip(owner[np.concatenate([[0], cuts])].tolist(), np.split(h, cuts), strict=True):
                found[i].append(run)
        parts.clear()
        size = 0

    for i, text in enumerate(texts):
        split = utf8(text).lower().split() if text else []
        for at in range(0, max(len(split) - words + 1, 1) if split else 0, PART_WORDS):
            part = split[at : at + PART_WORDS + words - 1]
            joined = b" ".join(part)
            parts.append((i, joined, len(part)))
            size += len(joined)
            if size > PART_BYTES:
                flush()
    flush()
    out = []
    for runs in found:
        h = np.sort(np.concatenate(runs)) if runs else EMPTY
        out.append(h[np.concatenate([[True], h[1:] != h[:-1]])] if len(h) else h)
    return out
