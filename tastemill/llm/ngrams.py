"""Hashed character n-grams of whole texts, worked out over byte arrays."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Bytes worked on at once; a longer text is cut at a blank and its parts are added up.
CHUNK = 1 << 20

#: Letters in lower case (bytes above 127 belong to letters of other alphabets); all else becomes a blank.
LETTERS = bytes(c if c >= 128 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))

_MIX = np.uint32(0x9E3779B1)


def chunks(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """(text numbers, parts): parts in text order, at most about CHUNK bytes together."""
    at, parts, held = [], [], 0
    for i, text in enumerate(texts):
        text = text.translate(LETTERS)
        start = 0
        while True:
            end = len(text)
            if end - start > CHUNK:
                cut = text.rfind(b" ", start + 1, start + CHUNK)
                end = cut if cut > start else start + CHUNK
            if held and held + end - start > CHUNK:
                yield at, parts
                at, parts, held = [], [], 0
            at.append(i)
            parts.append(text[start:end])
            held += end - start + 2
            start = end
            if start >= len(text):
                break
    if at:
        yield at, parts


def spread(values: np.ndarray, bits: int) -> np.ndarray:
    """Mix 32-bit hashes and keep `bits` of them."""
    values = values * _MIX
    values ^= values >> np.uint32(15)
    values *= np.uint32(0x85EBCA77)
    return (values >> np.uint32(32 - bits)).astype(np.int32)


def join(parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, starts): each part with a blank on both sides."""
    sizes = np.fromiter((len(p) + 2 for p in parts), np.int64, len(parts))
    return np.frombuffer(b" " + b"  ".join(parts) + b" ", np.uint8), np.cumsum(sizes) - sizes


def subwords(data: np.ndarray, sizes: tuple[int, ...], bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, buckets) of the n-grams that lie in a word (with its blanks around it), then of whole words."""
    blank = data == 32
    seen = np.cumsum(blank, dtype=np.int32)
    letters = data.astype(np.uint32) + np.uint32(1)
    rolled, size = letters, 1
    for n in range(2, max(sizes) + 1):
        rolled = rolled[: len(data) - n + 1] * np.uint32(0x01000193) + letters[n - 1 :]
        size = n
        if n not in sizes or len(rolled) == 0:
            continue
        inner = seen[size - 2 : len(data) - 1] - seen[: len(rolled)]
        places = np.flatnonzero(inner == 0)
        yield places, spread(rolled[places] ^ np.uint32(n * 0x1F123BB5 & 0xFFFFFFFF), bits)
    starts = np.flatnonzero(blank[:-1] & ~blank[1:]) + 1
    if len(starts):
        inside = np.flatnonzero(~blank)
        word = np.cumsum(np.isin(inside, starts, assume_unique=True)) - 1
        offset = (inside - starts[word]).astype(np.uint32)
        mixed = (letters[inside] + offset * np.uint32(0x3C6EF372)) * _MIX
        mixed ^= mixed >> np.uint32(13)
        mixed *= np.uint32(0xC2B2AE35)
        sums = np.add.reduceat(mixed, np.searchsorted(inside, starts), dtype=np.uint32)
        yield starts, spread(sums, bits)
