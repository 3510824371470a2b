"""Tokens, hashes and batches shared by the Arrow-backed operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

#: Native (Java and RE2) pattern of a whitespace-separated word.
WORD = r"[^\x20\x09-\x0D]+"

#: Work on so many bytes of text at a time, so that temporaries stay small.
CHUNK_BYTES = 1 << 21


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding. ``bytes.lower`` folds A-Z only and
    ``bytes.split`` splits at the six ASCII blanks only, which is just what the operators need."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return column.cast(kind).to_pylist()


def chunks(texts: list[bytes | None], budget: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Half-open index ranges whose texts add up to about ``budget`` bytes; a longer text is alone."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        n = len(text) if text else 0
        if size and size + n > budget:
            yield first, i
            first, size = i, 0
        size += n
    if first < len(texts):
        yield first, len(texts)


def word_hashes(words: list[bytes]) -> np.ndarray:
    """64-bit hashes, equal on every executor."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every input bit."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0x9E3779B97F4A7C15)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0xD1B54A32D192ED03)
    return x ^ (x >> np.uint64(32))


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash per window of ``width`` consecutive words (fewer words: none)."""
    n = len(hashes) - width + 1
    if n < 1:
        return hashes[:0]
    out = np.zeros(n, np.uint64)
    for k in range(width):
        out = out * np.uint64(0xC2B2AE3D27D4EB4F) + hashes[k : k + n]
    return mix64(out)


def shingle_set(text: bytes | None, width: int = 5) -> np.ndarray:
    """Sorted distinct shingle hashes of the A-Z-folded text; a shorter text is one shingle, one
    without words has none."""
    if not text:
        return np.empty(0, np.uint64)
    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    hashes = word_hashes(words)
    return np.unique(window_hashes(hashes, min(width, len(words))))
