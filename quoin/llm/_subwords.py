"""Hash buckets of words and of their character n-grams, for many words at once."""

from __future__ import annotations

import numpy as np

_MIX = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.random.default_rng(11).integers(1, 2**63, 64, dtype=np.uint64) | np.uint64(1)


def gram_buckets(words: list[str], sizes: tuple[int, ...], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each n-gram by the character where it begins, and the first character of each word.

    One column for each size; -1 where the n-gram would leave its word. The last column
    has the bucket of the whole word at its first character. Words stand between < and >
    and have at most 60 characters.
    """
    joined = "".join(f"<{w}>" for w in words)
    c = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    lengths = np.fromiter((len(w) + 2 for w in words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    starts = ends - lengths
    at = np.arange(len(c))
    left = np.repeat(ends, lengths) - at
    out = np.full((len(c), len(sizes) + 1), -1, dtype=np.int64)
    h = np.zeros(len(c), dtype=np.uint64)
    with np.errstate(over="ignore"):
        for n in range(1, max(sizes) + 1):
            shifted = np.zeros_like(c)
            shifted[: len(c) - n + 1] = c[n - 1 :]
            h = (h + shifted) * _MIX
            h ^= h >> np.uint64(29)
            if n in sizes:
                out[:, sizes.index(n)] = np.where(left >= n, (h >> np.uint64(20)).astype(np.int64) % buckets, -1)
        position = at - np.repeat(starts, lengths)
        whole = np.add.reduceat(c * _POWERS[position], starts)
        whole ^= whole >> np.uint64(31)
        out[starts, -1] = ((whole * _MIX) >> np.uint64(20)).astype(np.int64) % buckets
    return out, starts


def gram_means(words: list[str], sizes: tuple[int, ...], table: np.ndarray) -> np.ndarray:
    """Mean row of ``table`` over the buckets of each word."""
    if not words:
        return np.zeros((0, table.shape[1]), table.dtype)
    ids, starts = gram_buckets(words, sizes, len(table))
    padded = np.concatenate([table, np.zeros((1, table.shape[1]), table.dtype)])  # -1 reads the zero row
    total = padded[ids[:, 0]]
    for column in range(1, ids.shape[1]):
        total = total + padded[ids[:, column]]
    return np.add.reduceat(total, starts) / np.add.reduceat((ids >= 0).sum(axis=1), starts)[:, None]


def gram_lists(words: list[str], sizes: tuple[int, ...], buckets: int) -> dict[str, np.ndarray]:
    """The buckets of each word as an array."""
    if not words:
        return {}
    ids, starts = gram_buckets(words, sizes, buckets)
    ends = [*starts[1:].tolist(), len(ids)]
    return {w: (x := ids[a:b].ravel())[x >= 0] for w, a, b in zip(words, starts.tolist(), ends, strict=True)}
