"""Words of many texts at once: where they start and their 64-bit hashes, over the bytes of an Arrow column."""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

SEED = 42
BYTES_AT_ONCE = 1 << 19
ODD = 0x9E3779B97F4A7C15


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


#: White space parts words; ASCII case is folded.
SPACE = np.isin(np.arange(256), list(b" \t\n\v\f\r"))
#: Everything in ASCII but digits and letters parts words.
PUNCTUATION = np.array([not (48 <= b <= 57 or 65 <= b <= 90 or 97 <= b <= 122 or b >= 128) for b in range(256)])
VALUE = mixed(np.frombuffer(bytes(range(256)).lower(), np.uint8).astype(np.uint64) + np.uint64(SEED))


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number, and of its inverse, modulo 2**64."""
    return tuple(np.multiply.accumulate(np.r_[np.uint64(1), np.full(n - 1, x, np.uint64)]) for x in (ODD, pow(ODD, -1, 1 << 64)))


def slices(column: pa.Array, limit: int | None = None) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """The texts of a string column in runs of at most ``limit`` bytes (one text at least): first, beyond last, bytes on end, where each begins."""
    limit = limit or BYTES_AT_ONCE
    texts = column.cast(pa.large_binary()).fill_null(b"")
    if not len(texts):
        return
    begins = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(begins, begins[at] + limit, "right")) - 1)
        yield at, end, data[begins[at] : begins[end]], begins[at:end] - begins[at]
        at = end


def words_of(data: np.ndarray, begins: np.ndarray, parts: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of texts start, their hashes (ASCII case aside) and bytes. ``data``: the texts' bytes on end, ``begins``: where each begins.

    A word's hash is a polynomial of its bytes, taken from prefix sums. Memory beyond the words goes with ``BYTES_AT_ONCE``
    or the longest single word.
    """
    edge = np.ones(len(data) + 1, bool)
    edge[1:] = parts[data]
    edge[begins[begins <= len(data)]] = True  # a word may start here
    found, at = [], 0
    while at < len(data):
        end = min(at + BYTES_AT_ONCE, len(data))
        if end < len(data) and not edge[end]:
            back = np.flatnonzero(edge[at + 1 : end])
            ahead = end + int(np.argmax(edge[end:])) if edge[end:].any() else len(data)
            end = at + 1 + int(back[-1]) if len(back) else ahead
        part = data[at:end]
        word = ~parts[part]
        first = np.flatnonzero(word & edge[at:end])
        over = np.r_[edge[at + 1 : end], True] | np.r_[parts[part[1:]], True]
        last = np.flatnonzero(word & over) + 1
        n = BYTES_AT_ONCE if end - at <= BYTES_AT_ONCE else end - at
        up, down = _powers(n) if n == BYTES_AT_ONCE else _powers.__wrapped__(n)
        sums = np.zeros(len(part) + 1, np.uint64)
        np.cumsum(VALUE[part] * up[: len(part)], out=sums[1:])
        found.append((first + at, mixed((sums[last] - sums[first]) * down[first]), last - first))
        at = end
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found))


def set_bits(h: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How many of the hashes of each group (they lie on end; ``starts``: where each begins, none empty) have each of the 64 bits."""
    sizes = np.diff(np.r_[starts, len(h)])
    runs = -(-sizes // 255)  # eight counters to a number: a byte is enough for 255 hashes
    first = np.r_[0, np.cumsum(runs)[:-1]]
    place = np.arange(runs.sum()) - np.repeat(first, runs)
    at = np.repeat(starts, runs) + 255 * place
    bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    part = np.add.reduceat(bits.view(np.uint64), at, axis=0).view(np.uint8).astype(np.int64)
    return part if len(part) == len(starts) else np.add.reduceat(part, first, axis=0)


def sim_hashes(h: np.ndarray, starts: np.ndarray, lanes: int) -> np.ndarray:
    """``lanes`` 64-bit SimHashes of each group of hashes, a row per group; hashes weigh as often as they are there."""
    sizes = np.diff(np.r_[starts, len(h)])
    draw = np.random.default_rng(SEED).integers(0, 1 << 63, (lanes, 2)).astype(np.uint64)
    out = np.empty((len(starts), lanes), np.uint64)
    for lane, (salt, odd) in enumerate(draw):
        x = (h ^ salt) * (odd | np.uint64(1))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(ODD)
        x ^= x >> np.uint64(29)
        out[:, lane] = np.packbits(set_bits(x, starts) * 2 > sizes[:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out
