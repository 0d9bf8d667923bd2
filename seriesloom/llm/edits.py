"""Edit distances up to a limit, of many pairs of strings at once.

Myers' bit vectors over the diagonals that a distance within the limit can use (Hyyrö's band), a column of numpy arrays over many pairs of like
size. Pairs beyond their limit leave as soon as that is certain. Few pairs, or long ones, are compared one by one in whole numbers of Python. Both are exact.
"""

from __future__ import annotations

import numpy as np

#: Pairs of like size are compared together if there are as many, else one by one.
FEW = 12
#: Pairs count as of like size up to ``SMALL`` characters, or if the longest has one part in so many more than the shortest.
SMALL, WIDER = 320, 1
#: Kinds of characters that are counted apart.
KINDS = 256
#: Cells of tables that are worked on at once.
CELLS = 1 << 22


def _points(s: str | np.ndarray) -> np.ndarray:
    return s if isinstance(s, np.ndarray) else np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)


def _trimmed(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The strings without what both begin and end with, which needs no edit."""
    size = min(len(x), len(y))
    if not size or (x[0] != y[0] and x[-1] != y[-1]):
        return x, y
    other = x[:size] != y[:size]
    first = int(other.argmax())
    if not other[first]:
        return x[size:], y[size:]
    size -= first
    if len(x) != len(y):
        other = x[len(x) - size :] != y[len(y) - size :]
    last = int(other[::-1].argmax())
    last = last if other[-1 - last] else size
    return x[first : len(x) - last], y[first : len(y) - last]


def within(a: str | np.ndarray, b: str | np.ndarray, limit: int) -> bool:
    """Whether so many edits turn ``a`` into ``b``: Myers' bit vectors in one whole number, ended once too many are certain."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > limit:
        return False
    a, b = (x.tolist() for x in _trimmed(_points(a), _points(b)))
    if not b:
        return len(a) <= limit
    at: dict[int, int] = {}
    bit = 1
    for x in a:
        at[x] = at.get(x, 0) | bit
        bit <<= 1
    every, top = bit - 1, bit >> 1
    up, down, edits, left = every, 0, len(a), len(b)
    for x in b:
        eq = at.get(x, 0)
        across = (((eq & up) + up) ^ up) | eq
        more = down | every & ~(across | up)
        less = up & across
        left -= 1
        edits += bool(more & top) - bool(less & top)
        if edits - left > limit:
            return False
        eq |= down
        more = more << 1 | 1
        up = (less << 1 | ~(eq | more)) & every
        down = more & eq
    return edits <= limit


def _banded(a: list[np.ndarray], b: list[np.ndarray], limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each of ``b`` is within its limit of that of ``a``, which is as long or longer, by no more than the limit; and which few are left open."""
    long, short = (np.array([len(x) for x in y], np.int64) for y in (a, b))
    off = long - short  # the diagonal that ends in the last cell
    # A way that reaches diagonal d needs |d| edits at least, and |off - d| from there on.
    below = int(((limits - off) // 2).max()) + 1
    words = -(-(below + int(((limits + off) // 2).max()) + 2) // 64)
    points = np.concatenate([*a, *b])
    if points.max() > 4 * len(points):  # few of very many kinds
        kinds, codes = np.unique(points, return_inverse=True)
        codes, kinds = codes + 1, len(kinds)
    else:
        code = np.zeros(int(points.max()) + 1, np.uint32)
        code[points] = 1
        code = np.cumsum(code, dtype=np.uint32) * code  # kinds of characters, from 1
        codes, kinds = code[points], int(code.max())
    codes = codes.astype(np.uint8 if kinds < 255 else np.uint16 if kinds < 65535 else np.uint32)
    n, columns = len(a), int(short.max())
    x = np.zeros((n, columns + 64 * words), codes.dtype)  # 0 is like nothing
    y = np.full((columns, n), ~codes.dtype.type(0))
    at = 0
    for i, size in enumerate(long.tolist()):
        x[i, below : below + size] = codes[at : at + size][: x.shape[1] - below]
        at += size
    for i, size in enumerate(short.tolist()):
        y[:size, i] = codes[at : at + size]
        at += size
    up = np.zeros((words, n), np.uint64)  # where a row is one more than the row before; the band's first rows lie before the first
    for w in range(words):
        none = min(max(below - 64 * w, 0), 64)
        up[w] = 0 if none == 64 else ~np.uint64(0) << np.uint64(none)
    down = np.zeros_like(up)
    one, top = np.uint64(1), np.uint64(63)
    out = np.zeros(n, bool)
    who, word, bit = np.arange(n), (off + below) >> 6, ((off + below) & 63).astype(np.uint64)
    cell = word * n + who
    edits, left = off.copy(), short.copy()
    for j in range(columns):
        eq = np.ascontiguousarray(np.packbits(x[:, j : j + 64 * words] == y[j][:, None], axis=1, bitorder="little").view("<u8").T)
        same = eq & up
        total = same + up
        for w in range(words - 1):  # carries
            over = total[w] < same[w]
            if w:
                over |= (total[w] == same[w]) & carried
            total[w + 1] += over
            carried = over
        total ^= up
        total |= eq
        total |= down  # no more than a row and a column before
        more = total | up
        np.invert(more, out=more)
        more |= down
        less = total & up
        edits += 1 - ((total.ravel().take(cell) >> bit) & one).astype(np.int64)
        down = total >> one
        if words > 1:
            down[:-1] |= total[1:] << top
        up = down | more
        np.invert(up, out=up)
        up |= less
        down &= more
        left -= 1
        end = left == 0
        if end.any():
            out[who[end]] = edits[end] <= limits[end]
        if j % 16 == 15:
            on = (left > 0) & (edits <= limits)
            if on.sum() < FEW:
                return out, who[on]
            if on.sum() < 0.8 * len(on):
                x, y, up, down = x[on], y[:, on], up[:, on], down[:, on]
                who, word, bit, edits, left, limits = (z[on] for z in (who, word, bit, edits, left, limits))
                cell = word * len(who) + np.arange(len(who))
    return out, np.zeros(0, np.int64)


def _least(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Edits that each pair needs at least, as one side has characters that the other hasn't (told apart in ``KINDS`` kinds)."""

    def counts(x: list[np.ndarray]) -> np.ndarray:
        who = np.repeat(np.arange(0, KINDS * len(x), KINDS), [len(y) for y in x])
        return np.bincount(who + np.concatenate(x) % KINDS, minlength=KINDS * len(x)).reshape(-1, KINDS)

    more = counts(a) - counts(b)
    return np.maximum(np.maximum(more, 0).sum(axis=1), np.maximum(-more, 0).sum(axis=1))


def near(a: list, b: list, limits: np.ndarray) -> np.ndarray:
    """Whether ``limits`` edits turn each of ``a`` into that of ``b`` (strings, or arrays of whole numbers of 32 bits)."""
    out = np.zeros(len(a), bool)
    pairs = [_trimmed(_points(x), _points(y)) for x, y in zip(a, b)]
    pairs = [(x, y) if len(x) >= len(y) else (y, x) for x, y in pairs]
    long, short = np.array([(len(x), len(y)) for x, y in pairs], np.int64).reshape(-1, 2).T
    out[long <= limits] = True
    for i in np.flatnonzero((long == short) & ~out).tolist():
        out[i] = np.count_nonzero(pairs[i][0] != pairs[i][1]) <= limits[i]
    on = np.flatnonzero((long - short <= limits) & (short > 0) & ~out)
    on = on[np.argsort(long[on], kind="stable")]
    at = 0
    while at < len(on):
        size = int(long[on[at]])
        most = max(size + size // WIDER, SMALL)
        end = min(int(np.searchsorted(long[on], most, "right")), at + max(CELLS // (2 * most + 128), 1))
        part, at = on[at:end], end
        part = np.concatenate([x[_least(*zip(*(pairs[i] for i in x))) <= limits[x]] for x in np.split(part, range(4096, len(part), 4096))])
        if len(part) >= FEW:
            out[part], still = _banded([pairs[i][0] for i in part], [pairs[i][1] for i in part], limits[part])
            part = part[still]
        out[part] = [within(*pairs[i], int(limits[i])) for i in part]
    return out
