"""Vectorised word hashes and window anchors over batches of texts."""

from __future__ import annotations

import numpy as np

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1 << 62, size=n, dtype=np.int64).view(np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _table(20240601, 256)
_ROOT = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def _power(base: np.uint64, n: int) -> np.ndarray:
    """base ** 0..n-1 modulo 2**64, kept for the longest n so far."""
    got = _powers.get(int(base))
    if got is None or len(got) < n:
        got = np.full(max(n, 1 << 16), base, np.uint64)
        got[0] = 1
        got = np.multiply.accumulate(got)
        _powers[int(base)] = got
    return got[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit (xor-shift-multiply)."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of each word (run of bytes that aren't ASCII white space)."""
    b = np.frombuffer(data, np.uint8)
    if not len(b):
        return np.empty(0, np.uint64)
    inside = np.concatenate([[False], ~_SPACE[b], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    if not len(starts):
        return np.empty(0, np.uint64)
    total = np.zeros(len(b) + 1, np.uint64)
    np.cumsum(_BYTE[b] * _power(_ROOT, len(b)), out=total[1:])
    return mix((total[ends] - total[starts]) * _power(_INVERSE, len(b))[starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive words, by doubling; empty if there are fewer."""
    if len(words) < n:
        return np.empty(0, np.uint64)
    base, width, done, out = _ROOT | np.uint64(1), 1, 0, None
    power, cur = words, base  # power: hash of `width` words; cur: base ** width
    scale = np.uint64(1)
    with np.errstate(over="ignore"):
        while True:
            if n & width:
                if out is None:
                    out, done = power, width
                else:
                    keep = len(power) - done
                    out = out[:keep] + scale * power[done : done + keep] if keep > 0 else np.empty(0, np.uint64)
                    done += width
                scale = scale * cur
            if done == n:
                return mix(out[: len(words) - n + 1])
            power = power[: len(power) - width] + cur * power[width:]
            cur, width = cur * cur, width * 2


def window_minimum(x: np.ndarray, n: int) -> np.ndarray:
    """Minimum of every n consecutive values."""
    width, out = 1, x
    while width * 2 <= n:
        out = np.minimum(out[:-width], out[width:])
        width *= 2
    return np.minimum(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1]) if n > width else out


def word_edges(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets of each word's start and end."""
    inside = np.concatenate([[False], ~_SPACE[np.frombuffer(data, np.uint8)], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def regions(texts: list[bytes], window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Stretches of windows that share their least gram, over a batch of texts.

    Every window of ``window`` words belongs to exactly one stretch, chosen by its content alone
    (least gram hash, leftmost on ties), so equal windows anywhere share their anchor. Returns
    text index, first and last window (word positions in the text), anchor hash, region
    hash (of the anchor and all words the windows cover) and the first window's place in the batch.
    """
    none = np.empty(0, np.int64)
    data = b"\n".join(texts)
    words = word_hashes(data)
    if len(words) < window:
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    starts, _ = word_edges(data)
    text_at = np.cumsum([0, *(len(t) + 1 for t in texts[:-1])])
    owner = np.searchsorted(text_at, starts, side="right") - 1
    first_word = np.searchsorted(starts, text_at)
    grams = gram_hashes(words, gram)
    low = np.uint64((1 << 28) - 1)
    # positions in the low bits: a batch holds fewer than 2**28 words, and ties go to the left
    tagged = (grams & ~low) | (np.arange(len(grams), dtype=np.uint64) & low)
    least = window_minimum(tagged, window - gram + 1)
    valid = owner[: len(least)] == owner[window - 1 :]
    new = np.concatenate([[True], (least[1:] != least[:-1]) | (owner[1 : len(least)] != owner[: len(least) - 1])])
    cut = np.flatnonzero(new & valid)
    if not len(cut):
        return none, none, none, none.view(np.uint64), none.view(np.uint64), none
    # a stretch ends before the next one starts or where windows stop fitting into the text
    stop = np.flatnonzero(np.concatenate([(new[1:] | ~valid[1:]) & valid[:-1], [valid[-1]]]))
    anchor = grams[(least[cut] & low).astype(np.int64)]
    total = np.zeros(len(words) + 1, np.uint64)
    np.cumsum(words * _power(_ROOT, len(words)), out=total[1:])
    content = mix((total[stop + window] - total[cut]) * _power(_INVERSE, len(words))[cut] + (stop - cut).astype(np.uint64))
    text = owner[cut]
    return text, cut - first_word[text], stop - first_word[text], anchor, mix(content ^ (anchor * np.uint64(3))), cut
