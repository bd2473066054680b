"""Vectorised hashes over the characters and words of a text (numpy)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

U64 = np.uint64
BASE = 0x9E3779B97F4A7C15
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def mix64(x: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every input bit over all 64 output bits."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> U64(33))
    x = x * U64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> U64(33))


def rolling(values: np.ndarray, width: int) -> np.ndarray:
    """Polynomial hash of every window of ``width`` values, built by joining windows of doubling widths."""
    if len(values) < width:
        return np.zeros(0, dtype=U64)
    power, size = values, 1  # hash of windows of ``size``
    out, done = None, 0
    left = width
    while left:
        if left & 1:
            if out is None:
                out = power
            else:
                n = len(values) - (done + size) + 1
                out = out[:n] * U64(pow(BASE, size, 1 << 64)) + power[done : done + n]
            done += size
        left >>= 1
        if left:
            power = power[: len(power) - size] * U64(pow(BASE, size, 1 << 64)) + power[size:]
            size *= 2
    return out


_INVERSE = pow(BASE, -1, 1 << 64)
_POWERS: dict[str, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** 0 .. base ** n, kept between calls up to a megabyte of text."""
    have = _POWERS.get(str(base))
    if have is None or len(have) <= n:
        have = np.cumprod(np.concatenate([np.ones(1, U64), np.full(max(n, 4096), base, dtype=U64)]))
        if n <= 1 << 20:
            _POWERS[str(base)] = have
    return have[: n + 1]


def word_spans(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of a text and the starts and ends of its words, cut at ASCII white space."""
    raw = np.frombuffer(data, dtype=np.uint8)
    solid = ~_WHITE[raw]
    edge = np.diff(np.concatenate([[0], solid.view(np.int8), [0]]))
    return raw, np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: bytes) -> np.ndarray:
    """A 64-bit hash of every word: differences of one running polynomial sum, brought to a common power."""
    raw, start, end = word_spans(data)
    if not len(start):
        return np.zeros(0, dtype=U64)
    sums = np.concatenate([np.zeros(1, U64), np.cumsum((raw.astype(U64) + U64(1)) * _powers(BASE, len(raw))[:-1], dtype=U64)])
    return mix64((sums[end] - sums[start]) * _powers(_INVERSE, len(raw))[start] + (end - start).astype(U64))


def shingles(data: bytes, size: int) -> np.ndarray:
    """Hashes of all runs of ``size`` words; a shorter text that has words is one run."""
    words = word_hashes(data)
    if 0 < len(words) < size:
        size = len(words)
    return mix64(rolling(words, size)) if len(words) else words


PIECE = 1 << 20  # bytes of text whose words are hashed at a time


def long_text_words(text: bytes) -> np.ndarray:
    """Hashes of a text's words; a long text is cut at white space, so that only its hashes are held whole."""
    parts, a = [], 0
    while a < len(text):
        z = min(len(text), a + PIECE)
        while z < len(text) and text[z] not in b" \t\n\v\f\r":
            z += 1
        parts.append(word_hashes(text[a:z]))
        a = z
    return np.concatenate(parts) if parts else np.zeros(0, U64)


def pieces(texts: list[str]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first text, word hashes, ends) of texts in a row, about ``PIECE`` bytes at a time."""
    a, size, held = 0, 0, []
    for i, t in enumerate(texts):
        held.append(t.encode("utf-8"))
        size += len(held[-1])
        if size >= PIECE or i == len(texts) - 1:
            words = [long_text_words(h) for h in held] if len(held) == 1 else _together(held)
            yield a, np.concatenate(words), np.cumsum([len(w) for w in words])
            a, size, held = i + 1, 0, []


def _together(texts: list[bytes]) -> list[np.ndarray]:
    """Word hashes per text, from one pass over all of them."""
    if any(len(t) > PIECE for t in texts):
        return [long_text_words(t) for t in texts]
    joined = b"\n".join(texts)
    words = word_hashes(joined)
    _, start, _ = word_spans(joined)
    borders = np.cumsum([len(t) + 1 for t in texts])[:-1]
    return np.split(words, np.searchsorted(start, borders))
