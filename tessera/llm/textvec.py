r"""Vectorised helpers for whole texts inside a task: words, byte and word hashes.

The texts of one Arrow batch are joined (with a line feed between them) into
one byte array, so that splitting and hashing are a few numpy passes and no
Python loop runs per word. Work is cut into chunks of about `CHUNK` bytes; a
longer text is a chunk of its own and is never cut.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np

CHUNK = 1 << 18
U = np.uint64
_BASE = 0x9E3779B97F4A7C15
_M1, _M2, _M3 = U(0xBF58476D1CE4E5B9), U(0x94D049BB133111EB), U(0xD6E8FEB86659FD93)

BYTE_VALUE = np.random.default_rng(20240101).integers(1, 2**63, 256).astype(np.uint64) * U(2) + U(1)

#: words `[^\x20\x09-\x0D]+`
SPACE_WORD = np.ones(256, np.uint8)
SPACE_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = 0
#: words `[^\x00-\x2F\x3A-\x60\x7B-\x7F]+` after lower-casing A-Z
ALNUM_WORD = np.ones(256, np.uint8)
ALNUM_WORD[0x00:0x30] = 0
ALNUM_WORD[0x3A:0x61] = 0
ALNUM_WORD[0x7B:0x80] = 0
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        m = max(n, CHUNK + (1 << 18))
        for k, base in enumerate((_BASE, pow(_BASE, -1, 2**64))):
            step = np.full(m, U(base))
            step[0] = U(1)
            _powers[k] = np.cumprod(step, dtype=np.uint64)
    return _powers[0], _powers[1]


def mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser, so that sums of mixed values carry no structure."""
    x = (x ^ (x >> U(30))) * _M1
    x = (x ^ (x >> U(27))) * _M2
    return x ^ (x >> U(31))


def join_names(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Name of a concatenation from the names of its two parts (order matters)."""
    return mix(a * _M3 + (b ^ (b >> U(32))))


class Joined(NamedTuple):
    buf: np.ndarray      # the texts' bytes, each followed by a line feed
    begin: np.ndarray    # first byte of each text
    end: np.ndarray      # one past its last byte


def joined(texts: list[bytes]) -> Joined:
    size = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    end = np.cumsum(size + 1) - 1
    return Joined(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8), end - size, end)


def bodies(batch) -> list[bytes]:
    """Texts of an Arrow batch: its column `body`, or else `text` of its struct `row`, which then crosses once."""
    if "body" in batch.schema.names:
        return batch.column("body").to_pylist()
    return [t or b"" for t in batch.column("row").field("text").cast("binary").to_pylist()]


def chunked(sizes: list[int], limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes sum to about `limit` bytes."""
    a, total = 0, 0
    for i, s in enumerate(sizes):
        if total and total + s > limit:
            yield a, i
            a, total = i, 0
        total += s + 1
    if a < len(sizes):
        yield a, len(sizes)


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    p, _ = _power_tables(len(buf) + 1)
    out = np.empty(len(buf) + 1, np.uint64)
    out[0] = 0
    np.cumsum(BYTE_VALUE[buf] * p[:len(buf)], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of each byte span, a function of its bytes alone."""
    _, inverse = _power_tables(len(prefix))
    return mix((prefix[end] - prefix[start]) * inverse[start] + (end - start).astype(np.uint64))


class Words(NamedTuple):
    start: np.ndarray    # byte span of each word in the joined buffer
    end: np.ndarray
    doc: np.ndarray      # text index of each word
    first: np.ndarray    # per text: index of its first word
    count: np.ndarray    # per text: number of words


def split_words(j: Joined, kind: np.ndarray) -> Words:
    edge = np.diff(kind[j.buf], prepend=np.uint8(0))
    start = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == 255)
    first = np.searchsorted(start, j.begin)
    count = np.searchsorted(start, j.end) - first
    return Words(start, end, np.repeat(np.arange(len(count)), count), first, count)


def word_hash(j: Joined, w: Words) -> np.ndarray:
    return span_hash(byte_prefix(j.buf), w.start, w.end)


def run_names(name: np.ndarray, length: int) -> np.ndarray:
    """Name of every run of `length` consecutive items, by doubling.

    `name_2h(p)` joins `name_h(p)` and `name_h(p + h)`; the binary digits of
    `length` say which of the doubled names make up the rest.
    """
    n = len(name) - length + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, offset, power, h = None, 0, name, 1
    while True:
        if length & h:
            part = power[offset:offset + n]
            out = part if out is None else join_names(out, part)
            offset += h
        h *= 2
        if h > length:
            return out if length > 1 else mix(out)
        power = join_names(power[:len(power) - h // 2], power[h // 2:])


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Boolean mask of `n` items: covered by a run [s, s + length)."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + length, n), -1)
    return np.cumsum(step[:n]) > 0
