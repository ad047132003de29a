"""Bases, stretches and their minwise signatures, in numpy over Arrow batches.

A base is a letter; a stretch is 16 neighbouring bases out of A, C, G, T, equal to its reverse
complement, so it fits an unsigned 32-bit number. Everything here works on whole sequences,
in blocks of a few records so that arrays stay in the processor's cache.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

K = 16
OTHER, NONE = 4, 255
_CODE = np.full(256, NONE, np.uint8)
for _i in range(26):
    _CODE[ord("A") + _i] = _CODE[ord("a") + _i] = OTHER
for _i, _c in enumerate("ACGT"):
    _CODE[ord(_c)] = _CODE[ord(_c.lower())] = _i
#: Bases in a block of records that are worked on together.
BLOCK = 1 << 16


def _plain(text: str) -> bytes:
    """A text with letters beyond ASCII: those are bases too, though none of A, C, G, T."""
    return "".join(c if c.isascii() else "X" if c.isalpha() else "" for c in text).encode()


def encode(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all bases of a string column, and where each record starts (one more entry than records)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if len(column) == 0:
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if column.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    raw = np.frombuffer(column.buffers()[2], np.uint8)[ends[0] : ends[-1]]
    if raw.size and raw.max() >= 128:
        texts = [b"" if t is None else t if t.isascii() else _plain(t.decode("utf-8", "replace")) for t in column.to_pylist()]
        raw = np.frombuffer(b"".join(texts), np.uint8)
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    codes = _CODE[raw]
    keep = codes != NONE
    if keep.all():
        return codes, ends - ends[0]
    upto = np.concatenate([[0], np.cumsum(keep)])
    return codes[keep], upto[ends - ends[0]]


def stretches(codes: np.ndarray) -> np.ndarray:
    """The number of the stretch that starts at each base; meaningless where one isn't made of A, C, G, T."""
    f = codes.astype(np.uint32)
    f &= np.uint32(3)
    r = np.uint32(3) - f
    w = 1
    while w < K:
        s = np.uint32(2 * w)
        f, r = (f[:-w] << s) | f[w:], (r[w:] << s) | r[:-w]
        w *= 2
    return np.minimum(f, r)


def scramble(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 32-bit numbers that spreads every bit."""
    x = x ^ (x >> np.uint32(16))
    x *= np.uint32(0x7FEB352D)
    x ^= x >> np.uint32(15)
    x *= np.uint32(0x846CA68B)
    x ^= x >> np.uint32(16)
    return x


def record_stretches(codes: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scrambled stretches of the records laid end to end, and how many each has (repeats included)."""
    n = len(codes) - K + 1
    if n <= 0:
        return np.empty(0, np.uint32), np.zeros(len(starts) - 1, np.int64)
    bad = np.zeros(len(codes) + 1, np.int32)
    np.cumsum(codes >= OTHER, out=bad[1:])
    ok = bad[K:] == bad[:-K]
    inner = starts[1:-1]
    if len(inner):  # a stretch that would run into the next record
        over = (inner[:, None] - np.arange(1, K)[None, :]).ravel()
        ok[over[(over >= 0) & (over < n)]] = False
    h = scramble(stretches(codes))
    upto = np.concatenate([[0], np.cumsum(ok)])
    return h[ok], np.diff(upto[np.minimum(starts, n)])


def distinct(codes: np.ndarray) -> np.ndarray:
    """The distinct stretches of one record, sorted."""
    found = np.sort(record_stretches(codes, np.array([0, len(codes)]))[0])
    return found[np.concatenate([[True], found[1:] != found[:-1]])] if len(found) else found


def multipliers(count: int, seed: int = 20) -> np.ndarray:
    """Odd multipliers; each gives another order of the scrambled stretches."""
    return (np.random.default_rng(seed).integers(1 << 20, 1 << 32, count, dtype=np.uint64) | 1).astype(np.uint32)


def signatures(codes: np.ndarray, starts: np.ndarray, orders: np.ndarray, both_ends: bool) -> tuple[np.ndarray, np.ndarray]:
    """Per record the least stretch under each order and, with both_ends, also the greatest; and the number of distinct stretches.

    Records without a stretch get a row of zeros and count 0. With both_ends one hash evaluation
    yields two signature values: the columns alternate least, greatest.
    """
    n = len(starts) - 1
    per = 2 if both_ends else 1
    out = np.zeros((n, per * len(orders)), np.uint32)
    counts = np.zeros(n, np.int64)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(starts, starts[i] + BLOCK, side="right")) - 1)
        h, c = record_stretches(codes[starts[i] : starts[j]], starts[i : j + 1] - starts[i])
        live = np.flatnonzero(c)
        if len(live):
            at = np.concatenate([[0], np.cumsum(c[live])[:-1]])
            for k, (a, b) in enumerate(zip(at.tolist(), [*at[1:].tolist(), len(h)], strict=True)):
                one = np.sort(h[a:b])
                counts[i + live[k]] = 1 + np.count_nonzero(one[1:] != one[:-1])
            work = np.empty_like(h)
            for p, a in enumerate(orders):
                np.multiply(h, a, out=work)
                out[i + live, per * p] = np.minimum.reduceat(work, at)
                if both_ends:
                    out[i + live, 2 * p + 1] = np.maximum.reduceat(work, at)
        i = j
    return out, counts


def pack(codes: np.ndarray) -> bytes:
    """Codes in two bits a base, or four where a base is none of A, C, G, T."""
    wide = bool((codes >= OTHER).any())
    per = 2 if wide else 4
    padded = np.zeros(-(-len(codes) // per) * per, np.uint8)
    padded[: len(codes)] = codes
    weights = np.array([16, 1] if wide else [64, 16, 4, 1], np.uint8)
    body = (padded.reshape(-1, per) * weights).sum(axis=1, dtype=np.uint8)
    return bytes([wide]) + len(codes).to_bytes(8, "little") + body.tobytes()


def unpack(packed: bytes) -> np.ndarray:
    """The codes that pack() was given."""
    n = int.from_bytes(packed[1:9], "little")
    body = np.frombuffer(packed, np.uint8, offset=9)
    shifts = np.array([4, 0] if packed[0] else [6, 4, 2, 0], np.uint8)
    return ((body[:, None] >> shifts) & (15 if packed[0] else 3)).ravel()[:n]


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many values two sorted distinct arrays have in common."""
    both = np.concatenate([a, b])
    both.sort(kind="stable")
    return int((both[1:] == both[:-1]).sum())


def each_record(codes: np.ndarray, starts: np.ndarray) -> Iterator[np.ndarray]:
    for i in range(len(starts) - 1):
        yield codes[starts[i] : starts[i + 1]]
