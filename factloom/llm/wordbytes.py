"""Vectorised word splitting and hashing over UTF-8 bytes.

Every separator of the word rules used here is an ASCII byte, and no byte of a
multi-byte UTF-8 character is below 0x80, so splitting bytes and splitting
characters give the same words.  Words are hashed with a polynomial over a
table of random 64-bit values (mod 2**64), all words of a slice at once.
"""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_M1, _M2 = U64(0xBF58476D1CE4E5B9), U64(0x94D049BB133111EB)
#: Bytes of text handled at once; temporaries take about 40 times as much.
SLICE_BYTES = 1 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: a bijection that spreads every input bit."""
    x = x ^ (x >> U64(30))
    x = x * _M1
    x = x ^ (x >> U64(27))
    x = x * _M2
    return x ^ (x >> U64(31))


def constants(n: int, seed: int) -> np.ndarray:
    """n well-spread 64-bit constants made by rule from a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=U64) * U64(0x9E3779B97F4A7C15) + U64(seed))


_TABLE = constants(256, 0x51ED)
_BASE = constants(1, 0xBA5E)[0] | U64(1)
#: Inverse of the odd base modulo 2**64.
_INVERSE = U64(pow(int(_BASE), -1, 1 << 64))
_POWERS: dict[str, np.ndarray] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get("up")
    if have is None or len(have) < n:
        size = max(n, SLICE_BYTES + 1)
        up, down = np.full(size, _BASE, U64), np.full(size, _INVERSE, U64)
        up[0] = down[0] = U64(1)
        with np.errstate(over="ignore"):
            _POWERS["up"], _POWERS["down"] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS["up"], _POWERS["down"]


def _lower_table() -> np.ndarray:
    low = np.arange(256, dtype=np.uint8)
    low[65:91] += 32
    return low


LOWER = _lower_table()


def separators(kind: str) -> np.ndarray:
    """Which bytes separate words: "space" (0x20, 0x09-0x0D) or "alnum" (all ASCII but 0-9 and a-z)."""
    out = np.zeros(256, bool)
    if kind == "space":
        out[[0x20, *range(0x09, 0x0E)]] = True
    elif kind == "alnum":
        out[:0x80] = True
        out[0x30:0x3A] = False
        out[0x61:0x7B] = False
    else:
        raise ValueError(kind)
    return out


class Words:
    """The words of a run of texts: text number, byte span (in ``data``) and hash of each."""

    __slots__ = ("data", "hashes", "starts", "ends", "first", "count", "beginnings")

    def __init__(self, data, hashes, starts, ends, first, count, beginnings):
        self.data, self.hashes, self.starts, self.ends, self.first, self.count, self.beginnings = data, hashes, starts, ends, first, count, beginnings

    def joined(self, a: int, b: int) -> bytes:
        """Words a..b-1 with single spaces between, as lower-cased bytes."""
        return b" ".join(self.data[s:e].tobytes() for s, e in zip(self.starts[a:b], self.ends[a:b]))


def split(texts: list[str | None], kind: str, beginnings: tuple[int, ...] = ()) -> Words:
    """Words of all texts; text i owns words first[i] .. first[i] + count[i] - 1.  A null text has none.

    For each length in `beginnings`, Words.beginnings has the numbers of longer words and hashes of their first bytes.
    """
    raws = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
    data = LOWER[np.frombuffer(b"\n".join(raws) + b"\n", np.uint8)]
    sizes = np.fromiter((len(r) for r in raws), np.int64, len(raws))
    del raws
    text_at = np.concatenate(([0], np.cumsum(sizes + 1)))
    inside = ~separators(kind)[data]
    edges = np.flatnonzero(np.diff(inside.astype(np.int8), prepend=np.int8(0)))
    starts, ends = edges[0::2], edges[1::2]  # the closing separator ends the last word
    with np.errstate(over="ignore"):
        up, down = _powers(len(data) + 1)
        total = _TABLE[data]
        total *= up[: len(data)]
        total = np.concatenate((np.zeros(1, U64), np.cumsum(total, dtype=U64)))
        hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64))
        cut = []
        for n in beginnings:
            at = np.flatnonzero(ends - starts > n)
            cut.append((at, mix((total[starts[at] + n] - total[starts[at]]) * down[starts[at]] + U64(n) * U64(0x9E3779B97F4A7C15))))
    bounds = np.searchsorted(starts, text_at)
    return Words(data, hashes, starts, ends, bounds[:-1], np.diff(bounds), cut)


def shingle_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of the `size` words from each word on; the last size - 1 entries mean nothing."""
    out = np.zeros(len(hashes), U64)
    with np.errstate(over="ignore"):
        for k, c in enumerate(constants(size, 0x5419)):
            n = len(hashes) - k
            if n > 0:
                out[:n] += hashes[k:] * (c | U64(1))
        return mix(out)


def slices(texts: list[str | None], most_bytes: int = SLICE_BYTES):
    """Index ranges of consecutive texts of about `most_bytes`; a longer text is a range of its own."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        n = len(t) if t else 0
        if i > begin and size + n > most_bytes:
            yield begin, i
            begin, size = i, 0
        size += n
    if begin < len(texts):
        yield begin, len(texts)


def lookup(hashes: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of hashes that are among the sorted keys, and which key each is.

    A bit table of 2**20 entries, of a fixed size, turns most hashes away first.
    """
    if not len(hashes) or not len(keys):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    shift = U64(44)
    bits = np.zeros(1 << 20, bool)
    bits[keys >> shift] = True
    at = np.flatnonzero(bits[hashes >> shift])
    found = np.minimum(np.searchsorted(keys, hashes[at]), len(keys) - 1)
    same = keys[found] == hashes[at]
    return at[same], found[same]
