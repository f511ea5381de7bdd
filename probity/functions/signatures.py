"""MinHash slots of texts in Python and numpy: what one text is asked against many needs neither signatures of all texts nor rows for pairs."""

from __future__ import annotations

import hashlib

import numpy as np

try:
    from _md5 import md5  # the same digests in half the time of hashlib's
except ImportError:
    from hashlib import md5

_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(29)


class Codes(dict):
    """64-bit digests of tokens. Bounded by starting anew."""

    def __missing__(self, token: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[token] = h = int.from_bytes(hashlib.blake2b(token.encode(), digest_size=8).digest(), "little")
        return h


def digests(codes: Codes, words: list[str], k: int) -> np.ndarray:
    """64-bit digests of all k-word sequences, in order."""
    c = np.fromiter(map(codes.__getitem__, words), np.uint64, len(words))
    n = len(c) - k + 1
    h = np.zeros(n, np.uint64)
    for j in range(k):
        h = (h ^ (h >> _SHIFT)) * _FACTOR + c[j : j + n]
    return h ^ (h >> _SHIFT)


def strings(words: list[str], starts: np.ndarray, k: int) -> list[bytes]:
    return [" ".join(words[i : i + k]).encode() for i in starts.tolist()]


def least(slot: int, shingles: list[bytes]) -> int:
    """Which shingle has the least md5 after the slot's number."""
    salt = str(slot).encode()
    hashes = [md5(salt + x).digest() for x in shingles]
    return hashes.index(min(hashes))


def sign(codes: Codes, words: list[str], k: int, slots: int) -> tuple[np.ndarray, np.ndarray]:
    """(sorted digests of the distinct shingles, the digest of the least one of each slot)."""
    of, at = np.unique(digests(codes, words, k), return_index=True)
    shingles = strings(words, at, k)
    return of, of[[least(i, shingles) for i in range(slots)]]


class Targets:
    """Signed texts, asked for those that another text resembles.

    A slot of two texts is equal if the target's least shingle is in the other text and none of the other's own shingles is below it. The first is looked up
    for all targets at once and bounds the estimate from above; only what the bound leaves is hashed, until a shingle below is found or too few slots are left."""

    def __init__(self, sets: list[np.ndarray], signed: list[np.ndarray], k: int, slots: int):
        self.k, self.slots, self.ends = k, slots, np.cumsum([0, *map(len, sets)])
        self.flat = np.concatenate([np.empty(0, np.uint64), *sets])
        x = np.concatenate([np.empty(0, np.uint64), *signed])
        order = np.argsort(x, kind="stable")
        self.x, self.owner, self.slot = x[order], (order // slots).astype(np.int32), (order % slots).astype(np.int16)
        bits = min(24, max(10, len(x).bit_length() + 3))
        self.shift, self.known = np.uint64(64 - bits), np.zeros(1 << bits, bool)
        self.known[self.x >> self.shift] = True

    def find(self, codes: Codes, words: list[str], most_below: float) -> list[tuple[int, int, int, int]]:
        """(target, shared shingles, shingles of the target, equal slots) of each target with more than `most_below` of all slots equal."""
        if len(words) < self.k:
            return []
        h = digests(codes, words, self.k)
        near = np.unique(h[self.known[h >> self.shift]])
        low = np.searchsorted(self.x, near)
        n = np.searchsorted(self.x, near, "right") - low
        met = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(n.sum())
        count = np.bincount(self.owner[met], minlength=len(self.ends) - 1)
        found = np.flatnonzero(count / self.slots > most_below)
        if not len(found):
            return []
        met = met[np.isin(self.owner[met], found)]
        met = met[np.argsort(self.owner[met], kind="stable")]
        of, at = np.unique(h, return_index=True)
        shingles = strings(words, at, self.k)
        place = dict(zip(of.tolist(), range(len(of)), strict=True))
        top: dict[int, int] = {}  # slot -> digest of the text's least shingle, where it is known
        low: dict[int, bytes] = {}  # slot -> a hash that one of the text's shingles has there

        def is_least(i: int, x: int, own: list[bytes]) -> bool:
            """Whether none of the text's shingles is below x, the least of a target without `own`. What one target shows holds for the next."""
            if i in top:
                return top[i] == x
            salt = str(i).encode()
            to = md5(salt + shingles[place[x]]).digest()
            if low.get(i, to) < to:
                return False
            for begin in range(0, len(own), 64):
                if (least := min([md5(salt + y).digest() for y in own[begin : begin + 64]])) < to:
                    low[i] = least
                    return False
            top[i] = x
            return True

        out, begin = [], 0
        for t, slots in zip(found.tolist(), count[found].tolist(), strict=True):
            rows, begin = met[begin : begin + slots], begin + slots
            theirs = self.flat[self.ends[t] : self.ends[t + 1]]
            both = theirs[np.minimum(np.searchsorted(theirs, of), len(theirs) - 1)] == of
            own, equal = [shingles[i] for i in np.flatnonzero(~both).tolist()], slots
            for i, x in zip(self.slot[rows].tolist(), self.x[rows].tolist(), strict=True):
                equal -= not is_least(i, x, own)
                if equal / self.slots <= most_below:
                    break
            else:
                out.append((t, int(both.sum()), len(theirs), equal))
        return out
