"""A cuckoo filter over 64-bit keys: 16-bit marks, four to a bucket, with deletion."""

from __future__ import annotations

import numpy as np

from lexaxis.llm.textbatch import mix

SLOTS = 4
#: Share of the slots that may be taken before a filter is rebuilt at a larger size.
MAX_LOAD = 0.8
_KICKS = 500


class CuckooFilter:
    """Holds each key once per insert(). Never misses a held key; may find one that isn't held.

    A mark that finds no slot after many moves goes to `stash`, which is searched too.
    """

    def __init__(self, buckets: int) -> None:
        if buckets & (buckets - 1):
            raise ValueError("the number of buckets is a power of two")
        self.table = np.zeros((buckets, SLOTS), np.uint16)
        self.stash: list[tuple[int, int]] = []

    @classmethod
    def for_keys(cls, n: int) -> CuckooFilter:
        need = max(1, int(np.ceil(n / (SLOTS * MAX_LOAD))))
        return cls(1 << (need - 1).bit_length())

    @property
    def capacity(self) -> int:
        return int(self.table.size * MAX_LOAD)

    @property
    def held(self) -> int:
        return int(np.count_nonzero(self.table)) + len(self.stash)

    def _places(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        h = mix(keys)
        mark = (h >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1
        one = (h & np.uint64(len(self.table) - 1)).astype(np.int64)
        return mark, one, self._other(one, mark)

    def _other(self, at: np.ndarray, mark: np.ndarray) -> np.ndarray:
        return at ^ (mix(mark.astype(np.uint64)) & np.uint64(len(self.table) - 1)).astype(np.int64)

    def contains(self, keys: np.ndarray) -> np.ndarray:
        mark, one, two = self._places(keys)
        found = (self.table[one] == mark[:, None]).any(1) | (self.table[two] == mark[:, None]).any(1)
        for at, held in self.stash:
            found |= (mark == held) & ((one == at) | (two == at))
        return found

    def _fill(self, mark: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Puts marks in free slots of their buckets; True where one was found."""
        order = np.argsort(at, kind="stable")
        sorted_at = at[order]
        first = np.flatnonzero(np.r_[True, sorted_at[1:] != sorted_at[:-1]]) if len(at) else np.zeros(0, np.int64)
        rank = np.arange(len(at)) - np.repeat(first, np.diff(np.r_[first, len(at)]))
        done = np.zeros(len(at), bool)
        taken = (self.table[sorted_at] != 0).sum(1)
        ok = taken + rank < SLOTS
        if ok.any():
            # free slots of a bucket, in order: the rank-th free one goes to the rank-th newcomer
            free = np.argsort(self.table[sorted_at[ok]] != 0, axis=1, kind="stable")
            slot = free[np.arange(ok.sum()), rank[ok]]
            self.table[sorted_at[ok], slot] = mark[order[ok]]
            done[order[ok]] = True
        return done

    def insert(self, keys: np.ndarray) -> None:
        mark, one, two = self._places(keys)
        left = ~self._fill(mark, one)
        mark, two = mark[left], two[left]
        left = ~self._fill(mark, two)
        random = np.random.default_rng(len(self.table))
        for m, at in zip(mark[left].tolist(), two[left].tolist(), strict=True):
            for _ in range(_KICKS):
                slot = int(random.integers(SLOTS))
                m, self.table[at, slot] = int(self.table[at, slot]), m
                at = int(self._other(np.array([at]), np.array([m], np.uint16))[0])
                free = np.flatnonzero(self.table[at] == 0)
                if len(free):
                    self.table[at, free[0]] = m
                    break
            else:
                self.stash.append((at, m))

    def delete(self, keys: np.ndarray) -> None:
        """Takes one mark of each key out; every key must be held."""
        mark, one, two = self._places(keys)
        while len(mark):
            inside = np.stack([self.table[at] == mark[:, None] for at in (one, two)], axis=1).reshape(len(mark), -1)
            slot = inside.argmax(1)
            place = np.where(slot < SLOTS, one, two) * SLOTS + slot % SLOTS
            found = inside.any(1)
            for i in np.flatnonzero(~found).tolist():
                at = next((x for x in ((int(one[i]), int(mark[i])), (int(two[i]), int(mark[i]))) if x in self.stash), None)
                if at is None:
                    raise KeyError("a key that isn't held can't be deleted")
                self.stash.remove(at)
            # keys of one mark may have picked one place: the first takes it, the others look again
            found = np.flatnonzero(found)
            taken, first = np.unique(place[found], return_index=True)
            self.table.reshape(-1)[taken] = 0
            again = np.delete(found, first)
            mark, one, two = mark[again], one[again], two[again]

    def to_bytes(self) -> bytes:
        stash = np.array(self.stash, np.int64).reshape(-1, 2)
        return np.array([len(self.table), len(stash)], np.int64).tobytes() + stash.tobytes() + self.table.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> CuckooFilter:
        buckets, stashed = (int(x) for x in np.frombuffer(data, np.int64, 2))
        made = cls(buckets)
        made.stash = [tuple(x) for x in np.frombuffer(data, np.int64, 2 * stashed, 16).reshape(-1, 2).tolist()]
        made.table = np.frombuffer(data, np.uint16, buckets * SLOTS, 16 + 16 * stashed).reshape(-1, SLOTS).copy()
        return made
