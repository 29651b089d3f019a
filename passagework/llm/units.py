"""Units of text cut out of byte arrays, and ids remembered by distinct unit: whole batches without a loop over words."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import repeat

import numpy as np
import pyarrow as pa

#: Distinct units, and their bytes, that a task remembers; then it forgets all but the half met most often.
REMEMBERED, REMEMBERED_BYTES = 600_000, 64 << 20
#: Units encoded in one call.
AT_ONCE = 48


def bytes_where(test: Callable[[int], bool]) -> np.ndarray:
    return np.array([test(b) for b in range(256)])


def binary(held: np.ndarray, offsets: np.ndarray) -> pa.LargeBinaryArray:
    """Byte strings that lie behind each other in `held`."""
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(np.ascontiguousarray(held))])


def runs(held: np.ndarray, at: np.ndarray, inside: np.ndarray, kinds: np.ndarray | None = None) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """Maximal runs of bytes with `inside`, over all texts, none across two texts; and before which run each text begins.

    `at` has the texts' offsets in `held`, one more than texts; so has the second result. Runs also end between bytes of
    `kinds` 1 and 2.
    """
    kept = inside[held]
    begins = kept.copy()
    begins[1:] &= ~kept[:-1]
    if kinds is not None:
        kind = kinds[held]
        begins[1:] |= kind[1:] * kind[:-1] == 2
    first = at[:-1][at[:-1] < at[1:]]
    begins[first] = kept[first]
    places = np.flatnonzero(begins)
    before = np.cumsum(kept)
    total = int(before[-1]) if len(before) else 0
    return binary(held[kept], np.append(before[places] - 1, total)), np.searchsorted(places, at)


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each stretch, one stretch after another."""
    ends = np.cumsum(lengths)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts - ends + lengths, lengths)


class Remembered:
    """Id lists of distinct units, made once by `encode` while remembered.

    `encode` takes units and gives, for each of `sides`, their ids behind each other and how many each has. Units met often are kept, so that few of the rare
    ones that follow each other push them out.
    """

    def __init__(self, encode: Callable[[list[bytes]], Sequence[tuple[np.ndarray, np.ndarray]]], sides: int = 1, most: int | None = None):
        self.encode, self.sides, self.most = encode, sides, most or REMEMBERED
        self.new_ids, self.new_lengths = ([[] for _ in range(sides)] for _ in range(2))
        self._keep(np.empty(0, np.int64))

    def _keep(self, codes: np.ndarray) -> None:
        """Forgets all units but those at some places, which move up in their order."""
        if not len(codes):
            self.names, self.times = [], np.empty(0, np.int64)
            self.ids = [np.empty(0, np.int32) for _ in range(self.sides)]
            self.starts = [np.zeros(1, np.int64) for _ in range(self.sides)]
        else:
            held = [self.gather(codes, side) for side in range(self.sides)]
            self.names, self.times = [self.names[c] for c in codes.tolist()], self.times[codes] // 2
            self.ids, self.starts = [ids for ids, _ in held], [np.append(0, np.cumsum(lengths)) for _, lengths in held]
        self.places = {u: k for k, u in enumerate(self.names)}
        self.held_bytes = sum(map(len, self.names))

    def codes(self, units: pa.LargeBinaryArray) -> np.ndarray:
        """A place for each unit; valid until the next call."""
        coded = units.dictionary_encode()
        names, which = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        if len(self.places) + len(names) > self.most or self.held_bytes > REMEMBERED_BYTES:
            often = np.argsort(-self.times, kind="stable")[:self.most // 2]
            self._keep(np.sort(often[self.times[often] > 1]) if self.held_bytes <= REMEMBERED_BYTES else often[:0])
        known = np.fromiter(map(self.places.get, names, repeat(-1)), np.int64, len(names))
        new = np.flatnonzero(known < 0)
        if len(new):
            known[new] = len(self.places) + np.arange(len(new))
            fresh = [names[k] for k in new.tolist()]
            for at in range(0, len(fresh), AT_ONCE):
                self._add(fresh[at:at + AT_ONCE])
            self.ids = [np.concatenate([old, *new]) for old, new in zip(self.ids, self.new_ids, strict=True)]
            self.starts = [np.concatenate([old, old[-1] + np.cumsum(np.concatenate(new))]) for old, new in zip(self.starts, self.new_lengths, strict=True)]
            self.times = np.append(self.times, np.zeros(len(fresh), np.int64))
        self.new_ids, self.new_lengths = ([[] for _ in range(self.sides)] for _ in range(2))
        if not len(names):
            return np.empty(0, np.int64)
        codes = known[which]
        self.times += np.bincount(codes, minlength=len(self.times))
        return codes

    def _add(self, fresh: list[bytes]) -> None:
        self.held_bytes += sum(map(len, fresh))
        self.places.update(zip(fresh, range(len(self.places), len(self.places) + len(fresh)), strict=True))
        self.names += fresh
        for side, (ids, lengths) in enumerate(self.encode(fresh)):
            self.new_ids[side].append(ids)
            self.new_lengths[side].append(lengths)

    def gather(self, codes: np.ndarray, side: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units behind each other, and how many each unit has."""
        starts = self.starts[side]
        lengths = starts[codes + 1] - starts[codes]
        return self.ids[side][spread(starts[codes], lengths)], lengths
