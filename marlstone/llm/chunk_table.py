"""A table of distinct chunks and their ids, kept while a task runs.

Tokenizers whose pieces cannot cross certain marks cut a text into chunks that
are encoded alone. Each distinct chunk is encoded once; the ids of a text are
those of its chunks, joined back by position with array arithmetic.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa

#: Distinct chunks kept by a task; beyond it the table starts anew, which costs time but changes no result.
TABLE_CHUNKS = 300_000


def flattened(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, lists), np.int64, len(lists))
    return np.fromiter((i for x in lists for i in x), np.int32, int(lengths.sum())), lengths


class ChunkTable:
    """``encode`` gives the ids of chunks one after another, and the number of each chunk's; it may append a note
    on each chunk to ``notes``, which are kept by slot."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, np.ndarray]], most: int = TABLE_CHUNKS):
        self.encode, self.most = encode, most
        self.clear()

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.notes: list[str] = []
        self.ids = np.zeros(1 << 16, np.int32)
        self.used = 0
        self.start = np.zeros(0, np.int64)
        self.length = np.zeros(0, np.int64)

    def slots(self, chunks: list[str]) -> np.ndarray:
        """The slot of each of these distinct chunks, new ones encoded."""
        found = list(map(self.slot.get, chunks))
        new = [c for c, s in zip(chunks, found) if s is None]
        if not new:
            return np.array(found, np.int64)
        if self.slot and len(self.slot) + len(new) > self.most:
            self.clear()
            found, new = [None] * len(chunks), chunks
        ids, lengths = self.encode(new)
        need = len(ids)
        if self.used + need > len(self.ids):
            grown = np.zeros(max(2 * len(self.ids), self.used + need), np.int32)
            grown[: self.used] = self.ids[: self.used]
            self.ids = grown
        self.ids[self.used : self.used + need] = ids
        first = len(self.slot)
        self.slot.update(zip(new, range(first, first + len(new))))
        self.start = np.concatenate([self.start, self.used + np.cumsum(lengths) - lengths])
        self.length = np.concatenate([self.length, lengths])
        self.used += need
        # New chunks took slots in the order in which they stand.
        out = np.fromiter((-1 if s is None else s for s in found), np.int64, len(found))
        out[out < 0] = np.arange(first, first + len(new))
        return out

    def join(self, flat: pa.Array, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The ids of all chunks in order, the offsets that delimit the texts (from ``offsets`` in chunks), and the notes
        on the chunks in order (if there are any)."""
        coded = flat.dictionary_encode()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.combine_chunks()
        slots = self.slots(coded.dictionary.to_pylist())
        each = slots[coded.indices.to_numpy(zero_copy_only=False)] if len(flat) else np.zeros(0, np.int64)
        lengths = self.length[each] if len(each) else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        if total:
            place = np.int32 if max(total, self.used) < 2**31 else np.int64
            at = np.repeat((self.start[each] - (ends - lengths)).astype(place), lengths)
            at += np.arange(total, dtype=place)
            ids = self.ids.take(at)
        else:
            ids = np.zeros(0, np.int32)
        notes = pa.array([self.notes[s] for s in slots.tolist()], pa.string()).take(coded.indices) if self.notes else pa.array([], pa.string())
        return ids, np.concatenate([[0], ends])[offsets], notes
