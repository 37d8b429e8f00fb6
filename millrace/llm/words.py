"""Encoding batches of texts by their distinct space-led words.

Byte-level pre-tokenisers start a new piece at each space that something else than white space
follows, so a text's ids are those of its parts, each led by its space. A batch is split and
dictionary-encoded by Arrow; each distinct part is looked up once, and Arrow puts the results
together. Texts in which a part is empty or starts with white space are encoded as a whole.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Rows and bytes of text that are worked on at once.
ROWS, BYTES = 4096, 8 << 20
#: Bytes of results that a process keeps.
KEPT_BYTES = 40 << 20
#: Bytes that an entry takes besides its word and its result.
ENTRY = 210


class Kept(dict):
    """Results by word, None for what must not stand alone; emptied when it holds ``most`` bytes.
    ``size`` gives the bytes of a result."""

    def __init__(self, make: Callable[[str], object], most: int = KEPT_BYTES, size: Callable = len):
        super().__init__()
        self.make, self.most, self.size, self.held = make, most, size, 0

    def __missing__(self, part: str):
        found = None if not part or part[0].isspace() else self.make(part)
        held = self.held + ENTRY + len(part) + (self.size(found) if found is not None else 0)
        if held > self.most:
            self.clear()
            held = 0
        self.held = held
        self[part] = found
        return found


def slices(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Start and length of pieces of a column within the bounds (at least a row each)."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < len(texts):
        before = int(sizes[start - 1]) if start else 0
        stop = min(start + ROWS, max(start + 1, int(np.searchsorted(sizes, before + BYTES, "right"))))
        yield start, stop - start
        start = stop


def parts_of(texts: pa.Array, kept: Kept, whole: Callable[[str], object]) -> tuple[list, np.ndarray, np.ndarray]:
    """Results, the number of the result for each part of all texts, and where texts start (and the
    last ends) among the parts. Null and empty texts have no parts."""
    present = pc.fill_null(texts, "").cast(pa.large_string())
    split = pc.split_pattern(present, " ")
    offsets = split.offsets.to_numpy()
    offsets = offsets - offsets[0]
    coded = split.flatten().dictionary_encode()
    number = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    names = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
    firsts = offsets[:-1]
    rest = np.ones(len(number), bool)
    rest[firsts] = False
    # Only parts that follow a space are looked up with it.
    used = np.zeros(len(names), bool)
    used[number[rest]] = True
    results: list = [None] * len(names)
    # In order, so that makers can go on from the beginning of the word before.
    for i in sorted(np.flatnonzero(used).tolist(), key=names.__getitem__):
        results[i] = kept[names[i]]
    odd = np.array([r is None for r in results], bool)
    bad = np.add.reduceat((odd[number] & rest).astype(np.int64), firsts) > 0 if len(number) else np.zeros(0, bool)
    nothing = len(results)
    results.append(None)
    listed = number.copy()
    head = [names[i] for i in number[firsts].tolist()]
    for d, (first, is_bad) in enumerate(zip(head, bad.tolist())):
        a, b = int(offsets[d]), int(offsets[d + 1])
        if is_bad:
            listed[a:b] = nothing
            first = present[d].as_py()
        if first:
            listed[a] = len(results)
            results.append(whole(first))
        else:
            listed[a] = nothing
    keep = listed != nothing
    before = np.concatenate([[0], np.cumsum(keep)])
    return results, listed[keep], before[offsets]


def joined(values: list[bytes | None], number: np.ndarray, starts: np.ndarray) -> tuple[memoryview, np.ndarray]:
    """The bytes of all parts in order, and where each text starts (and the last ends)."""
    table = pa.array(values, pa.large_binary())
    taken = table.take(pa.array(number))
    data = taken.buffers()[2]
    places = np.frombuffer(taken.buffers()[1], np.int64)[taken.offset : taken.offset + len(taken) + 1]
    return memoryview(data) if data is not None else memoryview(b""), places[starts]
