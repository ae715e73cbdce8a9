"""Words of whole texts as 64-bit hashes, computed for a batch of texts at once.

A word's hash is a polynomial over random values of its bytes, taken from prefix
sums over the batch, so that the cost is a few vector operations per byte and no
Python object per word. A-Z is lower-cased; other letters stay as they are.
Two different words share a hash with a chance of about 2**-64.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20  # texts hashed together; a longer text is a chunk of its own
SLICE_BYTES = 4 << 20  # texts of a batch that an operator works on at a time


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser of 64-bit values (the one of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _values(separators: bytes, lower: bool = True) -> np.ndarray:
    """A random odd value for each byte, after lower-casing if so wished; 0 for a separator."""
    values = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    if lower:
        values[65:91] = values[97:123]
    values[list(separators)] = 0
    return values


#: words are runs of anything but space and the five control characters of white space
BY_SPACE = _values(b"\t\n\x0b\x0c\r ")
#: the same, with A-Z as they are
BY_SPACE_CASED = _values(b"\t\n\x0b\x0c\r ", lower=False)
#: words are runs of ASCII letters, digits and all characters beyond ASCII
BY_LETTER = _values(bytes(c for c in range(128) if not chr(c).isalnum()))

_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_powers = {"up": np.ones(1, np.uint64), "down": np.ones(1, np.uint64)}


def _power(name: str, n: int) -> np.ndarray:
    if len(_powers[name]) < n:
        size = max(n, CHUNK_BYTES + 1)
        steps = np.full(size, _BASE if name == "up" else _INVERSE, np.uint64)
        steps[0] = 1
        _powers[name] = np.multiply.accumulate(steps)
    return _powers[name][:n]


def hash_chunk(data: np.ndarray, offsets: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, first bytes and ends of the words, and the number of words of each text.

    ``data`` holds the texts' UTF-8 bytes one after another, ``offsets`` their n + 1 bounds from 0.
    """
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return none.view(np.uint64), none, none, np.zeros(len(offsets) - 1, np.int64)
    weights = values[data]
    word = weights != 0
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < n]
    opens[first] = word[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    closes[last] = word[last]
    starts, ends = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    weights *= _power("up", n)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(weights, out=sums[1:])
    hashes = mixed((sums[ends] - sums[starts]) * _power("down", n)[starts])
    return hashes, starts, ends, np.diff(np.searchsorted(starts, offsets))


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of texts; a null text counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    if not len(texts):
        return
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        end = int(np.searchsorted(bounds, bounds[row] + limit, "right")) - 1
        end = min(max(end, row + 1), len(texts))
        yield row, end, data[bounds[row] : bounds[end]], bounds[row : end + 1] - bounds[row]
        row = end


def slices(batches: Iterator[pa.RecordBatch], text) -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about SLICE_BYTES of text, or one longer text, so that a task's memory is bounded.

    ``text`` is a column's name, or a function that takes it from a batch.
    """
    for batch in batches:
        for first, last, _, _ in chunks(text(batch) if callable(text) else batch.column(text), SLICE_BYTES):
            yield batch.slice(first, last - first)


def hash_words(texts: pa.Array, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts in order, and the number of words of each text."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(texts):
        hashes, _, _, n = hash_chunk(data, offsets, values)
        parts.append(hashes)
        counts.append(n)
    return np.concatenate(parts), np.concatenate(counts)


def hash_prefixes(texts: pa.Array, values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the first ``size`` bytes of all words that are longer, in order, and the number of these words in each text."""
    parts, counts = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for _, _, data, offsets in chunks(texts):
        _, starts, ends, n = hash_chunk(data, offsets, values)
        long = ends - starts > size
        parts.append(hash_runs(values[data], starts[long], starts[long] + size))
        counts.append(np.bincount(np.repeat(np.arange(len(n)), n)[long], minlength=len(n)))
    return np.concatenate(parts), np.concatenate(counts)


def hash_runs(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """One value for each run [start, end) of words, given the hashes of all words: equal runs have equal ones wherever they stand."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * _power("up", len(hashes)), out=sums[1:])
    return mixed((sums[ends] - sums[starts]) * _power("down", len(hashes) + 1)[starts])


def lists(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.Array:
    """An Arrow column of lists from all values in order and the length of each list."""
    bounds = np.zeros(len(counts) + 1, np.int32)
    np.cumsum(counts, out=bounds[1:])
    return pa.ListArray.from_arrays(pa.array(bounds), pa.array(values, kind))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The inverse of ``lists`` for columns without nulls inside; a null list counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), counts
