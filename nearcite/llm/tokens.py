"""Words of Arrow text arrays as 64-bit hashes, for tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

SLICE_BYTES = 8 << 20


def mixed(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit values that spreads every bit."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    return x


def slices(batch: pa.RecordBatch, column: str, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in parts of so many bytes of text at most, at least one row each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch[column]), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        base = sizes[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(sizes, base + most, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def hashed_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, row offsets) of lower-cased (A-Z) texts cut at ASCII white space; null: no words."""
    texts = pc.fill_null(texts, "")
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    parts = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    flat = parts.flatten()
    offsets = parts.offsets.to_numpy().astype(np.int64)
    offsets = offsets - offsets[0]
    full = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    if not full.all():  # white space at the ends leaves empty parts
        offsets = np.concatenate([[0], np.cumsum(full)])[offsets]
        flat = flat.filter(pa.array(full))
    coded = pc.dictionary_encode(flat)
    codes, values = coded.indices.to_numpy(zero_copy_only=False), coded.dictionary.to_pylist()
    hashes = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in values), np.uint64, len(values))
    return (hashes[codes] if len(values) else np.empty(0, np.uint64)), offsets
