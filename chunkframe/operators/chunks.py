"""What a task does to one chunk: read a part of it, patch it, store it."""

from __future__ import annotations

from math import prod

import numpy as np

from ..codecs.base import Bound
from ..errors import Indexing
from ..functions.arrow import from_arrow
from ..grid import Part, outside, visible
from ..metadata import ArrayMetadata, key_of
from ..stores import Store


def read_part(store: Store, path: str, meta: ArrayMetadata, part: Part, hit=None) -> np.ndarray | None:
    """A part of a chunk, by byte ranges where the chunk is a shard; None: not stored.
    ``hit(d, low, high)``: whether a cell of that interval is wanted (in array coordinates);
    inner chunks without wanted cells may be left at the fill value."""
    key = key_of(path, meta.chunk_key(part.coords))
    shard = meta.pipeline.sole_sharding
    if shard is not None and (hit is not None or part.n != meta.chunk_shape):
        origin = [k * c for k, c in zip(part.coords, meta.chunk_shape)]
        local = (lambda d, a, b: hit(d, origin[d] + a, origin[d] + b)) if hit else None
        bound = Bound(meta.dtype, meta.chunk_shape, meta.fill)
        return shard.read(lambda at, n: store.get_partial(key, at, n), lambda n: store.get_suffix(key, n), bound, part.lo, part.n, local)
    data = store.get(key)
    return None if data is None else meta.pipeline.decode(data)[part.in_chunk]


def read_whole(store: Store, path: str, meta: ArrayMetadata, coords) -> np.ndarray:
    """A whole chunk to be patched (the fill value where it isn't stored)."""
    data = store.get(key_of(path, meta.chunk_key(coords)))
    return meta.dtype.filled(meta.chunk_shape, meta.fill) if data is None else np.array(meta.pipeline.decode(data), dtype=meta.dtype.numpy)


def store_chunk(store: Store, path: str, meta: ArrayMetadata, coords, block: np.ndarray, write_empty: bool = False) -> int:
    """Store a chunk, or erase it if all its cells are the fill value.  Bytes stored."""
    key = key_of(path, meta.chunk_key(coords))
    if meta.shape and not write_empty and meta.dtype.is_fill(block, meta.fill):
        store.erase(key)
        return 0
    data = meta.pipeline.encode(block)
    store.set(key, data)
    return len(data)


def trim_chunk(store: Store, path: str, meta: ArrayMetadata, coords, write_empty: bool = False) -> None:
    """Fit a stored chunk to a shape that shrank: erase it if it is wholly outside, else
    reset its cells outside to the fill value."""
    if outside(coords, meta.shape, meta.chunk_shape):
        store.erase(key_of(path, meta.chunk_key(coords)))
        return
    block = read_whole(store, path, meta, coords)
    kept = meta.dtype.filled(meta.chunk_shape, meta.fill)
    seen = tuple(slice(0, n) for n in visible(coords, meta.shape, meta.chunk_shape))
    kept[seen] = block[seen]
    store_chunk(store, path, meta, coords, kept, write_empty)


def patch_block(store, path, meta, part: Part, values: np.ndarray, write_empty: bool = False) -> int:
    """Assign a box of a chunk; a box that covers all visible cells isn't read first."""
    if part.n == meta.chunk_shape and meta.shape:
        return store_chunk(store, path, meta, part.coords, values, write_empty)
    seen = visible(part.coords, meta.shape, meta.chunk_shape)
    whole = all(n >= s for n, s in zip(part.n, seen))
    block = meta.dtype.filled(meta.chunk_shape, meta.fill) if whole else read_whole(store, path, meta, part.coords)
    block[part.in_chunk] = values
    return store_chunk(store, path, meta, part.coords, block, write_empty)


def patch_cells(store, path, meta, coords, index: list[np.ndarray], column, write_empty: bool = False) -> int:
    """Assign single cells of a chunk, the last of repeated ones."""
    values = from_arrow(column, meta.dtype, meta.fill)
    if not meta.shape:
        block = meta.dtype.filled((), meta.fill)
        block[()] = values[-1]
        return store_chunk(store, path, meta, (), block, True)
    for i, n in zip(index, meta.shape):
        if len(i) and (i.min() < 0 or i.max() >= n):
            raise Indexing(f"coordinates {i.min()}..{i.max()} in a dimension of {n}")
    local = tuple(i - k * c for i, k, c in zip(index, coords, meta.chunk_shape))
    flat = np.ravel_multi_index(local, meta.chunk_shape)
    # of repeated cells the last row counts
    last = len(flat) - 1 - np.unique(flat[::-1], return_index=True)[1]
    flat, values = flat[last], values[last]
    whole = len(flat) == prod(visible(coords, meta.shape, meta.chunk_shape))
    block = meta.dtype.filled(meta.chunk_shape, meta.fill) if whole else read_whole(store, path, meta, coords)
    block.reshape(-1)[flat] = values
    return store_chunk(store, path, meta, coords, block, write_empty)
