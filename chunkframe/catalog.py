"""Hierarchies: create, open, list, delete and consolidate nodes."""

from __future__ import annotations

import json
import warnings

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .codecs import build, fill_typesize
from .codecs.arrays import Transpose
from .dtypes import parse
from .errors import InvalidChunkShape, InvalidCodecs, InvalidMetadata, NodeExists, NodeNotFound, ShapeMismatch
from .metadata import METADATA_KEY, ArrayMetadata, GroupMetadata, check_codecs, key_of, node_type, normal_path
from .stores import Store, resolve

_UNSET = object()


def open(store, path: str = ""):  # noqa: A001  - the verb of the API
    """The array or group at ``path``."""
    from .operators.array import Array

    store, path = resolve(store), normal_path(path)
    text = store.get(key_of(path))
    if text is None:
        raise NodeNotFound(path or "/")
    if node_type(text) == "array":
        return Array(store, path, ArrayMetadata.from_json(text))
    return Group(store, path, GroupMetadata.from_json(text))


def create(store, shape, dtype="float64", *, path: str = "", chunk_shape=None, shard_shape=None, index_location: str = "end", fill_value=_UNSET, codecs=(),
           attributes: dict | None = None, dimension_names=None, order: str = "C", chunk_key_encoding: str = "default", separator: str | None = None,
           write_empty_chunks: bool = False, overwrite: bool = False):
    """Create an array.  ``overwrite`` removes an old node with all its keys first."""
    from .operators.array import Array

    store, path = resolve(store), normal_path(path)
    shape = tuple(int(n) for n in (shape if isinstance(shape, (list, tuple)) else [shape]))
    if any(n < 0 for n in shape):
        raise ShapeMismatch(f"shape {shape}")
    kind = parse(dtype)
    chunk = tuple(max(n, 1) for n in shape) if chunk_shape is None else _rank(chunk_shape, len(shape))
    if any(c < 1 for c in chunk):
        raise InvalidChunkShape(f"chunk {chunk}")
    chain = [build(c) for c in codecs]
    if order == "F" and len(shape) > 1:
        if any(c.name == "transpose" for c in chain):
            raise InvalidCodecs("order F and a transpose codec exclude each other")
        chain = [Transpose(list(range(len(shape)))[::-1]), *chain]
    chain = check_codecs(chain, kind)
    fill_typesize(chain, kind)
    if shard_shape is not None:
        shard = _rank(shard_shape, len(shape))
        if any(s < 1 or s % c for s, c in zip(shard, chunk)):
            raise InvalidChunkShape(f"shard {shard} is no multiple of chunk {chunk}")
        chain = [build({"name": "sharding_indexed", "configuration": {"chunk_shape": list(chunk), "codecs": [c.json for c in chain], "index_location": index_location}})]
        chunk = shard
    if dimension_names is not None and len(dimension_names) != len(shape):
        raise ShapeMismatch("as many dimension names as dimensions are needed")
    fill = kind.default_fill() if fill_value is _UNSET else _fill(kind, fill_value)
    meta = ArrayMetadata(shape, kind, chunk, fill, chain, chunk_key_encoding, separator or ("/" if chunk_key_encoding == "default" else "."), dict(attributes or {}), list(dimension_names) if dimension_names is not None else None)
    if chunk_key_encoding not in ("default", "v2"):
        raise InvalidMetadata(f"chunk keys {chunk_key_encoding!r}")
    meta.pipeline  # noqa: B018  - checks the chain before anything is written
    if store.exists(key_of(path)):
        if not overwrite:
            raise NodeExists(path or "/")
        store.erase_below(path)
    _ensure_parents(store, path)
    store.set(key_of(path), meta.to_json().encode())
    return Array(store, path, meta, write_empty_chunks)


def _rank(value, rank: int) -> tuple[int, ...]:
    value = tuple(int(n) for n in (value if isinstance(value, (list, tuple)) else [value]))
    if len(value) != rank:
        raise ShapeMismatch(f"{value} for rank {rank}")
    return value


def _fill(kind, value):
    if isinstance(value, (bytes, bytearray)) and kind.kind == "bytes":
        return bytes(value)
    if isinstance(value, str) or value is None:
        return kind.decode_fill(value)
    if kind.kind == "complex" and isinstance(value, (list, tuple)):
        return kind.decode_fill(value)
    return kind.coerce([value]).reshape(-1)[0] if kind.kind == "struct" else kind.coerce(value)[()]


def create_group(store, path: str = "", attributes: dict | None = None):
    """Create a group; an existing one is opened as it is."""
    store, path = resolve(store), normal_path(path)
    text = store.get(key_of(path))
    if text is not None:
        if node_type(text) == "array":
            raise NodeExists(f"an array is at {path or '/'}")
        if attributes:
            warnings.warn(f"the group at {path or '/'} exists; its attributes stay", stacklevel=2)
        return Group(store, path, GroupMetadata.from_json(text))
    _ensure_parents(store, path)
    meta = GroupMetadata(dict(attributes or {}))
    store.set(key_of(path), meta.to_json().encode())
    return Group(store, path, meta)


def _ensure_parents(store: Store, path: str) -> None:
    parts = path.split("/") if path else []
    for k in range(len(parts)):
        at = "/".join(parts[:k])
        text = store.get(key_of(at))
        if text is None:
            store.set(key_of(at), GroupMetadata().to_json().encode())
        elif node_type(text) == "array":
            raise NodeExists(f"an array is at {at or '/'}")


def delete_node(store, path: str = "") -> None:
    """Erase everything at and below ``path``; the root empties the store."""
    store, path = resolve(store), normal_path(path)
    if not store.exists(key_of(path)):
        raise NodeNotFound(path or "/")
    store.erase_below(path)


def consolidate_metadata(store) -> Group:
    """Inline the documents of all nodes below the root into the root group.  Folders are
    walked from the root and those of arrays aren't entered, so no chunk key is listed."""
    store = resolve(store)
    text = store.get(METADATA_KEY)
    if text is None:
        raise NodeNotFound("/")
    if node_type(text) != "group":
        raise InvalidMetadata("the root is no group")
    meta = GroupMetadata.from_json(text)
    found = {}
    waiting = [""]
    while waiting:
        at = waiting.pop()
        for name in store.list_dir(at):
            if name == METADATA_KEY:
                continue
            path = f"{at}/{name}" if at else name
            text = store.get(key_of(path))
            if text is not None:
                found[path] = json.loads(text)
            if text is None or node_type(text) == "group":
                waiting.append(path)
    meta.consolidated = dict(sorted(found.items()))
    store.set(METADATA_KEY, meta.to_json().encode())
    return Group(store, "", meta)


class Group:
    """A node that holds others."""

    def __init__(self, store: Store, path: str, meta: GroupMetadata):
        self.store, self.path, self.meta = store, path, meta

    def __repr__(self):
        return f"<Group /{self.path} {self.store.__class__.__name__}>"

    @property
    def attrs(self) -> dict:
        return dict(self.meta.attributes)

    def _child(self, name: str) -> str:
        name = normal_path(name)
        return f"{self.path}/{name}" if self.path else name

    def item(self, name: str):
        """A child at any depth: from the consolidated block, else from the store."""
        from .operators.array import Array

        name = normal_path(name)
        doc = (self.meta.consolidated or {}).get(name)
        if doc is None:
            return open(self.store, self._child(name))
        text = json.dumps(doc)
        if node_type(text) == "array":
            return Array(self.store, self._child(name), ArrayMetadata.from_json(text))
        meta = GroupMetadata.from_json(text)
        if meta.consolidated is None:
            meta.consolidated = self.meta.below(name)
        return Group(self.store, self._child(name), meta)

    __getitem__ = item

    def __contains__(self, name: str) -> bool:
        """With consolidated metadata only that is asked (a snapshot), else the store."""
        if self.meta.consolidated is not None:
            return normal_path(name) in self.meta.consolidated
        return self.store.exists(key_of(self._child(name)))

    def children(self) -> tuple[list[str], list[str]]:
        """Names of (arrays, groups) directly below."""
        found: dict[str, list[str]] = {"array": [], "group": []}
        if self.meta.consolidated is not None:
            for name, doc in sorted(self.meta.consolidated.items()):
                if "/" not in name:
                    found[node_type(json.dumps(doc))].append(name)
        else:
            for name in self.store.list_dir(self.path):
                if (text := self.store.get(key_of(self._child(name)))) is not None:
                    found[node_type(text)].append(name)
        return found["array"], found["group"]

    def children_df(self, spark: SparkSession) -> DataFrame:
        arrays, groups = self.children()
        return spark.createDataFrame([(n, "array") for n in arrays] + [(n, "group") for n in groups], "name string, node_type string")

    def create_array(self, name: str, shape, dtype="float64", **options):
        return create(self.store, shape, dtype, path=self._child(name), **options)

    def create_group(self, name: str, attributes: dict | None = None) -> Group:
        return create_group(self.store, self._child(name), attributes)

    def set_attr(self, name: str, value) -> None:
        self.set_attrs(self.attrs | {name: value})

    def set_attrs(self, attributes: dict) -> None:
        """Replace all attributes; the consolidated block stays."""
        self.meta.attributes = dict(attributes)
        self.store.set(key_of(self.path), self.meta.to_json().encode())

    def walk(self, max_depth: int | None = None, depth: int = 0):
        """(path, depth, node) of this group and all below, arrays before groups."""
        yield self.path, depth, self
        if max_depth is not None and depth >= max_depth:
            return
        arrays, groups = self.children()
        for name in arrays:
            yield self._child(name), depth + 1, self.item(name)
        for name in groups:
            yield from self.item(name).walk(max_depth, depth + 1)

    def tree(self, max_depth: int | None = None) -> str:
        lines = []
        for path, depth, node in self.walk(max_depth):
            name = path.rpartition("/")[2] or "/"
            lines.append("  " * depth + (name + "/" if isinstance(node, Group) and path else name) + ("" if isinstance(node, Group) else f" {node.shape} {node.dtype}"))
        return "\n".join(lines)

    def catalog_df(self, spark: SparkSession, max_depth: int | None = None) -> DataFrame:
        """One row for each node: ``path, depth, node_type, shape, chunk_shape, dtype, attributes``."""
        rows = []
        for path, depth, node in self.walk(max_depth):
            group = isinstance(node, Group)
            attrs = json.dumps(node.attrs)
            rows.append((path, depth, "group", None, None, None, attrs) if group else (path, depth, "array", list(node.shape), list(node.chunk_shape), node.dtype, attrs))
        schema = T.StructType([T.StructField("path", T.StringType()), T.StructField("depth", T.IntegerType()), T.StructField("node_type", T.StringType()), T.StructField("shape", T.ArrayType(T.LongType())),
                               T.StructField("chunk_shape", T.ArrayType(T.LongType())), T.StructField("dtype", T.StringType()), T.StructField("attributes", T.StringType())])
        return spark.createDataFrame(rows, schema)
