"""Metadata documents of arrays and groups, paths and chunk keys."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from math import prod

from .codecs import Pipeline, build, completed
from .dtypes import DType, parse
from .errors import ChunkframeError, InvalidCodecs, InvalidMetadata, InvalidPath, UnsupportedFeature

# Names of the public v3 format.
METADATA_KEY = "zarr.json"
_FORMAT_FIELD, _FORMAT = "zarr_format", 3


def normal_path(path: str) -> str:
    parts = [p for p in (path or "").replace("\\", "/").split("/") if p]
    if any(p in (".", "..") for p in parts):
        raise InvalidPath(path)
    return "/".join(parts)


def key_of(path: str, name: str = METADATA_KEY) -> str:
    return f"{path}/{name}" if path else name


def _document(text) -> dict:
    try:
        doc = json.loads(text)
    except ValueError as e:
        raise InvalidMetadata(f"no JSON: {e}") from e
    if not isinstance(doc, dict) or doc.get(_FORMAT_FIELD) != _FORMAT:
        raise InvalidMetadata("no version 3 document")
    return doc


def node_type(text) -> str:
    kind = _document(text).get("node_type")
    if kind not in ("array", "group"):
        raise InvalidMetadata(f"node type {kind!r}")
    return kind


def _sizes(value, least: int, what: str) -> tuple[int, ...]:
    value = value if isinstance(value, list) else [value]
    if any(isinstance(x, bool) or int(x) != x or x < least for x in value):
        raise InvalidMetadata(f"{what}: {value}")
    return tuple(int(x) for x in value)


@dataclass
class ArrayMetadata:
    shape: tuple[int, ...]
    dtype: DType
    chunk_shape: tuple[int, ...]
    fill: object
    codecs: list
    key_encoding: str = "default"
    separator: str = "/"
    attributes: dict = field(default_factory=dict)
    dimension_names: list | None = None

    @classmethod
    def from_json(cls, text) -> ArrayMetadata:
        doc = _document(text)
        if doc.get("node_type") != "array":
            raise InvalidMetadata("no array document")
        if doc.get("storage_transformers"):
            raise UnsupportedFeature("storage transformers")
        try:
            dtype = parse(doc["data_type"])
            shape = _sizes(doc["shape"], 0, "shape")
            chunk_grid, keys, codecs = doc["chunk_grid"], doc["chunk_key_encoding"], doc["codecs"]
            if chunk_grid["name"] != "regular":
                raise UnsupportedFeature(f"chunk grid {chunk_grid['name']}")
            chunk = _sizes(chunk_grid["configuration"]["chunk_shape"], 1, "chunk shape")
            encoding = keys["name"]
            separator = (keys.get("configuration") or {}).get("separator", "/" if encoding == "default" else ".")
            fill = dtype.decode_fill(doc["fill_value"])
        except ChunkframeError:
            raise
        except (KeyError, TypeError) as e:
            raise InvalidMetadata(f"missing or malformed member: {e}") from e
        if len(chunk) != len(shape):
            raise InvalidMetadata("chunk shape and shape differ in rank")
        if encoding not in ("default", "v2") or separator not in ("/", "."):
            raise InvalidMetadata(f"chunk keys {encoding!r} with {separator!r}")
        if not isinstance(codecs, list):
            raise InvalidMetadata("codecs must be a list")
        names = doc.get("dimension_names")
        if names is not None and len(names) != len(shape):
            raise InvalidMetadata("dimension names and shape differ in rank")
        attributes = doc.get("attributes")
        meta = cls(shape, dtype, chunk, fill, [build(c) for c in codecs], encoding, separator, attributes if isinstance(attributes, dict) else {}, names)
        return meta

    @property
    def pipeline(self) -> Pipeline:
        made = self.__dict__.get("_pipeline")
        if made is None:
            made = self.__dict__["_pipeline"] = Pipeline(completed(self.codecs, self.dtype), self.dtype, self.chunk_shape, self.fill)
        return made

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_pipeline"}

    def to_json(self) -> str:
        doc = {
            _FORMAT_FIELD: _FORMAT, "node_type": "array", "shape": list(self.shape), "data_type": self.dtype.json,
            "chunk_grid": {"name": "regular", "configuration": {"chunk_shape": list(self.chunk_shape)}},
            "chunk_key_encoding": {"name": self.key_encoding, "configuration": {"separator": self.separator}},
            "fill_value": self.dtype.encode_fill(self.fill), "codecs": [c.json for c in self.codecs],
        }
        if self.attributes:
            doc["attributes"] = self.attributes
        if self.dimension_names and any(n is not None for n in self.dimension_names):
            doc["dimension_names"] = list(self.dimension_names)
        return json.dumps(doc, indent=2, allow_nan=False)

    # -- chunk keys ----------------------------------------------------------
    def chunk_key(self, coords) -> str:
        if self.key_encoding == "default":
            return self.separator.join(["c", *map(str, coords)])
        return self.separator.join(map(str, coords)) or "0"

    def chunk_coords(self, key: str) -> tuple[int, ...] | None:
        """Inverse of ``chunk_key``; None for other keys."""
        parts = key.split(self.separator)
        if self.key_encoding == "default":
            if parts[0] != "c":
                return None
            parts = parts[1:]
        elif not self.shape:
            parts = [] if key == "0" else ["?"]
        if len(parts) != len(self.shape) or not all(p.isdigit() and p.isascii() and str(int(p)) == p for p in parts):
            return None
        return tuple(map(int, parts))

    @property
    def coordinate_names(self) -> list[str]:
        return [f"i{d}" for d in range(len(self.shape))]

    @property
    def cell_bytes(self) -> int:
        return self.dtype.itemsize * prod(self.chunk_shape)


@dataclass
class GroupMetadata:
    attributes: dict = field(default_factory=dict)
    consolidated: dict | None = None  # path -> document

    @classmethod
    def from_json(cls, text) -> GroupMetadata:
        doc = _document(text)
        if doc.get("node_type") != "group":
            raise InvalidMetadata("no group document")
        attributes = doc.get("attributes")
        block = doc.get("consolidated_metadata")
        known = block.get("metadata") if isinstance(block, dict) else None
        return cls(attributes if isinstance(attributes, dict) else {}, known if isinstance(known, dict) else None)

    def to_json(self) -> str:
        doc = {_FORMAT_FIELD: _FORMAT, "node_type": "group"}
        if self.attributes:
            doc["attributes"] = self.attributes
        if self.consolidated is not None:
            doc["consolidated_metadata"] = {"kind": "inline", "must_understand": False, "metadata": {k: self.consolidated[k] for k in sorted(self.consolidated)}}
        return json.dumps(doc, indent=2, allow_nan=False)

    def below(self, name: str) -> dict | None:
        """The consolidated entries of a child group, re-keyed; None if there are none."""
        if self.consolidated is None:
            return None
        found = {k[len(name) + 1 :]: v for k, v in self.consolidated.items() if k.startswith(name + "/")}
        return found or None


def check_codecs(entries, dtype: DType) -> list:
    chain = completed(list(entries), dtype)
    if sum(c.kind == "array->bytes" for c in chain) != 1:
        raise InvalidCodecs("one array->bytes codec is needed")
    return chain
