from __future__ import annotations

import base64
import json

from ..errors import InvalidMetadata, StoreError
from .base import Store, relative, resolve

#: The name of the index in the root folder.
MANIFEST = "manifest.json"


class ManifestStore(Store):
    """A virtual store: ``manifest.json`` maps keys to inline bytes or to byte ranges of
    other files; keys that it lacks are looked up beside it.  Read-only."""

    def __init__(self, root):
        self.root = root.rstrip("/") if isinstance(root, str) else str(root)
        self.beside = resolve(self.root)
        if hasattr(self.beside, "root"):
            self.root = self.beside.root
        raw = self.beside.get(MANIFEST)
        if raw is None:
            raise StoreError(f"no {MANIFEST} in {self.root}")
        try:
            doc = json.loads(raw)
            self.entries = dict(doc.get("entries") or doc.get("chunks") or {})
        except (ValueError, TypeError, AttributeError) as e:
            raise InvalidMetadata(f"{MANIFEST}: {e}") from e
        self.default_path = doc.get("default_path")
        self._stores: dict[str, Store] = {}

    def __getstate__(self):
        return self.__dict__ | {"_stores": {}}

    def _source(self, path: str) -> tuple[Store, str]:
        folder, _, name = relative(self.root, path).rpartition("/")
        folder = folder or "/"
        if folder not in self._stores:  # one client for each folder or host
            self._stores[folder] = resolve(folder)
        return self._stores[folder], name

    def _read(self, key, offset: int | None, length: int | None):
        """Bytes [offset, offset + length) of a value; a None offset counts from the end."""
        e = self.entries.get(key)
        if e is None:
            if key == MANIFEST:
                return None
            if offset is None:
                return self.beside.get_suffix(key, length)
            return self.beside.get(key) if length is None else self.beside.get_partial(key, offset, length)
        if "inline" in e:
            data = base64.b64decode(e["inline"])
            if offset is None:
                return data[max(0, len(data) - length) :]
            return data if length is None else data[offset : offset + length]
        path = e.get("path", self.default_path)
        if path is None:
            raise InvalidMetadata(f"{key}: neither inline bytes nor a path")
        store, name = self._source(path)
        start, size = int(e.get("offset", 0)), e.get("length")
        if size is None:
            if offset is None:
                return store.get_suffix(name, length)
            return store.get(name) if length is None and start == 0 else store.get_partial(name, start + offset, length if length is not None else 2**62)
        if offset is None:
            offset, length = max(0, size - length), min(length, size)
        length = size - offset if length is None else min(length, size - offset)
        data = store.get_partial(name, start + offset, max(0, length))
        if data is None:
            raise StoreError(f"{key}: {path} is missing")
        return data

    def get(self, key):
        return self._read(key, 0, None)

    def exists(self, key):
        return key in self.entries or (key != MANIFEST and self.beside.exists(key))

    def get_partial(self, key, offset, length):
        return self._read(key, offset, length)

    def get_suffix(self, key, length):
        return self._read(key, None, length)

    def list(self, prefix=""):
        try:
            own = self.beside.list(prefix)
        except StoreError:  # an address that can't be listed
            own = []
        below = [k for k in self.entries if not prefix or k == prefix or k.startswith(prefix + "/")]
        return sorted({*own, *below} - {MANIFEST})
