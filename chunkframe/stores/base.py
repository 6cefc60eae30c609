"""The store contract."""

from __future__ import annotations

import os

from ..errors import InvalidPath, InvalidStore, StoreError


class Store:
    """``/``-separated keys to bytes.  ``get`` returns None for a missing key."""

    #: Tasks on other machines see what this store holds.
    shared = True

    def get(self, key: str) -> bytes | None:
        raise NotImplementedError

    def exists(self, key: str) -> bool:
        return self.get(key) is not None

    def size(self, key: str) -> int | None:
        """Bytes of a value; None for a missing key."""
        data = self.get(key)
        return None if data is None else len(data)

    def set(self, key: str, data: bytes) -> None:
        raise StoreError(f"{type(self).__name__} is read-only")

    def erase(self, key: str) -> None:
        raise StoreError(f"{type(self).__name__} is read-only")

    def erase_below(self, prefix: str = "") -> None:
        """Remove ``prefix`` and all keys below it; stores that can do so in one call do."""
        for key in self.list(prefix):
            self.erase(key)

    def list(self, prefix: str = "") -> list[str]:
        """All keys below ``prefix``, sorted."""
        raise StoreError(f"{type(self).__name__} can't be listed")

    def list_dir(self, prefix: str = "") -> list[str]:
        """Names of the immediate children of ``prefix``, sorted."""
        base = f"{prefix}/" if prefix else ""
        return sorted({k[len(base) :].split("/")[0] for k in self.list(prefix) if k.startswith(base)})

    def get_partial(self, key: str, offset: int, length: int) -> bytes | None:
        """Up to ``length`` bytes from ``offset``, clipped at the end."""
        data = self.get(key)
        return None if data is None else data[offset : offset + length]

    def get_suffix(self, key: str, length: int) -> bytes | None:
        """The last ``length`` bytes, clipped at the start."""
        data = self.get(key)
        return None if data is None else data[max(0, len(data) - length) :]


#: What opens a path or an address; the store modules enter themselves.
_openers: dict[str, type[Store]] = {}


def opens(kind: str):
    def enter(cls):
        _openers[kind] = cls
        return cls

    return enter


def resolve(store) -> Store:
    """A store from a store or a path (``file:`` addresses are paths, http ones HttpStore,
    other schemes go through Arrow's file systems)."""
    if isinstance(store, Store):
        return store
    if isinstance(store, os.PathLike):
        store = os.fspath(store)
    if isinstance(store, str) and store:
        if store.startswith(("http://", "https://")):
            return _openers["http"](store)
        if store.startswith("file:"):
            store = "/" + store[5:].lstrip("/")
        if "://" in store:
            return _openers["arrow"](store)
        return _openers["zip" if store.endswith(".zip") else "local"](store)
    raise InvalidStore(f"no store: {store!r}")


def relative(base: str, path: str) -> str:
    """``path`` seen from ``base`` (both a folder or both an address); absolute ones pass.
    A path that climbs above its root is an error."""
    if path.startswith("/") or "://" in path or (len(path) > 1 and path[1] == ":"):
        return path
    scheme, mark, rest = base.partition("://")
    head = f"{scheme}://{rest.split('/')[0]}" if mark else "/" if base.startswith("/") else ""
    tail = rest.partition("/")[2] if mark else base.lstrip("/")
    parts: list[str] = []
    for piece in f"{tail}/{path}".split("/"):
        if piece == "..":
            if not parts:
                raise InvalidPath(f"{path} climbs above {base}")
            parts.pop()
        elif piece not in ("", "."):
            parts.append(piece)
    return head.rstrip("/") + ("/" if head else "") + "/".join(parts)
