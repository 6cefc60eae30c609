from __future__ import annotations

import os
import warnings
import zipfile

from ..errors import StoreError
from .base import Store, opens


@opens("zip")
class ZipStore(Store):
    """A zip file: random access to read (``mode="r"``), or entries gathered and written
    sorted and deflated on ``close`` (``mode="w"``).  The path is absolute from the
    start, as tasks work in other folders."""

    shared = True

    def __init__(self, path, mode: str = "r"):
        self.path, self.mode = os.path.abspath(os.fspath(path)), mode
        if mode not in ("r", "w"):
            raise StoreError(f"mode {mode!r}")
        self._entries: dict[str, bytes] | None = {} if mode == "w" else None
        self._closed = False
        self._zip = None
        if mode == "w":
            self.shared = False
        elif not os.path.isfile(self.path):
            raise StoreError(f"no zip file: {self.path}")

    def __getstate__(self):
        return self.__dict__ | {"_zip": None}

    def _open(self):
        if self._closed:
            raise StoreError("the zip store is closed")
        if self.mode == "r" and self._zip is None:
            try:
                self._zip = zipfile.ZipFile(self.path)
            except (OSError, zipfile.BadZipFile) as e:
                raise StoreError(f"{self.path}: {e}") from e
        return self._zip

    def _writable(self):
        self._open()
        if self.mode != "w":
            raise StoreError("the zip store is open to read")

    def get(self, key):
        z = self._open()
        if z is None:
            return self._entries.get(key)
        try:
            return z.read(key) if not key.endswith("/") else None
        except KeyError:
            return None

    def exists(self, key):
        z = self._open()
        return key in self._entries if z is None else key in z.NameToInfo and not key.endswith("/")

    def size(self, key):
        z = self._open()
        return super().size(key) if z is None else z.getinfo(key).file_size if self.exists(key) else None

    def set(self, key, data):
        self._writable()
        self._entries[key] = bytes(data)

    def erase(self, key):
        self._writable()
        self._entries.pop(key, None)

    def list(self, prefix=""):
        z = self._open()
        keys = self._entries if z is None else [n for n in z.namelist() if not n.endswith("/")]
        return sorted(k for k in keys if not prefix or k == prefix or k.startswith(prefix + "/"))

    def close(self):
        if self._closed:
            return
        if self.mode == "w":
            try:
                with zipfile.ZipFile(self.path, "w", zipfile.ZIP_DEFLATED) as z:
                    for key in sorted(self._entries):
                        z.writestr(zipfile.ZipInfo(key), self._entries[key], zipfile.ZIP_DEFLATED)
            except OSError as e:
                if os.path.isfile(self.path):
                    os.unlink(self.path)
                raise StoreError(f"{self.path}: {e}") from e
        elif self._zip is not None:
            self._zip.close()
        self._closed = True

    def __enter__(self):
        return self

    def __exit__(self, *_):
        self.close()

    def __del__(self):
        if getattr(self, "mode", "r") == "w" and not self._closed and self._entries:
            warnings.warn(f"{self.path} was never closed and isn't written", ResourceWarning, stacklevel=2)
