from __future__ import annotations

import os
import shutil
import tempfile

from ..errors import StoreError
from .base import Store, opens


@opens("local")
class LocalStore(Store):
    """A folder.  Writes go to a temporary name in the same folder and are renamed, so a
    reader or a repeated task never sees half a value."""

    def __init__(self, root):
        self.root = os.path.abspath(os.fspath(root))

    def _path(self, key: str) -> str:
        return os.path.join(self.root, *key.split("/")) if key else self.root

    def _read(self, key, read):
        try:
            with open(self._path(key), "rb") as f:
                return read(f)
        except (FileNotFoundError, IsADirectoryError, NotADirectoryError):
            return None

    def get(self, key):
        return self._read(key, lambda f: f.read())

    def exists(self, key):
        return os.path.isfile(self._path(key))

    def size(self, key):
        try:
            return os.path.getsize(self._path(key)) if self.exists(key) else None
        except FileNotFoundError:
            return None

    def get_partial(self, key, offset, length):
        def read(f):
            f.seek(offset)
            return f.read(length)

        return self._read(key, read)

    def get_suffix(self, key, length):
        def read(f):
            size = f.seek(0, os.SEEK_END)
            f.seek(max(0, size - length))
            return f.read()

        return self._read(key, read)

    def set(self, key, data):
        path = self._path(key)
        try:
            os.makedirs(os.path.dirname(path), exist_ok=True)
            fd, temporary = tempfile.mkstemp(prefix=".writing-", dir=os.path.dirname(path))
            try:
                with os.fdopen(fd, "wb") as f:
                    f.write(data)
                os.replace(temporary, path)
            except BaseException:
                if os.path.exists(temporary):
                    os.unlink(temporary)
                raise
        except OSError as e:
            raise StoreError(f"{key}: {e}") from e

    def erase(self, key):
        try:
            os.unlink(self._path(key))
        except FileNotFoundError:
            pass
        except OSError as e:
            raise StoreError(f"{key}: {e}") from e

    def erase_below(self, prefix=""):
        top = self._path(prefix)
        if os.path.isfile(top):
            return self.erase(prefix)
        try:
            for name in os.listdir(top) if os.path.isdir(top) else []:
                inner = os.path.join(top, name)
                shutil.rmtree(inner) if os.path.isdir(inner) and not os.path.islink(inner) else os.unlink(inner)
            if prefix and os.path.isdir(top):
                os.rmdir(top)
        except OSError as e:
            raise StoreError(f"{prefix}: {e}") from e

    def list(self, prefix=""):
        top = self._path(prefix)
        if os.path.isfile(top):
            return [prefix]
        found = []
        for folder, _, names in os.walk(top):
            base = os.path.relpath(folder, self.root).replace(os.sep, "/")
            found += [n if base == "." else f"{base}/{n}" for n in names if not n.startswith(".writing-")]
        return sorted(found)

    def list_dir(self, prefix=""):
        try:
            return sorted(n for n in os.listdir(self._path(prefix)) if not n.startswith(".writing-"))
        except (FileNotFoundError, NotADirectoryError):
            return []
