from __future__ import annotations

import uuid

from ..errors import StoreError
from .base import Store, opens


@opens("arrow")
class ArrowStore(Store):
    """A folder in any file system that Arrow reaches (``hdfs://``, ``s3://``, ``gs://``,
    ``file://``): what tasks of a cluster share."""

    def __init__(self, uri: str):
        self.uri = uri.rstrip("/")
        self._fs = None

    def __getstate__(self):
        return {"uri": self.uri, "_fs": None}

    def _open(self):
        if self._fs is None:
            from pyarrow import fs

            try:
                self._fs, self._root = fs.FileSystem.from_uri(self.uri)
            except (OSError, ValueError) as e:
                raise StoreError(f"{self.uri}: {e}") from e
            self._root = self._root.rstrip("/")
        return self._fs

    def _path(self, key: str) -> str:
        self._open()
        return f"{self._root}/{key}" if key else self._root

    def _read(self, key, read):
        try:
            with self._open().open_input_file(self._path(key)) as f:
                return read(f)
        except FileNotFoundError:
            return None
        except OSError as e:
            if not self.exists(key):
                return None
            raise StoreError(f"{key}: {e}") from e

    def get(self, key):
        return self._read(key, lambda f: f.read())

    def get_partial(self, key, offset, length):
        return self._read(key, lambda f: f.read_at(max(0, min(length, f.size() - offset)), offset) if offset < f.size() else b"")

    def get_suffix(self, key, length):
        return self._read(key, lambda f: f.read_at(min(length, f.size()), max(0, f.size() - length)))

    def _info(self, key):
        return self._open().get_file_info(self._path(key))

    def exists(self, key):
        return self._info(key).is_file

    def size(self, key):
        info = self._info(key)
        return info.size if info.is_file else None

    def set(self, key, data):
        """Objects appear whole; elsewhere a temporary name is renamed."""
        fs, path = self._open(), self._path(key)
        try:
            if fs.type_name in ("s3", "gcs", "abfs"):
                with fs.open_output_stream(path) as f:
                    f.write(data)
                return
            folder, _, name = path.rpartition("/")
            fs.create_dir(folder, recursive=True)
            temporary = f"{folder}/.writing-{uuid.uuid4().hex}"
            with fs.open_output_stream(temporary) as f:
                f.write(data)
            fs.move(temporary, path)
        except OSError as e:
            raise StoreError(f"{key}: {e}") from e

    def erase(self, key):
        try:
            self._open().delete_file(self._path(key))
        except FileNotFoundError:
            pass
        except OSError as e:
            if self.exists(key):
                raise StoreError(f"{key}: {e}") from e

    def list_dir(self, prefix=""):
        from pyarrow import fs

        if prefix and self.exists(prefix):
            return []
        found = self._open().get_file_info(fs.FileSelector(self._path(prefix), allow_not_found=True))
        return sorted(i.base_name for i in found if not i.base_name.startswith(".writing-"))

    def erase_below(self, prefix=""):
        if prefix and self.exists(prefix):
            return self.erase(prefix)
        try:
            if prefix:
                self._open().delete_dir(self._path(prefix))
            else:
                self._open().delete_dir_contents(self._root, missing_dir_ok=True)
        except FileNotFoundError:
            pass
        except OSError as e:
            raise StoreError(f"{prefix}: {e}") from e

    def list(self, prefix=""):
        from pyarrow import fs

        top = self._path(prefix)
        if prefix and self.exists(prefix):
            return [prefix]
        found = self._open().get_file_info(fs.FileSelector(top, allow_not_found=True, recursive=True))
        skip = len(self._root) + 1
        return sorted(i.path[skip:] for i in found if i.is_file and not i.base_name.startswith(".writing-"))
