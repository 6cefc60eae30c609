"""Key to bytes stores; all are picklable, so tasks can carry them."""

from .base import Store, resolve
from .arrowfs import ArrowStore
from .http import HttpStore
from .local import LocalStore
from .manifest import ManifestStore
from .memory import MemoryStore
from .zip import ZipStore

__all__ = ["ArrowStore", "HttpStore", "LocalStore", "ManifestStore", "MemoryStore", "Store", "ZipStore", "resolve"]
