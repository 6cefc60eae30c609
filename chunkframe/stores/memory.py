from __future__ import annotations

from .base import Store


class MemoryStore(Store):
    """A dictionary in this process.  A task gets a copy, so it can be read by tasks but
    must be written from the driver."""

    shared = False

    def __init__(self):
        self.values: dict[str, bytes] = {}

    def get(self, key):
        return self.values.get(key)

    def set(self, key, data):
        self.values[key] = bytes(data)

    def erase(self, key):
        self.values.pop(key, None)

    def list(self, prefix=""):
        return sorted(k for k in self.values if not prefix or k == prefix or k.startswith(prefix + "/"))
