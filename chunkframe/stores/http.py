from __future__ import annotations

from urllib.error import HTTPError, URLError
from urllib.parse import quote
from urllib.request import Request, urlopen

from ..errors import StoreError
from .base import Store, opens


@opens("http")
class HttpStore(Store):
    """Read-only over http(s).  404 and 403 mean a missing key; ranges are asked for, and
    servers that answer with the whole value are cut to size."""

    def __init__(self, base_url: str, timeout: float = 30):
        self.base_url, self.timeout = base_url.rstrip("/"), timeout

    def _fetch(self, key: str, span: str | None = None) -> tuple[bytes | None, bool]:
        """(value or None, whether it is the range)."""
        request = Request(f"{self.base_url}/{quote(key, safe='/')}")
        if span:
            request.add_header("Range", f"bytes={span}")
        try:
            with urlopen(request, timeout=self.timeout) as answer:  # noqa: S310
                return answer.read(), answer.status == 206
        except HTTPError as e:
            if e.code in (403, 404):
                return None, False
            if e.code == 416:
                return b"", True
            raise StoreError(f"{key}: HTTP {e.code}") from e
        except (URLError, OSError) as e:
            raise StoreError(f"{key}: {e}") from e

    def get(self, key):
        return self._fetch(key)[0]

    def exists(self, key):
        return self._fetch(key, "0-0")[0] is not None

    def get_partial(self, key, offset, length):
        if length <= 0:
            return b"" if self.exists(key) else None
        data, ranged = self._fetch(key, f"{offset}-{offset + length - 1}")
        return data if data is None or ranged else data[offset : offset + length]

    def get_suffix(self, key, length):
        data, ranged = self._fetch(key, f"-{length}")
        return data if data is None or ranged else data[max(0, len(data) - length) :]
