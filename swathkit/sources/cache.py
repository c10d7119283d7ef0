"""Content cache of remote files: one deterministic place for each address."""

from __future__ import annotations

import hashlib
import os
import time
from collections.abc import Callable
from dataclasses import dataclass


@dataclass(frozen=True)
class ContentCache:
    """Files under ``root``, fetched once; a fault that may pass is tried again."""

    root: str
    tries: int = 3
    wait_s: float = 0.1

    def path(self, address: str) -> str:
        """The file's place: a digest of the whole address, and its last part for people."""
        return f"{self.root}/{hashlib.sha256(address.encode()).hexdigest()[:16]}-{address.rstrip('/').rpartition('/')[2]}"

    def get(self, address: str, fetch: Callable[[str], bytes]) -> str:
        """The path of the file, fetched if it isn't there; written beside and moved, so that it is whole or absent."""
        path = self.path(address)
        if os.path.exists(path):
            return path
        for k in range(self.tries):
            try:
                raw = fetch(address)
                break
            except OSError:
                if k + 1 == self.tries:
                    raise
                time.sleep(self.wait_s)
        os.makedirs(self.root, exist_ok=True)
        part = f"{path}.{os.getpid()}.part"
        with open(part, "wb") as f:
            f.write(raw)
        os.replace(part, path)
        return path
