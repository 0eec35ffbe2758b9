"""Unsaved files over the index: a bounded, versioned map with least-recently-used eviction."""

from __future__ import annotations

import hashlib
import posixpath
from collections import OrderedDict
from dataclasses import dataclass

from graphmill.sources.parsers import rows_of


class TooLarge(ValueError):
    pass


@dataclass
class Shadow:
    content: str
    digest: str
    version: int


class ShadowFiles:
    """Files by plain path, at most max_files of them and max_bytes together; the least recently used go first."""

    def __init__(self, max_files: int = 256, max_bytes: int = 16 << 20):
        self.max_files, self.max_bytes = max_files, max_bytes
        self._files: OrderedDict[str, Shadow] = OrderedDict()
        self._bytes, self._next = 0, 1

    @staticmethod
    def plain(path: str) -> str:
        return posixpath.normpath(path.replace("\\", "/"))

    def put(self, path: str, content: str) -> tuple[int, list[str]]:
        """(version, evicted paths). A file larger than the whole bound is refused and nothing changes."""
        key, size = self.plain(path), len(content.encode())
        if size > self.max_bytes:
            raise TooLarge(f"{size} bytes exceed {self.max_bytes}")
        self.remove(key)
        gone = []
        while self._files and (len(self._files) >= self.max_files or self._bytes + size > self.max_bytes):
            old, f = self._files.popitem(last=False)
            self._bytes -= len(f.content.encode())
            gone.append(old)
        self._files[key] = Shadow(content, hashlib.sha256(content.encode()).hexdigest(), self._next)
        self._next += 1
        self._bytes += size
        return self._files[key].version, gone

    def get(self, path: str) -> Shadow | None:
        key = self.plain(path)
        if key in self._files:
            self._files.move_to_end(key)
            return self._files[key]
        return None

    def remove(self, path: str) -> bool:
        f = self._files.pop(self.plain(path), None)
        if f is not None:
            self._bytes -= len(f.content.encode())
        return f is not None

    def entries(self) -> list[str]:
        return sorted(self._files)

    def stats(self) -> dict[str, int]:
        return {"files": len(self._files), "bytes": self._bytes}

    def snapshot(self) -> list[tuple[str, str]]:
        return [(p, self._files[p].content) for p in self.entries()]

    def restore(self, rows: list[tuple[str, str]]) -> None:
        self._files.clear()
        self._bytes = 0
        for p, c in rows:
            if len(c.encode()) <= self.max_bytes:
                self.put(p, c)

    def compile(self, path: str) -> tuple[int, str, list[tuple], list[tuple]]:
        """(version, digest, symbol rows, edge rows) of one shadow file alone."""
        f = self.get(path)
        if f is None:
            raise KeyError(path)
        rows, edges = rows_of(self.plain(path), f.content)
        return f.version, f.digest, rows, edges
