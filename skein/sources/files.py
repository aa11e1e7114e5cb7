"""File systems behind paths: local ones as they are, others by their URI."""

from __future__ import annotations

from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str]:
    local = path.removeprefix("file://")
    return (fs.LocalFileSystem(), local) if "://" not in local else fs.FileSystem.from_uri(path)
