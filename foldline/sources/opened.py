"""Files on storage that every machine reads, opened at any place, by path or URI."""

from __future__ import annotations

import re

from pyarrow import NativeFile
from pyarrow import fs as pafs


def place(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if local := re.match(r"^file:/+(.*)$", path):
        return pafs.LocalFileSystem(), f"/{local[1]}"
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def opened(path: str) -> NativeFile:
    """The file for reading, with seek."""
    system, at = place(path)
    return system.open_input_file(at)


def mounted(path: str) -> str:
    """The path of a file that can be written at any place; storage that cannot is an error."""
    system, at = place(path)
    if not isinstance(system, pafs.LocalFileSystem):
        raise ValueError(f"{path} is not on a mounted file system, so it cannot be written by many tasks at their own places")
    return at
