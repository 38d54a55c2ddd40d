"""Which file system a path belongs to."""

from __future__ import annotations

import os
import re

import pyarrow as pa
from pyarrow import fs


def file_system(path: str) -> tuple[fs.FileSystem, str, str]:
    """File system of a path, what stands before its own paths, and the path in it."""
    path = re.sub(r"^file:/+", "/", path)
    path = path.rstrip("/") or "/"
    if "://" not in path:
        return fs.LocalFileSystem(), "", os.path.abspath(path)
    system, inner = fs.FileSystem.from_uri(path)
    return system, path[:len(path) - len(inner)], inner


def known_store(path: str) -> bool:
    """Whether Arrow can list a path: no pattern, and a store it knows."""
    try:
        system, _, inner = file_system(path)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError):
        return False
    return not set(path) & set("*?[{") or system.get_file_info(inner).type != fs.FileType.NotFound
