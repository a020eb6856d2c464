"""File systems that tasks open by themselves: names as Spark writes them, files that can be sought in."""

from __future__ import annotations

import re

from pyarrow import fs

# fixed values: scheme names of the same stores
ALIASES = {"s3a": "s3", "s3n": "s3", "abfs": "abfss"}


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """(file system, path inside) of a path or URI; ``dbfs:`` is the mount of that name."""
    scheme, rest = re.match(r"(?:([A-Za-z][\w+.-]*):)?(.*)$", path, re.S).groups()
    if scheme in (None, "file"):
        return fs.LocalFileSystem(), re.sub(r"^/+", "/", rest)
    if scheme == "dbfs":
        return fs.LocalFileSystem(), "/dbfs" + re.sub(r"^/+", "/", rest)
    return fs.FileSystem.from_uri(f"{ALIASES.get(scheme, scheme)}:{rest}")


def opens(path: str) -> bool:
    """Whether tasks can open files of this store; else Spark has to bring their contents."""
    try:
        return bool(store_of(path))
    except Exception:  # the store's library may be missing, or its scheme be known to Spark only
        return False
