"""Files by path or URI, opened where they are read: on mounted paths and in the stores that Arrow knows (file, s3, gs, hdfs)."""

from __future__ import annotations

import re

from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    local = re.sub(r"^file:/*", "/", path)
    if "://" in local:
        return fs.FileSystem.from_uri(local)
    return fs.LocalFileSystem(), local


def size_of(path: str) -> int:
    store, name = located(path)
    info = store.get_file_info(name)
    if info.type != fs.FileType.File:
        raise FileNotFoundError(path)
    return info.size


def parts_of(path: str) -> list[tuple[str, int]]:
    """(path, size) of a file, or of the files in a folder in order of their names, without those that begin with _ or a dot."""
    store, name = located(path)
    info = store.get_file_info(name)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.type == fs.FileType.File else [x for x in store.get_file_info(fs.FileSelector(name)) if x.type == fs.FileType.File and x.base_name[0] not in "._"]
    return [(x.path, x.size) for x in sorted(found, key=lambda x: x.base_name)]


def read_range(path: str, start: int, length: int) -> bytes:
    """Bytes of a file from ``start`` on; no others are read."""
    store, name = located(path)
    with store.open_input_file(name) as f:
        f.seek(start)
        return f.read(length)
