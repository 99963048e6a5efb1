"""Files opened inside tasks, wherever Arrow reaches: mounted folders and the stores that it was built with."""

from __future__ import annotations

import re

import pyarrow as pa
from pyarrow import fs


def located(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path within it; Spark's file:/... names local files too."""
    local = re.sub(r"^file:/*", "/", path)
    if "://" in local:
        try:
            return fs.FileSystem.from_uri(local)
        except pa.ArrowInvalid as e:
            raise ValueError(f"{path}: Arrow opens no such store ({e})") from None
    return fs.LocalFileSystem(), local


def opened(path: str) -> pa.NativeFile:
    """A file that is read by ranges: what isn't asked for isn't read."""
    system, name = located(path)
    return system.open_input_file(name)


def size(path: str) -> int | None:
    """Bytes of a file, None where there is none."""
    system, name = located(path)
    got = system.get_file_info(name)
    return got.size if got.type == fs.FileType.File else None
