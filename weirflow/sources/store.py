"""Files of a store as tasks and the driver see them, by path or url."""

from __future__ import annotations

import os
from fnmatch import fnmatch

from pyarrow import ArrowInvalid, ArrowNotImplementedError
from pyarrow.fs import FileInfo, FileSelector, FileSystem, FileType, LocalFileSystem


def place(path: str) -> tuple[FileSystem, str]:
    """The file system of a path or url, and the path in it."""
    if ":/" not in path:
        return LocalFileSystem(), os.path.abspath(path)
    if path.startswith("file:/"):
        return LocalFileSystem(), "/" + path.removeprefix("file:").lstrip("/")
    return FileSystem.from_uri(path)


def reachable(path: str) -> bool:
    """Whether tasks can read ranges of files at ``path`` by themselves; if not, only Spark's own readers reach it."""
    try:
        place(path)
    except (ArrowInvalid, ArrowNotImplementedError, OSError):
        return False
    return True


def files_below(path: str, pattern: str = "*") -> tuple[FileSystem, list[FileInfo]]:
    """The files at or below ``path`` whose names match, but for hidden ones and those with a leading underscore, by name."""
    fs, root = place(path)
    info = fs.get_file_info(root)
    if info.type == FileType.File:
        return fs, [info]
    found = fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
    hidden = lambda f: any(part[:1] in "._" for part in f.path[len(root) :].split("/") if part)
    return fs, sorted((f for f in found if f.type == FileType.File and not hidden(f) and fnmatch(f.base_name, pattern)), key=lambda f: f.path)
