"""Files by path or URI, for code that runs in Python on driver and executors.

Plain paths and ``file:`` URIs are local. Any other URI goes to the file system registered for its
scheme, or else to the one that ``pyarrow.fs`` opens for it (``s3``, ``gs``, ``hdfs``, …).
"""

from __future__ import annotations

import builtins
import glob as local_glob
import io
import os
import shutil
from collections.abc import Callable, Iterator
from dataclasses import dataclass

#: From a scheme to a function that gives a ``pyarrow.fs`` file system and the path on it.
SCHEMES: dict[str, Callable] = {}


def register(scheme: str, opener: Callable) -> None:
    """Use ``opener(uri)``, which returns (file system, path), for URIs of a scheme."""
    SCHEMES[scheme] = opener


def is_remote(path: str) -> bool:
    return "://" in path and not path.startswith("file:")


def local(path: str) -> str:
    """A local path without its scheme; URIs of other schemes stay as they are."""
    return path if is_remote(path) else path.removeprefix("file://").removeprefix("file:")


def _remote(path: str):
    from pyarrow import fs

    scheme = path.partition("://")[0]
    return SCHEMES[scheme](path) if scheme in SCHEMES else fs.FileSystem.from_uri(path)


def _info(path: str):
    system, at = _remote(path)
    return system.get_file_info(at)


class _Raw(io.RawIOBase):
    """What ``io.BufferedReader`` needs, over an Arrow file."""

    def __init__(self, file):
        self.file = file

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def readinto(self, buffer) -> int:
        data = self.file.read(len(buffer))
        buffer[: len(data)] = data
        return len(data)

    def seek(self, offset: int, whence: int = 0) -> int:
        self.file.seek(offset, whence)
        return self.file.tell()

    def tell(self) -> int:
        return self.file.tell()

    def close(self) -> None:
        if not self.closed:
            self.file.close()
        super().close()


def open(path: str, mode: str = "rb"):
    """A binary file for reading (``rb``) or writing (``wb``)."""
    if not is_remote(path):
        return builtins.open(local(path), mode, 1 << 20)
    system, at = _remote(path)
    return io.BufferedReader(_Raw(system.open_input_file(at)), 1 << 20) if mode == "rb" else system.open_output_stream(at)


def join(path: str, *names: str) -> str:
    return "/".join([path.rstrip("/"), *names]) if is_remote(path) else os.path.join(local(path), *names)


def exists(path: str) -> bool:
    return _info(path).type.name != "NotFound" if is_remote(path) else os.path.exists(local(path))


def isdir(path: str) -> bool:
    return _info(path).type.name == "Directory" if is_remote(path) else os.path.isdir(local(path))


def isfile(path: str) -> bool:
    return _info(path).type.name == "File" if is_remote(path) else os.path.isfile(local(path))


def getsize(path: str) -> int:
    return _info(path).size if is_remote(path) else os.path.getsize(local(path))


@dataclass(frozen=True)
class Stat:
    """Size, time of the last change, and what tells a file from another of its name."""

    size: int
    changed: float
    identity: int


def stat(path: str) -> Stat:
    if not is_remote(path):
        s = os.stat(local(path))
        return Stat(s.st_size, s.st_mtime, s.st_ino)
    info = _info(path)
    if info.type.name == "NotFound":
        raise FileNotFoundError(path)
    return Stat(info.size, info.mtime_ns / 1e9 if info.mtime_ns else 0.0, 0)


def makedirs(path: str) -> None:
    if is_remote(path):
        system, at = _remote(path)
        system.create_dir(at, recursive=True)
    else:
        os.makedirs(local(path), exist_ok=True)


def replace(source: str, target: str) -> None:
    if is_remote(source):
        (system, a), (_, b) = _remote(source), _remote(target)
        system.move(a, b)
    else:
        os.replace(local(source), local(target))


def remove(path: str) -> None:
    if is_remote(path):
        system, at = _remote(path)
        system.delete_file(at)
    else:
        os.remove(local(path))


def rmtree(path: str) -> None:
    if is_remote(path):
        system, at = _remote(path)
        system.delete_dir(at)
    else:
        shutil.rmtree(local(path), ignore_errors=True)


def glob(pattern: str) -> list[str]:
    """Paths that match; of other schemes only patterns in the last name."""
    if not any(c in pattern for c in "*?["):
        return [local(pattern)]
    if not is_remote(pattern):
        return sorted(local_glob.glob(local(pattern)))
    import fnmatch

    folder, _, name = pattern.rpartition("/")
    return sorted(p for p in walk(folder, max_depth=0) if fnmatch.fnmatch(p.rpartition("/")[2], name))


def walk(path: str, max_depth: int | None = None, follow_links: bool = True) -> Iterator[str]:
    """Files below a folder in sorted order of folders and names; hidden ones are skipped, and so
    are files whose names begin with an underscore."""
    if not is_remote(path):
        path = local(path)
        base = path.rstrip("/").count("/")
        for folder, inner, names in os.walk(path, followlinks=follow_links):
            inner[:] = sorted(d for d in inner if not d.startswith(".") and (max_depth is None or folder.rstrip("/").count("/") - base + 1 <= max_depth))
            yield from (os.path.join(folder, n) for n in sorted(names) if not n.startswith((".", "_")) and (follow_links or not os.path.islink(os.path.join(folder, n))))
        return
    from pyarrow import fs

    system, at = _remote(path)
    at = at.rstrip("/")
    for info in sorted(system.get_file_info(fs.FileSelector(at, recursive=True)), key=lambda i: i.path):
        below = info.path[len(at) :].strip("/")
        parts = below.split("/")
        if info.type.name == "File" and not any(p.startswith(".") for p in parts) and not parts[-1].startswith("_") and (max_depth is None or len(parts) - 1 <= max_depth):
            yield f"{path.rstrip('/')}/{below}"
