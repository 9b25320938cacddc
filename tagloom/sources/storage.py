"""Files and folders behind a path or a URI, as tasks see them.

Plain paths and ``file:`` URIs are this machine's, links not followed below a folder. Any
other scheme is opened by pyarrow's file systems; those tell no permissions, so no file of
theirs counts as executable.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import BinaryIO

from pyarrow import fs

_uri = re.compile(r"([A-Za-z][A-Za-z0-9+.-]+):(?://([^/]*))?(/.*)?$", re.DOTALL)


@dataclass(frozen=True)
class Entry:
    """What lies at a path; links and devices are neither file nor folder. ``stat`` changes when the file does."""

    name: str
    is_folder: bool
    is_file: bool
    size: int
    is_exec: bool
    stat: str


def local(path: str) -> str:
    """A ``file:`` URI as a plain path; any other path as it is."""
    found = _uri.match(path)
    return found[3] or "/" if found and found[1].lower() == "file" else path


def is_remote(path: str) -> bool:
    found = _uri.match(path)
    return bool(found) and found[1].lower() != "file"


@lru_cache(maxsize=16)
def _system(scheme: str, authority: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(f"{scheme}://{authority}/")


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI and the path in it; what follows the authority is taken as it stands, not decoded."""
    scheme, authority, rest = _uri.match(uri).groups()
    system, top = _system(scheme, authority or "")
    return system, top.rstrip("/") + (rest or "/")


def _local_entry(name: str, st: os.stat_result, is_folder: bool, is_file: bool) -> Entry:
    return Entry(name, is_folder, is_file, st.st_size, bool(st.st_mode & 0o111), f"{st.st_size}:{st.st_mtime_ns}:{st.st_ino}")


def _entry(info: fs.FileInfo) -> Entry:
    size = info.size or 0
    return Entry(info.base_name, info.type == fs.FileType.Directory, info.type == fs.FileType.File, size, False, f"{size}:{info.mtime_ns or 0}:0")


def entries_in(system: fs.FileSystem, folder: str) -> Iterator[Entry]:
    return map(_entry, system.get_file_info(fs.FileSelector(folder)))


def entries(folder: str) -> Iterator[Entry]:
    """What lies in a folder, in any order. Raises OSError for what cannot be listed."""
    if is_remote(folder):
        yield from entries_in(*_place(folder))
        return
    with os.scandir(local(folder)) as found:
        for e in found:
            yield _local_entry(e.name, e.stat(follow_symlinks=False), e.is_dir(follow_symlinks=False), e.is_file(follow_symlinks=False))


def entry(path: str) -> Entry:
    """What a path leads to, by a link too. Raises OSError if nothing is there."""
    if is_remote(path):
        system, inner = _place(path)
        info = system.get_file_info(inner)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(path)
        return _entry(info)
    here = local(path)
    return _local_entry(os.path.basename(here), os.stat(here), os.path.isdir(here), os.path.isfile(here))


def opened(path: str) -> BinaryIO:
    """A file to read from and seek in."""
    if is_remote(path):
        system, inner = _place(path)
        return system.open_input_file(inner)
    return open(local(path), "rb")


def put(path: str, content: bytes) -> None:
    """Write a small file, and the folders above it; a task that runs twice writes the same again."""
    if is_remote(path):
        system, inner = _place(path)
        system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(inner) as out:
            out.write(content)
        return
    os.makedirs(os.path.dirname(local(path)), exist_ok=True)
    with open(local(path), "wb") as out:
        out.write(content)
