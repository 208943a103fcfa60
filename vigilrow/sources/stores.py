"""Where files live: listing a folder and reading or writing a file, in any store.

A place without a scheme, or with ``file:``, is on a file system that all tasks
see.  Any other scheme is opened by ``pyarrow.fs`` (object stores, HDFS), or by
an opener given for that scheme.  Only tasks open stores; what travels is the
text of a place and the opener.
"""

from __future__ import annotations

import os
import re
import stat
from collections.abc import Callable, Iterator, Mapping

from pyarrow.fs import FileSelector, FileSystem, FileType

#: scheme -> function from a place (``scheme://...``) to a file system and the path in it.
Openers = Mapping[str, Callable[[str], tuple[FileSystem, str]]]

#: name, size (-1 if it cannot be read), whether it is a folder
Entry = tuple[str, int, bool]


def scheme_of(place: str) -> str:
    found = re.match(r"([A-Za-z][A-Za-z0-9+.-]*):/", place)
    return found[1].lower() if found else "file"


def local_path(place: str) -> str:
    return re.sub("^file:/+", "/", place)


def join(folder: str, name: str) -> str:
    return f"{folder.rstrip('/')}/{name}"


def _opened(root: str, place: str, openers: Openers) -> tuple[FileSystem, str]:
    """The file system of ``root`` and the path of a place below it; names below the root are taken as they are."""
    opener = openers.get(scheme_of(root), FileSystem.from_uri)
    system, path = opener(root)
    return system, path.rstrip("/") + place.removeprefix(root.rstrip("/"))


def entries(root: str, folder: str, openers: Openers) -> Iterator[Entry]:
    """What a folder holds, hidden names and empty files included.  Raises OSError if it cannot be read."""
    if scheme_of(root) != "file":
        system, path = _opened(root, folder, openers)
        for info in system.get_file_info(FileSelector(path)):
            if info.type != FileType.NotFound:
                is_folder = info.type == FileType.Directory
                yield info.base_name, 0 if is_folder else -1 if info.size is None else info.size, is_folder
        return
    with os.scandir(folder) as found:
        for entry in found:
            try:
                # Links to folders are not followed: they may lead back.
                if entry.is_dir(follow_symlinks=False):
                    yield entry.name, 0, True
                elif stat.S_ISREG(entry.stat().st_mode):
                    yield entry.name, entry.stat().st_size, False
            except OSError:
                yield entry.name, -1, False


def read(root: str, place: str, openers: Openers) -> bytes:
    """All bytes of a file.  Raises OSError if it cannot be read."""
    if scheme_of(root) != "file":
        system, path = _opened(root, place, openers)
        with system.open_input_stream(path) as stream:
            return stream.read()
    with open(local_path(place), "rb") as file:
        return file.read()


def write(root: str, place: str, content: bytes, openers: Openers) -> None:
    """Write a file and the folders above it; a repeated task writes the same bytes again."""
    if scheme_of(root) != "file":
        system, path = _opened(root, place, openers)
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with system.open_output_stream(path) as stream:
            stream.write(content)
        return
    path = local_path(place)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    # Written beside and moved, so that nobody reads half a file.
    beside = f"{path}.{os.getpid()}.part"
    with open(beside, "wb") as file:
        file.write(content)
    os.replace(beside, path)
