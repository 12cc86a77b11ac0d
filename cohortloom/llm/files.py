"""Binary files on the shared storage, written and read by tasks.

A task writes under a name of its own attempt and reports it in a row; the table of those rows, written
by Spark's committer, is the list of valid files. Files of lost or repeated attempts are in no list.
"""

from __future__ import annotations

import posixpath
import re
import uuid

from pyarrow import fs


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder URI; a plain path is a mounted shared folder."""
    if re.match(r"file:/[^/]", uri):
        uri = uri[5:]
    if "://" not in uri:
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


def new_file(folder: str, prefix: str, suffix: str) -> tuple[str, object]:
    """(name, output stream) of a new file in the folder."""
    system, path = open_folder(folder)
    system.create_dir(path, recursive=True)
    name = f"{prefix}-{uuid.uuid4().hex}{suffix}"
    return name, system.open_output_stream(posixpath.join(path, name), compression=None)


def open_file(folder: str, name: str):
    """Random-access input of a file in the folder."""
    system, path = open_folder(folder)
    return system.open_input_file(posixpath.join(path, name))
