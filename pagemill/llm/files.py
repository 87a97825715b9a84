"""Files in the shared folder, opened by executors through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create(folder: str, name: str):
    """A new output stream and its URI; the name is unique, so a task that runs again overwrites nothing."""
    uri = f"{folder}/{name.format(uuid.uuid4().hex)}"
    system, path = place(uri)
    if isinstance(system, fs.LocalFileSystem):
        system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return system.open_output_stream(path, compression=None), uri


def open_input(uri: str):
    system, path = place(uri)
    return system.open_input_file(path)
