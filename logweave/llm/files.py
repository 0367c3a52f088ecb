"""Files that tasks write to and read from the shared folder.

``pyarrow.fs`` opens the store that a URI names (file, hdfs, s3, gs, ...).  A task
writes under a name of its own, and only the names that its result rows carry count;
what a lost or repeated attempt has written is never read.
"""

from __future__ import annotations

import uuid

from pyarrow import fs


def _at(uri: str):
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def new_file(folder: str, suffix: str):
    """(uri, open output stream) of a file that no other attempt writes."""
    uri = f"{folder}/{uuid.uuid4().hex}{suffix}"
    store, path = _at(uri)
    store.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return uri, store.open_output_stream(path)


def open_file(uri: str):
    """A file that can be read by ranges: ``size()``, ``seek(at)``, ``read(n)``."""
    store, path = _at(uri)
    return store.open_input_file(path)


def read_range(file, at: int, size: int) -> bytes:
    file.seek(at)
    data = file.read(size)
    if len(data) != size:
        raise ValueError(f"the file ends before byte {at + size}")
    return data
