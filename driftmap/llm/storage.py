"""Files in the shared folder, opened from tasks: local paths and file: URIs by open(), other stores by pyarrow.fs."""

from __future__ import annotations

import os
import uuid


def _local(uri: str) -> str | None:
    if uri.startswith("file:"):
        return "/" + uri[5:].lstrip("/")
    return uri if "://" not in uri else None


def store(uri: str, write) -> str:
    """write(f) fills a file under a temporary name beside uri; the finished file gets a name of its own, which is returned.

    A task that is run again writes another file; only names that a task has returned are read.
    """
    stem, _, end = uri.rpartition(".")
    uri = f"{stem}-{uuid.uuid4().hex[:12]}.{end}"
    if path := _local(uri):
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(f"{path}.part", "wb") as f:
            write(f)
        os.replace(f"{path}.part", path)
        return uri
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    where.create_dir(path.rpartition("/")[0], recursive=True)
    with where.open_output_stream(path) as f:
        write(f)
    return uri


def opened(uri: str):
    """A seekable binary file for range reads."""
    if path := _local(uri):
        return open(path, "rb")
    from pyarrow import fs

    where, path = fs.FileSystem.from_uri(uri)
    return where.open_input_file(path)
