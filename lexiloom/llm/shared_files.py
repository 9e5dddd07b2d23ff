"""Binary files in the shared folder, written and read by tasks.

Any store that pyarrow can open from its URI will do (a local or mounted path, S3, GCS, HDFS).
Files appear under their final name by a rename, so a repeated or speculative task leaves one
whole file. Local paths are memory-mapped in place; remote files are mapped from a copy that has no
name any more, so nothing stays behind in an executor's own folder.
"""

from __future__ import annotations

import mmap
import os
import shutil
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def write(uri: str, *parts) -> None:
    """Write the buffers one after the other as file ``uri``."""
    store, path = _open(uri)
    store.create_dir(os.path.dirname(path), recursive=True)
    temp = f"{path}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as out:
        for p in parts:
            out.write(p)
    store.move(temp, path)


def mapped(uri: str, dtype) -> np.ndarray:
    """The file as a read-only memory-mapped array."""
    store, path = _open(uri)
    if isinstance(store, fs.LocalFileSystem):
        # as a plain array: every slice and index of the subclass runs Python code
        return np.asarray(np.memmap(path, dtype=dtype, mode="r")) if os.path.getsize(path) else np.empty(0, dtype)
    with tempfile.TemporaryFile() as copy:
        with store.open_input_stream(path) as src:
            shutil.copyfileobj(src, copy, 1 << 20)
        copy.flush()
        if not copy.tell():
            return np.empty(0, dtype)
        return np.frombuffer(mmap.mmap(copy.fileno(), 0, access=mmap.ACCESS_READ), dtype)
