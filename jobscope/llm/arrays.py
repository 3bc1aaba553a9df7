"""Arrays in the shared folder that workers map into memory."""

from __future__ import annotations

import mmap
import os
import tempfile
import uuid

import numpy as np
from pyarrow import fs


def put(path: str, array: np.ndarray) -> None:
    """Write the array's bytes; the file appears whole, so a repeated task replaces it by the same."""
    store, at = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
    store.create_dir(os.path.dirname(at), recursive=True)
    part = f"{at}.{uuid.uuid4().hex}"
    with store.open_output_stream(part) as f:
        f.write(np.ascontiguousarray(array).data)
    store.move(part, at)


def mapped(path: str, kind: str) -> np.ndarray:
    """The array, memory-mapped.  Of a store that is no file system, from a nameless local copy."""
    local = path.removeprefix("file://") if path.startswith("file://") else path.removeprefix("file:")
    if "://" in local:
        store, at = fs.FileSystem.from_uri(path)
        with store.open_input_stream(at) as f, tempfile.TemporaryFile() as copy:
            while data := f.read(1 << 24):
                copy.write(data)
            copy.flush()
            return _view(copy.fileno(), kind)
    with open(local, "rb") as f:
        return _view(f.fileno(), kind)


def _view(number: int, kind: str) -> np.ndarray:
    if not os.fstat(number).st_size:
        return np.zeros(0, kind)
    return np.frombuffer(mmap.mmap(number, 0, prot=mmap.PROT_READ), kind)
