"""Files of named numpy arrays in the shared folder: written whole under a name of their own and then renamed (so a repeated task does no harm), read by memory map where the folder is a file system of the machine, else fetched through pyarrow's file systems."""

from __future__ import annotations

import json
import mmap
import os
import uuid
from urllib.parse import urlparse

import numpy as np


def local_path(uri: str) -> str | None:
    parsed = urlparse(uri)
    return parsed.path if parsed.scheme in ("", "file") else None


def write(uri: str, arrays: dict[str, np.ndarray]) -> None:
    head, at = {}, 0
    for k, v in arrays.items():
        head[k] = [v.dtype.str, len(v), at]
        at += -(-v.nbytes // 64) * 64
    text = json.dumps(head).encode()
    text += b" " * (-(len(text) + 8) % 64)
    chunks = [len(text).to_bytes(8, "little"), text]
    for v in arrays.values():
        chunks += [np.ascontiguousarray(v).tobytes(), bytes(-v.nbytes % 64)]
    path = local_path(uri)
    if path is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        temp = f"{path}.{uuid.uuid4().hex}"
        with open(temp, "wb") as f:
            f.writelines(chunks)
        os.replace(temp, path)
        return
    from pyarrow import fs

    store, name = fs.FileSystem.from_uri(uri)
    store.create_dir(os.path.dirname(name), recursive=True)
    temp = f"{name}.{uuid.uuid4().hex}"
    with store.open_output_stream(temp) as f:
        for c in chunks:
            f.write(c)
    store.move(temp, name)


def read(uri: str) -> dict[str, np.ndarray]:
    path = local_path(uri)
    if path is not None:
        with open(path, "rb") as f:
            raw = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
    else:
        from pyarrow import fs

        store, name = fs.FileSystem.from_uri(uri)
        with store.open_input_file(name) as f:
            raw = f.read()
    size = int.from_bytes(raw[:8], "little")
    head = json.loads(raw[8 : 8 + size])
    return {k: np.frombuffer(raw, kind, n, 8 + size + at) for k, (kind, n, at) in head.items()}
