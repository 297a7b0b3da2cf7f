"""Plain arrays in the folder that all executors share."""

from __future__ import annotations

import os
import uuid
from urllib.parse import urlparse

import numpy as np


class Store:
    """Arrays by name below a URI: memory-mapped on a file system, read through Arrow's file systems elsewhere."""

    def __init__(self, uri: str):
        parsed = urlparse(uri)
        self.local = parsed.path if parsed.scheme in ("", "file") else None
        self.uri = uri

    def write(self, name: str, values: np.ndarray) -> None:
        """Whole or not at all: a task that is run again replaces the file by an equal one."""
        data = np.ascontiguousarray(values)
        if self.local is None:
            from pyarrow import fs

            system, path = fs.FileSystem.from_uri(self.uri)
            system.create_dir(path, recursive=True)
            with system.open_output_stream(f"{path}/{name}") as out:
                out.write(data.data)
            return
        os.makedirs(self.local, exist_ok=True)
        part = f"{self.local}/.{name}-{uuid.uuid4().hex}"
        with open(part, "wb") as out:
            data.tofile(out)
        os.replace(part, f"{self.local}/{name}")

    def array(self, name: str, dtype, n: int) -> np.ndarray:
        if not n:
            return np.zeros(0, dtype)
        if self.local is not None:
            return np.memmap(f"{self.local}/{name}", dtype, "r", shape=(n,))
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(self.uri)
        with system.open_input_file(f"{path}/{name}") as source:
            return np.frombuffer(source.read(), dtype, n)
