"""Sorted arrays in the shared folder, memory-mapped by the tasks that read them."""

from __future__ import annotations

import os
import shutil
import tempfile
import uuid

import numpy as np


def _local(uri: str) -> str | None:
    """The path of a folder that the operating system mounts, or None."""
    if uri.startswith("file:"):
        return "/" + uri.removeprefix("file:").lstrip("/")
    return uri if "://" not in uri else None


def write_array(folder: str, name: str, array: np.ndarray) -> str:
    """Write under a name no other attempt of the task uses; returns the place."""
    place = f"{folder}/{name}-{uuid.uuid4().hex}.npy"
    if (path := _local(place)) is not None:
        os.makedirs(os.path.dirname(path), exist_ok=True)
        np.save(path, array)
    else:
        from pyarrow import fs

        store, path = fs.FileSystem.from_uri(place)
        store.create_dir(os.path.dirname(path), recursive=True)
        with store.open_output_stream(path) as out:
            np.save(out, array)
    return place


class Shelf:
    """Opens arrays by place; copies those of a distant store to this machine for as long as it lives."""

    def __init__(self):
        self.copies: str | None = None

    def open(self, place: str) -> np.ndarray:
        path = _local(place)
        if path is None:
            from pyarrow import fs

            store, distant = fs.FileSystem.from_uri(place)
            self.copies = self.copies or tempfile.mkdtemp()
            path = os.path.join(self.copies, os.path.basename(distant))
            if not os.path.exists(path):
                with store.open_input_stream(distant) as source, open(path, "wb") as target:
                    shutil.copyfileobj(source, target)
        return np.load(path, mmap_mode="r")

    def close(self) -> None:
        if self.copies:
            shutil.rmtree(self.copies, ignore_errors=True)
            self.copies = None
