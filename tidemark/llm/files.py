"""Binary files in the shared folder, on any store that Arrow opens (local or mounted, HDFS, object stores)."""

from __future__ import annotations

import posixpath

import pyarrow as pa
from pyarrow import fs


def locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or of an absolute path; Spark's `file:/x` is understood."""
    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    return fs.FileSystem.from_uri(uri)


def write_stream(uri: str) -> pa.NativeFile:
    store, path = locate(uri)
    store.create_dir(posixpath.dirname(path), recursive=True)
    return store.open_output_stream(path, compression=None)


def read_mapped(uri: str) -> pa.NativeFile:
    """A file to read from anywhere: memory-mapped where it lies on a mounted disk."""
    store, path = locate(uri)
    if isinstance(store, fs.LocalFileSystem):
        return pa.memory_map(path) if store.get_file_info(path).size else pa.BufferReader(b"")
    return store.open_input_file(path)
