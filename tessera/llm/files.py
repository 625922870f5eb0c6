"""Whole files in the shared folder, by URI, from any executor."""

from __future__ import annotations

import uuid

from pyarrow import fs


def put(uri: str, data: bytes) -> str:
    """Writes under a name of its own, so that a second attempt of a task never touches the first one's file; returns the URI."""
    stem, dot, kind = uri.rpartition(".")
    uri = f"{stem}-{uuid.uuid4().hex[:12]}{dot}{kind}"
    store, path = fs.FileSystem.from_uri(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as f:
        f.write(data)
    return uri


def get(uri: str) -> bytes:
    store, path = fs.FileSystem.from_uri(uri)
    with store.open_input_stream(path) as f:
        return f.read()


def opened(uri: str):
    """A readable, sequential stream."""
    store, path = fs.FileSystem.from_uri(uri)
    return store.open_input_stream(path)
