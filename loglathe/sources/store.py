"""Byte access to files from Python tasks: listing, sizes, ranges."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs

#: Schemes that tasks can open themselves, and the names Arrow has for them.  Others are left to Spark's readers.
SCHEMES = {"": "file", "file": "file", "s3": "s3", "s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs"}


def scheme(path: str) -> str:
    head, colon, _ = path.partition(":")
    return head if colon and "/" not in head else ""


def reachable(path: str) -> bool:
    """Whether tasks can open the path: a shared mount or a store that Arrow knows, and no pattern of names."""
    return scheme(path) in SCHEMES and not any(c in path for c in "*?[{")


def open_store(path: str) -> tuple[arrow_fs.FileSystem, str]:
    kind = SCHEMES[scheme(path)]
    if kind == "file":
        local = path.partition(":")[2] if scheme(path) else path
        return arrow_fs.LocalFileSystem(), "/" + local.lstrip("/") if local.startswith("/") else posixpath.abspath(local)
    return arrow_fs.FileSystem.from_uri(f"{kind}:{path.partition(':')[2]}")


#: Characters that a path in a URI shows as they are, besides letters, digits and all beyond ASCII.
_PLAIN = set("/-_.!~*'();:@&=+$,")


def shown(path: str, inner: str) -> str:
    """The name that Spark's readers give a file: scheme and encoded path."""
    encoded = "".join(
        c if c.isalnum() or c in _PLAIN or ord(c) > 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in inner
    )
    kind = scheme(path) or "file"
    return f"{kind}:{encoded}" if SCHEMES[kind] == "file" else f"{kind}://{encoded}"


@dataclass(frozen=True)
class Found:
    """A file: ``inner`` opens it in its store, ``name`` is its last part, ``shown`` what tables call it."""

    inner: str
    name: str
    shown: str
    size: int


def list_store(path: str) -> list[Found]:
    """Files at or below a path by name, hidden ones left out; a path that does not exist is an error."""
    store, inner = open_store(path)
    info = store.get_file_info(inner)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(f"path does not exist: {path}")
    if info.type == arrow_fs.FileType.File:
        infos = [info]
    else:
        infos = store.get_file_info(arrow_fs.FileSelector(inner, recursive=True))
    root = len(inner.rstrip("/")) + 1
    files = [
        Found(i.path, i.base_name, shown(path, i.path), i.size or 0)
        for i in infos
        if i.type == arrow_fs.FileType.File and not any(p[:1] in ("_", ".") for p in i.path[root:].split("/"))
    ]
    return sorted(files, key=lambda f: f.inner)


def stream_of(path: str, inner: str, name: str):
    """The bytes of a file from the start; a ``.gz`` file is unpacked."""
    store, _ = open_store(path)
    return store.open_input_stream(inner, compression="gzip" if name.lower().endswith(".gz") else None, buffer_size=0)


def blocks(stream, size: int) -> Iterator[bytes]:
    while data := stream.read(size):
        yield data
