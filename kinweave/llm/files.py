"""Files of our own formats in a folder that all executors share, whatever store it is in."""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import pyarrow as pa
import pyarrow.fs as pafs


def store(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if "://" in uri else f"file://{os.path.abspath(uri)}")


@contextmanager
def published(uri: str) -> Iterator[pa.NativeFile]:
    """Write a file under a name of this attempt and move it into place when whole, so attempts never mix."""
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.tmp"
    try:
        with fs.open_output_stream(own) as f:
            yield f
        fs.move(own, path)
    except BaseException:
        if fs.get_file_info(own).type != pafs.FileType.NotFound:
            fs.delete_file(own)
        raise


def created(uri: str) -> pa.NativeFile:
    fs, path = store(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    return fs.open_output_stream(path)


def moved(uri: str, to: str) -> None:
    fs, path = store(uri)
    fs.move(path, store(to)[1])


def deleted(uri: str) -> None:
    fs, path = store(uri)
    fs.delete_file(path)


def listed(uri: str, suffix: str) -> list[tuple[str, int]]:
    """(uri, size) of the files of a folder with this suffix, by name."""
    fs, path = store(uri)
    scheme = uri.split("://")[0] + "://" if "://" in uri else "file://"
    host = uri[len(scheme) :].split("/")[0] if "://" in uri else ""
    found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
    prefix = f"{scheme}{host}" if host and scheme not in ("s3://", "gs://") else scheme
    return sorted((prefix + f.path, f.size) for f in found if f.is_file and f.path.endswith(suffix))


def reader(uri: str) -> pa.NativeFile:
    fs, path = store(uri)
    return fs.open_input_file(path)
