"""Files opened by tasks, by any address that Spark gives them."""

from __future__ import annotations

from urllib.parse import unquote, urlsplit

#: Schemes of Hadoop's connectors, as Arrow's file systems call them.
_SCHEMES = {"s3a": "s3", "s3n": "s3", "gs": "gs", "hdfs": "hdfs", "abfss": "abfss"}


def located(uri: str):
    """(file system, path) of an address."""
    from pyarrow import fs

    at = urlsplit(uri)
    if at.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(at.path) if at.scheme else uri
    return fs.FileSystem.from_uri(f"{_SCHEMES.get(at.scheme, at.scheme)}://{at.netloc}{at.path}")


def opened(uri: str):
    """A file to read, with seek; nothing is read until asked for."""
    system, path = located(uri)
    return system.open_input_file(path)


def size_of(uri: str) -> int:
    system, path = located(uri)
    return system.get_file_info(path).size
