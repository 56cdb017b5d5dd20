"""Files of one's own format in the shared folder, by pyarrow file systems (file, hdfs, s3, gs)."""

from __future__ import annotations


def _fs(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def open_out(uri: str):
    """An output stream; folders are made. Each task attempt names its own file, so a
    retried task never meets what a lost one left."""
    system, path = _fs(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_in(uri: str):
    system, path = _fs(uri)
    return system.open_input_file(path)
