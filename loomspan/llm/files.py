"""Files in the shared folder, opened from tasks by URI."""

from __future__ import annotations

import re


def _resolve(uri: str):
    from pyarrow import fs

    if re.match(r"file:|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return fs.FileSystem.from_uri(uri)


def open_new(uri: str):
    """A stream into a new file; its folder is made first. Names differ by attempt, so that a task run twice leaves a spare file and nothing else."""
    system, path = _resolve(uri)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def open_range(uri: str):
    """A file for reads of byte ranges."""
    system, path = _resolve(uri)
    return system.open_input_file(path)
