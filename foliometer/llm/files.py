"""Whole files written from tasks into the shared folder."""

from __future__ import annotations

import uuid

import pyarrow.fs as fs


def write_file(folder: str, name: str, data: bytes) -> None:
    """Write under another name and move into place, so readers see whole files only.

    A task that runs again writes the same bytes under the same name.
    """
    system, path = fs.FileSystem.from_uri(folder)
    system.create_dir(path, recursive=True)
    part = f"{path}/.{name}-{uuid.uuid4().hex}"
    with system.open_output_stream(part) as out:
        out.write(data)
    system.move(part, f"{path}/{name}")
