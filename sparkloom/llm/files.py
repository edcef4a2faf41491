"""Binary files in the shared folder, written and read by tasks through pyarrow's file systems."""

from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


@contextmanager
def writing(uri: str):
    """A stream for the file at uri.

    It is written under another name and moved when complete, so a lost task leaves no half file under the
    real name, and a task that runs again replaces it with the same bytes.  A task that fails deletes its draft.
    """
    system, path = fs.FileSystem.from_uri(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    draft = f"{path}.{uuid.uuid4().hex}.draft"
    try:
        with system.open_output_stream(draft) as stream:
            yield stream
    except BaseException:
        system.delete_file(draft)
        raise
    system.move(draft, path)


@contextmanager
def reading(uri: str):
    """A seekable file."""
    system, path = fs.FileSystem.from_uri(uri)
    with system.open_input_file(path) as stream:
        yield stream


def length(uri: str) -> int:
    system, path = fs.FileSystem.from_uri(uri)
    return system.get_file_info(path).size
