"""Files on shared storage, written and read inside tasks.

Any URI that ``pyarrow.fs`` knows will do (``file:``, ``hdfs:``, ``s3:``, ``gs:``).
A file gets its name only when it is complete, and names hold a random part, so a
repeated or speculative task never touches another attempt's file; readers only
open files that a successful task reported.
"""

from __future__ import annotations

import uuid
from typing import BinaryIO

from pyarrow import fs


def _place(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else f"file://{uri}")


class SharedFile:
    """A new file in ``folder``; ``close`` gives it its name and returns the URI."""

    def __init__(self, folder: str, stem: str, suffix: str):
        self.uri = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex}{suffix}"
        self.store, self.path = _place(self.uri)
        self.store.create_dir(self.path.rsplit("/", 1)[0], recursive=True)
        self.out = self.store.open_output_stream(self.path + ".part")
        self.size = 0

    def write(self, data: bytes) -> int:
        """Append; returns the offset at which ``data`` starts."""
        at = self.size
        self.out.write(data)
        self.size += len(data)
        return at

    def close(self) -> str:
        self.out.close()
        self.store.move(self.path + ".part", self.path)
        return self.uri


def open_read(uri: str) -> BinaryIO:
    store, path = _place(uri)
    return store.open_input_file(path)
