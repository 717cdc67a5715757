"""Seekable zstandard files: independent frames and a trailing seek table.

A file is a row of frames, each a complete zstandard frame, then one skippable frame with the
seek table: for each frame its compressed size, its size and the low 32 bits of the XXH64 of
its content, then the number of frames, a descriptor and a magic number (the public "zstd
seekable format", which any zstandard tool can decompress).  A reader takes the table from
the file's end and reads, checks and decompresses only the frames that it needs.

Files are written through the file system of their folder under a temporary name and appear by
renaming, so a task that runs again, or twice at once, leaves one whole file.
"""

from __future__ import annotations

import struct
import uuid

import numpy as np

SKIPPABLE, SEEKABLE, CHECKED = 0x184D2A5E, 0x8F92EAB1, 0x80
ENTRY, FOOT = struct.Struct("<III"), struct.Struct("<IBI")


def _file_system(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _checksum(content: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(content) & 0xFFFFFFFF


class SeekableWriter:
    """Writes one file, frame by frame."""

    def __init__(self, folder: str, name: str, level: int = 3):
        import zstandard

        self.fs, self.folder = _file_system(folder)
        self.uri, self.name = f"{folder}/{name}", name
        self.temporary = f"{self.folder}/.{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(self.folder, recursive=True)
        self.out = self.fs.open_output_stream(self.temporary, compression=None)
        self.zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self.table, self.written = [], 0

    def add(self, content: bytes) -> None:
        frame = self.zstd.compress(content)
        self.out.write(frame)
        self.table.append((len(frame), len(content), _checksum(content)))
        self.written += len(frame)

    def close(self) -> None:
        """End the file with its seek table and give it its name."""
        table = b"".join(ENTRY.pack(*e) for e in self.table) + FOOT.pack(len(self.table), CHECKED, SEEKABLE)
        self.out.write(struct.pack("<II", SKIPPABLE, len(table)) + table)
        self.out.close()
        self.fs.move(self.temporary, f"{self.folder}/{self.name}")


class SeekableReader:
    """Random access to the frames of one file."""

    def __init__(self, uri: str):
        import zstandard

        fs, path = _file_system(uri)
        self.file, self.zstd = fs.open_input_file(path), zstandard.ZstdDecompressor()
        size = self.file.size()
        n, flags, magic = FOOT.unpack(self.file.read_at(FOOT.size, size - FOOT.size))
        if magic != SEEKABLE or flags != CHECKED:
            raise ValueError(f"{uri} has no seek table")
        self.table = list(ENTRY.iter_unpack(self.file.read_at(n * ENTRY.size, size - FOOT.size - n * ENTRY.size)))
        self.starts = [0, *np.cumsum([e[0] for e in self.table]).tolist()]

    def content(self, k: int) -> bytes:
        """The content of one frame, checked."""
        packed, size, check = self.table[k]
        content = self.zstd.decompress(self.file.read_at(packed, self.starts[k]), max_output_size=size)
        if len(content) != size or _checksum(content) != check:
            raise ValueError(f"frame {k} is damaged")
        return content

    def close(self):
        self.file.close()
