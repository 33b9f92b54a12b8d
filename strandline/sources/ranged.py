"""Files of bytes read by ranges: flat vectors as a data source of Spark's, with a task for each range of records, and headers of WAV files.

Paths are Spark's. Local ones are opened as they are, those with another scheme by ``pyarrow.fs``.
"""

from __future__ import annotations

import struct
from functools import cache
from typing import BinaryIO

#: Bytes of records in one task.
RANGE = 32 << 20


@cache
def flat_vectors() -> type:
    """The data source ``flat_vectors``: (row_idx long, vec array<float>) of a file of 32-bit floats, little endian, without a header.

    Options: ``path``, ``dim`` (floats in a record), ``length`` (bytes of the file) and ``range`` (bytes in one task). A class made
    here is sent to workers whole, also to the one that plans, which may not find this module."""
    from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

    class Records(InputPartition):
        def __init__(self, begin: int, end: int):
            self.begin, self.end = begin, end

    class Reader(DataSourceReader):
        def __init__(self, options):
            self.path, self.dim = options["path"], int(options["dim"])
            self.n = int(options["length"]) // (4 * self.dim)
            self.each = max(1, int(options.get("range", 32 << 20)) // (4 * self.dim))

        def partitions(self):
            return [Records(i, min(i + self.each, self.n)) for i in range(0, self.n, self.each)]

        def read(self, partition):
            import numpy as np
            import pyarrow as pa

            scheme, _, rest = self.path.partition(":")
            if not rest or scheme == "file":
                f = open("/" + rest.lstrip("/") if rest else self.path, "rb")
            else:
                from urllib.parse import quote

                from pyarrow import fs

                system, name = fs.FileSystem.from_uri(quote(self.path, safe=":/@"))
                f = system.open_input_file(name)
            with f:
                f.seek(partition.begin * 4 * self.dim)
                some = max(1, (4 << 20) // (4 * self.dim))
                for i in range(partition.begin, partition.end, some):
                    n = min(some, partition.end - i)
                    flat = np.frombuffer(f.read(n * 4 * self.dim), "<f4")
                    if len(flat) != n * self.dim:
                        raise ValueError(f"{self.path} ends within record {i + len(flat) // self.dim}")
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * self.dim, pa.int32()), pa.array(flat))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + n), pa.int64()), lists], names=["row_idx", "vec"])

    class FlatVectors(DataSource):
        @classmethod
        def name(cls):
            return "flat_vectors"

        def schema(self):
            return "row_idx long, vec array<float>"

        def reader(self, schema):
            return Reader(self.options)

    return FlatVectors


def opened(path: str) -> BinaryIO:
    """A file to seek and read in."""
    scheme, _, rest = path.partition(":")
    if not rest or scheme == "file":
        return open("/" + rest.lstrip("/") if rest else path, "rb")
    from urllib.parse import quote

    from pyarrow import fs

    system, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))  # Spark's paths are plain text
    return system.open_input_file(name)


def wav_seconds(f: BinaryIO, length: int) -> float:
    """Frames over rate from the heads of the chunks of a RIFF file, whose samples aren't read; 0 for anything else."""
    head = f.read(12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        return 0.0
    at, rate, frame = 12, 0, 0
    while at + 8 <= length:
        f.seek(at)
        head = f.read(24)
        if len(head) < 8:
            return 0.0
        name, size = head[:4], struct.unpack_from("<I", head, 4)[0]
        if name == b"fmt ":
            if len(head) < 22:
                return 0.0
            rate, frame = struct.unpack_from("<I", head, 12)[0], struct.unpack_from("<H", head, 20)[0]
        elif name == b"data":
            return min(size, length - at - 8) // frame / rate if frame and rate else 0.0
        at += 8 + size + size % 2
    return 0.0
