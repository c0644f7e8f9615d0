"""WAV files as rows of samples, a long file as several partitions.

``register(spark)`` adds the data source ``pcm``:
``spark.read.format("pcm").option("bytes", 1 << 22).load(folder)``.
"""

from __future__ import annotations

import posixpath
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: A row is so many samples of all channels, one after the other, from sample ``first`` of the file on.
SCHEMA = "path string, first long, rate int, channels int, samples array<double>, error string"
#: Bytes of samples of one partition, and frames of one row.
BYTES, FRAMES = 8 << 20, 1 << 16
#: Bytes of a file that are looked at for its format first.
HEAD = 4_096


def _file_system(path: str):
    """(file system, path in it) for what Arrow knows: local paths, hdfs, s3, gs."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Format:
    kind: int
    channels: int
    rate: int
    width: int  # bytes of a frame
    start: int  # of the samples
    frames: int


def format_of(read, size: int) -> Format:
    """Of a WAV file from ``read(offset, n)``: chunk heads are read where they are, samples are not."""
    head = read(0, 12)
    if head[:4] != b"RIFF" or head[8:12] != b"WAVE":
        raise ValueError("no WAV file")
    at, kind = 12, None
    while at + 8 <= size:
        name, n = struct.unpack("<4sI", read(at, 8))
        if name == b"fmt ":
            code, channels, rate, _, width, bits = struct.unpack("<HHIIHH", read(at + 8, 16))
            if code == 0xFFFE:  # extensible: the real code follows
                code = struct.unpack("<H", read(at + 32, 2))[0]
            if not channels or not width or (code, bits) not in TYPES:
                raise ValueError(f"cannot read format {code} of {bits} bits")
            kind = code, channels, rate, width, bits
        elif name == b"data":
            if kind is None:
                raise ValueError("samples before their format")
            return Format(TYPES_AT[kind[0], kind[4]], kind[1], kind[2], kind[3], at + 8, min(n, size - at - 8) // kind[3])
        at += 8 + n + n % 2
    raise ValueError("no samples")


def _wide(raw: bytes) -> np.ndarray:
    """24-bit integers."""
    b = np.frombuffer(raw, np.uint8).reshape(-1, 3).astype(np.int32)
    return ((b[:, 0] | b[:, 1] << 8 | b[:, 2] << 16) << 8 >> 8) / 2.0**23


#: Sample formats by code and bits: how bytes become numbers in [-1, 1].
TYPES = {
    (1, 8): lambda raw: (np.frombuffer(raw, np.uint8).astype(np.float64) - 128) / 128,
    (1, 16): lambda raw: np.frombuffer(raw, "<i2") / 2.0**15,
    (1, 24): _wide,
    (1, 32): lambda raw: np.frombuffer(raw, "<i4") / 2.0**31,
    (3, 32): lambda raw: np.frombuffer(raw, "<f4").astype(np.float64),
    (3, 64): lambda raw: np.frombuffer(raw, "<f8").astype(np.float64),
}
TYPES_AT = {key: nth for nth, key in enumerate(TYPES)}


@dataclass
class Part(InputPartition):
    """Frames of a file, or what is wrong with it."""

    path: str
    first: int = 0
    frames: int = 0
    format: Format | None = None
    error: str | None = None


class PcmReader(DataSourceReader):
    def __init__(self, options: dict):
        if not options.get("path"):
            raise ValueError("a path is needed")
        self.path = options["path"]
        self.bytes = int(options.get("bytes", BYTES))
        self.frames = int(options.get("frames", FRAMES))

    def partitions(self) -> list[Part]:
        """Byte ranges of the files, from their heads alone, in the order of their paths."""
        from pyarrow import fs

        system, where = _file_system(self.path)
        found = system.get_file_info(where)
        files = [found] if found.type == fs.FileType.File else system.get_file_info(fs.FileSelector(where, recursive=True)) if found.type == fs.FileType.Directory else []
        scheme = self.path[: self.path.index("://") + 3] if "://" in self.path else ""
        out: list[Part] = []
        for info in sorted(files, key=lambda f: f.path):
            if info.type != fs.FileType.File or posixpath.splitext(info.path)[1].lower() != ".wav":
                continue
            try:
                with system.open_input_file(info.path) as f:
                    head = f.read(HEAD)

                    def read(at: int, n: int, f=f, head=head) -> bytes:
                        if at + n <= len(head):
                            return head[at : at + n]
                        f.seek(at)
                        return f.read(n)

                    form = format_of(read, info.size)
            except Exception as e:  # a broken file is a row with its error
                out.append(Part(scheme + info.path, error=str(e) or type(e).__name__))
                continue
            step = max(1, self.bytes // form.width)
            out += [Part(scheme + info.path, at, min(step, form.frames - at), form) for at in range(0, form.frames, step)]
        return out

    def read(self, part: Part) -> Iterator[tuple]:
        if part is None or part.error is not None or part.format is None:
            if part is not None:
                yield part.path, None, None, None, None, part.error
            return
        form = part.format
        turn = list(TYPES.values())[form.kind]
        system, where = _file_system(part.path)
        with system.open_input_file(where) as f:
            f.seek(form.start + part.first * form.width)
            for at in range(part.first, part.first + part.frames, self.frames):
                n = min(self.frames, part.first + part.frames - at)
                yield part.path, at, form.rate, form.channels, turn(f.read(n * form.width)).tolist(), None


class Pcm(DataSource):
    @classmethod
    def name(cls) -> str:
        return "pcm"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PcmReader:
        return PcmReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Pcm)


def by_channel(samples):
    """(key..., channel, first, y): rows of one channel's samples each, as ``loudness_lufs`` takes them."""
    from pyspark.sql import functions as F

    each = samples.where("error is null").withColumn("channel", F.explode(F.sequence(F.lit(0), F.col("channels") - 1)))
    own = F.filter("samples", lambda x, i: i % F.col("channels") == F.col("channel"))
    return each.select("path", "channel", "first", "rate", own.alias("y"))


def written(rows, key: str, samples: str, rate: int, folder: str) -> None:
    """A mono WAV file of 16 bits, ``folder``/``key``.wav, of each row's samples in [-1, 1]."""

    def write(batches):
        import pandas as pd

        system, where = _file_system(folder)
        system.create_dir(where, recursive=True)
        for pdf in batches:
            for k, y in zip(pdf["k"], pdf["y"], strict=True):
                data = np.clip(np.rint(np.asarray(y if y is not None else [], dtype=float) * 2**15), -(2**15), 2**15 - 1).astype("<i2").tobytes()
                head = struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + len(data), b"WAVE", b"fmt ", 16, 1, 1, rate, rate * 2, 2, 16, b"data", len(data))
                with system.open_output_stream(f"{where}/{k}.wav") as f:
                    f.write(head + data)
            yield pd.DataFrame({"n": [len(pdf)]})

    from pyspark.sql import functions as F

    rows.select(F.col(key).cast("string").alias("k"), F.col(samples).alias("y")).mapInPandas(write, "n long").agg(F.sum("n")).collect()
