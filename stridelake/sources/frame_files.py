"""Frames of video or array files as a Spark data source, for batch and stream reads of one folder.

    frame_files.register(spark)
    spark.read.format("frame_files").option("path", root).load()
    spark.readStream.format("frame_files").option("path", root).load()

Files are below root/<identity>/; a row is a frame. Options: `suffix` (".npy"), `decoder` ("module:function", by default
npy_frames), `identities` (names with commas between) and `videos` (a pattern of file names without suffix, as "v1*"), which
keep other files from being opened, `partition_bytes` (files are packed into partitions of about so many bytes, the largest first; a larger file has its
own) and, for streams, `settle_seconds` (younger files wait for the next batch, so that none is passed by).

decoder(content, columns) yields dicts of the wanted columns that are not of the file itself. A schema stated by the reader prunes
columns; one without any of the decoder's columns still gives a row a frame. Conditions are not pushed into the reader: Spark 4.1
keeps what one query pushed for the next one on the same DataFrame, which then lacks rows (a test shows that here none do). A file that fails gives one row with its error alone. Files are held
whole in a task. A missing root is an error, an empty one has no rows.
"""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from fnmatch import fnmatchcase
from importlib import import_module

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from ..schema import LANDMARK

SCHEMA = f"path string, identity string, video_id string, frame_idx int, lm array<{LANDMARK}>, error string"
OF_FILE = ("path", "identity", "video_id")


def npy_frames(content: bytes, columns: list[str]) -> Iterator[dict]:
    """Frames of an array of (frames, landmarks, 3); a frame of non-finite numbers has no pose (lm null)."""
    import io

    import numpy as np

    a = np.load(io.BytesIO(content), allow_pickle=False)
    if a.ndim != 3 or a.shape[2] != 3:
        raise ValueError(f"an array of (frames, landmarks, 3) was expected, not {a.shape}")
    posed = np.isfinite(a).all(axis=(1, 2))
    for i in range(len(a)):
        lm = [dict(zip("xyz", p)) for p in a[i].tolist()] if "lm" in columns and posed[i] else None
        yield {"frame_idx": i, "lm": lm}


def _names(path: str) -> dict:
    folder, name = posixpath.split(path)
    return {"path": path, "identity": posixpath.basename(folder), "video_id": posixpath.splitext(name)[0]}


class Files(InputPartition):
    def __init__(self, paths: list[str]):
        self.paths = paths


class _Frames:
    """What batch and stream have in common: listing, packing and decoding."""

    def __init__(self, options, schema: StructType):
        self.root, self.schema = options["path"], schema
        self.suffix, self.decoder = options.get("suffix", ".npy").lower(), options.get("decoder", f"{__name__}:npy_frames")
        self.most = int(options.get("partition_bytes", 64 << 20))
        self.settle = float(options.get("settle_seconds", 2))
        self.identities = {x.strip() for x in options["identities"].split(",")} if "identities" in options else None
        self.videos = options.get("videos", "*")

    def _store(self):
        from pyarrow import fs

        if "://" not in self.root and not self.root.startswith("file:"):
            return fs.LocalFileSystem(), self.root
        return fs.FileSystem.from_uri(self.root)

    def _found(self) -> list:
        """Files of the suffix and of the wanted names, by path."""
        from pyarrow import fs

        store, root = self._store()
        files = store.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((f for f in files if f.is_file and f.path.lower().endswith(self.suffix) and self._fits(f.path)), key=lambda f: f.path)

    def _fits(self, path: str) -> bool:
        own = _names(path)
        return (self.identities is None or own["identity"] in self.identities) and fnmatchcase(own["video_id"], self.videos)

    def _packed(self, files: list) -> list[Files]:
        packs, size = [], 0
        for f in sorted(files, key=lambda f: (-f.size, f.path)):
            if not packs or size + f.size > self.most:
                packs.append([])
                size = 0
            packs[-1].append(f.path)
            size += f.size
        return [Files(p) for p in packs]

    def read(self, partition):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow, columns = to_arrow_schema(self.schema), self.schema.names
        module, _, name = self.decoder.partition(":")
        decode, store = getattr(import_module(module), name), self._store()[0]
        for path in partition.paths if partition else ():
            own = _names(path)
            try:
                with store.open_input_stream(path) as stream:
                    rows = list(decode(stream.read(), [c for c in columns if c not in OF_FILE and c != "error"]))
            except Exception as e:  # noqa: BLE001  one bad file does not stop the others
                rows = [{"error": f"{type(e).__name__}: {e}"[:500]}]
            for at in range(0, len(rows), 1000):
                yield pa.RecordBatch.from_pylist([{c: (own | r).get(c) for c in columns} for r in rows[at : at + 1000]], schema=arrow)


class FrameReader(_Frames, DataSourceReader):
    def partitions(self):
        return self._packed(self._found()) or [Files([])]


class FrameStream(_Frames, DataSourceStreamReader):
    """An offset is the time and path of the last file that has been given out; files count by time, of equal ones by path."""

    last: dict | None = None

    def initialOffset(self) -> dict:
        return {"mtime_ns": -1, "path": ""}

    def latestOffset(self) -> dict:
        import time

        old = time.time_ns() - int(self.settle * 1e9)
        ends = [(f.mtime_ns, f.path) for f in self._found() if f.mtime_ns <= old]
        if ends:
            t, path = max(ends)
            self.last = {"mtime_ns": t, "path": path}
        return self.last or self.initialOffset()

    def partitions(self, start: dict, end: dict):
        low, high = ((o["mtime_ns"], o["path"]) for o in (start, end))
        return self._packed([f for f in self._found() if low < (f.mtime_ns, f.path) <= high])


class FrameFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frame_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> FrameReader:
        return FrameReader(self.options, schema)

    def streamReader(self, schema: StructType) -> FrameStream:
        return FrameStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the format known to the session."""
    spark.dataSource.register(FrameFiles)
