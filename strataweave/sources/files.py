"""Small files of any Hadoop store: whole reads, atomic writes, moves."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


class Files:
    """File operations of the driver; data of any size goes through Spark instead."""

    def __init__(self, spark: SparkSession) -> None:
        self._jvm, self._conf, self._gateway = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._gateway

    def _at(self, path: str):
        at = self._jvm.org.apache.hadoop.fs.Path(path)
        return at, at.getFileSystem(self._conf)

    def exists(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.exists(at)

    def read(self, path: str, most: int = 64 << 20) -> bytes | None:
        """The bytes, or None where there is no file; a file beyond ``most`` bytes is an error."""
        at, fs = self._at(path)
        if not fs.exists(at):
            return None
        if fs.getFileStatus(at).getLen() > most:
            raise ValueError(f"{path} is larger than {most} bytes")
        stream = fs.open(at)
        try:
            return bytes(stream.readAllBytes())
        finally:
            stream.close()

    def write(self, path: str, data: bytes, new: bool = False) -> None:
        """Under another name first, then moved into place; ``new``: only if nothing is there (FileExistsError)."""
        at, fs = self._at(path)
        fs.mkdirs(at.getParent())
        staged, _ = self._at(f"{path.rpartition('/')[0]}/.staged-{uuid.uuid4().hex}")
        out = fs.create(staged)
        out.write(bytearray(data))
        out.close()
        try:
            self._rename(fs, staged, at, not new)
        except Exception as why:
            fs.delete(staged, False)
            if new and fs.exists(at):
                raise FileExistsError(path) from why
            raise

    def _rename(self, fs, source, target, overwrite: bool) -> None:
        kind = self._jvm.org.apache.hadoop.fs.Options.Rename
        options = self._gateway.new_array(kind, 1)
        options[0] = kind.OVERWRITE if overwrite else kind.NONE
        self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), self._conf).rename(source, target, options)

    def move(self, source: str, target: str) -> None:
        """A file or folder to a place where nothing is."""
        (a, fs), (b, _) = self._at(source), self._at(target)
        fs.mkdirs(b.getParent())
        self._rename(fs, a, b, False)

    def delete(self, path: str) -> bool:
        at, fs = self._at(path)
        return fs.delete(at, True)

    def names(self, path: str) -> list[str]:
        """What a folder holds, sorted; nothing for a folder that isn't there."""
        at, fs = self._at(path)
        return sorted(s.getPath().getName() for s in fs.listStatus(at)) if fs.exists(at) else []

    def make_folder(self, path: str) -> None:
        at, fs = self._at(path)
        fs.mkdirs(at)
