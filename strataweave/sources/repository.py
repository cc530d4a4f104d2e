"""A data source of version-control repositories: refs and objects of local clones.

``spark.read.format("repository").option("path", ...).option("table", "objects" or "refs")``;
the clone must be readable at that path by every executor.  Objects are dealt to
partitions by the first hex digit of their id.
"""

from __future__ import annotations

import subprocess
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from strataweave.functions.identity import KINDS

SCHEMAS = {"objects": "oid binary, kind int, data binary", "refs": "name string, kind string, target binary"}


def _git(path: str, *words: str, stdin: bytes | None = None) -> bytes:
    return subprocess.run(["git", "-c", "safe.directory=*", "-C", path, *words], input=stdin, capture_output=True, check=True).stdout


class RepositorySource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "repository"

    def schema(self) -> str:
        return SCHEMAS[self.options.get("table", "objects")]

    def reader(self, schema) -> DataSourceReader:
        return RepositoryReader(self.options["path"], self.options.get("table", "objects"))


class RepositoryReader(DataSourceReader):
    def __init__(self, path: str, table: str) -> None:
        self.path, self.table = path, table

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(c) for c in ("0123456789abcdef" if self.table == "objects" else "*")]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        yield from self._refs() if self.table == "refs" else self._objects(partition.value)

    def _refs(self) -> Iterator[tuple]:
        """Heads and tags only, by name; a tag is not peeled."""
        out = _git(self.path, "for-each-ref", "--sort=refname", "--format=%(refname)%00%(objecttype)%00%(objectname)", "refs/heads", "refs/tags")
        for line in out.splitlines():
            name, kind, target = line.split(b"\0")
            yield name.decode("utf-8", "surrogateescape"), kind.decode(), bytes.fromhex(target.decode())

    def _objects(self, digit: str) -> Iterator[tuple]:
        listed = _git(self.path, "cat-file", "--batch-all-objects", "--batch-check=%(objectname)").split()
        mine = [x for x in listed if x.decode().startswith(digit)]
        if not mine:
            return
        p = subprocess.Popen(["git", "-c", "safe.directory=*", "-C", self.path, "cat-file", "--batch"], stdin=subprocess.PIPE, stdout=subprocess.PIPE)
        for oid in mine:
            p.stdin.write(oid + b"\n")
            p.stdin.flush()
            _, kind, size = p.stdout.readline().split()
            data = p.stdout.read(int(size))
            p.stdout.read(1)
            yield bytes.fromhex(oid.decode()), KINDS[kind.decode()], data
        p.stdin.close()
        p.wait()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RepositorySource)
