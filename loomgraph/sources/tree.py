"""Source trees as a table. The engine's own data source: the built-in ones skip files that are empty or begin with _."""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import exprs as X

SNIFF = 8000
_CONTROL = bytes([*range(9), *range(14, 32), 127])


def looks_binary(head: bytes) -> bool:
    """A NUL, invalid UTF-8 (but for a cut at the end) or more than 30 control bytes in a hundred; empty is text."""
    if not head:
        return False
    if b"\0" in head:
        return True
    for cut in range(4):
        try:
            head[: len(head) - cut].decode("utf-8")
            break
        except UnicodeDecodeError:
            continue
    else:
        return True
    return len(head) - len(head.translate(None, _CONTROL)) > len(head) * 0.3


class _Files(InputPartition):
    def __init__(self, root: str, paths: list[str]):
        super().__init__(None)
        self.root, self.paths = root, paths


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.patterns = [p for p in options.get("exclude", "").split(",") if p]
        self.per_task = int(options.get("filesPerTask", "500"))

    def partitions(self) -> list[InputPartition]:
        """Names are listed here, excluded and hidden folders pruned with all below; contents are read by tasks."""
        compiled = [re.compile(rx) for p in self.patterns if (rx := X._glob(p)) is not None]
        out = lambda name: name.startswith(".") or any(rx.fullmatch(name) for rx in compiled)
        paths: list[str] = []
        for folder, below, names in os.walk(self.root):
            below[:] = sorted(d for d in below if not out(d) and not os.path.islink(os.path.join(folder, d)))
            paths += [os.path.relpath(os.path.join(folder, n), self.root) for n in sorted(names) if not out(n)]
        return [_Files(self.root, paths[k : k + self.per_task]) for k in range(0, len(paths), self.per_task)] or [_Files(self.root, [])]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        for path in partition.paths:
            full = os.path.join(partition.root, path)
            try:
                content = Path(full).read_bytes()
            except OSError as e:
                yield path.replace(os.sep, "/"), full, None, False, str(e)
                continue
            yield path.replace(os.sep, "/"), full, content, looks_binary(content[:SNIFF]), None


class TreeSource(DataSource):
    """spark.read.format("tree").option("exclude", "vendor,*.min.js").load(root)"""

    @classmethod
    def name(cls) -> str:
        return "tree"

    def schema(self) -> str:
        return "path string, abs_path string, content binary, is_binary boolean, error string"

    def reader(self, schema) -> DataSourceReader:
        return TreeReader(self.options)


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """All files below `root`, with binary and unreadable ones; see TreeSource."""
    spark.dataSource.register(TreeSource)
    return spark.read.format("tree").option("exclude", ",".join(exclude or [])).load(root)


def readable(scanned: DataFrame) -> DataFrame:
    """(path, abs_path, language, content, text) of the readable text files of scan()."""
    kept = scanned.where("not is_binary and error is null")
    return kept.select("path", "abs_path", X.language_of(F.col("path")).alias("language"), "content", F.decode("content", "UTF-8").alias("text"))


def unreadable(scanned: DataFrame) -> DataFrame:
    """(path, error) of the files of scan() that couldn't be read."""
    return scanned.where("error is not null").select("path", "error")


def read_tree(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, abs_path, language, content, text) of the readable text files below `root`."""
    return readable(scan(spark, root, exclude))


def line_counts(files: DataFrame) -> DataFrame:
    return files.select("path", X.line_count(F.col("text")).alias("n_lines"))
