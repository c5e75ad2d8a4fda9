"""A data source over a tree of files, hidden ones included: format "file_tree".

    register(spark)
    spark.read.format("file_tree").load("/path/to/tree")

Rows are (path, size, mtime, is_symlink, repository, content): path is relative to
the root, repository says whether the folder that holds the file is a checkout of
its own below the root (so that its files can be told apart), content is null with
option content=false, for files over max_bytes (2,000,000), and for keys and
certificates, which are never opened. Options: content, max_bytes, suffixes
(comma-separated; other files are listed without content), files_per_task.

The driver only lists names; files are read by the tasks. The tree has to be
mounted on all executors; for object stores use the binaryFile source, which
leaves hidden files out.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .peek import never_opened

MAX_BYTES, FILES_PER_TASK = 2_000_000, 500
SCHEMA = "path string, size long, mtime timestamp, is_symlink boolean, repository string, content binary"
# Folders that never hold source.
SKIPPED = (
    ".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "env", "dist", "build", "target", "out", ".next", ".nuxt", "vendor", ".terraform",
    ".pytest_cache", ".mypy_cache", ".ruff_cache", "coverage", ".idea", ".vscode", "site-packages", ".gradle", ".cache", "tmp", "logs",
)


class Chunk(InputPartition):
    def __init__(self, files: list[tuple[str, str | None]]):
        self.files = files


class TreeReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.root = options["path"]
        self.content = options.get("content", "true").lower() == "true"
        self.max_bytes = int(options.get("max_bytes", MAX_BYTES))
        self.suffixes = tuple(filter(None, options.get("suffixes", "").lower().split(",")))
        self.per_task = int(options.get("files_per_task", FILES_PER_TASK))

    def listed(self) -> Iterator[tuple[str, str | None]]:
        """(path, repository) of every file in order; the repository is the innermost checkout below the root."""

        def walk(folder: str, owner: str | None) -> Iterator[tuple[str, str | None]]:
            try:
                entries = sorted(os.scandir(os.path.join(self.root, folder)), key=lambda e: e.name)
            except OSError:
                return
            if folder and any(e.name == ".git" for e in entries) and not set(folder.split("/")) & set(SKIPPED):
                owner = folder
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    yield from walk(path, owner)
                elif e.is_file():
                    yield path, owner

        yield from walk("", None)

    def partitions(self) -> list[Chunk]:
        files = list(self.listed())
        return [Chunk(files[i : i + self.per_task]) for i in range(0, len(files), self.per_task)] or [Chunk([])]

    def read(self, partition: Chunk) -> Iterator[tuple]:
        from datetime import datetime

        for path, owner in partition.files:
            full = os.path.join(self.root, path)
            try:
                info = os.stat(full)
                wanted = self.content and info.st_size <= self.max_bytes and not never_opened(path.rpartition("/")[2])
                wanted = wanted and (not self.suffixes or path.lower().endswith(self.suffixes))
                content = None
                if wanted:
                    with open(full, "rb") as f:
                        content = f.read()
            except OSError:
                continue  # it went meanwhile, or may not be read
            yield path, info.st_size, datetime.fromtimestamp(info.st_mtime), os.path.islink(full), owner, content


class FileTree(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(dict(self.options))


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FileTree)


def read_tree(spark: SparkSession, root: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("file_tree").options(**options).load(root)
