"""Readers that test paths before they open anything: run directories and checkouts as Python data sources.

Filters on the parts of a path are pushed down, and applied folder by folder while the tree is listed: a label,
replicate, repository or revision that is not wanted is never descended into, a skipped folder neither,
and no content of theirs is opened. What is left is dealt to tasks by number and size of files.

Any store that Arrow has a file system for can be read (local and shared folders, HDFS, S3, GCS); for others
``reachable`` says no, and the readers of ``runs`` and ``files`` fall back on Spark's own formats.
"""

from __future__ import annotations

import os
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from urllib.parse import unquote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualNullSafe, EqualTo, Filter, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual, Not

PUSHDOWN = "spark.sql.python.filterPushdown.enabled"
FILES_OF_TASK, BYTES_OF_TASK = 500, 64 << 20
RUN_PARTS = ("repo", "sha", "label", "rep")
CHECKOUT_PARTS = ("repo", "sha")


def _open_store(root: str) -> tuple[fs.FileSystem, str]:
    if "://" in root or root.startswith("file:"):
        return fs.FileSystem.from_uri(root)
    return fs.LocalFileSystem(), os.path.abspath(root)


def reachable(root: str) -> bool:
    """Whether Arrow can list ``root``; a folder that does not exist can be listed, it is empty."""
    try:
        store, path = _open_store(root)
        store.get_file_info(path)
    except (OSError, ValueError, NotImplementedError):
        return False
    return True


def holds(test: Filter, values: dict[str, object]) -> bool:
    """A pushed filter on a row's known values."""
    if isinstance(test, Not):
        return not holds(test.child, values)
    value = values[test.attribute[0]]
    if isinstance(test, (EqualTo, EqualNullSafe)):
        return value == test.value
    if isinstance(test, In):
        return value in test.value
    if isinstance(test, IsNotNull):
        return value is not None
    return value <= test.value if isinstance(test, LessThanOrEqual) else value < test.value


def understood(test: Filter, columns: Iterable[str]) -> bool:
    """Whether ``holds`` can decide a filter from ``columns`` alone."""
    if isinstance(test, Not):
        return not isinstance(test.child, Not) and understood(test.child, columns)
    if isinstance(test, In) and None in test.value or getattr(test, "value", 0) is None:
        return False  # comparisons with null are left to Spark
    sizes = isinstance(test, (LessThan, LessThanOrEqual)) and test.attribute == ("length",)
    return (sizes or isinstance(test, (EqualTo, EqualNullSafe, In, IsNotNull))) and len(test.attribute) == 1 and test.attribute[0] in columns


def column_of(test: Filter) -> str:
    return column_of(test.child) if isinstance(test, Not) else test.attribute[0]


@dataclass
class Files(InputPartition):
    """Files of one task: path, size and the values known from the path."""

    found: tuple[tuple[str, int, tuple[str, ...]], ...]


class _TreeReader(DataSourceReader):
    """Lists ``<root>/<part>/<part>/...`` level by level, dropping what the pushed filters reject."""

    parts: tuple[str, ...] = ()
    columns: tuple[str, ...] = ()

    def __init__(self, options: dict[str, str]):
        self.root, self.options, self.tests = options["path"], options, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802
        for test in filters:
            if understood(test, self.columns):
                self.tests.append(test)
            else:
                yield test

    def kept(self, values: dict[str, object], only: str | None = None) -> bool:
        """Tests on the columns known so far; ``only`` those on one column."""
        return all(holds(t, values) for t in self.tests if column_of(t) in values and only in (None, column_of(t)))

    def folders(self, store: fs.FileSystem, path: str) -> Iterator[fs.FileInfo]:
        return iter(sorted((i for i in store.get_file_info(fs.FileSelector(path, allow_not_found=True)) if not i.base_name.startswith(".") or i.is_file), key=lambda i: i.base_name))

    def heads(self, store: fs.FileSystem, path: str, known: tuple[str, ...] = ()) -> Iterator[tuple[str, tuple[str, ...]]]:
        """Folders of all parts that no filter rejects."""
        if len(known) == len(self.parts):
            yield path, known
            return
        name = self.parts[len(known)]
        for info in self.folders(store, path):
            value = unquote(info.base_name)
            if info.type == fs.FileType.Directory and self.kept({name: value}, name):
                yield from self.heads(store, info.path, (*known, value))

    def files(self, store: fs.FileSystem, path: str, known: tuple[str, ...]) -> Iterator[tuple[str, int, tuple[str, ...]]]:
        raise NotImplementedError

    def partitions(self) -> Sequence[InputPartition]:
        store, path = _open_store(self.root)
        out, held, size = [], [], 0
        for head, known in self.heads(store, path):
            for found in self.files(store, head, known):
                held.append(found)
                size += found[1]
                if len(held) >= FILES_OF_TASK or size >= BYTES_OF_TASK:
                    out.append(Files(tuple(held)))
                    held, size = [], 0
        if held or not out:
            out.append(Files(tuple(held)))
        return out

    def content(self, store: fs.FileSystem, path: str) -> str:
        with store.open_input_file(path) as opened:
            return bytes(opened.read()).decode("utf-8", "replace")


class RunReader(_TreeReader):
    parts, columns = RUN_PARTS, RUN_PARTS

    def files(self, store, path, known):
        info = store.get_file_info(f"{path}/{self.options['file']}")
        if info.is_file:
            yield info.path, info.size, known

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _open_store(self.root)
        for path, _, known in partition.found:
            yield (*known, self.content(store, path))


class CheckoutReader(_TreeReader):
    parts, columns = CHECKOUT_PARTS, (*CHECKOUT_PARTS, "path", "length")

    def __init__(self, options: dict[str, str]):
        super().__init__(options)
        self.suffixes = tuple(options["suffixes"].split(","))
        self.skipped = frozenset(options.get("skipped", "").split(",")) - {""}

    def files(self, store, path, known):
        folders = [(path, "")]
        while folders:
            folder, below = folders.pop()
            for info in store.get_file_info(fs.FileSelector(folder)):
                inside = f"{below}{info.base_name}"
                if info.type == fs.FileType.Directory:
                    if info.base_name not in self.skipped:
                        folders.append((info.path, inside + "/"))
                elif info.is_file and info.base_name.endswith(self.suffixes) and self.kept({"path": inside, "length": info.size}):
                    yield info.path, info.size, (*known, inside)

    def read(self, partition: Files) -> Iterator[tuple]:
        store, _ = _open_store(self.root)
        for path, size, (repo, sha, inside) in partition.found:
            yield repo, sha, inside, size, self.content(store, path)


class RunSource(DataSource):
    """One kind of file of run directories ``<root>/<repo>/<sha>/<label>/<rep>/<file>``."""

    @classmethod
    def name(cls) -> str:
        return "partlens_runs"

    def schema(self) -> str:
        return ", ".join(f"{k} string" for k in RUN_PARTS) + ", value string"

    def reader(self, schema) -> DataSourceReader:
        return RunReader(dict(self.options))


class CheckoutSource(DataSource):
    """Files of checkouts ``<root>/<repo>/<sha>/<path>``."""

    @classmethod
    def name(cls) -> str:
        return "partlens_checkouts"

    def schema(self) -> str:
        return "repo string, sha string, path string, length long, text string"

    def reader(self, schema) -> DataSourceReader:
        return CheckoutReader(dict(self.options))


def _registered(spark: SparkSession) -> SparkSession:
    spark.conf.set(PUSHDOWN, "true")
    for source in (RunSource, CheckoutSource):
        spark.dataSource.register(source)
    return spark


def run_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """repo, sha, label, rep, value of every file ``name``; filters on the key choose what is opened."""
    return _registered(spark).read.format("partlens_runs").option("file", name).load(root)


def checkout_files(spark: SparkSession, root: str, suffixes: Sequence[str], skipped: Sequence[str] = ()) -> DataFrame:
    """repo, sha, path, length, text of the files with a suffix outside the skipped folders; filters on all but the text choose what is opened."""
    read = _registered(spark).read.format("partlens_checkouts").option("suffixes", ",".join(suffixes)).option("skipped", ",".join(skipped))
    return read.load(root)
