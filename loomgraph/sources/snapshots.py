"""A data source of feed snapshots, for batches and streams, and a sink and source of one file per article.

``spark.dataSource.register`` both, then ``spark.read.format("feed_snapshots").load(folder)``,
``spark.readStream.format("feed_snapshots").load(folder)`` and ``df.write.format("article_files")``, which reads as well.
Folders may be addresses of any store that Arrow's file systems reach.
"""

from __future__ import annotations

import re
import uuid
from collections import Counter
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from xml.etree import ElementTree
from zlib import crc32

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, DataSourceWriter, InputPartition, WriterCommitMessage

from loomgraph.sources import export
from loomgraph.sources.feeds import FIELDS, feed_rows

ITEMS = f"source_id string, file string, place int, {', '.join(f'{f} string' for f in FIELDS)}, error string"
ARTICLES = "day string, folder string, file string, markdown string"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:/") else (fs.LocalFileSystem(), path)


def names(path: str) -> list[str]:
    store, root = opened(path)
    return sorted(i.base_name for i in store.get_file_info(fs.FileSelector(root)) if i.type == fs.FileType.File and not i.base_name.startswith(("_", ".")))


@dataclass
class Files(InputPartition):
    files: tuple[str, ...]


def rows_of(path: str, files: tuple[str, ...]) -> Iterator[tuple]:
    """Items of snapshots named <anything>--<source id>.<kind>; a body that can't be read is a row with its error."""
    store, root = opened(path)
    for name in files:
        source = re.sub(r"^.*--|\.[^.]*$", "", name)
        try:
            with store.open_input_stream(f"{root.rstrip('/')}/{name}") as f:
                body = f.read().decode()
            for i, r in enumerate(feed_rows(body)):
                yield (source, name, i, *[None if (v := r.get(x)) is None else str(v) for x in FIELDS], None)
        except (ElementTree.ParseError, ValueError, AttributeError) as e:
            yield (source, name, 0, *[None] * len(FIELDS), f"{type(e).__name__}: {e}")


class SnapshotReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("filesPerTask", 64))

    def partitions(self) -> list[Files]:
        every = names(self.path)
        return [Files(tuple(every[i:i + self.size])) for i in range(0, len(every), self.size)] or [Files(())]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.files)


class SnapshotStream(DataSourceStreamReader):
    """An offset is the last name read: snapshots are named in the order of their coming."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("filesPerTask", 64))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"after": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        every = names(self.path)
        return {"after": every[-1] if every else ""}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        new = [n for n in names(self.path) if start["after"] < n <= end["after"]]
        return [Files(tuple(new[i:i + self.size])) for i in range(0, len(new), self.size)]

    def read(self, partition: Files) -> Iterator[tuple]:
        return rows_of(self.path, partition.files)


class FeedSnapshots(DataSource):
    @classmethod
    def name(cls) -> str:
        return "feed_snapshots"

    def schema(self) -> str:
        return ITEMS

    def reader(self, schema) -> SnapshotReader:
        return SnapshotReader(self.options)

    def streamReader(self, schema) -> SnapshotStream:  # noqa: N802
        return SnapshotStream(self.options)


@dataclass
class Written(WriterCommitMessage):
    folders: tuple[str, ...]


class ArticleWriter(DataSourceWriter):
    """Tasks write below a hidden folder of the job; the commit moves whole folders, an abort deletes it (a task
    that is ended late may leave files there, where nothing reads them).

    Articles of one name are numbered in the order of their rows, so rows of one (day, folder, file) must
    come to one task (:func:`write_articles` sees to that).
    """

    def __init__(self, options: dict) -> None:
        self.path, self.job = options["path"].rstrip("/"), f"_job-{uuid.uuid4().hex}"

    def write(self, iterator) -> Written:
        store, root = opened(self.path)
        seen, folders = Counter(), set()
        for row in iterator:
            folder = f"{row['day']}/{row['folder']}"
            if folder not in folders:
                store.create_dir(f"{root}/{self.job}/{folder}", recursive=True)
                folders.add(folder)
            seen[folder, row["file"]] += 1
            number = seen[folder, row["file"]]
            name = row["file"] if number == 1 else f"{row['file'].removesuffix('.md')}-{number}.md"
            with store.open_output_stream(f"{root}/{self.job}/{folder}/{name}") as f:
                f.write((row["markdown"] or "").encode())
        return Written(tuple(sorted(folders)))

    def commit(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        days = sorted({f.split("/", 1)[0] for m in messages if m for f in m.folders})
        store.create_dir(root, recursive=True)
        with ThreadPoolExecutor(16) as pool:  # a day that isn't there yet is one move
            list(pool.map(lambda d: moved(store, f"{root}/{self.job}/{d}", f"{root}/{d}"), days))
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        store, root = opened(self.path)
        if store.get_file_info(f"{root}/{self.job}").type != fs.FileType.NotFound:
            store.delete_dir(f"{root}/{self.job}")


def moved(store: fs.FileSystem, old: str, new: str) -> None:
    """Moves a folder, or what it holds if there is one of that name; files of the same name are replaced."""
    if store.get_file_info(new).type != fs.FileType.Directory:
        store.move(old, new)
        return
    for f in store.get_file_info(fs.FileSelector(old)):
        moved(store, f.path, f"{new}/{f.base_name}")


@dataclass
class Days(InputPartition):
    """Part ``part`` of ``of`` of the files of some days."""

    days: tuple[str, ...]
    part: int = 0
    of: int = 1


class ArticleReader(DataSourceReader):
    """Tasks list and read the files of some days each; a day without date may hold any number, so many tasks share it."""

    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("daysPerTask", 64))

    def partitions(self) -> list[Days]:
        store, root = opened(self.path)
        found = store.get_file_info(fs.FileSelector(root, allow_not_found=True))
        days = sorted(i.base_name for i in found if i.type == fs.FileType.Directory and not i.base_name.startswith(("_", ".")))
        dated = [d for d in days if d != "undated"]
        return [Days(tuple(dated[i:i + self.size])) for i in range(0, len(dated), self.size)] + [Days(("undated",), i, 64) for i in range(64) if "undated" in days] or [Days(())]

    def read(self, partition: Days) -> Iterator[tuple]:
        store, root = opened(self.path)
        for day in partition.days:
            for folder in store.get_file_info(fs.FileSelector(f"{root.rstrip('/')}/{day}")):
                for f in store.get_file_info(fs.FileSelector(folder.path)):
                    if crc32(f"{folder.base_name}/{f.base_name}".encode()) % partition.of == partition.part:
                        with store.open_input_stream(f.path) as stream:
                            yield (day, folder.base_name, f.base_name, stream.read().decode())


class ArticleFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "article_files"

    def schema(self) -> str:
        return ARTICLES

    def reader(self, schema) -> ArticleReader:
        return ArticleReader(self.options)

    def writer(self, schema, overwrite: bool) -> ArticleWriter:
        return ArticleWriter(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FeedSnapshots)
    spark.dataSource.register(ArticleFiles)


def write_articles(items: DataFrame, path: str) -> None:
    """One Markdown file per article under ``path``/<day>/<source>/<title>.md; "undated" without a date."""
    spark = items.sparkSession
    spark.dataSource.register(ArticleFiles)
    day = F.coalesce(F.date_format("pub_date", "yyyy-MM-dd"), F.lit("undated")).alias("day")
    rows = export.articles(items).join(items.select("id", day), "id").select("id", "day", "folder", "file", "markdown")
    # a day's folders are made by one task; what has no date is dealt by file
    undated = F.when(F.col("day") == "undated", F.struct("folder", "file"))
    ordered = rows.repartition(F.col("day"), undated).sortWithinPartitions("day", "folder", "file", "id")
    ordered.select("day", "folder", "file", "markdown").write.format("article_files").mode("append").save(path)


