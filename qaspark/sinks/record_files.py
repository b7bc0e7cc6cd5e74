"""K6: one file a record, by a Python data source for Spark's writer.

    spark.dataSource.register(RecordFiles)
    df.write.format("record_files").option("path", folder).mode("overwrite").save()

A row has a file name and a text.  Each task writes its rows to files that are complete when they get their name, so that a task that is run again
writes the same files again.  The commit writes ``_SUCCESS`` with the number of files; a job that fails leaves none.

Tasks list what they write in short files of the folder ``<folder>.names`` beside it, whose names the commit writes to ``INDEX`` there.  Tasks read the
records back by these lists: the folder is not listed, and no record's name passes through the driver.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row, StructType

MARKER = "_SUCCESS"
INDEX = "INDEX"
#: Names of a list, and bytes that a reading task holds before it hands them on.
LISTED, HELD = 2_000, 16_000_000


def _store(path: str):
    """(file system, path in it) of a path or URI."""
    from pyarrow import fs
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("/") else (fs.LocalFileSystem(), path.removeprefix("file:"))


@dataclasses.dataclass
class Written(WriterCommitMessage):
    lists: list[str]
    files: int


class RecordFilesWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path = path
        files, root = _store(path)
        from pyarrow import fs
        there = files.get_file_info(root).type != fs.FileType.NotFound
        if there and overwrite:
            files.delete_dir_contents(root)
        elif there and files.get_file_info(f"{root}/{MARKER}").type != fs.FileType.NotFound:
            raise FileExistsError(f"{path} holds records")
        files.create_dir(root, recursive=True)
        files.create_dir(f"{root}.names", recursive=True)
        files.delete_dir_contents(f"{root}.names")

    def write(self, iterator: Iterator[Row]) -> Written:
        files, root = _store(self.path)
        lists, names, n = [], [], 0

        def listed() -> None:
            lists.append(uuid.uuid4().hex)
            with files.open_output_stream(f"{root}.names/{lists[-1]}") as out:
                out.write("\n".join(map(json.dumps, names)).encode("ascii"))
            names.clear()

        for name, text in iterator:
            if not name or "/" in name or name.startswith(("_", ".")):
                raise ValueError(f"not a file name: {name!r}")
            unfinished = f"{root}/_{uuid.uuid4().hex}"
            with files.open_output_stream(unfinished) as out:
                out.write((text or "").encode("utf-8"))
            files.move(unfinished, f"{root}/{name}")
            n += 1
            names.append(name)
            if len(names) == LISTED:
                listed()
        if names:
            listed()
        return Written(lists, n)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _store(self.path)
        with files.open_output_stream(f"{root}.names/{INDEX}") as out:
            out.write("\n".join(x for m in messages if m for x in m.lists).encode("ascii"))
        with files.open_output_stream(f"{root}/{MARKER}") as out:
            out.write(b"%d\n" % sum(m.files for m in messages if m))

    def abort(self, messages: list[Written | None]) -> None:
        """Files of tasks that ended stay, without the marker; the next run with overwrite removes them."""


class RecordFiles(DataSource):
    """Rows (name string, text string) as files of a folder that driver and executors share."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "name string, text string"

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceWriter:
        return RecordFilesWriter(self.options["path"], overwrite)


def write_record_files(df: DataFrame, path: str, name_col: str, text_col: str, overwrite: bool = True) -> None:
    """K6: the text of each row in the file that ``name_col`` names, in the folder ``path``; a null text is an empty file.

    Names must be plain and differ: two rows of one name are an error, found before anything is written.
    """
    rows = df.select(F.col(name_col).cast("string").alias("name"), F.col(text_col).cast("string").alias("text"))
    twice = rows.groupBy("name").count().where("count > 1").first()
    if twice:
        raise ValueError(f"{twice['count']} records are named {twice.name!r}")
    df.sparkSession.dataSource.register(RecordFiles)
    rows.write.format("record_files").option("path", path).mode("overwrite" if overwrite else "append").save()


def read_record_files(spark: SparkSession, path: str) -> DataFrame:
    """(name, text) of the files of a folder that was written whole."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MARKER}")
    if not hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
        raise FileNotFoundError(f"{path} holds no complete set of records")
    files, root = _store(path)
    with files.open_input_stream(f"{root}.names/{INDEX}") as index:
        lists = index.read().decode("ascii").split()

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = _store(path)

        def content(name: str) -> bytes:
            with files.open_input_stream(name) as source:
                return source.read()

        for b in batches:
            for one in b["list"]:
                rows, held = [], 0
                for name in map(json.loads, content(f"{root}.names/{one}").decode("ascii").split("\n")):
                    rows.append((name, content(f"{root}/{name}").decode("utf-8")))
                    held += len(rows[-1][1])
                    if held > HELD:
                        yield pd.DataFrame(rows, columns=["name", "text"])
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=["name", "text"])

    chunks = spark.createDataFrame([(x,) for x in lists], "list string").repartition(max(1, min(len(lists), 8 * spark.sparkContext.defaultParallelism)))
    return chunks.mapInPandas(texts, "name string, text string")

