"""A sink that puts rows into ZIP archives: spark.write.format("archives").

Rows have archive, name and content; `write_archives` deals them so that an archive's rows lie in one task, in the order of
their names. A task writes beside the place where archives belong; they are moved there when the whole write commits. A write that
fails, or whose executors are lost, leaves no archive and no part of one.
"""

from __future__ import annotations

import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Fixed value: every member is as old as the format allows, so equal rows give equal archives.
WHEN = (1980, 1, 1, 0, 0, 0)


def place(path: str) -> tuple[fs.FileSystem, str]:
    """Of a URI, or of a path that all executors share."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    """Archives of a task: where each lies and what it is called."""

    archives: list[tuple[str, str]]


class ArchiveWriter(DataSourceWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite = path.rstrip("/"), overwrite
        self.pending = f"{self.path}/_pending-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator) -> Written:
        system, root = place(self.pending)
        system.create_dir(root, recursive=True)
        done, names, current, archive, stream = [], set(), None, None, None
        try:
            for row in iterator:
                if row["archive"] is None or row["name"] is None:
                    continue
                if row["archive"] != current:
                    if archive:
                        archive.close()
                        stream.close()
                    current, names = row["archive"], set()
                    if any(current == a for _, a in done):
                        raise ValueError(f"the rows of archive {current} don't lie together")
                    part = f"{root}/{uuid.uuid4().hex}"
                    stream = system.open_output_stream(part)
                    archive = zipfile.ZipFile(stream, "w", zipfile.ZIP_STORED)
                    done.append((part, current))
                if row["name"] in names:
                    raise ValueError(f"archive {current} has two members {row['name']}")
                names.add(row["name"])
                archive.writestr(zipfile.ZipInfo(row["name"], WHEN), bytes(row["content"] or b""))
        except BaseException:
            # What is begun is of no use; the pending folder goes with the write.
            if stream:
                stream.close()
            raise
        if archive:
            archive.close()
            stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        system, root = place(self.path)
        system.create_dir(root, recursive=True)
        found = [x for m in messages if m is not None for x in m.archives]
        if len({name for _, name in found}) < len(found):
            self.abort(messages)
            raise ValueError("an archive's rows lay in more than one task")
        for part, name in found:
            target = f"{root}/{name}.zip"
            if system.get_file_info(target).type != fs.FileType.NotFound:
                if not self.overwrite:
                    self.abort(messages)
                    raise FileExistsError(target)
                system.delete_file(target)
            system.move(part, target)
        self.abort(messages)

    def abort(self, messages: list[Written | None]) -> None:
        system, root = place(self.pending)
        if system.get_file_info(root).type == fs.FileType.Directory:
            system.delete_dir(root)


class Archives(DataSource):
    @classmethod
    def name(cls) -> str:
        return "archives"

    def schema(self) -> str:
        return "archive string, name string, content binary"

    def writer(self, schema, overwrite: bool) -> ArchiveWriter:
        return ArchiveWriter(self.options["path"], overwrite)


def write_archives(rows: DataFrame, path: str, mode: str = "append") -> None:
    """An archive path/<archive>.zip of each value of archive, with a member for each of its rows (archive, name, content).

    Names of an archive must differ, else nothing is written; so must those of archives and files that are there, unless the mode is
    overwrite. A null content is an empty member; rows without archive or name are left out. An archive is
    written by one task, a member at a time; other archives by others.
    """
    rows.sparkSession.dataSource.register(Archives)
    dealt = rows.select("archive", "name", "content").repartition("archive").sortWithinPartitions("archive", "name")
    dealt.write.format("archives").option("path", path).mode(mode).save()


def members(spark: SparkSession, path: str) -> DataFrame:
    """archive, name, size and crc (of the content) of all members of the archives in a folder; each archive is read by one task."""
    import io

    import pandas as pd

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").load(path).select("path", "content")

    def work(frames):
        for frame in frames:
            rows = []
            for where, content in zip(frame["path"], frame["content"], strict=True):
                name = where.rsplit("/", 1)[-1].removesuffix(".zip")
                rows += [(name, m.filename, m.file_size, m.CRC) for m in zipfile.ZipFile(io.BytesIO(content)).infolist()]
            yield pd.DataFrame(rows, columns=["archive", "name", "size", "crc"])

    return files.mapInPandas(work, "archive string, name string, size long, crc long")
