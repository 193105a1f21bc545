"""A sink of record files that writes all of a batch or nothing.

Tasks write their files under a folder of their own in `.staging/<batch>`, so attempts
never meet. Only when all tasks are done is a list of the folders that count put
beside them, whole, by a rename: from then on the batch stands. Files are then moved
to their places, and the staging folder goes last. A job that fails before the list
leaves the store as it was; one that is lost after it is finished by recover(), which
readers and the next write call, and which moves again whatever is still there.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

STAGING, LIST = ".staging", "commit.json"


def file_system(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (pafs.LocalFileSystem(), root)


def _put(fs: pafs.FileSystem, path: str, content: bytes) -> None:
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(path) as out:
        out.write(content)


def _below(fs: pafs.FileSystem, path: str) -> list[str]:
    return [x.path for x in fs.get_file_info(pafs.FileSelector(path, recursive=True, allow_not_found=True)) if x.type == pafs.FileType.File]


def recover(root: str) -> int:
    """Finish batches whose list is written; how many. Batches without one are left to their writer."""
    fs, top = file_system(root)
    done = 0
    for batch in fs.get_file_info(pafs.FileSelector(f"{top}/{STAGING}", allow_not_found=True)):
        if fs.get_file_info(f"{batch.path}/{LIST}").type == pafs.FileType.File:
            with fs.open_input_stream(f"{batch.path}/{LIST}") as f:
                folders = json.loads(f.read())
            for folder in folders:
                for path in _below(fs, f"{batch.path}/{folder}"):
                    to = f"{top}/{path.removeprefix(f'{batch.path}/{folder}/')}"
                    if to.endswith(REMOVED_NAME):
                        to = to.removesuffix(REMOVED_NAME)
                        if fs.get_file_info(to).type == pafs.FileType.File:
                            fs.delete_file(to)
                        fs.delete_file(path)
                    else:
                        fs.create_dir(to.rpartition("/")[0], recursive=True)
                        fs.move(path, to)
            fs.delete_dir(batch.path)
            done += 1
    return done


REMOVED_NAME = ".removed~"


@dataclass
class _Done(WriterCommitMessage):
    folder: str
    files: int


class _Writer(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.batch = root, uuid.uuid4().hex

    def write(self, rows: Iterator) -> _Done:
        fs, top = file_system(self.root)
        context = TaskContext.get()
        folder = f"{context.partitionId()}-{context.attemptNumber()}-{uuid.uuid4().hex[:8]}"
        n = 0
        for r in rows:
            parts = (r.file_path or "").split("/")
            if any(p in ("", ".", "..") for p in parts) or parts[0] == STAGING or parts[-1].endswith(REMOVED_NAME):
                raise ValueError(f"{r.file_path!r} is no place below the store")
            gone = r.content is None
            _put(fs, f"{top}/{STAGING}/{self.batch}/{folder}/{r.file_path}{REMOVED_NAME if gone else ''}", b"" if gone else r.content.encode())
            n += 1
        return _Done(folder, n)

    def commit(self, messages: list) -> None:
        fs, top = file_system(self.root)
        place = f"{top}/{STAGING}/{self.batch}"
        folders = [m.folder for m in messages if m is not None and m.files]
        if folders:
            _put(fs, f"{place}/{LIST}.tmp", json.dumps(folders).encode())
            fs.move(f"{place}/{LIST}.tmp", f"{place}/{LIST}")
            recover(self.root)
        else:
            self.abort(messages)

    def abort(self, messages: list) -> None:
        fs, top = file_system(self.root)
        if fs.get_file_info(f"{top}/{STAGING}/{self.batch}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{top}/{STAGING}/{self.batch}")


class RecordFiles(DataSource):
    """format("record_files"): rows of file_path, content; a null content removes the file."""

    @classmethod
    def name(cls) -> str:
        return "record_files"

    def schema(self) -> str:
        return "file_path string, content string"

    def writer(self, schema, overwrite: bool) -> _Writer:
        if overwrite:
            raise ValueError("records are written by mode append; what is not named stays")
        return _Writer(self.options["path"].rstrip("/"))


def write(texts: DataFrame, root: str) -> None:
    """All (file_path, content) below root, or none; a path may be there once."""
    spark: SparkSession = texts.sparkSession
    twice = texts.groupBy("file_path").count().filter("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"{twice[0].file_path} is written twice")
    recover(root)
    spark.dataSource.register(RecordFiles)
    texts.select("file_path", "content").write.format("record_files").mode("append").save(root)
