"""A sink of documents, a file each, that publishes all of a write or nothing.

Tasks stage their documents beside the target; the commit moves them into place, each by one rename, so a document that was
there is whole until the new one is. A write that fails or is killed before its commit changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyarrow import fs as pafs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

#: Renames at a time in a commit.
MOVES = 32
_STAGED = "_staged-"


def _at(path: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    if "://" in path:
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path.removeprefix("file:")


@dataclass
class _Staged(WriterCommitMessage):
    folder: str
    files: int


class _DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict[str, str]):
        self.path, self.name, self.document = options["path"].rstrip("/"), options.get("name", "rec_id"), options.get("document", "document")
        self.suffix = options.get("suffix", ".json")
        self.job = f"{self.path}/{_STAGED}{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> _Staged:
        fs, _ = _at(self.path)
        folder = _at(f"{self.job}/{uuid.uuid4().hex}")[1]  # each attempt of a task has its own
        fs.create_dir(folder, recursive=True)
        n = 0
        for row in iterator:
            name = str(row[self.name])
            if row[self.name] is None or row[self.document] is None or not name or "/" in name or name[0] in "._":
                raise ValueError(f"no document can be named {row[self.name]!r}, or it has no content")
            at = f"{folder}/{name}{self.suffix}"
            if fs.get_file_info(at).type != pafs.FileType.NotFound:
                raise ValueError(f"two documents are named {name}")
            with fs.open_output_stream(at) as out:
                out.write(row[self.document].encode())
            n += 1
        return _Staged(folder, n)

    def commit(self, messages: list[_Staged | None]) -> None:
        fs, target = _at(self.path)
        files = [f for m in messages if m for f in fs.get_file_info(pafs.FileSelector(m.folder))]
        names = [f.base_name for f in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"two documents are named {next(x for x in names if names.count(x) > 1)}")
        with ThreadPoolExecutor(MOVES) as pool:
            list(pool.map(lambda f: fs.move(f.path, f"{target}/{f.base_name}"), files))
        fs.delete_dir(_at(self.job)[1])

    def abort(self, messages: list[_Staged | None]) -> None:
        fs, _ = _at(self.path)
        job = _at(self.job)[1]
        if fs.get_file_info(job).type == pafs.FileType.Directory:
            fs.delete_dir(job)


class DocumentSink(DataSource):
    """Options path, name (the column that names a document, rec_id unless said), document (its content) and suffix."""

    @classmethod
    def name(cls) -> str:
        return "timeline_documents"

    def writer(self, schema, overwrite: bool) -> _DocumentWriter:
        return _DocumentWriter(dict(self.options))


def write_documents(documents: DataFrame, path: str, name: str = "rec_id", document: str = "document", suffix: str = ".json") -> None:
    """Publishes (name, document) as files of `path`; documents that are not named stay as they are. Names are one a document:
    two of one name, a null and what would leave the folder are errors, and then nothing is published."""
    documents.sparkSession.dataSource.register(DocumentSink)
    documents.select(name, document).write.format(DocumentSink.name()).mode("append").option("name", name).option("document", document).option("suffix", suffix).save(path)


def write_documents_twice(base: DataFrame, add, path: str, name: str = "rec_id", document: str = "document") -> None:
    """The documents as they are, and in a second commit what `add` makes of them: if it fails, the first ones stand."""
    write_documents(base, path, name, document)
    write_documents(add(base), path, name, document)


def clear_staged(spark: SparkSession, path: str) -> int:
    """Removes what writes that were killed have staged, and says how many there were. Call it when no write is running."""
    fs, target = _at(path)
    if fs.get_file_info(target).type != pafs.FileType.Directory:
        return 0
    left = [f.path for f in fs.get_file_info(pafs.FileSelector(target)) if f.base_name.startswith(_STAGED)]
    for f in left:
        fs.delete_dir(f)
    return len(left)
