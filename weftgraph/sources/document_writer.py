"""One valid document as the output of many tasks: a data source that tasks write parts of, and a commit that makes them one file.

Tasks write their rows as parts beside the target. When all have ended, the commit copies head, parts in the order of their partitions and foot
into a draft, block by block, and gives the draft its name at once. A job that fails deletes its parts, and the target is as it was. A document
is one file, so its bytes pass through the process that commits, BLOCK at a time; exports too large for that stay part files.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

#: Bytes that are copied at a time.
BLOCK = 8 << 20


def _place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")


@dataclass
class Part(WriterCommitMessage):
    partition: int
    file: str
    rows: int


class DocumentWriter(DataSourceArrowWriter):
    """Writes the column ``value`` of each row, with ``between`` after each."""

    def __init__(self, target: str, head: str, foot: str, between: str) -> None:
        self.target, self.head, self.foot, self.between = target, head, foot, between
        self.folder = f"{target}.parts-{uuid.uuid4().hex[:12]}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        task = TaskContext.get()
        name, n = f"{self.folder}/{task.partitionId():08d}-{task.taskAttemptId()}", 0
        fs, path = _place(name)
        fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(path) as out:
            for batch in iterator:
                values = batch.column(batch.schema.get_field_index("value")).to_pylist()
                out.write("".join(f"{v or ''}{self.between}" for v in values).encode())
                n += len(values)
        return Part(task.partitionId(), name, n)

    def commit(self, messages: list[Part | None]) -> None:
        fs, target = _place(self.target)
        draft = f"{target}.draft-{uuid.uuid4().hex[:12]}"
        fs.create_dir(target.rsplit("/", 1)[0], recursive=True)
        with fs.open_output_stream(draft) as out:
            out.write(self.head.encode())
            for part in sorted((m for m in messages if m and m.rows), key=lambda m: m.partition):
                with fs.open_input_stream(_place(part.file)[1]) as source:
                    while block := source.read(BLOCK):
                        out.write(block)
            out.write(self.foot.encode())
        if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(target).type != pafs.FileType.NotFound:
            fs.delete_file(target)
        fs.move(draft, target)
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, folder = _place(self.folder)
        if fs.get_file_info(folder).type != pafs.FileType.NotFound:
            fs.delete_dir(folder)


class DocumentSource(DataSource):
    """``format("weft_document")`` with options head, foot and between (a line feed by default); rows of one column ``value``."""

    @classmethod
    def name(cls) -> str:
        return "weft_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        if "value" not in schema.names:
            raise ValueError("a document is written from a column named value")
        get = self.options.get
        return DocumentWriter(get("path"), get("head", ""), get("foot", ""), get("between", "\n"))


def write_document(rows: DataFrame, path: str, head: str, foot: str, order: list[str], between: str = "\n") -> None:
    """Write ``rows`` (value, and the columns of ``order``) as one file at ``path``: head, values in order, foot."""
    spark = rows.sparkSession
    spark.dataSource.register(DocumentSource)
    spread = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("value")
    writer = spread.write.format("weft_document").mode("overwrite").option("head", head).option("foot", foot).option("between", between)
    writer.save(path)
