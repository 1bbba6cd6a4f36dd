"""Media columns: payloads as PNG images in tar shards, addressed by content, described by header reads.

A text's bytes, filled up with spaces to rows of 192, are the samples of an 8-bit grey image. Each task writes the
images of the distinct payloads it meets into one tar shard in the shared folder, and its rows carry digest, shard,
offset and length. One stored copy of each digest is chosen for the whole table; the copies that other tasks may have
written of it stay unreferenced. A second job opens each shard once: a range read of the image header fills the
metadata columns, and a read of the image gives back the samples for checksums and features.
"""

from __future__ import annotations

import hashlib
import re
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import result_path, stage

#: Samples in an image row; bytes of a PNG up to the end of its header chunk.
WIDTH, HEADER_BYTES = 192, 33

_MAGIC = b"\x89PNG\r\n\x1a\n"


def pad(raw: bytes) -> bytes:
    """The bytes with spaces appended up to a positive multiple of the row width."""
    return raw + b" " * (-len(raw) % WIDTH if raw else WIDTH)


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes, level: int = 6) -> bytes:
    """An 8-bit grey image whose samples are the payload, row by row, without filters."""
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    header = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return _MAGIC + _chunk(b"IHDR", header) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), level)) + _chunk(b"IEND", b"")


def read_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bits and colour type from the first bytes of an image."""
    if head[:8] != _MAGIC or head[12:16] != b"IHDR":
        raise ValueError("not a PNG header")
    return struct.unpack(">IIBB", head[16:26])


def from_png(image: bytes) -> bytes:
    """The samples of an image that ``to_png`` made."""
    width, height, _bits, _colour = read_header(image)
    at, body = 8, []
    while at < len(image):
        (n,) = struct.unpack(">I", image[at : at + 4])
        if image[at + 4 : at + 8] == b"IDAT":
            body.append(image[at + 8 : at + 8 + n])
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    return rows[:, 1:].tobytes()


def feature(samples: bytes, height: int) -> str:
    """Size, mean, spread and the shares of the sixteen levels of a payload's samples, as text."""
    x = np.frombuffer(samples, np.uint8)
    levels = np.bincount(x >> 4, minlength=16) * 1000 // len(x)
    return f"grey8 {WIDTH}x{height} mean={x.mean():.4f} std={x.std():.4f} levels={','.join(map(str, levels))}"


def _open(uri: str, write: bool):
    """A file of the shared store, by whatever scheme it has."""
    fs, path = pafs.FileSystem.from_uri(uri if re.match(r"\w+:", uri) else f"file://{uri}")
    if not write:
        return fs.open_input_file(path)
    fs.create_dir(path.rsplit("/", 1)[0], recursive=True)
    return fs.open_output_stream(path)


def _put(draft: str, final: str) -> None:
    """A whole file gets its name; one that another run of the same task has put there is replaced by its like."""
    fs, path = pafs.FileSystem.from_uri(final if re.match(r"\w+:", final) else f"file://{final}")
    draft = pafs.FileSystem.from_uri(draft if re.match(r"\w+:", draft) else f"file://{draft}")[1]
    if not isinstance(fs, pafs.LocalFileSystem) and fs.get_file_info(path).type != pafs.FileType.NotFound:
        fs.delete_file(path)
    fs.move(draft, path)


def store_payloads(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the tar shards below ``folder`` and return doc_id, n_bytes, digest, shard (its name there), offset, length for every row.

    A shard is named by its task. A task writes a draft and gives it the name when it is whole; one that runs again reads the same
    rows, and so puts an equal shard in its place. A failed run's draft stays in the folder with nothing that refers to it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, where, out = 0, {}, None
        task = TaskContext.get()
        shard = f"shard-{task.partitionId():06d}.tar"
        draft = f"{folder}/draft-{task.partitionId():06d}-{task.taskAttemptId()}"
        try:
            for b in batches:
                rows = []
                for text in b.column(1).to_pylist():
                    raw = (text or "").encode()
                    payload = pad(raw)
                    digest = hashlib.sha256(payload).digest()
                    if digest not in where:
                        out = out or _open(draft, True)
                        image = to_png(payload)
                        entry = tarfile.TarInfo(f"{digest.hex()}.png")
                        entry.size = len(image)
                        out.write(entry.tobuf(tarfile.USTAR_FORMAT))
                        out.write(image + b"\0" * (-len(image) % 512))
                        where[digest] = (at + 512, len(image))
                        at += 512 + len(image) + -len(image) % 512
                    rows.append((len(raw), digest, shard, *where[digest]))
                cols = list(zip(*rows, strict=True)) or [()] * 5
                kinds = (pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds, strict=True))],
                    names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                )
            if out:
                out.write(b"\0" * 1024)
                out.close()
                _put(draft, f"{folder}/{shard}")
                out = None
        finally:
            if out:
                out.close()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long")


def _describe(folder: str):
    return lambda batches: _described(folder, batches)


def _described(folder: str, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    opened, name = None, None
    for b in batches:
        rows = []
        for digest, shard, offset, length in zip(*(b.column(k).to_pylist() for k in range(4)), strict=True):
            if shard != name:
                if opened:
                    opened.close()
                opened, name = _open(f"{folder}/{shard}", False), shard
            opened.seek(offset)
            width, height, bits, _colour = read_header(opened.read(HEADER_BYTES))
            opened.seek(offset)
            image = opened.read(length)
            samples = from_png(image)
            rows.append(
                (
                    digest, width, height, bits, width * height * bits // 8, hashlib.sha256(samples).hexdigest(), zlib.crc32(samples[-16:]), length,
                    hashlib.sha256(image).hexdigest(), feature(samples, height),
                ),
            )
        cols = list(zip(*rows, strict=True)) or [()] * 10
        kinds = (pa.binary(), *[pa.int32()] * 3, pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
            names=["digest", "width", "height", "bits", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
        )
    if opened:
        opened.close()


def media_columns(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None) -> DataFrame:
    """Store every payload and describe it: one row for each row of ``docs``.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature, then width,
    height, bits (read from headers alone), folder, and shard (its name there), offset and length of the stored image. ``folder`` is where the
    shards go (by default a new one in the shared folder, which ``drop_staged`` leaves alone); a folder that holds shards already raises FileExistsError. Nulls: a null text is an empty one, whose payload
    is one row of spaces; a null id stays null. Equal texts have equal values, the place included. Extra columns are
    not read; an empty table writes no shard and gives no rows.
    """
    folder = (folder or result_path(docs.sparkSession, "media")).rstrip("/")
    fs, path = pafs.FileSystem.from_uri(folder if re.match(r"\w+:", folder) else f"file://{folder}")
    if any(f.base_name.startswith("shard-") for f in fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))):
        raise FileExistsError(f"{folder} holds shards, which rows of an earlier run may name")
    placed = stage(store_payloads(docs, folder, id_col, text_col), "placed")
    chosen = placed.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    # a row is few bytes but names a whole image: a task for each shard, whatever its rows' bytes
    shards = placed.agg(F.count_distinct("shard")).first()[0]
    described = chosen.repartition(max(1, shards), "shard").sortWithinPartitions("shard", "offset").mapInArrow(
        _describe(folder),
        "digest binary, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )
    found = chosen.join(described, "digest")
    return placed.select("doc_id", "n_bytes", "digest").join(found, "digest").select(
        "doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature",
        "width", "height", "bits", F.lit(folder).alias("folder"), "shard", "offset", "length",
    )
