"""Token ids in seekable Zstandard files.

A file is a plain Zstandard stream::

    frame 0 | frame 1 | ... | skippable frame holding the seek table

* One frame per document, independent of all others, with content size and
  content checksum; its content is the document's ids as little-endian
  unsigned integers of the file's id width.
* The skippable frame (magic ``0x184D2A5E``) holds one 24-byte entry a frame -
  identifier (int64), has-identifier flag (u32), compressed and decompressed
  size (u32), low 32 bits of the XXH64 of the content (u32) - and a 16-byte
  footer: writing task (u32), file number within the task (u32), frames (u32),
  id width (u8) and the three bytes ``ID\\n``.

A reader takes the last 16 bytes, then the table, then only the frames it
wants.  Files are written by Spark's own text sink (one value per file, the
sink's closing newline is the last byte of the footer) and read by its
``binaryFile`` source, so any file system that Spark reaches will do, a failed
task leaves nothing behind and no executor needs a shared local folder.

Documents are range-partitioned by identifier before they are encoded (ties
are split by a hash of the text), so files in (task, number) order hold
ascending identifiers and a hot identifier does not end in one task.

Defined results: a NULL or empty text gives a document of the end id alone;
NULL identifiers come first and read back as NULL; repeated rows are written
as often as they occur; a very long text is one frame like any other, encoded
whole; an empty table writes no document; other columns are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabrisk.llm.pieces import text_slices
from tabrisk.llm.shared import cut
from tabrisk.llm.tokens import encoder
from tabrisk.session import checkpoint_dir

SKIPPABLE = 0x184D2A5E
ENTRY = np.dtype([("id", "<i8"), ("has_id", "<u4"), ("packed", "<u4"), ("size", "<u4"), ("check", "<u4")])
FOOTER = struct.Struct("<IIIB3s")
TAG = b"ID\n"
FILE_BYTES = 8 << 20  # compressed bytes after which a task starts another file


def seek_table(task: int, number: int, entries: np.ndarray, width: int) -> bytes:
    body = entries.tobytes() + FOOTER.pack(task, number, len(entries), width, TAG)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_table(content: bytes) -> tuple[np.ndarray, np.ndarray, int, int, int]:
    """(entries, frame offsets, id width, task, number) of a file."""
    task, number, frames, width, tag = FOOTER.unpack(content[-FOOTER.size:])
    if tag != TAG:
        raise ValueError("not a token file: bad footer")
    start = len(content) - FOOTER.size - frames * ENTRY.itemsize
    magic, size = struct.unpack("<II", content[start - 8:start])
    if magic != SKIPPABLE or size != len(content) - start:
        raise ValueError("not a token file: bad seek table")
    entries = np.frombuffer(content, ENTRY, frames, start)
    return entries, np.concatenate([[0], np.cumsum(entries["packed"], dtype=np.int64)]), width, task, number


def read_frame(content: bytes, entries: np.ndarray, at: np.ndarray, i: int, width: int,
               decompressor) -> np.ndarray:
    """Ids of one document; raises if frame or seek-table checksum disagree."""
    import xxhash

    raw = decompressor.decompress(content[at[i]:at[i + 1]])
    if len(raw) != entries["size"][i] or xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF != entries["check"][i]:
        raise ValueError(f"token file: frame {i} is damaged")
    return np.frombuffer(raw, "<u2" if width == 2 else "<u4")


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id",
                      text_col: str = "text", level: int = 3, file_bytes: int = FILE_BYTES) -> None:
    """Write the ids of every text, each followed by ``end_id``, below ``path``."""

    def files(batches):
        import xxhash
        import zstandard
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        enc = encoder(vocabulary)
        width = 2 if max(enc.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        kind = np.dtype("<u2" if width == 2 else "<u4")
        end = np.array([end_id], kind).tobytes()
        packer = zstandard.ZstdCompressor(level=level, write_checksum=True, write_content_size=True)
        frames, entries, held = [], [], 0

        def file():
            table = np.array(entries, ENTRY) if entries else np.zeros(0, ENTRY)
            content = b"".join([*frames, seek_table(task, number, table, width)])
            return pa.RecordBatch.from_arrays([pa.array([content[:-1]], pa.binary())], ["content"])

        for batch in batches:
            for part in text_slices(batch, "_text"):
                ids, bounds = enc.encode(part.column("_text"))
                ids = ids.astype(kind)
                for key, a, b in zip(part.column("_id").to_pylist(), bounds[:-1], bounds[1:]):
                    raw = ids[a:b].tobytes() + end
                    frame = packer.compress(raw)
                    frames.append(frame)
                    entries.append((key or 0, key is not None, len(frame), len(raw),
                                    xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF))
                    held += len(frame)
                    if held >= file_bytes:
                        yield file()
                        frames, entries, held, number = [], [], 0, number + 1
        if entries:
            yield file()

    rows = docs.select(F.col(id_col).cast("bigint").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    ordered = (rows.withColumn("_tie", F.xxhash64("_text"))
               .repartitionByRange("_id", "_tie").sortWithinPartitions("_id", "_tie"))
    (ordered.mapInArrow(files, "content binary").select(F.col("content").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).text(path))


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).where(F.col("length") > 0).select("content")


def file_totals(spark: SparkSession, path: str) -> DataFrame:
    """``task, number, first_token`` per file, read from the seek tables: ids in all files before."""

    def totals(batches):
        for batch in batches:
            rows = []
            for content in batch.column("content"):
                entries, _, width, task, number = read_table(content.as_buffer().to_pybytes())
                rows.append((task, number, int(entries["size"].sum(dtype=np.int64)) // width))
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], pa.int64()) for i in range(3)], ["task", "number", "n"])

    return _first_tokens(_files(spark, path).mapInArrow(totals, "task bigint, number bigint, n bigint"))


def _first_tokens(files: DataFrame) -> DataFrame:
    """``task, number, first_token`` from the ids per file."""
    before = Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)  # a row for each writing task
    tasks = (files.groupBy("task").agg(F.sum("n").alias("_n"))
             .select("task", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))
    within = Window.partitionBy("task").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    return files.join(tasks, "task").select(
        "task", "number", (F.col("_before") + F.coalesce(F.sum("n").over(within), F.lit(0))).alias("first_token"))


def read_token_files(spark: SparkSession, path: str, only=None, digest: bool = False) -> DataFrame:
    """Documents of the files: ``doc_id, task, number, position, local_start,
    n_tokens`` and ``ids`` (array), or with ``digest`` the CRC-32 of the ids as
    u32 instead.  ``only`` (identifiers) leaves all other frames compressed."""
    wanted = None if only is None else np.unique(np.array(list(only), np.int64))

    def documents(batches):
        import zstandard

        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            for content in batch.column("content"):
                content = content.as_buffer().to_pybytes()
                entries, at, width, task, number = read_table(content)
                sizes = entries["size"].astype(np.int64) // width
                start = np.cumsum(sizes) - sizes
                pick = np.arange(len(entries)) if wanted is None else np.flatnonzero(
                    np.isin(entries["id"], wanted) & (entries["has_id"] == 1))
                for chunk in np.array_split(pick, max(1, int(sizes[pick].sum() // 4_000_000))):
                    if not len(chunk):
                        continue
                    out = []
                    for i in chunk:
                        ids = read_frame(content, entries, at, i, width, unpack)
                        out.append(zlib.crc32(ids.astype("<u4").tobytes()) if digest else ids.astype(np.int32))
                    values = pa.array(out, pa.int64() if digest else pa.list_(pa.int32()))
                    yield pa.RecordBatch.from_arrays([
                        pa.array(entries["id"][chunk], mask=entries["has_id"][chunk] == 0),
                        pa.array(np.full(len(chunk), task)), pa.array(np.full(len(chunk), number)),
                        pa.array(chunk), pa.array(start[chunk]), pa.array(sizes[chunk]), values],
                        ["doc_id", "task", "number", "position", "local_start", "n_tokens",
                         "ids_crc32" if digest else "ids"])

    last = "ids_crc32 bigint" if digest else "ids array<int>"
    return _files(spark, path).mapInArrow(documents, (
        "doc_id bigint, task bigint, number bigint, position bigint, local_start bigint, n_tokens bigint, " + last))


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def token_file_digest(docs: DataFrame, vocabulary: str, end_id: int, path: str | None = None) -> DataFrame:
    """Write, read back: ``doc_id, start, n_tokens, ids_crc32`` (and place in the files).

    Files are read once; what comes before each file is summed from the rows read."""
    spark = docs.sparkSession
    path = path or new_folder(spark, "token-files")
    write_token_files(docs, path, vocabulary, end_id)
    rows = cut(read_token_files(spark, path, digest=True))
    sizes = rows.groupBy("task", "number").agg(F.sum("n_tokens").alias("n"))
    return rows.join(_first_tokens(sizes), ["task", "number"]).select(
        "doc_id", (F.col("first_token") + F.col("local_start")).alias("start"), "n_tokens",
        "ids_crc32", "task", "number", "position")
