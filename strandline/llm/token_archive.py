"""Token ids in archives of independent zstandard frames with a trailing seek table (operator 2).

A file holds the documents of one range of ids, a frame each: the ids as little-endian unsigned integers of `width`
bytes (2 where the vocabulary allows, else 4). Two skippable frames follow: the document ids, and the seek table of the
public zstd seekable format (compressed size, size and low 32 bits of XXH64 of each frame, then the footer). A reader
needs the two tables and the frames of the documents it wants.

Defined results: a null text is an empty one; an empty document has the end id alone; rows with one id or a null id
each stay a document (null ids first), repeated rows too; a text of any length is one frame; an empty table gives no
files. Columns other than id and text are ignored whatever their names.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import BinaryIO

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._pretokens import chunks, largest_id, library_store
from ._spark import ready, scratch, stored

#: Fixed values of the zstd seekable format.
SKIPPABLE_SEEK, SKIPPABLE_OWN, SEEKABLE, CHECKSUMS = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1, 0x80
_NULL_ID = -(1 << 63)
MANIFEST = "part int, file string, n_docs long, n_tokens long, n_bytes long, width int"


class ArchiveWriter:
    """Writes documents to a file object that need not be seekable."""

    def __init__(self, out: BinaryIO, width: int, level: int = 3) -> None:
        import zstandard

        self.out, self.width, self.n_bytes = out, width, 0
        self._zstd = zstandard.ZstdCompressor(level=level, write_checksum=False)
        self._entries: list[tuple[int, int, int]] = []
        self._ids: list[int] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        import xxhash

        if len(ids) and int(ids.max()) >= 1 << 8 * self.width:
            raise ValueError(f"id {int(ids.max())} does not fit in {self.width} bytes")
        raw = ids.astype(f"<u{self.width}").tobytes()
        frame = self._zstd.compress(raw)
        self._put(frame)
        self._entries.append((len(frame), len(raw), xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF))
        self._ids.append(_NULL_ID if doc_id is None else doc_id)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.n_bytes += len(data)

    def close(self) -> None:
        ids = np.array(self._ids, "<i8").tobytes()
        self._put(struct.pack("<IIB", SKIPPABLE_OWN, len(ids) + 1, self.width) + ids)
        table = np.array(self._entries, "<u4").reshape(-1, 3).tobytes()
        self._put(struct.pack("<II", SKIPPABLE_SEEK, len(table) + 9) + table + struct.pack("<IBI", len(self._entries), CHECKSUMS, SEEKABLE))


class ArchiveReader:
    """Reads single documents of an archive; file needs seek() and read()."""

    def __init__(self, file, size: int) -> None:
        self.file = file
        file.seek(size - 9)
        count, flags, magic = struct.unpack("<IBI", file.read(9))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("no seek table with checksums at the end")
        begin = size - 9 - 12 * count - 8
        file.seek(begin)
        if struct.unpack("<II", file.read(8)) != (SKIPPABLE_SEEK, 12 * count + 9):
            raise ValueError("the seek table is damaged")
        self.entries = np.frombuffer(file.read(12 * count), "<u4").reshape(-1, 3).astype(np.int64)
        file.seek(begin - 8 * count - 9)
        magic, length, self.width = struct.unpack("<IIB", file.read(9))
        if magic != SKIPPABLE_OWN or length != 8 * count + 1:
            raise ValueError("the table of documents is damaged")
        self.doc_ids = np.frombuffer(file.read(8 * count), "<i8")
        self.begins = np.cumsum(self.entries[:, 0]) - self.entries[:, 0]

    def __len__(self) -> int:
        return len(self.doc_ids)

    def ids(self, k: int) -> np.ndarray:
        self.file.seek(int(self.begins[k]))
        return self._open(k, self.file.read(int(self.entries[k, 0])))

    def slices(self, most: int = 4 << 20) -> Iterator[tuple[int, list[np.ndarray]]]:
        """All documents in order, by reads of about `most` bytes: the first one's place and their ids."""
        k = 0
        while k < len(self):
            stop = max(k + 1, int(np.searchsorted(self.begins + self.entries[:, 0], self.begins[k] + most, "right")))
            self.file.seek(int(self.begins[k]))
            sizes = self.entries[k:stop, 0]
            data, at = memoryview(self.file.read(int(sizes.sum()))), self.begins[k:stop] - self.begins[k]
            yield k, [self._open(k + i, data[a : a + n]) for i, (a, n) in enumerate(zip(at.tolist(), sizes.tolist(), strict=True))]
            k = stop

    def _open(self, k: int, frame) -> np.ndarray:
        import xxhash
        import zstandard

        raw = zstandard.ZstdDecompressor().decompress(frame, max_output_size=int(self.entries[k, 1]))
        if xxhash.xxh64(raw).intdigest() & 0xFFFFFFFF != self.entries[k, 2]:
            raise ValueError(f"checksum of frame {k}")
        return np.frombuffer(raw, f"<u{self.width}")


def write_archives(docs: DataFrame, tokenizer: str, end_id: int, folder: str, id_col: str = "doc_id", text_col: str = "text", width: int | None = None) -> DataFrame:
    """Encode every whole text, append end_id, write one archive for each range of ids in ascending order. Returns the manifest, a stored table.

    width, the bytes of an id, is 2 where the tokenizer's ids and end_id allow, else 4; one that is given has to hold them.
    Each task writes a name of its own and then moves it, so a repeated or speculative task leaves one whole file.
    """
    spark = docs.sparkSession
    largest = max(largest_id(tokenizer), end_id)
    width = width or (2 if largest < 1 << 16 else 4)
    if largest >= 1 << 8 * width:
        raise ValueError(f"ids up to {largest} do not fit in {width} bytes")
    ready(spark)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, files, writer, n_docs, n_tokens = library_store(tokenizer), None, None, 0, 0
        context = TaskContext.get()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, b in chunks(texts):
                flat, per_doc = store.encode_texts(texts.slice(a, b - a))
                if writer is None:
                    files, path = fs.FileSystem.from_uri(folder)
                    files.create_dir(path, recursive=True)
                    name = f"part-{context.partitionId():06d}"
                    own = f"{path}/_{name}-{context.taskAttemptId()}"
                    out = files.open_output_stream(own)
                    writer = ArchiveWriter(out, width)
                stops = np.cumsum(per_doc)
                for doc, stop, n in zip(ids.slice(a, b - a).to_pylist(), stops.tolist(), per_doc.tolist(), strict=True):
                    writer.add(doc, np.append(flat[stop - n : stop], np.uint32(end_id)))
                n_docs, n_tokens = n_docs + len(per_doc), n_tokens + len(flat) + len(per_doc)
        if writer is not None:
            writer.close()
            out.close()
            files.move(own, f"{path}/{name}.zst")
            yield pa.RecordBatch.from_pydict({"part": pa.array([context.partitionId()], pa.int32()), "file": [f"{folder}/{name}.zst"], "n_docs": [n_docs], "n_tokens": [n_tokens], "n_bytes": [writer.n_bytes], "width": pa.array([width], pa.int32())})

    ranged = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # Dealt by more than the id, so that rows of one id, or of none, are many tasks' work.
    order = ["id", "mark", "place"]
    ranged = ranged.withColumn("mark", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order).drop("mark", "place")
    return stored(ranged.mapInArrow(write, MANIFEST), "manifest")


def read_archives(manifest: DataFrame) -> DataFrame:
    """Every document of the archives: doc_id, start (ids of all documents before it), n_tokens, ids (little-endian unsigned 32-bit)."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        for batch in batches:
            for row in batch.to_pylist():
                files, path = fs.FileSystem.from_uri(row["file"])
                with files.open_input_file(path) as f:
                    archive, start = ArchiveReader(f, row["n_bytes"]), row["before"]
                    for k, docs in archive.slices():
                        n = np.array([len(x) for x in docs], np.int64)
                        stops = start + np.cumsum(n)
                        names = archive.doc_ids[k : k + len(docs)]
                        yield pa.RecordBatch.from_pydict({"doc_id": pa.array(names, pa.int64(), mask=names == _NULL_ID), "start": stops - n, "n_tokens": n, "ids": pa.array([x.astype("<u4").tobytes() for x in docs], pa.binary())})
                        start = int(stops[-1])

    before = F.coalesce(F.sum("n_tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # One row a file: the window over the manifest is as long as there are files.
    files = manifest.withColumn("before", before)
    parts = int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return files.repartition(parts, "part").mapInArrow(read, "doc_id long, start long, n_tokens long, ids binary")


def op2_token_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as archives of byte-level BPE ids, read back: doc_id, start, n_tokens, ids_crc32."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_archives(docs, public_tokenizers.path("byte_bpe_50k.json"), 2, scratch(spark, "archives"))
    return read_archives(manifest).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


QUERIES = {"op2_token_archive": op2_token_archive}
ORACLES: dict[str, str] = {}
