"""Binary token files: length-delimited, checksummed records with an offset index (operator 9).

A data file is a run of records::

    uint64 length | uint32 masked crc of the length | payload | uint32 masked crc of the payload

all little-endian. A payload is ``uint8 flags | int64 doc_id | ids``; flag 1 says that the
id is null, flag 2 that ids take four bytes, not two. The index of a data file is a file of
its own with the offset of every record, so that records can be read in any order. A
checksum is masked, as a checksum of data that holds checksums is weak.

Documents are range-partitioned by ``doc_id`` and sorted, so the files, in the order of the
manifest, hold ascending ids. A task writes to names of its own attempt and reports them
when it has closed them; only what successful attempts report is in the manifest, so a
retried task leaves no trace. Defined results: a null text is empty and gets the end id
only; null ids come first; rows of equal id follow each other in a fixed order; an empty
table gives no records. Extra columns are ignored.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.chunks import ChunkCache, word_encoder
from tessella.llm.resident import resident
from tessella.runtime import byte_width, materialize, scratch_path

VOCABULARY = "word_bpe_49k.json"
END_ID = 1
#: Input bytes of a data file, and rows of a batch that is read back.
FILE_BYTES = 1 << 26
READ_ROWS = 8192
READ_BYTES = 1 << 22
MANIFEST = "part int, path string, n_records long, n_tokens long"


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    """One record."""
    length = struct.pack("<Q", len(payload))
    return b"".join((length, struct.pack("<I", masked_crc(length)), payload, struct.pack("<I", masked_crc(payload))))


def unframe(data: bytes, at: int) -> tuple[bytes, int]:
    """The payload of the record at ``at`` and where the next one starts."""
    length = data[at : at + 8]
    if len(length) < 8 or struct.unpack_from("<I", data, at + 8)[0] != masked_crc(length):
        raise ValueError(f"bad record length at {at}")
    to = at + 12 + struct.unpack("<Q", length)[0]
    payload = data[at + 12 : to]
    if len(data) < to + 4 or struct.unpack_from("<I", data, to)[0] != masked_crc(payload):
        raise ValueError(f"bad record at {at}")
    return payload, to + 4


def pack_record(doc_id: int | None, ids: bytes, wide: bool = False) -> bytes:
    return struct.pack("<Bq", (doc_id is None) | wide << 1, doc_id or 0) + ids


def unpack_record(payload: bytes) -> tuple[int | None, np.ndarray]:
    flags, doc_id = struct.unpack_from("<Bq", payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, dtype="<u4" if flags & 2 else "<u2", offset=9)


def _filesystem(path: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(path)


class RecordWriter:
    """A data file and its index; complete once closed."""

    def __init__(self, path: str) -> None:
        store, self.local = _filesystem(path)
        store.create_dir(self.local.rpartition("/")[0], recursive=True)
        self.data, self.index = store.open_output_stream(self.local), store.open_output_stream(self.local + ".idx")
        self.at = 0

    def write(self, payload: bytes) -> None:
        self.index.write(struct.pack("<Q", self.at))
        record = frame(payload)
        self.data.write(record)
        self.at += len(record)

    def close(self) -> None:
        self.data.close()
        self.index.close()


class RecordReader:
    """Random access by the index: ``reader[i]`` is the payload of record ``i``."""

    def __init__(self, path: str) -> None:
        store, local = _filesystem(path)
        with store.open_input_stream(local + ".idx") as f:
            self.offsets = np.frombuffer(f.read(), dtype="<u8")
        self.file = store.open_input_file(local)
        self.size = self.file.size()

    def __len__(self) -> int:
        return len(self.offsets)

    def __getitem__(self, i: int) -> bytes:
        at = int(self.offsets[i])
        to = int(self.offsets[i + 1]) if i + 1 < len(self) else self.size
        self.file.seek(at)
        return unframe(self.file.read(to - at), 0)[0]

    def __iter__(self) -> Iterator[bytes]:
        lo = 0
        while lo < len(self):  # a block of records at a time: READ_BYTES, or a single longer one
            start = int(self.offsets[lo])
            hi = max(lo + 1, int(np.searchsorted(self.offsets, start + READ_BYTES, side="right")) - 1)
            hi = len(self) if self.size <= start + READ_BYTES else hi
            self.file.seek(start)
            block = self.file.read((int(self.offsets[hi]) if hi < len(self) else self.size) - start)
            for i in range(lo, hi):
                yield unframe(block, int(self.offsets[i]) - start)[0]
            lo = hi


def opened(path: str) -> ChunkCache:
    return resident(("records", path), lambda: ChunkCache(word_encoder(path), "<u2", limit=600_000))


def write_records(docs: DataFrame, vocabulary: str, folder: str, end_id: int = END_ID) -> DataFrame:
    """Encode and write ``docs(doc_id, text)`` under ``folder``; returns the manifest.

    ``part`` numbers the files in the order of their ids. A file holds about ``FILE_BYTES``
    of input.
    """
    end = struct.pack("<H", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache, writer, records, tokens = opened(vocabulary), None, 0, 0
        part = TaskContext.get().partitionId()
        path = f"{folder}/part-{part:06d}-{uuid.uuid4().hex}.rec"
        for batch in batches:
            writer = writer or RecordWriter(path)
            doc_ids = batch.column("doc_id").to_pylist()
            for first, ids, bounds in cache.texts(batch.column("text")):
                edges = bounds.tolist()
                for doc_id, a, b in zip(doc_ids[first:], edges, edges[1:]):
                    writer.write(pack_record(doc_id, ids[a:b].tobytes() + end))
                records += len(edges) - 1
                tokens += len(ids) + len(edges) - 1
        if writer:
            writer.close()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "path": [path], "n_records": pa.array([records], pa.int64()), "n_tokens": pa.array([tokens], pa.int64())})

    rows = docs.select("doc_id", "text").withColumn("h", F.xxhash64("text"))
    dealt = rows.repartitionByRange(byte_width(docs, FILE_BYTES), "doc_id", "h").sortWithinPartitions("doc_id", "h").drop("h")
    return materialize(dealt.mapInArrow(run, MANIFEST), "manifest")


def read_records(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of all records, read back from the files.

    The manifest has one row for each file of ``FILE_BYTES`` of input.
    """
    files, total = [], 0
    for f in sorted(manifest.collect(), key=lambda f: f.part):
        files.append((f.path, total))
        total += f.n_tokens

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows)], ["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in batches:
            for path, start in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                rows: list[tuple] = []
                for payload in RecordReader(path):
                    doc_id, tokens = unpack_record(payload)
                    rows.append((doc_id, start, len(tokens), zlib.crc32(tokens.astype("<u4").tobytes())))
                    start += len(tokens)
                    if len(rows) == READ_ROWS:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    rows = spark.createDataFrame(files, "path string, start long").repartition(max(1, len(files)))
    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op9_token_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    manifest = write_records(docs, public_tokenizers.path(VOCABULARY), scratch_path(spark, "records"))
    return read_records(spark, manifest)
