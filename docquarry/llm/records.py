"""Operator 1: token ids as length-delimited binary records.

A shard is a `.bin` file of frames and an `.idx` file. A frame is: payload length (8 bytes, little-endian), masked CRC-32C of these
8 bytes, payload, masked CRC-32C of the payload. A payload is: one byte (1 if the document has an id), the id (8 bytes), then the
token ids, each in 2 bytes (vocabularies of up to 65,536) or 4, little-endian. The index has a fixed-width entry for each frame, so
records can be read in any order. `manifest.json`, written when all tasks have ended, names the shards in document order with the
number of ids before each of them; files of lost or repeated task attempts are not in it.

Defined cases: a null text is the empty text (only its end id); a null doc_id comes first and stays null; repeated rows are each
written; extra columns are ignored; an empty table gives no shards.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from .crc32c import masked_crc32c
from .encode import encoder, in_slices
from .shared import shared_folder, trimming

HEAD, ENTRY = struct.Struct("<?q"), np.dtype([("known", "?"), ("doc_id", "<i8"), ("offset", "<i8"), ("size", "<i8")])
FRAME = 16  # bytes of a frame besides its payload
READ_BYTES = 16_000_000


@dataclass
class Shard(WriterCommitMessage, InputPartition):
    partition: int
    name: str
    records: int
    tokens: int
    start: int = 0


class TokenRecords(DataSource):
    """format("token_records"); options: path, width (bytes of an id), shuffle_seed (read records in a seeded order)."""

    @classmethod
    def name(cls) -> str:
        return "token_records"

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> DataSourceReader:
        return RecordReader(self.options["path"], self.options.get("shuffle_seed"))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return RecordWriter(self.options["path"], int(self.options["width"]))


class RecordWriter(DataSourceArrowWriter):
    """Takes (doc_id long, ids binary) in order; one shard a task."""

    def __init__(self, path: str, width: int):
        self.path, self.width = path, width

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        name, at, tokens, entries = f"part-{part:06d}-{uuid.uuid4().hex}", 0, 0, []
        with store.open_output_stream(f"{folder}/{name}.bin") as out:
            for batch in iterator:
                ids, keys = batch.column("ids").to_pylist(), batch.column("doc_id").to_pylist()
                payloads = [HEAD.pack(k is not None, k or 0) + x for k, x in zip(keys, ids, strict=True)]
                sizes = [struct.pack("<Q", len(p)) for p in payloads]
                for k, p, n, c, d in zip(keys, payloads, sizes, masked_crc32c(sizes).tolist(), masked_crc32c(payloads).tolist(), strict=True):
                    out.write(n + struct.pack("<I", c) + p + struct.pack("<I", d))
                    entries.append((k is not None, k or 0, at, len(p)))
                    at += len(p) + FRAME
                tokens += sum(map(len, ids)) // self.width
        with store.open_output_stream(f"{folder}/{name}.idx") as out:
            out.write(np.array(entries, ENTRY).tobytes())
        return Shard(part, name, len(entries), tokens)

    def commit(self, messages) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        store.create_dir(folder, recursive=True)
        shards, start = [], 0
        for m in sorted((m for m in messages if m and m.records), key=lambda m: m.partition):
            shards.append({"name": m.name, "records": m.records, "tokens": m.tokens, "start": start})
            start += m.tokens
        with store.open_output_stream(f"{folder}/manifest.json") as out:
            out.write(json.dumps({"width": self.width, "shards": shards}).encode())

    def abort(self, messages) -> None:
        store, folder = fs.FileSystem.from_uri(self.path)
        for m in messages:
            if m:
                for end in ("bin", "idx"):
                    store.delete_file(f"{folder}/{m.name}.{end}")


class RecordReader(DataSourceReader):
    def __init__(self, path: str, seed: str | None):
        self.path, self.seed = path, seed

    def manifest(self) -> dict:
        store, folder = fs.FileSystem.from_uri(self.path)
        with store.open_input_stream(f"{folder}/manifest.json") as f:
            return json.loads(f.read())

    def partitions(self) -> list[Shard]:
        shards = [Shard(k, s["name"], s["records"], s["tokens"], s["start"]) for k, s in enumerate(self.manifest()["shards"])]
        if self.seed is not None:
            np.random.default_rng(int(self.seed)).shuffle(shards)
        return shards or [Shard(0, "", 0, 0)]

    def read(self, shard: Shard) -> Iterator[pa.RecordBatch]:
        if not shard.records:
            return
        store, folder = fs.FileSystem.from_uri(self.path)
        kind = np.dtype(f"<u{self.manifest()['width']}")
        with store.open_input_stream(f"{folder}/{shard.name}.idx") as f:
            index = np.frombuffer(f.read(), ENTRY)
        count = (index["size"] - HEAD.size) // kind.itemsize
        start = shard.start + np.cumsum(count) - count
        order = np.arange(len(index))
        if self.seed is not None:
            np.random.default_rng([int(self.seed), shard.partition]).shuffle(order)
        groups = np.cumsum(index["size"][order]) // READ_BYTES
        with store.open_input_file(f"{folder}/{shard.name}.bin") as f:
            for own in np.split(order, np.flatnonzero(np.diff(groups)) + 1):
                ids = [p[HEAD.size :] for p in self.payloads(f, index[own])]
                yield pa.record_batch(
                    [
                        pa.array(index["doc_id"][own], pa.int64(), mask=~index["known"][own]),
                        pa.array(start[own], pa.int64()),
                        pa.array(count[own], pa.int64()),
                        pa.array([np.frombuffer(x, kind).astype("<u4").tobytes() for x in ids], pa.binary()),
                    ],
                    ["doc_id", "start", "n_tokens", "ids"],
                )

    def payloads(self, f, entries: np.ndarray) -> list[bytes]:
        """The payloads of some frames; ValueError if a length or a checksum is wrong."""
        low = int(entries["offset"].min())
        if self.seed is None:  # neighbours: one read
            whole = f.read_at(int((entries["offset"] + entries["size"]).max()) + FRAME - low, low)
            frames = [whole[a : a + n + FRAME] for a, n in zip((entries["offset"] - low).tolist(), entries["size"].tolist(), strict=True)]
        else:
            frames = [f.read_at(n + FRAME, a) for a, n in zip(entries["offset"].tolist(), entries["size"].tolist(), strict=True)]
        heads, payloads = [x[:8] for x in frames], [x[12:-4] for x in frames]
        said = [struct.unpack("<QI", x[:12]) + struct.unpack("<I", x[-4:]) for x in frames]
        for (n, c, d), p, c2, d2 in zip(said, payloads, masked_crc32c(heads).tolist(), masked_crc32c(payloads).tolist(), strict=True):
            if n != len(p) or c != c2 or d != d2:
                raise ValueError(f"a damaged record in {self.path}")
        return payloads


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int | None = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id long, ids binary): the ids of each whole text, then end_id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(tokenizer)
        end = b"" if end_id is None else np.array([end_id], own.dtype).tobytes()
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in in_slices(texts):
                yield pa.record_batch([batch.column(0).slice(a, b - a), pa.array([x + end for x in own.encode(texts[a:b])], pa.binary())], ["doc_id", "ids"])

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(trimming(run), "doc_id long, ids binary")


def write_token_records(docs: DataFrame, path: str, tokenizer: str, end_id: int | None = 2) -> None:
    """Writes whole documents in ascending doc_id order, as shards that follow one another."""
    docs.sparkSession.dataSource.register(TokenRecords)
    dealt = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    encode_documents(dealt, tokenizer, end_id).write.format("token_records").mode("append").option("width", encoder(tokenizer).dtype.itemsize).save(path)


def read_token_records(spark: SparkSession, path: str, shuffle_seed: int | None = None) -> DataFrame:
    """(doc_id, start, n_tokens, ids binary of little-endian unsigned 32-bit ids); every checksum is verified."""
    spark.dataSource.register(TokenRecords)
    reader = spark.read.format("token_records")
    return (reader if shuffle_seed is None else reader.option("shuffle_seed", shuffle_seed)).load(path)


def token_records(docs: DataFrame, tokenizer: str) -> DataFrame:
    """Writes docs as records in the shared folder and reads them back."""
    path = shared_folder(docs.sparkSession)
    write_token_records(docs, path, tokenizer)
    return read_token_records(docs.sparkSession, path)
