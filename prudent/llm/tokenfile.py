"""Token-id files: byte- or bit-plane shuffled blocks compressed with zstandard, with a chunk index.

File format (little-endian).  One file per shard of consecutive ``doc_id``:

    magic   8 bytes ``PLANES01``
    blocks  of ``BLOCK`` ids (the last one shorter); a block is its planes, one after the other, each a
            zstandard frame.  Byte planes: plane p holds byte p of every id.  Bit planes: plane p
            holds bit p of every id, eight ids a byte, lowest bit first.  Planes above the largest id
            of a block are not stored.
    docs    a zstandard frame of the documents' ids and lengths (two 64-bit columns)
    index   zstandard frame of JSON: ids, docs, plane kind, and per block its offset, number of ids
            and the sizes of its planes
    footer  offsets of docs and index (2 x 8 bytes), magic again

Files are written under a name of their own per task attempt and renamed when complete, and only
the manifest, which Spark writes with the attempts that succeeded, says which files count: a lost
executor or a second attempt leaves at most an unnamed file behind.
"""

from __future__ import annotations

import json
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prudent.llm.common import shared_path, staged
from prudent.llm.tokens import encoder as shared_encoder
from prudent.llm.tokens import vocabulary_path

MAGIC, BLOCK, LEVEL = b"PLANES01", 1 << 16, 3
#: documents of a shard, about; a shard streams through its task, so long texts only make it longer
SHARD_DOCS = 20_000


def filesystem(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a shared folder (file:, hdfs:, s3:, ... or a plain path) and the path in it."""
    if uri.startswith("file:"):
        uri = "/" + uri[5:].lstrip("/")
    return pafs.FileSystem.from_uri(uri)


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Transpose ids into byte or bit planes, lowest first, without the empty ones on top."""
    top = int(ids.max()) if len(ids) else 0
    raw = np.ascontiguousarray(ids, "<u4").view(np.uint8).reshape(-1, 4)
    if not bits:
        return [raw[:, p].tobytes() for p in range(-(-top.bit_length() // 8))]
    spread = np.unpackbits(raw, axis=1, bitorder="little")
    return [np.packbits(spread[:, p], bitorder="little").tobytes() for p in range(top.bit_length())]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    if not bits:
        raw = np.zeros((n, 4), np.uint8)
        for p, plane in enumerate(planes):
            raw[:, p] = np.frombuffer(plane, np.uint8)
        return raw.view("<u4").reshape(-1)
    spread = np.zeros((n, 32), np.uint8)
    for p, plane in enumerate(planes):
        spread[:, p] = np.unpackbits(np.frombuffer(plane, np.uint8), count=n, bitorder="little")
    return np.packbits(spread, axis=1, bitorder="little").view("<u4").reshape(-1)


class Writer:
    """Appends documents to one shard; holds one block and the documents' lengths."""

    def __init__(self, out, bits: bool):
        self.out, self.bits, self.at = out, bits, 0
        self.rest: list[np.ndarray] = []
        self.held = self.total = 0
        self.blocks: list[list] = []
        self.names: list[int] = []
        self.lengths: list[int] = []
        self.zip = zstandard.ZstdCompressor(level=LEVEL)
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.out.write(data)
        self.at += len(data)

    def add(self, name: int, ids: np.ndarray) -> None:
        self.names.append(name)
        self.lengths.append(len(ids))
        self.rest.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        while self.held >= BLOCK:
            self._block(BLOCK)

    def _block(self, n: int) -> None:
        ids = np.concatenate(self.rest)
        self.rest, self.held = [ids[n:]], self.held - n
        planes = [self.zip.compress(p) for p in to_planes(ids[:n], self.bits)]
        self.blocks.append([self.at, n, [len(p) for p in planes]])
        for p in planes:
            self._put(p)

    def close(self) -> int:
        if self.held:
            self._block(self.held)
        docs = self.at
        self._put(self.zip.compress(np.array([self.names, self.lengths], "<i8").tobytes()))
        index = self.at
        self._put(self.zip.compress(json.dumps({"ids": self.total, "docs": len(self.names), "bits": self.bits,
                                                "blocks": self.blocks}).encode()))
        self._put(struct.pack("<qq", docs, index) + MAGIC)
        return self.at


class Reader:
    """Random access to the ids of a shard by block."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        docs, index = struct.unpack("<qq", self._at(size - 24, 16))
        if self._at(size - 8, 8) != MAGIC or self._at(0, 8) != MAGIC:
            raise ValueError("not a complete token file")
        self.unzip = zstandard.ZstdDecompressor()
        self.index = json.loads(self.unzip.decompress(self._at(index, size - 24 - index)))
        both = np.frombuffer(self.unzip.decompress(self._at(docs, index - docs)), "<i8").reshape(2, -1)
        self.names, self.lengths = both

    def _at(self, offset: int, n: int) -> bytes:
        self.source.seek(offset)
        return self.source.read(n)

    def block(self, i: int) -> np.ndarray:
        offset, n, sizes = self.index["blocks"][i]
        data, planes = self._at(offset, sum(sizes)), []
        for size in sizes:
            planes.append(self.unzip.decompress(data[:size]))
            data = data[size:]
        return from_planes(planes, n, self.index["bits"])

    def documents(self) -> Iterator[tuple[int, int, list[np.ndarray]]]:
        """(doc_id, number of ids, the ids in parts) in file order, one block at a time."""
        block, at, i = np.empty(0, np.uint32), 0, 0
        for name, n in zip(self.names.tolist(), self.lengths.tolist()):
            parts, left = [], n
            while left:
                if at == len(block):
                    block, at, i = self.block(i), 0, i + 1
                take = min(left, len(block) - at)
                parts.append(block[at:at + take])
                at, left = at + take, left - take
            yield name, n, parts


#: stands for a null id in the file's 64-bit column
_NO_ID = -(1 << 63)


def _write(root: str, path: str, end_id: int, bits: bool):
    def run(batches: Iterable[pa.RecordBatch]):
        fs = encoder = writer = name = out = place = None
        shard = None
        for batch in batches:
            if not batch.num_rows:
                continue
            if writer is None:
                encoder = shared_encoder(path)
                fs, folder = filesystem(root)
                fs.create_dir(folder, recursive=True)
                name = f"{uuid.uuid4().hex}.planes"
                place = f"{folder}/{name}"
                out = fs.open_output_stream(place + ".part")
                writer = Writer(out, bits)
                shard = batch.column(2)[0].as_py()
            texts = batch.column(1)
            for at in range(0, batch.num_rows, 512):
                ids = batch.column(0).slice(at, 512).to_pylist()
                for doc, got in zip(ids, encoder.encode_batch(texts.slice(at, 512).to_pylist(), end_id=end_id)):
                    writer.add(_NO_ID if doc is None else doc, got)
        if writer is not None:
            size = writer.close()
            out.close()
            fs.move(place + ".part", place)
            yield pa.RecordBatch.from_pylist(
                [{"shard": shard, "file": name, "ids": writer.total, "docs": len(writer.names), "bytes": size}],
                schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("ids", pa.int64()), ("docs", pa.int64()), ("bytes", pa.int64())]))
    return run


def write_token_files(docs: DataFrame, root: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None,
                      end_id: int = 0, bits: bool = False, shards: int | None = None) -> DataFrame:
    """Encode every text, append ``end_id`` and write the ids in ascending order of the id to ``root``.

    Returns the manifest: one row per file with its number of ids, of documents and of bytes, and
    ``start``, the ids of all files before it.  Rows are dealt by range of (id, text hash), so a
    repeated or null id doesn't make one large file; nulls come first, repeated ids by text hash.
    """
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if shards is None:
        shards = max(-(-docs.count() // SHARD_DOCS), docs.sparkSession.sparkContext.defaultParallelism)
    tie = F.xxhash64("text")
    dealt = (base.repartitionByRange(shards, F.col("doc_id"), tie).sortWithinPartitions(F.col("doc_id"), tie)
             .withColumn("shard", F.spark_partition_id()))
    files = staged(dealt.mapInArrow(_write(root, tokenizer or vocabulary_path(), end_id, bits),
                                    "shard int, file string, ids long, docs long, bytes long"), "token-manifest")
    # one row per file of many megabytes: only the manifest is ordered in one place
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return files.withColumn("start", F.coalesce(F.sum("ids").over(before), F.lit(0).cast("long")))


def _read(root: str):
    schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])

    def run(batches):
        fs, folder = filesystem(root)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{folder}/{row['file']}") as f:
                    reader, start, out = Reader(f), row["start"], []
                    for name, n, parts in reader.documents():
                        crc = 0
                        for p in parts:
                            crc = zlib.crc32(np.ascontiguousarray(p, "<u4").data, crc)
                        out.append((None if name == _NO_ID else name, start, n, crc))
                        start += n
                        if len(out) == 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
                            out = []
                    if out:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out), schema)], schema=schema)
    return run


def read_token_files(manifest: DataFrame, root: str) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document, read back from the files."""
    spread = manifest.repartition(max(1, min(manifest.count(), 10_000)), "shard")
    return spread.select("file", "start").mapInArrow(_read(root), "doc_id long, start long, n_tokens long, ids_crc32 long")


def token_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 0,
                bits: bool = False, root: str | None = None) -> DataFrame:
    """Write the token files and read them back.

    Cases: a null or empty text is the end id alone; a null id is kept and comes first; repeated
    rows are documents of their own; other columns are ignored; an empty table writes no file and
    gives an empty result.  A text of any length passes block by block.
    """
    root = root or shared_path(docs.sparkSession, "token-files")
    return read_token_files(write_token_files(docs, root, id_col, text_col, tokenizer, end_id, bits), root)
