"""Exact deduplication as a stateful stream over files of documents.

A stream reads every file once.  Its keyed state lives on disk (RocksDB), never expires and holds
per digest of the normalised text: how many rows had it, and of the one that stays (the largest id)
the identifier and the content locator, that is the file and the row in it.  Spark combines rows of
one digest in each task before they go to the state's partition, so a group that holds a third of
all rows sends one row a task.  The text itself is neither shuffled to the state nor kept there.

A digest that is there already is a hit, not yet a copy: the row's full bytes are compared with the
content that the locator names.  Rows whose bytes differ (a collision) are grouped by their whole
text instead, so no digest, however weak, can merge different texts.

A later call with the same ``state`` reads only files that came since; a call that was broken off
goes on from the stream's checkpoint.  State and checkpoint lie in the shared folder.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Callable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prudent.llm.common import shared_path, staged

#: bytes of retained texts (and rows) up to which they are broadcast to the copies; beyond, both sides are shuffled
BROADCAST_BYTES, BROADCAST_ROWS = 32 << 20, 200_000
#: settings of the stream's state: on disk, saved as changes, without space taken ahead in every partition's store
_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
          "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
          "spark.sql.streaming.stateStore.rocksdb.allowFAllocate": "false"}
LOCATED = ["doc_id", "file", "row", "bytes", "digest", "text_sha256"]
_STATE = "digest string, n long, keep struct<doc_id: long, file: string, row: long, bytes: long>"


def sha256(text: bytes) -> str:
    return hashlib.sha256(text).hexdigest()


def _digests(digest: Callable[[bytes], str], content: bool):
    def run(batches):
        for batch in batches:
            text = pc.ascii_lower(pc.fill_null(batch.column(3), ""))
            raw = text.cast(pa.large_binary())
            size, digests, sha = [], [], []
            for value in raw:
                b = value.as_buffer() or b""
                size.append(len(b))
                digests.append(digest(b))
                sha.append(digests[-1] if digest is sha256 else sha256(b))
            out = [batch.column(0), batch.column(1), batch.column(2), pa.array(size, pa.int64()),
                   pa.array(digests, pa.string()), pa.array(sha, pa.string())]
            yield pa.RecordBatch.from_arrays(out + [text] * content, names=LOCATED + ["text"] * content)
    return run


def located(docs: DataFrame, id_col: str, text_col: str, digest: Callable[[bytes], str], content: bool = False) -> DataFrame:
    """Id, content locator (``file, row``), size and digests of every document; with its normalised text if asked for."""
    meta = docs.metadataColumn("_metadata")
    base = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), meta["file_path"].alias("file"),
                       meta["row_index"].alias("row"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return base.mapInArrow(_digests(digest, content), "doc_id long, file string, row long, bytes long, digest string, text_sha256 string"
                           + ", text string" * content)


def _pattern(path: str) -> str:
    """The path as a glob that only it matches: a stream takes a single file by no other name."""
    path = path.rstrip("/")
    return path if any(c in path for c in "*?[{") else f"{path[:-1]}[{path[-1]}]"


def follow(spark: SparkSession, path: str, state: str, digest: Callable[[bytes], str] = sha256,
           id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """Take all files that have come into the keyed state; returns the state (``digest, n, keep``).

    ``options`` go to the file source, such as ``maxFilesPerTrigger`` or ``maxBytesPerTrigger``.
    Each micro-batch leaves the keys it touched in a folder of its own, which a repeated batch overwrites.
    """
    spark.createDataFrame([], _STATE).write.mode("overwrite").parquet(f"{state}/keys/batch=-1")
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    for name, value in options.items():
        reader = reader.option(name, value)
    keyed = (located(reader.parquet(_pattern(path)), id_col, text_col, digest)
             .groupBy("digest").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row", "bytes")).alias("keep")))

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{state}/keys/batch={number}")

    before = {name: spark.conf.get(name, None) for name in _STORE}
    for name, value in _STORE.items():
        spark.conf.set(name, value)
    try:
        query = (keyed.writeStream.outputMode("update").foreachBatch(put)
                 .option("checkpointLocation", f"{state}/stream").trigger(availableNow=True).start())
        query.awaitTermination()
    finally:
        for name, value in before.items():
            if value is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, value)
    # a key's count only grows, so its last state is the one of the highest count
    kept = spark.read.schema(_STATE).parquet(f"{state}/keys")
    return kept.groupBy("digest").agg(F.max(F.struct("n", "keep")).alias("s")).select("digest", "s.n", "s.keep")


def unequal(rows: DataFrame, hits: DataFrame) -> DataFrame:
    """``digest`` of rows whose full bytes differ from the retained content of their digest.

    ``rows`` are located documents with their digest, ``hits`` the states of more than one row.
    """
    size = hits.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.col("keep.bytes")), F.lit(0)).alias("bytes")).first()
    keys = hits.select(F.col("digest").alias("hit"), F.col("keep.file").alias("keep_file"), F.col("keep.row").alias("keep_row"))
    if size["n"] <= BROADCAST_ROWS:
        keys = F.broadcast(keys)
    found = rows.join(keys, F.col("digest") == F.col("hit"))
    stays = (F.col("file") == F.col("keep_file")) & (F.col("row") == F.col("keep_row"))
    kept = found.where(stays).select(F.col("digest").alias("kept_digest"), F.col("text").alias("kept_text"))
    if size["n"] <= BROADCAST_ROWS and size["bytes"] <= BROADCAST_BYTES:
        kept = F.broadcast(kept)
    return (found.where(~stays).join(kept, F.col("digest") == F.col("kept_digest"))
            .where(F.col("text") != F.col("kept_text")).select("digest"))


def deduplicate(spark: SparkSession, path: str, state: str | None = None, digest: Callable[[bytes], str] = sha256,
                id_col: str = "doc_id", text_col: str = "text", **options: str) -> DataFrame:
    """``doc_id, keep_id, group_size, kept, text_sha256`` of every row of the Parquet files at ``path``.

    Texts are equal when identical after lower-casing A-Z.  Of equal texts the row with the largest
    id stays; ``kept`` is true for that one row.

    Cases: null counts as an empty text and all empty texts are equal; a null id is smaller than
    any other (``keep_id`` is null where all ids of a group are); of repeated rows with the largest id
    one stays, the last by file and row; texts of any length are compared whole; other columns are
    not read, whatever their names; an empty table gives an empty result.
    """
    state = state or shared_path(spark, "exact")
    states = staged(follow(spark, path, state, digest, id_col, text_col, **options), "exact-keys")
    docs = spark.read.parquet(path)
    contents = located(docs, id_col, text_col, digest, content=True)
    collided = staged(unequal(contents, states.where("n > 1")).distinct(), "exact-collided")
    out = located(docs, id_col, text_col, digest).join(states, "digest")
    if collided.isEmpty():
        return out.select(*_decision())
    apart = F.col("digest") == F.col("split_digest")
    split = collided.select(F.col("digest").alias("split_digest"))
    # the whole text parts the rows of these digests
    whole = contents.join(split, apart, "left_semi")
    groups = whole.groupBy("text").agg(F.count("*").alias("n"), F.max(F.struct("doc_id", "file", "row")).alias("keep"))
    parted = whole.join(groups, "text")
    return out.join(split, apart, "left_anti").select(*_decision()).unionByName(parted.select(*_decision()))


def _decision() -> list[Column]:
    stays = functools.reduce(Column.__and__, [F.col("file") == F.col("keep.file"), F.col("row") == F.col("keep.row")])
    return ["doc_id", F.col("keep.doc_id").alias("keep_id"), F.col("n").alias("group_size"), stays.alias("kept"), "text_sha256"]
