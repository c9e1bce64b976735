"""Token-id output: each document's ids are compressed on their own with a zstandard dictionary trained on serialised id
arrays, and kept in blocks with an offset index, so that one short document is read without its neighbours.

Format (version 1). A Parquet data set, uncompressed, one row a block of consecutive documents in ascending id order:
``part`` and ``block`` give the order, ``first_token`` the tokens of the part before the block, ``dictionary`` the
SHA-256 of the dictionary, ``doc_ids`` the ids, ``offsets`` where each document's frame begins in ``frames`` (and, last,
where the frames end), ``n_tokens`` each document's number of ids. A frame holds unsigned 32-bit little-endian ids. The
dictionary is beside it as a data set of one row. Statistics on ``least_id`` and ``most_id`` let a reader skip blocks.

Spark's own reader and committer do the input and output, so the format works on any store, and a lost executor's
blocks are written again. Null and empty texts are the end id alone. Rows without id come first. Repeated rows are kept.
An empty table makes an empty data set. Other columns than ``doc_id`` and ``text`` are not read. The dictionary is trained on
a bounded sample: about ``SAMPLE`` distinct documents by a hash of id and text (so rows without id, and repeated rows, don't
come together), of each the ids of one window of ``WINDOW`` characters at most, ``PIECE`` bytes of them. So the driver is
sent 32 MB at most, however many or long the documents are. Documents with equal ids are in order of their texts. A task
holds the ids of a slice of about 1 MB of texts (or of one longer text), and a block, at a time.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from factledger.llm.common import SLOTS, column, drawn, new_path, slices, texts_of
from factledger.llm.encode import encoder

DICTIONARY_BYTES = 64 * 1024
SAMPLE, PIECE = 2000, 16 * 1024  # documents that the dictionary is trained on, about, and bytes of ids of each at most
WINDOW = 40_000  # characters of a sampled document that are encoded, at a place drawn from its text
BLOCK_BYTES = 1_000_000  # of frames in a block
LEVEL = 3
END = array("I", [0]).tobytes()

BLOCK_DDL = "part int, block int, first_token long, dictionary string, least_id long, most_id long, doc_ids array<bigint>, offsets array<bigint>, n_tokens array<bigint>, frames binary"


def train_dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; with too little to train on, the samples' own beginning (raw content), which is empty for
    none."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES]


def sampled_ids(docs: DataFrame, count: int, path: str, kind: str) -> list[bytes]:
    """The ids of a window of each sampled document: at most twice ``SAMPLE`` times ``PIECE`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = encoder(path, kind).ids
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([pa.array([(ids(x) + END)[-PIECE:] for x in texts_of(batch)], pa.binary())], ["ids"])

    rate = int(min(1.0, SAMPLE / max(1, count)) * SLOTS)
    chosen = drawn(docs, F.lit(rate), ["doc_id", "text"])
    room = F.greatest(F.char_length("text") - WINDOW, F.lit(0)) + 1
    window = F.substring("text", F.pmod(F.xxhash64("text"), room).cast("int") + 1, F.lit(WINDOW))
    found = chosen.select(window.alias("text")).mapInArrow(run, "ids binary").limit(2 * SAMPLE).toArrow()
    return sorted(found.column("ids").to_pylist())  # in an order that hangs on them alone


def write(docs: DataFrame, target: str, path: str, kind: str = "byte") -> str:
    """Encode ``doc_id``, ``text`` and write the data set to ``target``; gives the dictionary's SHA-256."""
    spark = docs.sparkSession
    count = docs.count()
    samples = sampled_ids(docs, count, path, kind)
    trained = train_dictionary(samples)
    name = hashlib.sha256(trained).hexdigest()
    spark.createDataFrame([(name, bytearray(trained))], "sha256 string, content binary").coalesce(1).write.parquet(f"{target}/dictionary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = encoder(path, kind).many
        press = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(trained), write_content_size=True)
        part, block, total = TaskContext.get().partitionId(), 0, 0
        names = [x.split()[0] for x in BLOCK_DDL.split(", ")]
        doc_ids, frames, sizes, held = [], [], [], 0

        def done() -> pa.RecordBatch:
            offsets = np.cumsum([0, *map(len, frames)])
            known = [x for x in doc_ids if x is not None]
            row = [part, block, total, name, min(known, default=None), max(known, default=None), doc_ids, offsets.tolist(), sizes, b"".join(frames)]
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)

        for batch in slices(batches):
            for doc, raw in zip(column(batch, "doc_id").to_pylist(), many(texts_of(batch), END), strict=True):
                doc_ids.append(doc)
                frames.append(press.compress(raw))
                sizes.append(len(raw) // 4)
                held += len(frames[-1])
                if held >= BLOCK_BYTES:
                    yield done()
                    block, total = block + 1, total + sum(sizes)
                    doc_ids, frames, sizes, held = [], [], [], 0
        if doc_ids:
            yield done()

    ordered = docs.select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    ordered.mapInArrow(run, BLOCK_DDL).write.option("compression", "none").parquet(f"{target}/blocks")
    return name


def decode_block(offsets: list[int], frames: bytes, dictionary: bytes, which: list[int] | None = None) -> list[bytes]:
    """The ids of the block's documents, or of those at the positions given."""
    open_ = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary))
    which = range(len(offsets) - 1) if which is None else which
    return [open_.decompress(frames[offsets[i] : offsets[i + 1]]) for i in which]


def dictionary(spark: SparkSession, source: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{source}/dictionary").first()
    return row.sha256, bytes(row.content)


def read(spark: SparkSession, source: str) -> DataFrame:
    """``doc_id``, ``start`` (ids of all documents before it), ``n_tokens``, ``ids`` of each document of a data set."""
    name, trained = dictionary(spark, source)
    blocks = spark.read.parquet(f"{source}/blocks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                if row["dictionary"] != name:
                    raise ValueError(f"block {row['part']}/{row['block']} was written with another dictionary")
                n = np.array(row["n_tokens"], np.int64)
                ids = decode_block(row["offsets"], row["frames"], trained)
                start = row["first_token"] + np.cumsum(n) - n
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), row["part"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(start), pa.array(n), pa.array(ids, pa.binary())], ["part", "doc_id", "start", "n_tokens", "ids"])

    docs = blocks.select("part", "dictionary", "block", "first_token", "doc_ids", "offsets", "n_tokens", "frames").mapInArrow(run, "part int, doc_id long, start long, n_tokens long, ids binary")
    # One row for each part: the parts are the tasks that wrote, so this is small however many documents there are.
    sizes = blocks.select("part", F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x).alias("n")).groupBy("part").agg(F.sum("n").alias("n"))
    before = sizes.select("part", F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return docs.join(F.broadcast(before), "part").select("doc_id", (F.col("start") + F.col("before")).alias("start"), "n_tokens", "ids")


def fetch(spark: SparkSession, source: str, doc_id: int) -> list[bytes]:
    """The ids of one document, by the index: blocks are skipped by their statistics and only its frame is opened."""
    _, trained = dictionary(spark, source)
    rows = spark.read.parquet(f"{source}/blocks").where((F.col("least_id") <= doc_id) & (F.col("most_id") >= doc_id)).collect()
    return [x for r in rows for x in decode_block(r.offsets, bytes(r.frames), trained, [i for i, d in enumerate(r.doc_ids) if d == doc_id])]


def new_target(spark: SparkSession) -> str:
    """A place for a data set that goes when the process ends."""
    return new_path(spark, "tokens")


def checksums(ids: DataFrame) -> DataFrame:
    """``doc_id``, ``start``, ``n_tokens`` and the CRC-32 of the ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            crc = pa.array([zlib.crc32(x) for x in column(batch, "ids").to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*[column(batch, x) for x in ("doc_id", "start", "n_tokens")], crc], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return ids.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
