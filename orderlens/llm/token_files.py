"""Token-id files: documents compressed one by one with a shared zstandard dictionary.

A dictionary is trained on the serialized ids of a bounded sample of documents and stored
beside the data.  Documents are compressed where they are; their frames are sorted by doc_id
in range partitions and written in blocks: a block holds the zstandard frames of its documents
end to end, the offset of each, and the hash of the dictionary it needs.  One short document is
read by its block and offset alone, without touching its neighbours.  Blocks are rows of a Parquet table, so that any store
Spark reaches will do and Spark's commit protocol covers lost executors.

Ids are stored as unsigned 16-bit numbers where the vocabulary allows, else 32-bit.

Defined results: a null or empty text is the end id alone; documents of equal doc_id follow
each other in any order; a missing doc_id sorts first and is read back as null; an empty
table gives files without blocks; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orderlens.llm.chunks import ChunkEncoder
from orderlens.llm.common import hash_partitions, input_partitions, stored

END_ID = 1
LEVEL = 1
#: Documents that the dictionary is trained on, at most; those with the smallest id hashes.
SAMPLE_DOCS = 600
#: Bytes of each that are used for training, and the dictionary's size.
SAMPLE_BYTES, DICTIONARY_BYTES = 8_192, 65_536
BLOCK_DOCS, BLOCK_BYTES = 256, 1 << 20

BLOCK_SCHEMA = (
    "part int, block int, first_token bigint, dictionary string, doc_ids array<bigint>, "
    "named array<boolean>, offsets array<bigint>, n_tokens array<bigint>, payload binary"
)


def _serial(ids: bytes, end_id: int, dtype: str) -> bytes:
    return np.append(np.frombuffer(ids, dtype="<u4"), np.uint32(end_id)).astype(dtype).tobytes()


def train_dictionary(docs: DataFrame, vocabulary: str, end_id: int, dtype: str) -> bytes:
    """The shared dictionary, raw content if the sample is too small to train on."""
    ids = docs.select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS)
    sample = docs.join(F.broadcast(ids), "doc_id").select("doc_id", F.substring("text", 1, SAMPLE_BYTES).alias("text"))
    encoder = ChunkEncoder(vocabulary, False)
    # repeated rows of the chosen ids aside, SAMPLE_DOCS texts
    texts = [r["text"] for r in sample.groupBy("doc_id").agg(F.min("text").alias("text")).orderBy("doc_id").collect()]
    samples = [_serial(ids, end_id, dtype)[:SAMPLE_BYTES] for ids in encoder.encode(texts)]
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[:DICTIONARY_BYTES] or b"\0" * 8


def dictionary_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def write_token_files(docs: DataFrame, path: str, vocabulary: str, end_id: int = END_ID,
                      vocabulary_size: int = 49_408) -> None:
    """Write ``docs`` (doc_id, text) under ``path``: ``dictionary``, ``blocks`` and ``parts``."""
    spark = docs.sparkSession
    dtype = "<u2" if max(vocabulary_size, end_id + 1) <= 1 << 16 else "<u4"
    data = train_dictionary(docs, vocabulary, end_id, dtype)
    name = dictionary_hash(data)
    # as an Arrow table: a list of rows would start Python workers of its own
    spark.createDataFrame(pa.table({"hash": [name], "data": [data], "dtype": [dtype]})) \
        .coalesce(1).write.parquet(f"{path}/dictionary")

    def encode(batches):
        packer = zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(data))
        encoder = ChunkEncoder.shared(vocabulary, False)
        for batch in batches:
            ids = encoder.encode(batch.pop("text"))
            yield batch.astype({"doc_id": "Int64"}).assign(
                n_tokens=[len(raw) // 4 + 1 for raw in ids],
                frame=[packer.compress(_serial(raw, end_id, dtype)) for raw in ids],
            )

    def gather(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        block, first, held, ids, frames, tokens = 0, 0, 0, [], [], []

        def close():
            sizes = np.cumsum([0, *map(len, frames)])
            return pd.DataFrame({
                "part": [part], "block": [block], "first_token": [first], "dictionary": [name],
                "doc_ids": [[i or 0 for i in ids]], "named": [[i is not None for i in ids]],
                "offsets": [sizes.tolist()], "n_tokens": [tokens],
                "payload": [b"".join(frames)],
            })

        for batch in batches:
            for doc_id, n, frame in zip(batch["doc_id"].astype(object), batch["n_tokens"].tolist(), batch["frame"]):
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                tokens.append(n)
                frames.append(frame)
                held += len(frame)
                if len(ids) >= BLOCK_DOCS or held >= BLOCK_BYTES:
                    yield close()
                    block, first, held = block + 1, first + sum(tokens), 0
                    ids, frames, tokens = [], [], []
        if ids:
            yield close()

    # texts stay where they are: their frames, a fraction in size, are what is sorted
    framed = stored(docs.select("doc_id", "text").mapInPandas(encode, "doc_id bigint, n_tokens bigint, frame binary"), "frames")
    n = max(hash_partitions(spark), input_partitions(docs))
    (
        framed.repartitionByRange(n, F.col("doc_id").asc_nulls_first())
        .sortWithinPartitions(F.col("doc_id").asc_nulls_first())
        .mapInPandas(gather, BLOCK_SCHEMA).write.parquet(f"{path}/blocks")
    )
    blocks = spark.read.parquet(f"{path}/blocks")
    sizes = blocks.groupBy("part").agg(
        F.sum(F.aggregate("n_tokens", F.lit(0).cast("bigint"), lambda a, x: a + x)).alias("n")
    )
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    # one row per partition of the sort
    sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start")) \
        .coalesce(1).write.parquet(f"{path}/parts")


def read_token_files(spark: SparkSession, path: str, only: list[int] | None = None,
                     with_ids: bool = False) -> DataFrame:
    """Decoded documents: doc_id, start, n_tokens, ids_crc32, and the ids if asked for.

    ``only`` names documents; other frames of their blocks are not decompressed.
    """
    saved = spark.read.parquet(f"{path}/dictionary").first()
    data, dtype = bytes(saved["data"]), saved["dtype"]
    if dictionary_hash(data) != saved["hash"]:
        raise ValueError("the dictionary does not match its hash")
    wanted = None if only is None else frozenset(only)
    blocks = spark.read.parquet(f"{path}/blocks")
    if only is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*map(F.lit, only))))

    def run(batches):
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data))
        for batch in batches:
            for b in batch.itertuples(index=False):
                if b.dictionary != saved["hash"]:
                    raise ValueError(f"block {b.part}/{b.block} needs dictionary {b.dictionary}")
                start, rows = b.first_token, []
                for i, (doc_id, named, n) in enumerate(zip(b.doc_ids, b.named, b.n_tokens)):
                    doc_id = int(doc_id) if named else None
                    if wanted is None or doc_id in wanted:
                        frame = b.payload[b.offsets[i]:b.offsets[i + 1]]
                        ids = np.frombuffer(reader.decompress(frame), dtype=dtype).astype("<u4")
                        rows.append((doc_id, b.part, start, len(ids), zlib.crc32(ids.tobytes()),
                                     ids.tolist() if with_ids else None))
                    start += int(n)
                out = pd.DataFrame(rows, columns=["doc_id", "part", "at", "n_tokens", "ids_crc32", "ids"])
                yield out.astype({"doc_id": "Int64"})

    schema = "doc_id bigint, part int, at bigint, n_tokens bigint, ids_crc32 bigint, ids array<bigint>"
    found = blocks.mapInPandas(run, schema).join(
        F.broadcast(spark.read.parquet(f"{path}/parts")), "part"
    )
    columns = ["doc_id", (F.col("part_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32"]
    return found.select(*columns, *["ids"] * with_ids)
