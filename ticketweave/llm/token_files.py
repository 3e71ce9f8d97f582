"""Token ids on disk: fixed-size blocks of ids cut into bit or byte planes, each plane compressed with zstandard.

A folder holds ``blocks`` (one row per block: its planes and the pieces of documents in it) and ``shards`` (one row per
shard with its first id's position). A shard is a range of document ids, so shards and their blocks follow document order;
the block index says where each document's ids lie, and a reader fetches just the blocks it needs. Both are Parquet tables,
written by Spark's committers, so a task that runs again leaves no half-written file, on any store that Spark can reach.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ticketweave.llm.common import small_batches

BLOCK_IDS, END_ID, LEVEL = 1 << 16, 2, 1
_BLOCK = "shard long, block long, first_id long, n_ids long, width int, mode string, planes array<binary>, pieces array<struct<doc_id:{id},doc_start:long,doc_tokens:long,offset:long,length:long>>"


def to_planes(ids: np.ndarray, mode: str) -> tuple[int, list[bytes]]:
    """Width in bits and the planes, lowest first; only as many as the largest id needs."""
    import zstandard

    width = max(1, int(ids.max()).bit_length()) if len(ids) else 1
    lanes = ids.astype("<u4").view(np.uint8).reshape(-1, 4)
    if mode == "byte":
        raw = [lanes[:, b].tobytes() for b in range(-(-width // 8))]
    else:
        bits = np.unpackbits(lanes, axis=1, bitorder="little")[:, :width]
        raw = [p.tobytes() for p in np.packbits(np.ascontiguousarray(bits.T), axis=1, bitorder="little")]
    squeeze = zstandard.ZstdCompressor(level=LEVEL).compress
    return width, [squeeze(p) for p in raw]


def from_planes(planes: list[bytes], n: int, mode: str, start: int = 0, stop: int | None = None) -> np.ndarray:
    """Ids ``start`` to ``stop`` of a block of ``n``; only that part of the planes is turned back."""
    import zstandard

    expand, stop = zstandard.ZstdDecompressor().decompress, n if stop is None else stop
    out, first = np.zeros(stop - start, dtype="<u4"), start // 8
    for b, plane in enumerate(planes):
        raw = np.frombuffer(expand(bytes(plane)), dtype=np.uint8)
        if mode == "byte":
            out |= raw[start:stop].astype("<u4") << (8 * b)
        else:
            bits = np.unpackbits(raw[first:-(-stop // 8)], bitorder="little")[start - 8 * first:stop - 8 * first]
            out |= bits.astype("<u4") << b
    return out


def _write_blocks(path: str, size: int, mode: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from ticketweave.llm.tokens import encoder

        encode, shard = encoder(path).encode_batch, TaskContext.get().partitionId()
        held, pieces, used, block, kind = [], [], 0, 0, None

        def flush() -> pa.RecordBatch:
            ids = np.concatenate(held)
            width, planes = to_planes(ids, mode)
            piece = pa.list_(pa.struct([("doc_id", kind), *[(c, pa.int64()) for c in ("doc_start", "doc_tokens", "offset", "length")]]))
            longs = [pa.array([x], pa.int64()) for x in (shard, block, block * size, len(ids))]
            return pa.RecordBatch.from_arrays(
                [*longs, pa.array([width], pa.int32()), pa.array([mode]), pa.array([planes], pa.list_(pa.binary())), pa.array([pieces], piece)],
                names=["shard", "block", "first_id", "n_ids", "width", "mode", "planes", "pieces"])

        for batch in batches:
            kind = batch.schema.field(0).type
            encoded, bounds = encode(batch.column(1), end_id)
            for doc, low, high in zip(batch.column(0).to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist()):
                total, at = high - low, 0
                while at < total:
                    take = min(size - used, total - at)
                    held.append(encoded[low + at:low + at + take])
                    pieces.append((doc, at, total, used, take))
                    used, at = used + take, at + take
                    if used == size:
                        yield flush()
                        held, pieces, used, block = [], [], 0, block + 1
        if held:
            yield flush()

    return run


def write_token_files(
    docs: DataFrame, folder: str, tokenizer: str, key: str = "doc_id", text: str = "text", block_ids: int = BLOCK_IDS, mode: str = "bit", end_id: int = END_ID,
) -> None:
    """Encode every whole text, append ``end_id``, and write the ids in ascending ``key`` order, null first, ties by text.

    Null and empty texts are ``end_id`` alone; rows that repeat are written each; an empty table gives empty tables.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"))
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The length spreads rows that repeat one key; a hot key would otherwise be one shard.
    ranged = rows.repartitionByRange(parts, "doc_id", F.length("text")).sortWithinPartitions("doc_id", F.length("text"), "text")
    ranged.mapInArrow(_write_blocks(tokenizer, block_ids, mode, end_id), _BLOCK.format(id=docs.schema[key].dataType.simpleString())).write.parquet(f"{folder}/blocks")
    blocks = docs.sparkSession.read.parquet(f"{folder}/blocks")
    shards = blocks.groupBy("shard").agg(F.sum("n_ids").alias("n_ids"))
    earlier = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row per shard
    shards.withColumn("shard_start", F.coalesce(F.sum("n_ids").over(earlier), F.lit(0))).write.parquet(f"{folder}/shards")


def read_token_files(spark: SparkSession, folder: str, which: str = "all") -> DataFrame:
    """One row per piece of a document in a block: doc_id, start (ids of all documents before its own), piece_start, doc_tokens, ids.

    ``which``: all pieces, only ``whole`` documents, or only pieces of documents ``cut`` by a block's edge. Cut ones stand at
    a block's ends and whole ones between them, so that no more of a block is turned back than is asked for.
    """
    blocks, shards = spark.read.parquet(f"{folder}/blocks"), spark.read.parquet(f"{folder}/shards")
    kind = blocks.schema["pieces"].dataType.elementType["doc_id"].dataType.simpleString()
    at = blocks.join(shards.select("shard", "shard_start"), "shard").withColumn("block_start", F.col("shard_start") + F.col("first_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = {c: batch.column(i) for i, c in enumerate(batch.schema.names)}
            for i in range(batch.num_rows):
                pieces = rows["pieces"][i].values
                doc_start, total, offset, length = (pieces.field(c).to_numpy(zero_copy_only=False) for c in ("doc_start", "doc_tokens", "offset", "length"))
                wanted = np.arange(len(length)) if which == "all" else np.flatnonzero((length < total) == (which == "cut"))
                if not len(wanted):
                    continue
                spans = [(offset[k], offset[k] + length[k]) for k in wanted] if which == "cut" else [(offset[wanted[0]], offset[wanted[-1]] + length[wanted[-1]])]
                planes, n, mode = rows["planes"][i].as_py(), rows["n_ids"][i].as_py(), rows["mode"][i].as_py()
                ids = np.concatenate([from_planes(planes, n, mode, int(a), int(b)) for a, b in spans])
                bounds = np.concatenate([[0], np.cumsum(length[wanted])]).astype("int32")
                lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(ids.astype("int32")))
                start = rows["block_start"][i].as_py() + offset[wanted] - doc_start[wanted]
                yield pa.RecordBatch.from_arrays(
                    [pieces.field("doc_id").take(pa.array(wanted)), pa.array(start), pa.array(doc_start[wanted]), pa.array(total[wanted]), lists], names=["doc_id", "start", "piece_start", "doc_tokens", "ids"])

    read = at.select("block_start", "n_ids", "mode", "planes", "pieces")
    return read.mapInArrow(run, f"doc_id {kind}, start long, piece_start long, doc_tokens long, ids array<int>")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents from a folder: doc_id, start, n_tokens, ids; only those that lie in several blocks meet in a shuffle."""
    cut = read_token_files(spark, folder, "cut").groupBy("doc_id", "start").agg(F.first("doc_tokens").alias("n_tokens"), F.sort_array(F.collect_list(F.struct("piece_start", "ids"))).alias("parts"))
    joined = cut.select("doc_id", "start", "n_tokens", F.flatten(F.transform("parts", lambda p: p["ids"])).alias("ids"))
    whole = read_token_files(spark, folder, "whole").select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), "ids")
    return whole.unionByName(joined)
