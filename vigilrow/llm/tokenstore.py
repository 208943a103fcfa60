"""Token ids on disk: one compressed wavelet-matrix file for each shard.

Documents are put in id order over many tasks, encoded, and cut into shards of
about ``SHARD_TOKENS`` ids (a long document may span shards).  A shard is one row of one file: the
wavelet matrix of its ids (``wavelet.WaveletMatrix``), and which documents lie in it.
From the file alone one can read any id, count an id up to any place, and find
its occurrences.

Cases: a null or empty text is its end id alone.  Repeated rows are stored each;
rows with one id are stored in the order of their texts; rows without an id
come first.  An empty table gives no shards.  Other columns are passed over.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vigilrow.llm import tokens
from vigilrow.llm.common import arrow_schema, map_rows, modest_batches
from vigilrow.llm.wavelet import WaveletMatrix
from vigilrow.session import ensure_checkpoint_dir, materialize

SHARD_TOKENS = 2_000_000
#: part and seq order the shards; before: ids of the same part in earlier shards;
#: doc_ids, starts (place in the document) and lengths: the pieces in the shard.
SHARD = "part int, seq int, before long, n_tokens long, doc_ids array<long>, starts array<long>, lengths array<long>, doc_tokens array<long>, wavelet binary"


def write(docs: DataFrame, encoder: Callable[[], tokens.Encoder], end_id: int, path: str | None = None, doc_id: str = "doc_id",
          text: str = "text", shard_tokens: int = SHARD_TOKENS) -> str:
    """Encode whole texts, add the end id, and write the shard files.  Returns their folder."""
    spark = docs.sparkSession
    path = path or f"{ensure_checkpoint_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    schema = arrow_schema(SHARD)

    def run(batches):
        encode, part = encoder(), TaskContext.get().partitionId()
        levels = max(encode.tokenizer.get_vocab_size() - 1, end_id, 1).bit_length()
        held, size, seq, before = [], 0, 0, 0

        def shard():
            nonlocal held, size, seq, before
            ids = np.concatenate([h[4] for h in held])
            row = {
                "part": [part], "seq": [seq], "before": [before], "n_tokens": [len(ids)], "doc_ids": [[h[0] for h in held]],
                "starts": [[h[1] for h in held]], "lengths": [[h[2] for h in held]], "doc_tokens": [[h[3] for h in held]],
                "wavelet": [WaveletMatrix.of(ids, levels).to_bytes()],
            }
            held, size, seq, before = [], 0, seq + 1, before + len(ids)
            return pa.RecordBatch.from_pydict(row, schema=schema)

        for batch in batches:
            block, ends = encode.column(batch.column(1), end_id)
            for doc, first, last in zip(batch.column(0).to_pylist(), [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                ids, start = block[first:last], 0
                while start < len(ids):
                    length = min(len(ids) - start, shard_tokens - size)
                    held.append((doc, start, length, len(ids), ids[start : start + length]))
                    start, size = start + length, size + length
                    if size == shard_tokens:
                        yield shard()
        if held:
            yield shard()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    modest_batches(spark)
    # Rows of one id stay together: the range is on the id alone.
    rows = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    rows.mapInArrow(run, SHARD).write.option("maxRecordsPerFile", 1).option("compression", "none").parquet(path)
    return path


def shards(spark: SparkSession, path: str) -> DataFrame:
    """The shard rows with ``first_token``: ids before the shard in the whole store."""
    found = spark.read.schema(SHARD).parquet(path)
    # One row for each writing task.
    parts = found.groupBy("part").agg(F.sum("n_tokens").alias("part_tokens"))
    parts = parts.select("part", (F.sum("part_tokens").over(Window.orderBy("part")) - F.col("part_tokens")).alias("part_start"))
    return found.join(F.broadcast(parts), "part").withColumn("first_token", F.col("part_start") + F.col("before")).drop("part_start")


PIECE = "doc_id long, part int, seq int, piece_start long, doc_tokens long, first long, ids binary"


def pieces(spark: SparkSession, path: str, sums: bool = False) -> DataFrame:
    """What the files hold: doc_id, part, seq, piece_start (in the document), doc_tokens, first (place of the piece in the store), ids.

    With ``sums``, a whole document has its ids' checksum, ids_crc32, instead of its ids.
    """

    def make():
        def work(batch: pa.RecordBatch) -> dict:
            out = {n: [] for n in ("doc_id", "part", "seq", "piece_start", "doc_tokens", "first", "ids", *(["ids_crc32"] if sums else []))}
            for row in range(batch.num_rows):
                get = {n: batch.column(n)[row].as_py() for n in ("part", "seq", "first_token", "doc_ids", "starts", "lengths", "doc_tokens")}
                values = WaveletMatrix.from_bytes(batch.column("wavelet")[row].as_buffer()).values().astype("<u4")
                ends = np.cumsum(get["lengths"])
                n = len(ends)
                out["doc_id"] += get["doc_ids"]
                out["part"] += [get["part"]] * n
                out["seq"] += [get["seq"]] * n
                out["piece_start"] += get["starts"]
                out["doc_tokens"] += get["doc_tokens"]
                out["first"] += (get["first_token"] + ends - get["lengths"]).tolist()
                for end, length, tokens_in_all in zip(ends.tolist(), get["lengths"], get["doc_tokens"], strict=True):
                    ids, summed = values[end - length : end], sums and length == tokens_in_all
                    out["ids"].append(None if summed else ids.tobytes())
                    if sums:
                        out["ids_crc32"].append(zlib.crc32(ids) if summed else None)
            return out

        return work

    return map_rows(shards(spark, path), make, PIECE + (", ids_crc32 long" if sums else ""), rows=1)


def digest(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every stored document, read back from the files.

    Documents that lie in one shard are done there; only those that span shards are gathered.
    """
    found = pieces(spark, path, sums=True).select(
        "doc_id", "piece_start", "doc_tokens", (F.col("first") - F.col("piece_start")).alias("start"),
        F.col("ids_crc32").isNotNull().alias("whole"), "ids_crc32", "ids",
    )
    # Written once, so the files are decoded once; ids are kept for documents across shards only.
    found = materialize(found, "token-digest")
    single = found.where("whole").select("doc_id", "start", F.col("doc_tokens").alias("n_tokens"), "ids_crc32")
    # Pieces of one stored document share the place of its first id.
    cut = found.where("NOT whole").select("doc_id", "piece_start", "doc_tokens", "start", "ids")

    def join(key, part):
        part = part.sort_values("piece_start")
        crc = 0
        for block in part["ids"]:
            crc = zlib.crc32(block, crc)
        part = part.iloc[:1][["doc_id", "start", "doc_tokens"]].rename(columns={"doc_tokens": "n_tokens"})
        part["doc_id"] = part["doc_id"].astype("Int64")
        return part.assign(ids_crc32=crc)

    spanning = cut.groupBy("start").applyInPandas(join, "doc_id long, start long, n_tokens long, ids_crc32 long")
    return single.unionByName(spanning)
