"""Token counts from flat token files without an index.

A token file is nothing but little-endian uint16 ids, every document followed by the
end-of-document id. Files are read in blocks of ``block_tokens`` ids by as many tasks as
there are blocks; a block finds its separators in one vector comparison. What crosses a
block border is stitched by a prefix scan over one narrow row per block: the last
separator before the block (a running maximum) starts its first document, the separators
before it (a running sum) number its documents.

Rows: a document is the run before a separator, which may be empty; ids after a file's
last separator are one more document, not terminated. An empty file has no documents.
``write_token_files`` takes null text as empty; repeated rows and null ids are documents
of their own; extra columns are not read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from payflow.llm.common import shared_folder, stored
from payflow.llm.files import read_range, write_file

END_ID = 50256              # free in the 50,256-rank vocabulary
BLOCK_TOKENS = 1 << 20
FILE_TOKENS = 1 << 24


@lru_cache(maxsize=2)
def encoding(path: str | None):
    """Byte-level BPE of a ranks file; ``None`` is the public byte_bpe_50k vocabulary."""
    import base64

    import public_tokenizers
    import tiktoken
    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def write_token_files(docs: DataFrame, folder: str, ranks: str | None = None, end_id: int = END_ID,
                      file_tokens: int = FILE_TOKENS) -> DataFrame:
    """Tokenise all texts into flat files below ``folder``; returns (file, ordinal, doc_id),
    the order of the documents in each file."""
    job = uuid.uuid4().hex[:8]
    end = np.array([end_id], dtype="<u2").tobytes()

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        task, encode = TaskContext.get().partitionId(), encoding(ranks).encode_ordinary
        part, held, ids, size = 0, [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal part, size
            name = f"{job}-{task:06d}-{part:04d}.u16"
            write_file(f"{folder}/{name}", b"".join(held))
            out = pd.DataFrame({"file": name, "ordinal": np.arange(len(ids)), "doc_id": pd.array(ids, dtype="Int64")})
            part, size = part + 1, 0
            held.clear()
            ids.clear()
            return out

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"]):
                got = np.asarray(encode(text or ""), dtype="<u2").tobytes() + end
                held.append(got)
                ids.append(None if pd.isna(doc_id) else int(doc_id))
                size += len(got) // 2
                if size >= file_tokens:
                    yield flush()
        if ids:
            yield flush()

    return stored(docs.select("doc_id", "text").mapInPandas(write, "file string, ordinal long, doc_id long"), "order")


def scan(spark: SparkSession, folder: str, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """(file, ordinal, start, n_tokens, terminated) of every document in the token files below ``folder``."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", "*.u16")
             .schema("path string, modificationTime timestamp, length long, content binary").load(folder)
             .select("path", (F.col("length") / 2).cast("long").alias("ids")))
    blocks = (files.where("ids > 0")
              .select("path", "ids", F.explode(F.sequence(F.lit(0), F.floor((F.col("ids") - 1) / block_tokens).cast("int"))).alias("block"))
              .repartition("path", "block"))

    def separators(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, ids, block in zip(batch["path"], batch["ids"], batch["block"]):
                start = int(block) * block_tokens
                data = read_range(path, 2 * start, 2 * min(block_tokens, int(ids) - start))
                at = np.flatnonzero(np.frombuffer(data, dtype="<u2") == end_id) + start
                yield pd.DataFrame({"path": [path], "ids": [ids], "block": [block], "ends": [at]})

    found = stored(blocks.mapInPandas(separators, "path string, ids long, block int, ends array<long>"), "separators")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = (found.select("path", "block", F.size("ends").cast("long").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("last"))
               .select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"),
                       F.coalesce(F.max("last").over(before), F.lit(-1)).alias("carry")))
    rows = found.join(carried, ["path", "block"])
    file = F.substring_index("path", "/", -1).alias("file")
    inner = (rows.select(file, "base", "carry", "ends", F.posexplode("ends").alias("k", "end"))
             .withColumn("before", F.when(F.col("k") == 0, F.col("carry")).otherwise(F.expr("ends[k - 1]")))
             .select("file", (F.col("base") + F.col("k")).alias("ordinal"), (F.col("before") + 1).alias("start"),
                     (F.col("end") - F.col("before") - 1).alias("n_tokens"), F.lit(True).alias("terminated")))
    # ids after the last separator: the file's last block knows it
    last = (F.col("block") + 1) * F.lit(block_tokens) >= F.col("ids")
    open_end = F.greatest(F.col("carry"), F.coalesce(F.try_element_at("ends", F.lit(-1)), F.lit(-1)))
    tail = (rows.where(last).withColumn("from", open_end).where(F.col("from") < F.col("ids") - 1)
            .select(file, (F.col("base") + F.size("ends")).alias("ordinal"), (F.col("from") + 1).alias("start"),
                    (F.col("ids") - F.col("from") - 1).alias("n_tokens"), F.lit(False).alias("terminated")))
    return inner.unionByName(tail)


def document_token_counts(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, file, ordinal, start): all texts written as token files, then counted by ``scan``."""
    folder = shared_folder(docs.sparkSession, "tokens")
    order = write_token_files(docs, folder, ranks)
    if order.isEmpty():
        return docs.sparkSession.createDataFrame([], "doc_id long, n_tokens long, file string, ordinal long, start long")
    return (scan(docs.sparkSession, folder).join(order, ["file", "ordinal"])
            .select("doc_id", "n_tokens", "file", "ordinal", "start"))
