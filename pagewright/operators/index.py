"""The index: what is to be embedded, upserts, keyword postings, and checks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from pagewright.functions import text as T

Embedder = Callable[[list[str]], np.ndarray]


def pending(chunks: DataFrame, index: DataFrame, model: str) -> DataFrame:
    """Chunks that the index lacks in their present wording, with their hash."""
    hashed = chunks.withColumn("hash", T.content_hash(F.col("text"), model))
    return hashed.join(index.select("chunk_id", "hash").where("hash IS NOT NULL").distinct(), ["chunk_id", "hash"], "left_anti")


def stale(chunks: DataFrame, index: DataFrame) -> DataFrame:
    """Index rows whose chunk is gone."""
    return index.join(chunks.select("chunk_id").distinct(), "chunk_id", "left_anti")


def upsert(index: DataFrame, fresh: DataFrame, gone: DataFrame | None = None) -> DataFrame:
    """The index with fresh rows in place of those of their chunk_id, and without gone ones."""
    kept = index.join(fresh.select("chunk_id"), "chunk_id", "left_anti")
    if gone is not None:
        kept = kept.join(gone.select("chunk_id"), "chunk_id", "left_anti")
    return kept.unionByName(fresh, allowMissingColumns=True)


def hashed_words(dim: int) -> Embedder:
    """An embedder without a model: signed word hashes, for tests and offline use; it claims no quality."""

    def embed(texts: list[str]) -> np.ndarray:
        import hashlib
        import re

        out = np.zeros((len(texts), dim), dtype=np.float32)
        for k, text in enumerate(texts):
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                out[k, h % dim] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm == 0, 1, norm)

    return embed


def embed(chunks: DataFrame, embedder: Embedder, batch: int = 32, retries: int = 3) -> DataFrame:
    """``chunks`` with their vector, embedded in batches; a batch is tried again, and its count checked."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            vectors: list[np.ndarray] = []
            for at in range(0, len(frame), batch):
                texts = frame["text"].iloc[at : at + batch].tolist()
                for turn in range(retries):
                    try:
                        made = embedder(texts)
                        break
                    except OSError:
                        if turn + 1 == retries:
                            raise
                if len(made) != len(texts):
                    raise ValueError(f"{len(texts)} texts, {len(made)} vectors")
                vectors += [*np.asarray(made, dtype=np.float32)]
            yield frame.assign(vector=vectors)

    rows = chunks.drop("vector")
    return rows.mapInPandas(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", vector array<float>")


#: Buckets that stored postings are parted into by their term.
BUCKETS = 64


def postings(chunks: DataFrame) -> DataFrame:
    """(term, chunk_id, tf): how often each token stands in each chunk."""
    return (
        chunks.select("chunk_id", F.explode(T.tokens(F.col("text"))).alias("term")).groupBy("term", "chunk_id").agg(F.count("*").alias("tf"))
    )


def term_stats(posted: DataFrame) -> DataFrame:
    return posted.groupBy("term").agg(F.count("*").alias("df"))


def doc_stats(chunks: DataFrame) -> DataFrame:
    return chunks.select("chunk_id", F.size(T.tokens(F.col("text"))).alias("len"))


def write_keyword_index(chunks: DataFrame, path: str) -> None:
    """Store what keyword search needs of the chunks: postings by term's hash, lengths, and their sums, one version each.

    Searches read the buckets of their terms only.
    """
    posted = postings(chunks).join(doc_stats(chunks), "chunk_id").withColumn("bucket", F.pmod(F.xxhash64("term"), F.lit(BUCKETS)).cast("int"))
    posted.repartition("bucket").sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    doc_stats(chunks).agg(F.count("*").alias("n"), F.avg("len").alias("mean")).write.mode("overwrite").parquet(f"{path}/stats")


def read_keyword_index(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame] | None:
    """(postings with lengths, one row of sums) as stored; null where there is no whole one, which is no error."""
    from pagewright.sources.store import exists

    if not (exists(spark, f"{path}/postings/_SUCCESS") and exists(spark, f"{path}/stats/_SUCCESS")):
        return None
    return spark.read.parquet(f"{path}/postings"), spark.read.parquet(f"{path}/stats")


def verify(index: DataFrame, dim: int) -> DataFrame:
    """One row of what is wrong with an index, over all its rows."""
    v = F.col("vector")
    norm = F.aggregate(F.coalesce(v, F.array().cast("array<float>")), F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    return index.agg(
        F.count("*").alias("rows"),
        (F.count("*") - F.count_distinct("chunk_id")).alias("repeated_ids"),
        F.count_if(v.isNull()).alias("no_vector"),
        F.count_if(v.isNotNull() & (F.size(v) != dim)).alias("wrong_length"),
        F.count_if(F.exists(v, lambda x: F.isnan(x))).alias("with_nan"),
        F.count_if((F.size(v) == dim) & (norm == 0)).alias("zero_length"),
        F.count_if(F.col("entry_date").isNull() | (F.col("entry_date") == "")).alias("undated"),
        F.count_if(F.col("hash").isNull()).alias("no_hash"),
    )
