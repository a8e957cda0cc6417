"""Exact nearest vectors and an offline embedder."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..tables import importable


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 5, block: int = 4096) -> DataFrame:
    """query_id, rank, vec_id, distance: the k nearest by Euclidean distance, ties by id; vectors: vec_id, embedding; queries: query_id, embedding.

    The stated query set goes to every task in blocks of `block` queries, one pass over the vectors a block; null embeddings are left out. Each batch of vectors is
    compared as a whole; of a task only the k best a query go on, and the final rank cuts to k before it shuffles."""
    importable(vectors.sparkSession)
    asked = queries.select("query_id", "embedding").where("embedding is not null")
    parts = max(1, -(-asked.count() // block))
    out = [_nearest(vectors, asked.where(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i) if parts > 1 else asked, k) for i in range(parts)]
    return reduce(DataFrame.unionByName, out)


def _nearest(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    rows = queries.collect()
    ids = np.asarray([r.query_id for r in rows], np.int64)
    asked = vectors.sparkSession.sparkContext.broadcast((ids, np.asarray([r.embedding for r in rows], np.float64).reshape(len(rows), -1) if rows else np.zeros((0, 0))))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        qid, q = asked.value
        dist, found = [np.zeros(0)] * len(qid), [np.zeros(0, np.int64)] * len(qid)
        for pdf in batches:
            pdf = pdf[pdf["embedding"].notna()]
            if pdf.empty:
                continue
            x, vid = np.stack(pdf["embedding"].to_numpy()).astype(np.float64), pdf["vec_id"].to_numpy()
            for i in range(len(qid)):
                d, v = np.append(dist[i], np.sqrt(((x - q[i]) ** 2).sum(axis=1))), np.append(found[i], vid)
                top = np.lexsort((v, d))[:k]
                dist[i], found[i] = d[top], v[top]
        if len(qid):
            yield pd.DataFrame({"query_id": np.repeat(qid, [len(v) for v in found]), "vec_id": np.concatenate(found), "distance": np.concatenate(dist)})

    near = vectors.select("vec_id", "embedding").mapInPandas(best, "query_id long, vec_id long, distance double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy("distance", "vec_id"))
    return near.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "distance")


def hash_embedding(docs: DataFrame, dims: int = 64, text_col: str = "chunk", unit: bool = True) -> DataFrame:
    """An offline embedder: signed counts of tokens (a-z, 0-9, lower-cased) in buckets of their digest, of length one if unit."""
    importable(docs.sparkSession)

    def embed(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        import hashlib
        import re

        words, known = re.compile(r"[a-z0-9]+"), {}
        for texts in batches:
            if len(known) > 200_000:
                known.clear()
            out = []
            for t in texts:
                v = np.zeros(dims)
                for w in words.findall((t or "").lower()):
                    if (h := known.get(w)) is None:
                        h = known[w] = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big")
                    v[h % dims] += 1 if h >> 16 & 1 else -1
                n = np.linalg.norm(v) if unit else 0
                out.append((v / n if n else v).astype(np.float32).tolist())
            yield pd.Series(out)

    return docs.withColumn("embedding", F.pandas_udf(embed, "array<float>")(F.col(text_col)))


class VectorStore:
    """Chunks and their vectors as one Parquet table: vec_id, doc_id, chunk_no, chunk, embedding."""

    def __init__(self, spark: SparkSession, path: str, embed: Callable[[DataFrame], DataFrame]) -> None:
        self.spark, self.path, self.embed = spark, path, embed

    def exists(self) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/_SUCCESS")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def build(self, chunks: DataFrame, rebuild: bool = False) -> VectorStore:
        """Write the table unless it is there and rebuild is false; chunks: doc_id, chunk_no, chunk, blank ones go. A corpus without chunks is an error."""
        if rebuild or not self.exists():
            whole = chunks.schema["doc_id"].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint")
            number = F.when(F.col("doc_id").between(0, 1 << 38) & (F.col("chunk_no") < 1 << 24), F.shiftleft(F.col("doc_id").cast("long"), 24) + F.col("chunk_no")) if whole else F.lit(None).cast("long")
            some = chunks.where(F.trim("chunk") != "").withColumn("vec_id", F.coalesce(number, F.xxhash64("doc_id", "chunk_no")))
            self.embed(some).select("vec_id", "doc_id", "chunk_no", "chunk", "embedding").write.mode("overwrite").parquet(self.path)
            if self.load().isEmpty():
                raise ValueError("no chunks to index")
        return self

    def load(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def retrieve(self, questions: DataFrame, k: int = 5) -> DataFrame:
        """query_id, rank, doc_id, chunk_no, chunk: the k nearest chunks of each question (query_id, question), ties by number: document and place where ids are whole numbers, else a hash of both."""
        rows = self.load()
        near = vector_topk(rows.select("vec_id", "embedding"), self.embed(questions.withColumnRenamed("question", "chunk")).select("query_id", "embedding"), k)
        found = near.join(rows.select("vec_id", "doc_id", "chunk_no", "chunk"), "vec_id")
        return found.select("query_id", "rank", "doc_id", "chunk_no", "chunk")
