"""Corpora of text chunks with vectors, kept as Parquet: a folder for each ingest, and a list of the folders for each version."""

from __future__ import annotations

import json
import logging
import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.errors import EngineError
from siltstone.fs import Files
from siltstone.operators import text
from siltstone.research import Found

log = logging.getLogger(__name__)

#: Ingests after which the parts become one.
MOST_PARTS = 16


class Corpora:
    def __init__(self, spark: SparkSession, root: str, embedder: text.Embedder):
        self.spark, self.root, self.embedder, self.files = spark, f"{root.rstrip('/')}/corpora", embedder, Files(spark)

    def _folder(self, corpus: str) -> str:
        if not corpus or "/" in corpus or corpus.startswith("."):
            raise EngineError(f"{corpus!r} is no name for a corpus")
        return f"{self.root}/{corpus}"

    def _versions(self, corpus: str) -> list[str]:
        return [n for n in self.files.names(self._folder(corpus)) if n.endswith(".current")]

    def _parts(self, corpus: str) -> list[str]:
        """The folders of the current version, the oldest first."""
        names, folder = self._versions(corpus), self._folder(corpus)
        return [f"{folder}/{p}" for p in json.loads(self.files.read(f"{folder}/{names[-1]}"))] if names else []

    def chunks(self, corpus: str) -> DataFrame | None:
        """Of each document the chunks of the last ingest that had it."""
        parts = self._parts(corpus)
        if not parts:
            return None
        if len(parts) == 1:
            return self.spark.read.parquet(f"{parts[0]}/chunks")
        read = [(self.spark.read.parquet(f"{p}/chunks").withColumn("part", F.lit(k)), self.spark.read.parquet(f"{p}/documents").withColumn("part", F.lit(k))) for k, p in enumerate(parts)]
        chunks, documents = (reduce(DataFrame.unionByName, side) for side in zip(*read))
        last = documents.groupBy("doc_id").agg(F.max("part").alias("part"))
        return chunks.join(last, ["doc_id", "part"], "left_semi").drop("part")

    def ingest(self, corpus: str, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Chunks and vectors of these documents in place of any that the corpus has of them; how many chunks. Only they are written; what they replace
        is left out when read. After MOST_PARTS ingests the parts become one. The new version is complete before it becomes the current one, and
        of two ingests at once one fails."""
        folder, number, parts = self._folder(corpus), len(self._versions(corpus)), self._parts(corpus)
        docs = docs.withColumn("doc_id", docs[id_col].cast("string"))
        at = f"{folder}/v-{uuid.uuid4().hex}"
        text.chunked(docs, "doc_id", text_col, embedder=self.embedder).select("doc_id", "chunk_index", "text", "embedding").write.parquet(f"{at}/chunks")
        docs.select("doc_id").distinct().write.parquet(f"{at}/documents")
        self._commit(corpus, number, [*parts, at])
        if len(parts) + 1 >= MOST_PARTS:
            self.compact(corpus)
        return self.spark.read.parquet(f"{at}/chunks").count()

    def _commit(self, corpus: str, number: int, parts: list[str]) -> None:
        self.files.write_new(f"{self._folder(corpus)}/{number:012d}.current", json.dumps([p.rsplit("/", 1)[1] for p in parts]).encode())

    def compact(self, corpus: str) -> None:
        """One part instead of many. Earlier versions stay readable."""
        number, at = len(self._versions(corpus)), f"{self._folder(corpus)}/v-{uuid.uuid4().hex}"
        chunks = self.chunks(corpus)
        if chunks is not None:
            chunks.write.parquet(f"{at}/chunks")
            self.spark.read.parquet(f"{at}/chunks").select("doc_id").distinct().write.parquet(f"{at}/documents")
            self._commit(corpus, number, [at])

    def retrieve(self, query: str, corpus: str, k: int = text.TOP) -> list[Found]:
        """The nearest chunks; nothing, with a log entry, if anything fails."""
        if not corpus:
            return []
        try:
            chunks = self.chunks(corpus)
            if chunks is None:
                return []
            vector = self.embedder.embed([query])[0]
            rows = text.nearest(chunks, vector, k, ties=["doc_id", "chunk_index"]).select("doc_id", "text", "score").collect()
            return [Found(r["doc_id"], r["text"], r["score"]) for r in rows]
        except Exception:
            log.exception("retrieval from %s failed", corpus)
            return []
