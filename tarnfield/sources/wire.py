"""Results as JSON lines with the name of their schema, and what may be plugged in."""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCHEMAS = ("search_hit.v1", "answer.v1", "chunk.v1", "document.v1", "ingest_item.v1", "eval_result.v1", "error.v1")


def to_wire(rows: DataFrame, schema: str) -> DataFrame:
    """One column ``value``: a JSON object for each row, schema_version first; nulls are left out."""
    if schema not in SCHEMAS:
        raise ValueError(f"unknown schema {schema}")
    return rows.select(F.to_json(F.struct(F.lit(schema).alias("schema_version"), *[c for c in rows.columns if c != "schema_version"])).alias("value"))


def write_lines(rows: DataFrame, schema: str, path: str) -> None:
    """JSON lines below ``path``, written by all tasks at once."""
    to_wire(rows, schema).write.text(path)


def error_rows(items: DataFrame, code: str, message: str) -> DataFrame:
    """A structured error for each item (query_id)."""
    return items.select("query_id", F.lit(code).alias("code"), F.lit(message).alias("message"))


class SourceConnector(Protocol):
    """Gives assets (source_uri, workspace_path, byte_len, checksum, content, …)."""

    def scan(self) -> DataFrame: ...


class Extractor(Protocol):
    """Turns assets into blocks (doc_id, kind, heading_path, start, end, text, …)."""

    def extract(self, assets: DataFrame) -> DataFrame: ...


class Chunker(Protocol):
    """Turns blocks or texts into chunks (doc_id, ordinal, text, start, end, token_estimate, …)."""

    version: str

    def chunk(self, docs: DataFrame) -> DataFrame: ...


class Embedder(Protocol):
    """Adds ``embedding`` to rows with a text."""

    model_id: str
    dim: int

    def embed(self, rows: DataFrame) -> DataFrame: ...


class Retriever(Protocol):
    """Gives hits (query_id, chunk_id, doc_id, score, rank) for queries (query_id, text)."""

    def search(self, queries: DataFrame, k: int) -> DataFrame: ...


class LanguageModel(Protocol):
    """Adds ``answer`` to rows with a prompt."""

    def generate(self, prompts: DataFrame) -> DataFrame: ...


class Verifier(Protocol):
    """Adds ``logits`` to rows with premise and hypothesis."""

    def score(self, pairs: DataFrame) -> DataFrame: ...


class HashEmbedder:
    """A stand-in for tests: unit vectors that depend on the text alone."""

    def __init__(self, dim: int = 8, model_id: str = "hash-v1") -> None:
        self.dim, self.model_id = dim, model_id

    def embed(self, rows: DataFrame) -> DataFrame:
        parts = [F.pmod(F.xxhash64("text", F.lit(k)), F.lit(2001)) / 1000.0 - 1.0 for k in range(self.dim)]
        raw = rows.withColumn("_v", F.array(*parts))
        norm = F.sqrt(F.aggregate("_v", F.lit(0.0), lambda s, x: s + x * x))
        return raw.withColumn("embedding", F.transform("_v", lambda x: (x / norm).cast("float"))).drop("_v")


class IndexRetriever:
    """Lexical search on a stored index, as a retriever."""

    def __init__(self, index) -> None:
        self.index = index

    def search(self, queries: DataFrame, k: int) -> DataFrame:
        from tarnfield.operators.search import lexical

        return lexical(queries, self.index, k)
