"""Token counts through a cache keyed by content digest and tokenizer digest.

A text is encoded once per tokenizer version, however many documents carry it
and however often the job runs: documents are reduced to distinct digests,
digests already in the cache are taken from it, only misses are encoded, and
their counts are appended for later runs.

Defined results: a null text counts as the empty text (0 bytes, the tokenizer's
count for ""); repeated rows each get a row; an empty table gives an empty
table; columns beyond the id and the text are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm.common import text_batches, tune_arrow
from vacantia.session import settled

CACHE_SCHEMA = "digest binary, n_tokens bigint, tokenizer string"
#: Part of the tokenizer digest: a change of how texts are handed over must not meet old counts.
MODE = b"no added special tokens, no truncation, no padding, special strings by default"

_loaded: dict[str, object] = {}


def tokenizer_digest(path: str) -> str:
    """Version of the tokenizer: its file and the way it is called."""
    return hashlib.sha256(Path(path).read_bytes() + MODE).hexdigest()


def _counter(path: str):
    """A function from texts to token counts; the tokenizer is loaded once a worker."""
    if path not in _loaded:
        if path.endswith(".model"):
            import sentencepiece

            model = sentencepiece.SentencePieceProcessor(model_file=path)
            _loaded[path] = lambda texts: [len(ids) for ids in model.encode(texts, num_threads=1)]
        else:
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _loaded[path] = lambda texts: [len(e.ids) for e in model.encode_batch_fast(texts, add_special_tokens=False)]
    return _loaded[path]


def count_texts(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = _counter(path)
        for batch in text_batches(batches, limit=1 << 18):
            counts = count(batch.column("text").to_pylist())
            yield pa.record_batch([batch.column("digest"), pa.array(counts, pa.int64())], names=["digest", "n_tokens"])

    return run


def read_cache(spark: SparkSession, path: str, tokenizer: str) -> DataFrame:
    """Stored counts of one tokenizer; one row per digest even if two jobs appended the same text."""
    stored = spark.read.schema(CACHE_SCHEMA).parquet(path).filter(F.col("tokenizer") == tokenizer)
    return stored.groupBy("digest").agg(F.min("n_tokens").alias("n_tokens"))


def token_counts(
    docs: DataFrame, tokenizer_path: str, cache_path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row, encoding only texts the cache lacks.

    ``cache_path`` is a folder all executors share; it is made if missing and
    gets the new counts, as Parquet split by tokenizer digest. The digest is
    SHA-256 of the UTF-8 text, null normalised to the empty text; nothing else
    may be normalised, because the counts must be those of the text as it is.
    Copies are reduced before the shuffle, so a text that fills a third of the
    table crosses it once per map task.
    """
    spark = tune_arrow(docs.sparkSession)
    version = tokenizer_digest(tokenizer_path)
    text = F.coalesce(F.col(text_col), F.lit(""))
    digest = F.unhex(F.sha2(text, 256))
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    cached = read_cache(spark, cache_path, version)
    texts = docs.select(digest.alias("digest"), text.alias("text")).dropDuplicates(["digest"])
    misses = texts.join(cached, "digest", "left_anti")
    fresh = misses.mapInArrow(count_texts(tokenizer_path), "digest binary, n_tokens bigint")
    fresh.withColumn("tokenizer", F.lit(version)).write.mode("append").partitionBy("tokenizer").parquet(cache_path)
    keyed = docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), digest.alias("digest"))
    counts = settled(read_cache(spark, cache_path, version), "counts")  # bare sides: AQE can split the digest of a hot text
    counted = keyed.join(counts, "digest")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
