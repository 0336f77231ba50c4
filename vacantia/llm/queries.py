"""Registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

import importlib.util
import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vacantia.llm import (
    byte_bpe, decontamination, embedding_dedup, fill_in_middle, filter_audit, html_extraction, language_id, near_dedup, quality,
    sharding, suffix_dedup, token_counts, toxicity,
)
from vacantia.llm.oracles import ORACLES
from vacantia.session import tune, work_path

__all__ = ["ORACLES", "QUERIES"]

#: Folder of the public tokenizer files and of the module that describes them.
TOKENIZERS = "/opt/tokenizers"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def public_tokenizers():
    """The module that gives the places of the files and the splitting pattern."""
    spec = importlib.util.spec_from_file_location("public_tokenizers", os.path.join(TOKENIZERS, "__init__.py"))
    module = importlib.util.module_from_spec(spec)
    spec.loader.exec_module(module)
    return module


def query(fn: Callable[[Callable[[str], DataFrame]], DataFrame]):
    """Register ``fn(table)`` under its name; ``table`` reads one of the given tables."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        tune(spark)
        return fn(lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet"))

    QUERIES[fn.__name__] = run
    return fn


@query
def op1_token_counts(table):
    """An empty cache per run, so that all texts are encoded."""
    docs = table("documents")
    cache = work_path(docs.sparkSession, "token-cache")
    return token_counts.token_counts(docs, public_tokenizers().path("byte_bpe_50k.json"), cache)


@query
def op2_sharding(table):
    return sharding.sharded(table("documents"), dict.fromkeys(range(16), 1.0), dict.fromkeys(range(17), 1.0))


@query
def op3_decontamination(table):
    return decontamination.contaminated(table("documents"), table("benchmark"))


@query
def op4_near_dedup(table):
    return near_dedup.near_duplicates(table("documents"), percent=85)


@query
def op5_language_id(table):
    docs = table("documents")
    fold = language_id.remainder("doc_id", 4)
    model = language_id.prototypes(docs, fold != 2)
    found = language_id.identified(docs, model)
    return found.select("doc_id", (language_id.remainder("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


@query
def op6_html_extraction(table):
    return html_extraction.main_texts(table("pages"))


@query
def op7_byte_bpe(table):
    public = public_tokenizers()
    return byte_bpe.encoded(table("documents"), public.path("byte_bpe_multi_50k.tiktoken"), public.PATTERN, with_ids=False)


@query
def op8_embedding_dedup(table):
    return embedding_dedup.near_embeddings(table("embeddings"))


@query
def op9_quality(table):
    docs = table("documents")
    return quality.resampled(docs, quality.learned(docs, table("labels")))


@query
def op10_toxicity(table):
    docs = table("documents")
    fold = language_id.remainder("doc_id", 5)
    model = toxicity.train(docs, table("labels"), fold != 0)
    found = toxicity.scored(docs, model)
    return found.select("doc_id", (language_id.remainder("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


@query
def op11_filter_audit(table):
    return filter_audit.audited(table("documents"), table("labels"))


@query
def op12_fill_in_middle(table):
    made = fill_in_middle.fill_in_middle(table("documents"), seed=42, percent=50, spm_percent=80)
    back = fill_in_middle.restored(F.col("output"), F.col("form"))
    return made.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(back, 256).alias("restored_sha256"),
    )


@query
def op13_suffix_dedup(table):
    found = suffix_dedup.repeats_removed(table("documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
