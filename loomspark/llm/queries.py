"""The registered queries of the corpus operators; each derives its columns from an operator's own results."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm.bpe import encode_decode
from loomspark.llm.chat import rotate_perspectives
from loomspark.llm.common import fresh_path, table
from loomspark.llm.decontaminate import decontaminate
from loomspark.llm.divergence import divergence
from loomspark.llm.exact_dedup import exact_dedup
from loomspark.llm.mixing import mix
from loomspark.llm.ngram_join import near_duplicates
from loomspark.llm.quality import classify
from loomspark.llm.suffix_dedup import remove_repeats
from loomspark.llm.threshold_search import search
from loomspark.llm.token_counts import count_tokens
from loomspark.llm.token_files import read_token_files, write_token_files
from loomspark.llm.vamana import nearest


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rotate_perspectives(table(spark, sf_dir, "conversations"))


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), texts=False).drop("row_no", "kept")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("word_bpe_49k.json")
    return encode_decode(table(spark, sf_dir, "documents"), path, ids=False, decoded=False).drop("ids", "decoded")


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents")).drop("row_no")


def op8_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))


def op10_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = fresh_path(spark, "token-files")
    write_token_files(table(spark, sf_dir, "documents"), folder, public_tokenizers.path("word_bpe_49k.json"), vocabulary=49_408)
    return read_token_files(spark, folder, ids=False).drop("ids")


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), texts=False)
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256")
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest, "contaminated")


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_chat_formatting": op1_chat_formatting,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_bpe_round_trip": op3_bpe_round_trip,
        "op4_quality": op4_quality,
        "op5_ngram_join": op5_ngram_join,
        "op6_token_counts": op6_token_counts,
        "op7_exact_dedup": op7_exact_dedup,
        "op8_source_mix": op8_source_mix,
        "op9_nearest_vectors": op9_nearest_vectors,
        "op10_token_files": op10_token_files,
        "op11_ranked_search": op11_ranked_search,
        "op12_decontamination": op12_decontamination,
        "op13_source_divergence": op13_source_divergence,
    }
