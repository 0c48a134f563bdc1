"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quillmill.llm.ann import nearest_neighbours
from quillmill.llm.conversations import REPAIR_SQL, damage, repair_report
from quillmill.llm.flac import media_digests
from quillmill.llm.langid import identify_language
from quillmill.llm.licenses import licenses_sql, scan_licenses
from quillmill.llm.mixing import MIXING_SQL, mix_sources
from quillmill.llm.packing import pack_documents
from quillmill.llm.phrases import PHRASES_SQL, mine_phrases
from quillmill.llm.pii import find_personal_data
from quillmill.llm.sharding import place_documents, sharding_sql
from quillmill.llm.simhash import simhash_groups
from quillmill.llm.substring import REPEATS_SQL, remove_repeats
from quillmill.llm.suffixes import remove_repeated_bytes
from quillmill.session import load


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(load(spark, sf_dir, "documents"))


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(load(spark, sf_dir, "documents"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_personal_data(load(spark, sf_dir, "documents"))


def op4_flac(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_digests(load(spark, sf_dir, "documents"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(load(spark, sf_dir, "documents"))


def op6_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return place_documents(load(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(load(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(load(spark, sf_dir, "documents"))


def op9_substring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(load(spark, sf_dir, "documents"))


def op10_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(load(spark, sf_dir, "embeddings"))


def op11_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(load(spark, sf_dir, "documents"))


def op12_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine_phrases(load(spark, sf_dir, "documents"))


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = load(spark, sf_dir, "conversations")
    return repair_report(damage(turns), turns)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_language_id": op1_language_id,
    "op2_simhash": op2_simhash,
    "op3_pii": op3_pii,
    "op4_flac": op4_flac,
    "op5_licenses": op5_licenses,
    "op6_sharding": op6_sharding,
    "op7_mixing": op7_mixing,
    "op8_packing": op8_packing,
    "op9_substring": op9_substring,
    "op10_neighbours": op10_neighbours,
    "op11_suffix_array": op11_suffix_array,
    "op12_phrases": op12_phrases,
    "op13_conversation_repair": op13_conversation_repair,
}

ORACLES: dict[str, str] = {
    "op5_licenses": licenses_sql(),
    "op6_sharding": sharding_sql(),
    "op7_mixing": MIXING_SQL,
    "op9_substring": REPEATS_SQL,
    "op12_phrases": PHRASES_SQL,
    "op13_conversation_repair": REPAIR_SQL,
}
