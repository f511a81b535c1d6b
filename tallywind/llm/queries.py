"""The operators as queries over the given tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import ann, chat, decontaminate, jaccard, merkle, mixing, periods, pseudonyms, quality, repeats, templates, toxicity, warc
from .common import prepare, table


def op1_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"),
                            F.col("source"), F.concat_ws("/", "source", "lang"))


def op3_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return mixing.mix(table(spark, sf_dir, "documents")).drop("source")


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    turns = chat.control_case(table(spark, sf_dir, "conversations"))
    return chat.digests(chat.expand(turns))


def op5_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return repeats.digests(repeats.remove_repeats(table(spark, sf_dir, "documents")))


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return jaccard.near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return pseudonyms.report(table(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return warc.archive_round_trip(table(spark, sf_dir, "pages").select("page_id", "url", "html"))


def op11_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return templates.extract(table(spark, sf_dir, "pages"))


def op12_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return periods.digests(periods.collapse(table(spark, sf_dir, "documents"), edit=periods.plant))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return merkle.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ann": op1_ann,
    "op2_quality": op2_quality,
    "op3_mix": op3_mix,
    "op4_chat": op4_chat,
    "op5_repeats": op5_repeats,
    "op6_jaccard": op6_jaccard,
    "op7_pii": op7_pii,
    "op8_warc": op8_warc,
    "op9_toxicity": op9_toxicity,
    "op10_decontaminate": op10_decontaminate,
    "op11_templates": op11_templates,
    "op12_periods": op12_periods,
    "op13_merkle": op13_merkle,
}

ORACLES: dict[str, str] = {
    "op3_mix": mixing.SQL,
    "op4_chat": chat.SQL,
    "op8_warc": warc.SQL,
    "op11_templates": templates.SQL,
    "op13_merkle": merkle.SQL,
}
