"""Queries of the operators, each over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import chat_format, decontaminate, html_text, jaccard_join, license_scan, media, mixing, periodic_runs, pii, quality, token_ids, toxicity, whitening
from .scratch import table


def tokenizer_file() -> str:
    """The default tokenizer; its place is a parameter of the operator."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_media_columns(spark, sf_dir):
    return media.media_digest(table(spark, sf_dir, "documents"))


def op2_jaccard_join(spark, sf_dir):
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op3_token_ids(spark, sf_dir):
    return token_ids.store_and_digest(table(spark, sf_dir, "documents"), tokenizer_file())


def op4_license_scan(spark, sf_dir):
    return license_scan.scan(table(spark, sf_dir, "documents"))


def op5_html_text(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op6_decontamination(spark, sf_dir):
    return decontaminate.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_toxicity(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op8_quality(spark, sf_dir):
    return quality.quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_mixing(spark, sf_dir):
    return mixing.mix(table(spark, sf_dir, "documents"))


def op10_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op11_periodic_runs(spark, sf_dir):
    return periodic_runs.find(table(spark, sf_dir, "documents"))


def op12_whitening(spark, sf_dir):
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


#: What both turns of the conversation say that is formatted beside the table's.
CONTROL_TURN = "</s>[INST] ok [/INST]"


def op13_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = F.lit(CONTROL_TURN)
    extra = spark.range(1).select(F.lit(-7).alias("id"), said.alias("prompt"), said.alias("response"))
    records = chat_format.as_records(rows).unionByName(chat_format.as_records(extra))
    return chat_format.read_back(chat_format.format_records(records))


QUERIES = {
    f.__name__: f
    for f in (
        op1_media_columns, op2_jaccard_join, op3_token_ids, op4_license_scan, op5_html_text, op6_decontamination, op7_toxicity,
        op8_quality, op9_mixing, op10_pii, op11_periodic_runs, op12_whitening, op13_chat_format,
    )
}
ORACLES = {"op9_mixing": mixing.oracle_sql()}
