"""The queries of this package and the SQL for those that SQL can state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    from . import bpe, chat, licenses, media, mix, pii, quality, secrets, simhash, urls

    return {
        "pipeline": corpus_pipeline.run,
        "op1_mix": mix.op1_mix,
        "op2_secrets": secrets.op2_secrets,
        "op3_simhash": simhash.op3_simhash,
        "op4_pii": pii.op4_pii,
        "op5_urls": urls.op5_urls,
        "op6_chat": chat.op6_chat,
        "op7_licenses": licenses.op7_licenses,
        "op8_media": media.op8_media,
        "op9_bpe": bpe.op9_bpe,
        "op10_quality": quality.op10_quality,
    }


def oracle_sql() -> dict[str, str]:
    from . import oracle

    return {
        "op5_urls": oracle.url_sql(),
        "op6_chat": oracle.chat_sql(),
        "op7_licenses": oracle.license_sql(),
        "op10_quality": oracle.quality_sql(),
    }
