"""The queries of this subpackage and their SQL, as __spark_entry__.py adds them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import html_text, language, lines, media, mixing, packing, quality, ranking, simhash, spelling, substrings, syncmers, warc


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [lines.op1_lines, substrings.op2_substrings, simhash.op3_simhash, syncmers.op4_syncmers, media.op5_media, quality.op6_quality, language.op7_language, mixing.op8_mix, warc.op9_warc, packing.op10_pack, ranking.op11_ranking, spelling.op12_spelling, html_text.op13_html, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op8_mix": mixing.OP8_SQL, "op11_ranking": ranking.OP11_SQL, "op12_spelling": spelling.OP12_SQL, "op13_html": html_text.OP13_SQL}
