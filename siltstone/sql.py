"""Operators by name for SQL: scalar functions that Spark puts into the plan as expressions, and table functions."""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from siltstone.functions import text as T

_W, _T = (p.replace("\\", "\\\\") for p in (T.WORD, T.TOKEN))
_SIGNS = T.PUNCTUATION.replace("\\", "\\\\").replace("'", "\\'")
#: name, parameters, type and body of each scalar function; bodies may use those before.
SCALARS = [
    ("silt_words", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(lower(t), '{_W}', 0)"),
    ("silt_tokens", "t STRING", "ARRAY<STRING>", f"regexp_extract_all(t, '{_T}', 0)"),
    ("silt_token_count", "t STRING", "BIGINT", "CAST(coalesce(size(silt_tokens(t)), 0) AS BIGINT)"),
    ("silt_answer", "t STRING", "STRING", f"trim(regexp_replace(translate(lower(trim(coalesce(t, ''))), '{_SIGNS}', ''), '\\\\s+', ' '))"),
    ("silt_jaccard", "a ARRAY<STRING>, b ARRAY<STRING>", "DOUBLE", "CASE WHEN size(a) = 0 OR size(b) = 0 THEN 0.0D ELSE size(array_intersect(a, b)) / size(array_union(a, b)) END"),
    ("silt_plateau", "before DOUBLE, last DOUBLE, now DOUBLE, threshold DOUBLE", "BOOLEAN", "coalesce(before > 0 AND last > 0 AND (before - last) / before * 100 < threshold AND (last - now) / last * 100 < threshold, false)"),
]


class TextWindows:
    """silt_windows(text, size, overlap): chunk_no, text and token_count of overlapping windows of white-space words."""

    def eval(self, text: str, size: int, overlap: int) -> Iterator[tuple[int, str, int]]:
        words = (text or "").split()
        step = size - overlap if size > overlap else size
        for number, start in enumerate(range(0, len(words), step)):
            piece = words[start : start + size]
            yield number, " ".join(piece), len(piece)
            if start + size >= len(words):
                break


class TraceRows:
    """silt_trace_rows(content): place, field and value of each cell of a trace file, read by its own header."""

    def eval(self, content: bytes) -> Iterator[tuple[int, str, str]]:
        for place, row in enumerate(csv.DictReader(io.StringIO(bytes(content or b"").decode("utf-8", "replace"), newline=""))):
            for field, value in row.items():
                if isinstance(field, str) and isinstance(value, str):
                    yield place, field, value


def register(spark: SparkSession) -> list[str]:
    """Make the functions known to the session's SQL; their names. May be called again."""
    for name, parameters, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS {kind} RETURN {body}")
    windows = StructType([StructField("chunk_no", IntegerType()), StructField("text", StringType()), StructField("token_count", IntegerType())])
    cells = StructType([StructField("place", IntegerType()), StructField("field", StringType()), StructField("value", StringType())])
    spark.udtf.register("silt_windows", udtf(TextWindows, returnType=windows))
    spark.udtf.register("silt_trace_rows", udtf(TraceRows, returnType=cells))
    return [s[0] for s in SCALARS] + ["silt_windows", "silt_trace_rows"]
