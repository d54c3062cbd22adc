"""A table function for SQL users: SELECT * FROM documents, LATERAL text_windows(text, 1000, 500)."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf


class TextWindows:
    """start_char, text of plain sliding windows (no segments); null and blank texts give no row."""

    def eval(self, text: str, size: int, stride: int) -> Iterator[tuple[int, str]]:
        if not text or not 0 < stride < size:
            return
        at = 0
        while True:
            part = text[at : at + size]
            if part.strip():
                yield at, part
            if at + size >= len(text):
                return
            at += stride


def register(spark: SparkSession) -> None:
    spark.udtf.register("text_windows", udtf(TextWindows, returnType="start_char int, text string"))
