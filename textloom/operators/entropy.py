"""Burstiness, lexical variety and the score derived from them.

Defined results: texts without words have one empty sentence (count 1, burstiness 0, variety 0).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.functions.text import prose, sentences


def entropy(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, n_sentences, burstiness (sample deviation of sentence lengths), lexical, ai_score."""
    clean = prose(F.col(text))
    lengths = F.filter(F.transform(sentences(clean), lambda s: F.size(F.regexp_extract_all(s, F.lit("[A-Za-z']+"), F.lit(0)))), lambda n: n > 0)
    ws = F.regexp_extract_all(F.lower(clean), F.lit("[a-z']+"), F.lit(0))
    df = df.filter(F.col(text).isNotNull()).select(*key, lengths.alias("l"), ws.alias("w"))
    n = F.size("l")
    mean = F.aggregate("l", F.lit(0.0), lambda a, x: a + x) / n
    var = F.aggregate(F.transform("l", lambda x: (x - mean) * (x - mean)), F.lit(0.0), lambda a, x: a + x) / (n - 1)
    df = df.select(*key, F.greatest(F.lit(1), n).alias("n_sentences"), F.when(n < 2, 0.0).otherwise(F.sqrt(var)).alias("b"), F.when(F.size("w") == 0, 0.0).otherwise(F.size(F.array_distinct("w")) / F.size("w")).alias("e"))
    score = 0.65 * F.greatest(F.lit(0.0), 1 - F.col("b") / 10) + 0.35 * F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("e") - 0.4) / 0.4))
    return df.select(*key, "n_sentences", F.round(F.col("b") + 1e-9, 4).alias("burstiness"), F.round(F.col("e") + 1e-9, 4).alias("lexical"), F.round(score + 1e-9, 4).alias("ai_score"))
