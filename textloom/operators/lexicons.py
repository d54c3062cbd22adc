"""Readers of lexicon files, as tables of raw lines (file_name, line_no from 1, raw_line).

Defined results: lines with too few fields, without three numbers or without a word are left out; which of several lines
of a word counts is the reader's policy.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.operators.affect import cleanse

VAD = ("v", "a", "d")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file_name, line_no and raw_line of the text files of a path, each file read whole so that its lines keep their numbers."""
    files = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file_name"), F.split("value", "\r?\n").alias("_l"))
    return files.select("file_name", F.posexplode("_l").alias("k", "raw_line")).select("file_name", (F.col("k") + 1).alias("line_no"), "raw_line")


def language(file_name: Column) -> Column:
    return F.regexp_extract(file_name, r"_([a-z]{2})(?:_\d+)?\.", 1)


def vad(raw: DataFrame, policy: str = "last") -> DataFrame:
    """lang, word, v, a, d.

    "last": words lower-cased and stripped, the last line of a word counts. "first": words cleansed, scores kept within 0
    and 1, the first line counts. The word is the translation (fifth field), where there is one and the file isn't English.
    """
    f = F.split("raw_line", "\t")
    field = F.element_at(F.when(F.size("_f") >= 5, F.col("_f")), 5)
    rows = raw.select(language(F.col("file_name")).alias("lang"), "line_no", f.alias("_f")).filter(F.size("_f") >= 4)
    rows = rows.select("lang", "line_no", F.col("_f")[0].alias("_own"), field.alias("_other"), *[F.expr(f"try_cast(trim(_f[{k}]) AS double)").alias(c) for k, c in enumerate(VAD, 1)])
    key = F.when((F.col("lang") != "en") & (F.trim(F.coalesce("_other", F.lit(""))) != ""), F.col("_other")).otherwise(F.col("_own"))
    word = cleanse(key) if policy == "first" else F.lower(F.trim(key))
    score = (lambda c: F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col(c)))) if policy == "first" else F.col
    rows = rows.filter("v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL").select("lang", word.alias("word"), "line_no", *[score(c).alias(c) for c in VAD]).filter("length(word) > 0")
    pick = F.min_by if policy == "first" else F.max_by
    return rows.groupBy("lang", "word").agg(pick(F.struct(*VAD), "line_no").alias("s")).select("lang", "word", "s.*")


def axis(intensity: DataFrame, emotion: str) -> DataFrame:
    """lang, word, score of one emotion."""
    return intensity.filter(F.col("emotion") == emotion).select("lang", "word", "score")


def installed(intensity: DataFrame) -> DataFrame:
    """lang, emotion, words: what a table of intensities holds."""
    return intensity.groupBy("lang", "emotion").agg(F.count("*").alias("words"))


def profiles(intensity: DataFrame) -> DataFrame:
    """lang, word, profile: the emotions of a word with their scores, as a map."""
    entries = F.array_sort(F.collect_list(F.struct("emotion", "score")))
    return intensity.groupBy("lang", "word").agg(F.map_from_entries(entries).alias("profile"))
