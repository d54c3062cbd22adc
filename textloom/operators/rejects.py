"""Rows that fail to parse (problem 6).

Each distinct value of a column is cast once, the invalid values form a dictionary with the reason, and
that dictionary is joined back beside the structural checks (quoting, number of fields).

Defined results: a null or blank raw line and the header line yield neither a row nor a failure; repeated
rows count once; a null file name or line number is kept as it is; any further column is ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

EMOTIONS = ("anger", "fear", "anticipation", "trust", "surprise", "sadness", "joy", "disgust")

# A field is bare (no double quote anywhere) or wholly enclosed in double quotes, inner ones doubled. With a tab
# put before the line every field is one match from the end of the last one; what they leave over is misquoted.
FIELD = r'(?s)\G\t([ ]*+"(?:[^"]++|"")*+"[ \r]*+|[^"\t]*+)(?=\t|\z)'
NUMBER = r"^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$"


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^[\s ]+|[\s ]+$", "")


def _unquote(field: Column) -> Column:
    bare = _strip(field)
    quoted = bare.startswith('"')
    inner = F.substring(bare, F.lit(2), F.length(bare) - 2)
    return F.when(quoted, _strip(F.replace(inner, F.lit('""'), F.lit('"')))).otherwise(bare)


def split_lines(raw: DataFrame) -> DataFrame:
    """file_name, line_no, raw_line -> the same, with `quoting_ok`, the unquoted `fields` and `expected` fields.

    Header (line 1) and blank lines are left out.
    """
    lines = (
        raw.select("file_name", "line_no", "raw_line")
        .dropDuplicates()
        .filter(F.col("raw_line").isNotNull() & (F.length(_strip(F.col("raw_line"))) > 0))
        .filter(F.coalesce(F.col("line_no") != 1, F.lit(True)))
    )
    tabbed = F.concat(F.lit("\t"), F.col("raw_line"))
    found = F.array_join(F.regexp_extract_all(tabbed, F.lit(FIELD), F.lit(0)), "")
    ok = F.length(found) == F.length(tabbed)
    fields = F.when(ok, F.transform(F.regexp_extract_all(tabbed, F.lit(FIELD), F.lit(1)), _unquote))
    english = F.coalesce(F.col("file_name").contains("_en_"), F.lit(False))
    return lines.withColumns({"quoting_ok": ok, "fields": fields, "expected": F.when(english, 3).otherwise(4)})


def invalid_values(lines: DataFrame) -> DataFrame:
    """The dictionary of invalid values: kind, value, fail_reason. Every distinct value is cast once."""
    n = F.size("fields")
    pairs = lines.filter(F.col("quoting_ok") & (n == F.col("expected"))).select(
        F.explode(
            F.array(
                F.struct(F.lit("emotion").alias("kind"), F.col("fields")[1].alias("value")),
                F.struct(F.lit("score").alias("kind"), F.col("fields")[2].alias("value")),
                F.struct(F.lit("translated_word").alias("kind"), F.when(F.col("expected") == 4, F.get("fields", F.lit(3))).alias("value")),
            )
        ).alias("p")
    )
    values = pairs.select("p.kind", "p.value").filter(F.col("value").isNotNull()).distinct()
    bad = (
        F.when(F.col("kind") == "emotion", ~F.lower("value").isin(*EMOTIONS))
        .when(F.col("kind") == "score", ~F.col("value").rlike(NUMBER) | F.expr("try_cast(value AS DOUBLE)").isNull())
        .otherwise((F.length("value") > 0) & ~F.col("value").rlike(r"\p{L}"))
    )
    return values.filter(bad).withColumn("fail_reason", F.col("kind"))


def parse(raw: DataFrame) -> DataFrame:
    """All content lines with `fail_reason` (null: the line is valid) and the typed columns of valid lines.

    The first reason that applies, in the order quoting, column_count, emotion, score, translated_word.
    The dictionary is joined per column; AQE broadcasts it while it is small and salts nothing else, because
    the probe side is not shuffled then. Where it is large, a skewed value is split by AQE's skew join.
    """
    lines = split_lines(raw)
    bad = invalid_values(lines)

    def flag(df: DataFrame, kind: str, value: Column) -> DataFrame:
        d = bad.filter(F.col("kind") == kind).select(F.col("value").alias(f"{kind}_v"), F.lit(True).alias(f"{kind}_bad"))
        return df.withColumn(f"{kind}_k", value).join(d, F.col(f"{kind}_k") == F.col(f"{kind}_v"), "left").drop(f"{kind}_v")

    right = F.size("fields") == F.col("expected")
    df = lines
    df = flag(df, "emotion", F.when(right, F.get("fields", F.lit(1))))
    df = flag(df, "score", F.when(right, F.get("fields", F.lit(2))))
    df = flag(df, "translated_word", F.when(right & (F.col("expected") == 4), F.get("fields", F.lit(3))))
    reason = (
        F.when(~F.col("quoting_ok"), "quoting")
        .when(F.size("fields") != F.col("expected"), "column_count")
        .when(F.col("emotion_bad"), "emotion")
        .when(F.col("score_bad"), "score")
        .when(F.col("translated_word_bad"), "translated_word")
    )
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.expr("try_cast(score_k AS DOUBLE)")))
    return df.select(
        "file_name",
        F.col("line_no").cast("bigint").alias("line_no"),
        reason.alias("fail_reason"),
        F.when(reason.isNull(), F.get("fields", F.lit(0))).alias("english_word"),
        F.when(reason.isNull(), F.lower("emotion_k")).alias("emotion"),
        F.when(reason.isNull(), score).alias("score"),
        F.when(reason.isNull(), F.nullif(F.col("translated_word_k"), F.lit(""))).alias("translated_word"),
    )


def failures(raw: DataFrame) -> DataFrame:
    """file_name, line_no, fail_reason of every line that fails."""
    return parse(raw).filter(F.col("fail_reason").isNotNull()).select("file_name", "line_no", "fail_reason")


def loaded(raw: DataFrame) -> DataFrame:
    """The valid lines, typed; scores clamped to 0..1."""
    return parse(raw).filter(F.col("fail_reason").isNull()).drop("fail_reason")
