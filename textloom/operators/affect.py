"""Affect lexicons and scores.

Defined results: blank words are dropped; a word met in several lines keeps its highest score (or the first or last
line, if asked for); a text without matched words has no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.operators.rejects import EMOTIONS


def cleanse(word: Column) -> Column:
    """Lower case and stripped; null if blank, with inner white space, or of less than half letters and digits."""
    w = F.lower(F.regexp_replace(word, r"^\s+|\s+$", ""))
    solid = F.length(F.regexp_replace(w, r"[^\p{L}\p{N}]", ""))
    return F.when((F.length(w) > 0) & ~w.rlike(r"\s") & (solid / F.length(w) >= 0.5), w)


def intensity(lines: DataFrame, policy: str = "max") -> DataFrame:
    """lang, emotion, word, score from parsed lines (file_name, line_no, english_word, emotion, score, translated_word)."""
    lang = F.regexp_extract("file_name", "_([a-z]{2})_", 1)
    word = cleanse(F.coalesce("translated_word", "english_word"))
    rows = lines.select(lang.alias("lang"), "emotion", word.alias("word"), "score", "file_name", "line_no").filter("word IS NOT NULL")
    if policy == "max":
        return rows.groupBy("lang", "emotion", "word").agg(F.max("score").alias("score"))
    order = [F.col(c).desc() if policy == "last" else F.col(c) for c in ("file_name", "line_no")]
    return rows.withColumn("n", F.row_number().over(W.partitionBy("lang", "emotion", "word").orderBy(*order))).filter("n = 1").select("lang", "emotion", "word", "score")


def profile(tokens: DataFrame, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """key, emotion, matched, mean, sd (population) of the matched tokens (key..., lang, word)."""
    m = tokens.join(lexicon, ["lang", "word"])
    return m.groupBy(*key, "emotion").agg(F.count("*").alias("matched"), F.round(F.avg("score") + 1e-9, 4).alias("mean_score"), F.round(F.stddev_pop("score") + 1e-9, 4).alias("sd_score"))


def rotate(df: DataFrame) -> DataFrame:
    """v, a, d in 0..1 -> power, danger, structure in -1..1, and the quadrant of power and danger."""
    v, a, d = (F.col(c) * 2 - 1 for c in "vad")

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))

    p, s = clip(d), clip(-a)
    danger = clip(-0.7 * v + 0.3 * a)
    quadrant = F.when((p >= 0) & (danger >= 0), "Apex Threat").when(p >= 0, "Benevolent Authority").when(danger < 0, "Composed Submission").otherwise("Desperate Panic")
    return df.withColumns({"power": F.round(p + 1e-9, 4), "danger": F.round(danger + 1e-9, 4), "structure": F.round(s + 1e-9, 4), "quadrant": quadrant})


def with_fallback(lexicon: DataFrame, langs: list[str], default: str = "en") -> DataFrame:
    """The lexicon of each asked language; one without any row gets the default's rows under its own name."""
    spark = lexicon.sparkSession
    asked = spark.createDataFrame([(x,) for x in dict.fromkeys(langs)], "lang string")
    own = lexicon.join(asked, "lang", "left_semi")
    empty = asked.join(lexicon.select("lang").distinct(), "lang", "left_anti")
    rest = [c for c in lexicon.columns if c != "lang"]
    # one copy of the default lexicon for each language without rows: both sides are small by their nature
    borrowed = empty.withColumn("from", F.lit(default)).join(lexicon.withColumnRenamed("lang", "from"), "from").select("lang", *rest)
    return own.select("lang", *rest).unionByName(borrowed)


def valence(tokens: DataFrame, lexicon: DataFrame, key: list[str]) -> DataFrame:
    """key, matched, and mean and deviation (population) of v, a and d over the matched tokens (key..., lang, word)."""
    m = tokens.join(lexicon.select("lang", "word", "v", "a", "d"), ["lang", "word"])
    return m.groupBy(*key).agg(F.count("*").alias("matched"), *[f(c) for c in "vad" for f in (lambda c: F.round(F.avg(c) + 1e-9, 4).alias(f"{c}_mean"), lambda c: F.round(F.stddev_pop(c) + 1e-9, 4).alias(f"{c}_sd"))])


def triggers(vad: DataFrame, emotions: DataFrame, key: list[str]) -> DataFrame:
    """key, escalation, contempt, paranoia from the results of `valence` and `profile`; absent emotions count 0."""
    names = ("anger", "disgust", "fear", "anticipation")
    e = emotions.groupBy(*key).agg(*[F.coalesce(F.max(F.when(F.col("emotion") == n, F.col("mean_score"))), F.lit(0.0)).alias(n) for n in names], F.coalesce(F.max(F.when(F.col("emotion") == "anger", F.col("sd_score"))), F.lit(0.0)).alias("anger_sd"))
    power = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.col("d_mean") * 2 - 1))
    danger = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -0.7 * (F.col("v_mean") * 2 - 1) + 0.3 * (F.col("a_mean") * 2 - 1)))
    threat, panic = (power >= 0) & (danger >= 0), (power < 0) & (danger >= 0)
    return vad.join(e, key).select(
        *key,
        (threat & ((F.col("anger") > 0.75) | (F.col("anger_sd") > 0.4))).alias("escalation"),
        (threat & (F.col("anger") > 0.6) & (F.col("disgust") > 0.5)).alias("contempt"),
        (panic & (F.col("fear") > 0.6) & (F.col("anticipation") > 0.6)).alias("paranoia"),
    )


def _pds(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """tokens (key..., lang, word) that the lexicon has, with power, danger and structure, not rounded."""
    m = tokens.join(lexicon.select("lang", "word", "v", "a", "d"), ["lang", "word"])
    v, a, d = (F.col(c) * 2 - 1 for c in "vad")

    def clip(x: Column) -> Column:
        return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x))

    return m.withColumns({"power": clip(d), "danger": clip(-0.7 * v + 0.3 * a), "structure": clip(-a)})


def pds(tokens: DataFrame, lexicon: DataFrame, emotions: DataFrame, key: list[str]) -> DataFrame:
    """key, matched, and mean and deviation (population) of power, danger, structure and the eight emotions over the matched tokens; a word without an emotion counts 0 for it."""
    names = sorted(EMOTIONS)
    wide = emotions.groupBy("lang", "word").agg(*[F.max(F.when(F.col("emotion") == e, F.col("score"))).alias(e) for e in names])
    m = _pds(tokens, lexicon).join(wide, ["lang", "word"], "left").na.fill(0.0, names)
    axes = ["power", "danger", "structure", *names]
    return m.groupBy(*key).agg(F.count("*").alias("matched"), *[f for c in axes for f in (F.round(F.avg(c) + 1e-9, 4).alias(f"{c}_mean"), F.round(F.stddev_pop(c) + 1e-9, 4).alias(f"{c}_sd"))])


def extremes(tokens: DataFrame, lexicon: DataFrame, key: list[str], most: int = 60) -> DataFrame:
    """key, rank, word, power, danger: the matched tokens (with `pos`) farthest from the middle of the plane of power and danger."""
    m = _pds(tokens, lexicon).select(*key, "pos", "word", F.round(F.col("power") + 1e-9, 4).alias("power"), F.round(F.col("danger") + 1e-9, 4).alias("danger"))
    far = F.round(F.sqrt(F.col("power") * F.col("power") + F.col("danger") * F.col("danger")), 9)
    rank = F.row_number().over(W.partitionBy(*key).orderBy(far.desc(), "pos"))
    return m.withColumn("rank", rank).filter(F.col("rank") <= most).select(*key, "rank", "word", "power", "danger")


def valence_of_all(texts: DataFrame, matched: DataFrame, key: list[str]) -> DataFrame:
    """`valence` with a row for every text: one without a matched word has means of 0.5, deviations of 0 and a note."""
    out = texts.select(*key).distinct().join(matched, key, "left")
    out = out.withColumn("note", F.when(F.col("matched").isNull(), "no word of the text is in the lexicon"))
    return out.na.fill(0, ["matched"]).na.fill(0.5, [f"{c}_mean" for c in "vad"]).na.fill(0.0, [f"{c}_sd" for c in "vad"])
