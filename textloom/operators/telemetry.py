"""Character and structure telemetry per text or window.

Defined results: null texts have no row; empty texts have zero counts; ties between letters go to the first in the alphabet.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.functions.text import pauses, trailing_space, words, zero_width

# Alphabets of the letter histograms and the folding of Arabic letter variants.
LATIN = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
CYRILLIC = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"
ARABIC = "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"
FARSI = ARABIC + "پچژگ"
ARABIC_FOLD = ("آأإٱىئؤ", "ااااييو")


def word_counts(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds total_words, total_chars and avg_word_length."""
    w = words(F.col(text))
    chars = F.length(F.regexp_replace(F.col(text), "[^A-Za-z]+", ""))
    return df.withColumns({"total_words": F.size(w), "total_chars": chars, "avg_word_length": F.round(chars / F.greatest(F.lit(1), F.size(w)) + 1e-9, 2)})


def counts_of(only: Column, alphabet: str) -> Column:
    """(letter, n) of the letters that occur in a text that has no others: one pass for each letter, no row for each character."""
    n = [F.struct(F.lit(x).alias("letter"), (F.length(only) - F.length(F.replace(only, F.lit(x), F.lit("")))).cast("bigint").alias("n")) for x in alphabet]
    return F.filter(F.array(*n), lambda c: c["n"] > 0)


def letters(df: DataFrame, key: list[str], text: Column, alphabet: str) -> DataFrame:
    """key, letter, n: counts of the letters of `alphabet` that occur in each row."""
    only = df.select(*key, F.regexp_replace(text, f"[^{alphabet}]+", "").alias("_o")).filter(F.length("_o") > 0)
    return only.select(*key, F.explode(counts_of(F.col("_o"), alphabet)).alias("c")).select(*key, "c.letter", "c.n")


def all_letters(df: DataFrame, key: list[str], text: str = "text", alphabet: str = LATIN) -> DataFrame:
    """key, letter, n of every letter of the alphabet, 0 where it doesn't occur."""
    u = df.filter(F.col(text).isNotNull()).select(*key, F.upper(text).alias("_o"))
    n = [F.struct(F.lit(x).alias("letter"), (F.length("_o") - F.length(F.replace(F.col("_o"), F.lit(x), F.lit("")))).cast("bigint").alias("n")) for x in alphabet]
    return u.select(*key, F.explode(F.array(*n)).alias("c")).select(*key, "c.letter", "c.n")


def latin_letters(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return letters(df, key, F.upper(text), LATIN)


def cyrillic_letters(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    return letters(df, key, F.upper(text), CYRILLIC)


def arabic_letters(df: DataFrame, key: list[str], text: str = "text", farsi: bool = False) -> DataFrame:
    return letters(df, key, F.translate(F.col(text), *ARABIC_FOLD), FARSI if farsi else ARABIC)


def top_letters(counts: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """The k commonest letters with their rank."""
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("n"), "letter"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def doubles(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pair, n: letters doubled inside words, from left to right, without overlap."""
    pairs = F.flatten(F.transform(words(F.upper(text)), lambda w: F.regexp_extract_all(w, F.lit(r"([A-Z])\1"), F.lit(0))))
    return df.select(*key, F.explode(pairs).alias("pair")).groupBy(*key, "pair").agg(F.count("*").alias("n"))


def hidden(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds hidden_unicode_count and stego_anomaly_flag."""
    n = zero_width(F.col(text)) + trailing_space(F.col(text))
    return df.withColumns({"hidden_unicode_count": n, "stego_anomaly_flag": n > 0})


def pause_wave(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pos, value: the pause magnitudes in order."""
    return df.select(*key, F.posexplode(pauses(F.col(text))).alias("pos", "value"))


def scripts_ja(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds counts of kanji, hiragana and katakana and their shares among them."""
    n = {name: F.regexp_count(F.col(text), F.lit(p)) for name, p in (("kanji", r"[\x{4E00}-\x{9FFF}]"), ("hiragana", r"[\x{3041}-\x{3096}]"), ("katakana", r"[\x{30A1}-\x{30FA}]"))}
    df = df.withColumns(n)
    total = F.greatest(F.lit(1), sum((F.col(c) for c in n), F.lit(0)))
    return df.withColumns({f"{c}_ratio": F.round(F.col(c) / total + 1e-9, 6) for c in n})


def hangul_letters(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, onset, n: leading consonant (0 to 18) of each Hangul syllable, by arithmetic on its code point."""
    syllables = F.explode(F.split(F.regexp_replace(text, r"[^\x{AC00}-\x{D7A3}]+", ""), "")).alias("ch")
    o = F.floor((F.ascii("ch") - 44032) / 588).cast("int")
    return df.select(*key, syllables).filter("ch != ''").select(*key, o.alias("onset")).groupBy(*key, "onset").agg(F.count("*").alias("n"))
