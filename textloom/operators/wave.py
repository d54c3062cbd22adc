"""Letter-wave layer: letter values as a signal, its envelope and spectrum.

Defined results: texts without letters have no row; empty buckets of an envelope are 0; ties between modes go to
the smaller root, the lower tier and the first category of CATEGORIES.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from textloom.functions.arrays import let, total

# Categories of letters and the values of umlauts; A to Z count 1 to 26.
CATEGORIES = {"origin": "A", "kinetic": "BEFJPSV", "resonant": "CHLMOUY", "sovereign": "DIKQTWXZ", "liminal": "GNRÄÖÜ"}
UMLAUTS = {"Ä": 1.5, "Ö": 15.5, "Ü": 21.5}
FOLD = ("ÁÀÂÃÅÉÈÊÍÌÎÓÒÔÕÚÙÛÑÇÝ", "AAAAAEEEIIIOOOOUUUNCY")
ROOTS = {1: "Source", 2: "Bond", 3: "Overflow", 4: "Foundation", 5: "Friction", 6: "Grounding", 7: "Precursor", 8: "Infinity/State", 9: "Transcendent"}
SAMPLES, PEAKS = 256, 5


def folded(text: Column) -> Column:
    """Upper case, accents folded, only letters with a value (and white space) left."""
    return F.regexp_replace(F.translate(F.upper(text), *FOLD), r"[^A-ZÄÖÜ\s]+", "")


def value(letter: Column) -> Column:
    out = (F.ascii(letter) - 64).cast("double")
    for ch, v in UMLAUTS.items():
        out = F.when(letter == ch, v).otherwise(out)
    return out


def category(letter: Column) -> Column:
    out = F.lit(None).cast("string")
    for name, of in CATEGORIES.items():
        out = F.when(letter.isin(*of), name).otherwise(out)
    return out


def signal(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, pos (from 0), letter, x."""
    letters = F.split(F.regexp_replace(folded(F.col(text)), r"\s+", ""), "")
    return df.select(*key, F.posexplode(F.filter(letters, lambda c: c != "")).alias("pos", "letter")).withColumn("x", value(F.col("letter")))


def words(df: DataFrame, text: str = "text") -> DataFrame:
    """word, total, sigma (population), root and tier of each distinct word."""
    w = df.select(F.explode(F.filter(F.split(folded(F.col(text)), r"\s+"), lambda c: c != "")).alias("word")).distinct()
    letters = w.select("word", F.explode(F.split("word", "")).alias("letter")).filter("letter != ''").withColumn("x", value(F.col("letter")))
    out = letters.groupBy("word").agg(F.sum("x").alias("total"), F.round(F.stddev_pop("x") + 1e-9, 4).alias("sigma"))
    root = ((F.floor("total").cast("int") - 1) % 9 + 1).cast("int")
    tier = F.when(F.col("sigma") < 2, 1).when(F.col("sigma") < 5, 2).otherwise(3)
    return out.withColumns({"root": root, "tier": tier})


def _values(letters: Column) -> Column:
    return F.transform(F.filter(F.split(letters, ""), lambda c: c != ""), value)


@lru_cache(200_000)
def _word(word: str) -> tuple[float, int, int]:
    """Deviation, root and tier of one word, as `words` gives them; words met lately are remembered."""
    x = [UMLAUTS.get(c, ord(c) - 64.0) for c in word]
    mean = sum(x) / len(x)
    sigma = math.floor((math.sqrt(sum((v - mean) ** 2 for v in x) / len(x)) + 1e-9) * 1e4 + 0.5) / 1e4
    return sigma, (math.floor(sum(x)) - 1) % 9 + 1, 1 if sigma < 2 else 2 if sigma < 5 else 3


OF_WORDS = {"words": T.LongType(), "sigma": T.DoubleType(), "root": T.IntegerType(), "tier": T.IntegerType(), "tier_1": T.LongType(), "tier_2": T.LongType(), "tier_3": T.LongType()}


@F.pandas_udf(T.StructType([T.StructField(*x) for x in OF_WORDS.items()]))
def _of_words(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for s in texts:
        rows = []
        for t in s:
            w = [_word(x) for x in t.split()] if isinstance(t, str) else []
            root, tier = Counter(x[1] for x in w), Counter(x[2] for x in w)
            first = [min(c, key=lambda k: (-c[k], k)) if c else 0 for c in (root, tier)]
            rows.append((len(w), sum(x[0] for x in w), *first, tier[1], tier[2], tier[3]))
        yield pd.DataFrame(rows, columns=list(OF_WORDS))


def summary(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, mean_sigma, root, tier, label, and shares of the tiers and of the categories, over the words of each row.

    The words are looked up among those that a worker has met; nothing is shuffled. Ties between modes go to the smaller one.
    """
    w = df.select(*key, folded(F.col(text)).alias("_t")).select(*key, _of_words("_t").alias("_w"), F.regexp_replace("_t", r"\s+", "").alias("_o")).filter("_w.words > 0")
    label = F.element_at(F.create_map(*[F.lit(x) for kv in ROOTS.items() for x in kv]), F.col("_w.root"))
    tiers = [F.round(F.col(f"_w.tier_{c}") / F.col("_w.words") + 1e-9, 4).alias(f"tier_{c}") for c in (1, 2, 3)]
    kinds = [F.round(F.regexp_count("_o", F.lit(f"[{of}]")) / F.length("_o") + 1e-9, 4).alias(name) for name, of in CATEGORIES.items()]
    return w.select(*key, F.round(F.col("_w.sigma") / F.col("_w.words") + 1e-9, 4).alias("mean_sigma"), "_w.root", "_w.tier", label.alias("label"), *tiers, *kinds)


def envelope(df: DataFrame, key: list[str], text: str = "text", buckets: int = 100, empty: bool = False) -> DataFrame:
    """key, bucket, value: mean letter value of each of `buckets` equal parts; with `empty` also of parts without letters, as 0."""
    x = F.transform(F.filter(F.split(F.regexp_replace(folded(F.col(text)), r"\s+", ""), ""), lambda c: c != ""), value)
    s = df.select(*key, x.alias("_x")).filter(F.size("_x") > 0)

    def part(b: Column) -> Column:  # bucket b holds the positions from floor(b n / B) to floor((b + 1) n / B)
        first = F.floor(b * F.size("_x") / buckets).cast("int")
        own = F.slice("_x", first + 1, F.floor((b + 1) * F.size("_x") / buckets).cast("int") - first)
        return F.struct(b.alias("bucket"), let(own, lambda v: F.when(F.size(v) > 0, F.round(total(v, F.lit(0.0)) / F.size(v) + 1e-9, 4))).alias("value"))

    out = s.select(*key, F.explode(F.transform(F.sequence(F.lit(0), F.lit(buckets - 1)), part)).alias("p")).select(*key, "p.bucket", "p.value")
    return out.na.fill(0.0, ["value"]) if empty else out.filter("value IS NOT NULL")


def pattern(df: DataFrame, key: list[str], text: str = "text", samples: int = SAMPLES) -> DataFrame:
    """key, pos, value: the first `samples` letter values less their mean, the signal that `spectrum` transforms."""
    s = signal(df, key, text).filter(F.col("pos") < samples)
    return s.select(*key, "pos", F.round(F.col("x") - F.avg("x").over(W.partitionBy(*key)) + 1e-9, 4).alias("value"))


def spectrum(df: DataFrame, key: list[str], text: str = "text", peaks: int = PEAKS) -> DataFrame:
    """key, bin, magnitude, norm_freq: the strongest bins 1 to 127 of a 256-point transform of the first letters."""
    s = signal(df, key, text).filter(F.col("pos") < SAMPLES)
    s = s.withColumn("x", F.col("x") - F.avg("x").over(W.partitionBy(*key)))
    # the transform is a sum over letters for each bin: partial sums are combined before the shuffle
    b = s.select(*key, "pos", "x", F.explode(F.sequence(F.lit(1), F.lit(SAMPLES // 2 - 1))).alias("bin"))
    angle = 2 * math.pi * ((F.col("pos") * F.col("bin")) % SAMPLES) / SAMPLES
    m = b.groupBy(*key, "bin").agg(F.sum(F.col("x") * F.cos(angle)).alias("re"), F.sum(F.col("x") * F.sin(angle)).alias("im"))
    m = m.select(*key, "bin", F.round(F.sqrt(F.col("re") ** 2 + F.col("im") ** 2) + 1e-9, 4).alias("magnitude"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("magnitude"), "bin"))
    return m.withColumn("r", rank).filter(F.col("r") <= peaks).select(*key, "bin", "magnitude", F.round(F.col("bin") / SAMPLES, 6).alias("norm_freq"))


def categories(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, category, n of the letters."""
    only = df.select(*key, F.regexp_replace(folded(F.col(text)), r"\s+", "").alias("_o"))
    n = [F.struct(F.lit(name).alias("category"), F.regexp_count("_o", F.lit(f"[{of}]")).cast("bigint").alias("n")) for name, of in CATEGORIES.items()]
    return only.select(*key, F.explode(F.filter(F.array(*n), lambda c: c["n"] > 0)).alias("c")).select(*key, "c.category", "c.n")
