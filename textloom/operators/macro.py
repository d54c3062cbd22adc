"""Semantic clusters: exact seeds, centroids and cosine similarity.

Seeds are a parameter table (lang, cluster, pole, word, ord) of any size: they are vocabulary, not code. A word that stands in
several poles belongs to the last.

Defined results: texts without content words score 0 for all poles; ties of a vector between poles count for each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.functions.arrays import total

# Polite and casual forms with their weights.
KEIGO = {
    "ございます": 2.5, "いたします": 2.5, "おります": 2.0, "申します": 2.0, "いただきます": 2.0, "くださいます": 2.0, "いらっしゃ": 1.8, "おっしゃ": 1.8, "なさいます": 1.8, "くださ": 1.5, "ご覧": 1.5, "まいります": 1.5, "いただ": 1.5, "存じます": 1.8,
    "ます": 1.0, "ました": 1.0, "ません": 1.0, "でございます": 2.0, "です": 0.8, "でした": 0.8, "でしょう": 0.8, "お": 0.4, "ご": 0.5, "だよ": -0.8, "じゃない": -1.0, "だろう": -0.6, "だな": -0.8, "っていう": -0.6,
}
# Particles that Arabic writes together with the next word, and the marks it may leave out.
AR_PREFIXES = ("وال", "فال", "بال", "لل", "و", "ف", "ب", "ل", "ال")
AR_MARKS = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}]"
#: Poles that a table of scores may have as columns, and values of centroids that an expression may hold.
POLES, CENTROID_VALUES = 200, 100_000
#: Similarity above which a vector counts for a pole.
SIMILAR = 0.65


def lookup(seeds: DataFrame) -> DataFrame:
    """lang, word, cluster, pole: the last definition of a word wins."""
    return seeds.groupBy("lang", F.lower("word").alias("word")).agg(F.max_by(F.struct("cluster", "pole"), "ord").alias("s")).select("lang", "word", "s.cluster", "s.pole")


def exact_hits(tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """tokens (key..., lang, word) that are seeds, with cluster and pole."""
    return tokens.join(lookup(seeds), ["lang", "word"])


def pole_scores(tokens: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """key, pole_name (cluster_pole), score: hits over content tokens; only poles with hits have a row."""
    total = tokens.groupBy(*key).agg(F.count("*").alias("total"))
    hits = exact_hits(tokens, seeds).groupBy(*key, F.concat_ws("_", "cluster", "pole").alias("pole_name")).agg(F.count("*").alias("hits"))
    return hits.join(total, key).select(*key, "pole_name", F.round(F.col("hits") / F.greatest(F.lit(1), F.col("total")) + 1e-9, 6).alias("score"))


def drivers(tokens: DataFrame, seeds: DataFrame, key: list[str], k: int = 5) -> DataFrame:
    """key, pole_name, word, weight: the k words that weigh most in each pole."""
    h = exact_hits(tokens, seeds).groupBy(*key, F.concat_ws("_", "cluster", "pole").alias("pole_name"), "word").agg(F.count("*").alias("weight"))
    rank = F.row_number().over(W.partitionBy(*key, "pole_name").orderBy(F.desc("weight"), "word"))
    return h.withColumn("rank", rank).filter(F.col("rank") <= k)


def centroids(vectors: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, dim, value: normalised mean vector of each label, in long form."""
    m = vectors.select(label, F.posexplode(vector).alias("dim", "x")).groupBy(label, "dim").agg(F.avg("x").alias("x"))
    n = m.groupBy(label).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    return m.join(n, label).select(label, "dim", F.when(F.col("n") > 0, F.col("x") / F.col("n")).otherwise(0.0).alias("value"))


def similar(vectors: DataFrame, centres: DataFrame, key: str = "vec_id", label: str = "label", vector: str = "embedding", least: float = SIMILAR) -> DataFrame:
    """key, pole, sim of the vectors that are closer than `least` to a centroid.

    The centroids' number is checked: up to CENTROID_VALUES values they are part of the expression, and nothing is shuffled;
    beyond, they are joined dimension by dimension, with partial products combined before the shuffle.
    """
    if centres.count() > CENTROID_VALUES:
        v = vectors.select(key, F.posexplode(vector).alias("dim", "x"))
        norm = v.groupBy(key).agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
        dots = v.join(centres.withColumnRenamed(label, "pole"), "dim").groupBy(key, "pole").agg(F.sum(F.col("x") * F.col("value")).alias("dot"))
        sims = dots.join(norm, key).select(key, "pole", F.when(F.col("n") > 0, F.col("dot") / F.col("n")).otherwise(0.0).alias("sim"))
        return sims.filter(F.col("sim") > least)
    poles: dict[object, list[float]] = {}
    for r in centres.orderBy(label, "dim").toLocalIterator():
        poles.setdefault(r[label], []).append(r["value"])
    kind = centres.schema[label].dataType
    if not poles:
        return vectors.select(key, F.lit(None).cast(kind).alias("pole"), F.lit(0.0).alias("sim")).limit(0)

    def product(a: Column, b: Column) -> Column:
        return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0))

    v = F.col(vector)
    norm = F.sqrt(product(v, v))
    sims = F.array(*[F.struct(F.lit(pole).cast(kind).alias("pole"), product(v, F.array(*[F.lit(x) for x in c])).alias("dot")) for pole, c in poles.items()])
    out = vectors.select(key, norm.alias("n"), F.explode(sims).alias("p"))
    return out.select(key, "p.pole", F.when(F.col("n") > 0, F.col("p.dot") / F.col("n")).otherwise(0.0).alias("sim")).filter(F.col("sim") > least)


def pole_table(tokens: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """key, total and a column for each pole (cluster_pole), 0 where there is no hit: hits over content tokens. One shuffle, by key."""
    names = sorted(f"{r[0]}_{r[1]}" for r in seeds.select("cluster", "pole").distinct().limit(POLES + 1).collect())
    if len(names) > POLES:
        raise ValueError(f"more than {POLES} poles; pole_scores has them as rows")
    t = tokens.join(lookup(seeds), ["lang", "word"], "left").withColumn("_p", F.concat_ws("_", "cluster", "pole"))
    return t.groupBy(*key).agg(F.count("*").alias("total"), *[F.round(F.sum((F.col("_p") == n).cast("int")) / F.count("*") + 1e-9, 6).alias(n) for n in names])


def variants(seeds: DataFrame) -> DataFrame:
    """The seeds and other ways to write them: without marks and joiners, in Arabic with particles. A word that is a seed itself stays that seed."""
    bare = F.regexp_replace(F.regexp_replace("word", AR_MARKS, ""), "\u200c", "")
    joined = F.when(F.col("lang") == "ar", F.array(*[F.concat(F.lit(p), bare) for p in AR_PREFIXES])).otherwise(F.array().cast("array<string>"))
    more = seeds.select("lang", "cluster", "pole", "ord", "word", F.explode(F.array_union(F.array(bare), joined)).alias("w")).filter("w != word").drop("word").withColumnRenamed("w", "word")
    # the first definition of a variant counts, the last of a seed: variants are put before all seeds, in reverse
    least = -F.col("ord") - 1_000_000_000
    return seeds.select("lang", "cluster", "pole", "word", F.col("ord").cast("long")).unionByName(more.select("lang", "cluster", "pole", "word", least.cast("long").alias("ord")))


def fallback(tokens: DataFrame, seeds: DataFrame, key: list[str], most: int = 10) -> DataFrame:
    """key, word, pole_name, of texts without any hit: their first `most` different words of two letters or more (tokens have `pos`)."""
    hit = exact_hits(tokens, seeds).select(*key).distinct()
    first = tokens.filter(F.length("word") > 1).join(hit, key, "left_anti").groupBy(*key, "word").agg(F.min("pos").alias("pos"))
    rank = F.row_number().over(W.partitionBy(*key).orderBy("pos"))
    return first.withColumn("rank", rank).filter(F.col("rank") <= most).select(*key, "word", F.lit("baseline_structural").alias("pole_name"))


def entities(mentions: DataFrame, tokens: DataFrame, seeds: DataFrame, key: list[str], most: int = 5) -> DataFrame:
    """key, entity, pole_name, weight: for each entity named in a text (key..., sent, entity) the pole of most hits in a sentence of it."""
    hits = exact_hits(tokens, seeds).groupBy(*key, "sent", F.concat_ws("_", "cluster", "pole").alias("pole_name")).agg(F.count("*").alias("weight"))
    both = mentions.select(*key, "sent", "entity").distinct().join(hits, [*key, "sent"])
    best = both.groupBy(*key, "entity").agg(F.max_by(F.struct("pole_name", "weight"), F.struct(F.col("weight"), F.col("pole_name"))).alias("b")).select(*key, "entity", "b.*")
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("weight"), "entity"))
    return best.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def densities(tokens: DataFrame, fields: DataFrame, key: list[str]) -> DataFrame:
    """key, field, hits, density: words of a field (field, word) over all content tokens; fields without a hit have no row."""
    total_ = tokens.groupBy(*key).agg(F.count("*").alias("total"))
    words = fields.select("field", F.lower("word").alias("word")).distinct()
    hits = tokens.join(words, "word").groupBy(*key, "field").agg(F.count("*").alias("hits"))
    return hits.join(total_, key).select(*key, "field", "hits", F.round(F.col("hits") / F.col("total") + 1e-9, 6).alias("density"))


def politeness(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, formal, casual: weighted uses of polite and casual forms per 100 characters; each form counts by itself."""

    def weighed(sign: int) -> Column:
        used = [(F.length(text) - F.length(F.replace(F.col(text), F.lit(p), F.lit("")))) / len(p) * abs(w) for p, w in KEIGO.items() if w * sign > 0]
        return F.round(sum(used, F.lit(0.0)) * 100 / F.length(text) + 1e-9, 4)

    return df.filter(F.length(text) > 0).select(*key, weighed(1).alias("formal"), weighed(-1).alias("casual"))


def first_contained(tokens: DataFrame, seeds: DataFrame, key: list[str]) -> DataFrame:
    """For scripts without word boundaries: each token takes the first seed (by ord) that it contains.

    Only a token's parts are looked up: parts as long as some seed, each joined with the seeds by equality.
    """
    words = tokens.select("lang", "word").distinct()
    longest = seeds.agg(F.max(F.length("word"))).first()[0] or 1
    part = F.explode(F.flatten(F.transform(F.sequence(F.lit(1), F.least(F.length("word"), F.lit(longest))), lambda n: F.transform(F.sequence(F.lit(1), F.length("word") - n + 1), lambda k: F.substring(F.col("word"), k, n)))))
    hit = words.filter("length(word) > 0").select("lang", "word", part.alias("seed")).join(seeds.withColumnRenamed("word", "seed"), ["lang", "seed"])
    return tokens.join(hit.groupBy("lang", "word").agg(F.min_by(F.struct("cluster", "pole"), "ord").alias("s")).select("lang", "word", "s.cluster", "s.pole"), ["lang", "word"]).select(*key, "word", "cluster", "pole")
