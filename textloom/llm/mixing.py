"""Mixing sources to target shares (problem 9).

Every document gets its size in tokens of a public tokenizer and a random key from the hash of its id. The keys
range-partition each source into buckets; sums of the buckets give distributed prefix sums, and each source is cut
where its exact budget is reached, after as many whole epochs as the budget holds. No source, however large,
is ordered in one task.

Defined results: the size of a mix is the largest for which no source needs more than its repeats, unless
`total_tokens` asks for another (then sources that fall short give all they may). Shares are taken relative to the
sources that have documents; a target without documents is reported with share 0; documents of a null or
untargeted source, and those without a token, are in no mix. Repeated target rows count once.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from textloom.session import checkpoint

#: The vocabulary file; a parameter of every function that counts. It must be there on every executor.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Documents that one bucket of the range partition holds, about, and buckets of one span of the level above.
BUCKET_ROWS = 5_000
SPAN = 1_000
# Fixed value: how byte-level BPE vocabularies of this kind split a text before merging.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(2)
def _encoding(path: str):  # noqa: ANN202
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding(Path(path).stem, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(df: DataFrame, column: str = "text", tokenizer: str = TOKENIZER, to: str = "tokens") -> DataFrame:
    """Tokens of each text, as `to`; 0 for null and empty texts. The vocabulary file must be there on every executor."""

    @F.pandas_udf(T.LongType())
    def count(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encode = _encoding(tokenizer).encode_ordinary
        for s in texts:
            yield s.map(lambda t: len(encode(t.encode("utf-8", "replace").decode("utf-8"))) if isinstance(t, str) and t else 0)

    return df.withColumn(to, count(F.col(column)))


def sized(docs: DataFrame, key: str = "doc_id", source: str = "source", column: str = "text", tokenizer: str = TOKENIZER, seed: int = 0) -> DataFrame:
    """key, source, tokens and random key of the documents with a source and a token; checkpointed, for tokenizing is dear."""
    rows = token_counts(docs.select(key, source, column).filter(F.col(source).isNotNull()), column, tokenizer)
    h = F.xxhash64(F.lit(seed), F.col(source), F.col(key))
    return checkpoint(rows.filter("tokens > 0").select(F.col(key).alias("key"), F.col(source).alias("source"), "tokens", h.alias("h")))


def budgets(rows: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """mix_name, source, target_share, max_repeats, size of the source, budget, whole epochs and the rest of the last one."""
    sizes = rows.groupBy("source").agg(F.sum("tokens").alias("size"))
    t = targets.filter("target_share > 0 AND max_repeats > 0 AND source IS NOT NULL").select("mix_name", "source", "target_share", "max_repeats").dropDuplicates(["mix_name", "source"])
    mix = W.partitionBy("mix_name")
    t = t.join(sizes, "source", "left").withColumn("size", F.coalesce("size", F.lit(0)))
    t = t.withColumn("share", F.when(F.col("size") > 0, F.col("target_share") / F.sum(F.when(F.col("size") > 0, F.col("target_share"))).over(mix)).otherwise(0.0))
    room = F.when(F.col("size") > 0, F.col("max_repeats") * F.col("size") / F.col("share"))
    total = F.lit(float(total_tokens)) if total_tokens else F.min(room).over(mix)
    budget = F.least(F.col("share") * total, (F.col("max_repeats") * F.col("size")).cast("double"))
    t = t.withColumn("budget", F.floor(F.when(F.col("size") > 0, budget).otherwise(0.0) + 1e-6))
    epochs = F.when(F.col("size") > 0, F.floor(F.col("budget") / F.col("size"))).otherwise(0)
    return t.withColumn("epochs", epochs.cast("int")).withColumn("rest", F.col("budget") - F.col("epochs") * F.col("size"))


def _before(parts: DataFrame, by: list[str], order: str) -> DataFrame:
    """Adds `before`: the sum of `part` over the earlier rows in `order`."""
    w = W.partitionBy(*by).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return parts.withColumn("before", F.coalesce(F.sum("part").over(w), F.lit(0)))


def select(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_name, key, source, tokens, repeats (how often the document stands in the mix).

    Prefix sums have three levels: of spans within a source, of buckets within a span, of documents within a bucket. With
    10^10 documents a source has 2000 spans, so that no level gathers much in one task.
    """
    n = rows.count()
    buckets = max(1, -(-n // BUCKET_ROWS))
    # the key's range, cut into equal parts: parts in order are the source in order
    rows = rows.withColumn("bucket", F.floor((F.shiftrightunsigned("h", 1) / F.lit(float(2**63))) * buckets).cast("long"))
    part = rows.groupBy("source", "bucket").agg(F.sum("tokens").alias("part")).withColumn("span", F.floor(F.col("bucket") / SPAN))
    spans = _before(part.groupBy("source", "span").agg(F.sum("part").alias("part")), ["source"], "span").select("source", "span", F.col("before").alias("lower"))
    part = _before(part, ["source", "span"], "bucket").join(spans, ["source", "span"]).select("source", "bucket", (F.col("before") + F.col("lower")).alias("before"))
    order = W.partitionBy("source", "bucket").orderBy(F.shiftrightunsigned("h", 1), "h", "key").rowsBetween(W.unboundedPreceding, W.currentRow)
    rows = rows.join(part, ["source", "bucket"]).withColumn("upto", F.col("before") + F.sum("tokens").over(order))
    plan = plan.filter("budget > 0").select("mix_name", "source", "epochs", "rest", "max_repeats")
    # the document at the cut is in if more than half of it is within the budget
    cut = (F.col("upto") - F.col("tokens") / 2 <= F.col("rest")).cast("int")
    repeats = F.least(F.col("epochs") + cut, F.col("max_repeats").cast("int"))
    # the plan has a row for each target, a table of a few rows that Spark may broadcast if it measures it to be small
    return rows.join(plan, "source").withColumn("repeats", repeats).filter("repeats > 0").select("mix_name", "key", "source", "tokens", "repeats")


def shares(mixed: DataFrame, plan: DataFrame) -> DataFrame:
    """mix_name, source, target_share, actual_share, tokens, documents and most repeats of each target."""
    got = mixed.groupBy("mix_name", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("repeats"))
    out = plan.select("mix_name", "source", "target_share", "max_repeats").join(got, ["mix_name", "source"], "left").na.fill(0, ["tokens", "documents", "repeats"])
    total = F.sum("tokens").over(W.partitionBy("mix_name"))
    return out.withColumn("actual_share", F.when(total > 0, F.col("tokens") / total).otherwise(0.0))


def mix(docs: DataFrame, targets: DataFrame, total_tokens: int | None = None, key: str = "doc_id", tokenizer: str = TOKENIZER, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the mixes' documents with their repeats, the shares actually reached)."""
    rows = sized(docs, key, tokenizer=tokenizer, seed=seed)
    plan = budgets(rows, targets, total_tokens)
    mixed = select(rows, plan)
    return mixed.withColumnRenamed("key", key), shares(mixed, plan)
