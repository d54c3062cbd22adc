"""Queries over the test tables, and their SQL, for the operators of this subpackage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.llm import canonical as p1
from textloom.llm import garbled as p4
from textloom.llm import language as p7
from textloom.llm import leaks as p8
from textloom.llm import mixing as p9
from textloom.llm import oracle
from textloom.llm import pii as p10
from textloom.llm import quality as p5
from textloom.llm import reading as p3
from textloom.llm import sentences as p2
from textloom.sources import requests, table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1.look_alikes(requests(spark, folder))


def p1_canonical(spark: SparkSession, folder: str) -> DataFrame:
    return p1.canonical(requests(spark, folder).distinct()).select("request_id", "canonical_text")


def p1_classes(spark: SparkSession, folder: str) -> DataFrame:
    return p1.classes(requests(spark, folder))


#: What the SQL of `p2_tiling` takes for white space or nothing.
BLANKS = r"[\s\x{AD}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202C}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]+"


def p2_tiling(spark: SparkSession, folder: str) -> DataFrame:
    """Characters, but white space, that a text's sentences hold, and how many sentences begin before the last one has ended."""
    texts = requests(spark, folder).distinct()
    s = p2.sentences(texts)
    before = F.lag("end_char").over(W.partitionBy("request_id").orderBy("sent_idx"))
    s = s.withColumn("o", (before > F.col("start_char")).cast("bigint")).join(texts, "request_id")
    held = F.length(F.regexp_replace(F.substring("text", F.col("start_char").cast("int") + 1, (F.col("end_char") - F.col("start_char")).cast("int")), BLANKS, ""))
    return s.groupBy("request_id").agg(F.sum(held).alias("solid"), F.coalesce(F.sum("o"), F.lit(0)).cast("bigint").alias("overlaps"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    picked = table(spark, folder, "review_sample").filter("review_task = 'sentences'").select("request_id").distinct()
    texts = requests(spark, folder).join(picked, "request_id", "left_semi")
    return p2.sentences(texts).select("request_id", "start_char", "end_char").distinct()


def p2_sentences(spark: SparkSession, folder: str) -> DataFrame:
    return p2.sentences(requests(spark, folder)).distinct()


def _reading(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Requests picked for reading: those of unknown level, and the texts of known level."""
    picked = table(spark, folder, "review_sample").filter("review_task = 'reading'").groupBy("request_id").agg(F.max("known_level").alias("known_level"))
    texts = requests(spark, folder).join(picked, "request_id")
    return texts.filter("known_level IS NULL"), texts.filter("known_level IS NOT NULL")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    unknown, known = _reading(spark, folder)
    return p3.levels(unknown, p3.grader(known)).select("request_id", "reading_level").distinct()


def p3_levels(spark: SparkSession, folder: str) -> DataFrame:
    return p3.levels(requests(spark, folder), p3.grader(_reading(spark, folder)[1])).distinct()


def p3_scale(spark: SparkSession, folder: str) -> DataFrame:
    """Texts with a word that got a level, and how many levels aren't the score, rounded, from 1 to 3."""
    r = p3_levels(spark, folder).join(requests(spark, folder).filter(F.col("text").rlike(r"\p{L}")).select("request_id").distinct(), "request_id", "left_semi")
    off = ~F.col("reading_score").between(1, 3) | (F.col("reading_level") != F.ceil(F.col("reading_score") - 0.5))
    return r.agg(F.countDistinct("request_id").alias("graded"), F.coalesce(F.sum(off.cast("bigint")), F.lit(0)).alias("off_scale"))


def p4_certain(spark: SparkSession, folder: str) -> DataFrame:
    """Texts of which it is certain whether they are garbled; the digest of what came out, where that must be the text."""
    lost = F.col("text").contains("\ufffd")
    texts = requests(spark, folder).filter(lost | ~F.col("text").rlike(r"[^\x00-\x7F]"))
    out = p4.restore(texts).join(texts.select("request_id", lost.alias("lost")).distinct(), "request_id")
    return out.select("request_id", "garbled", F.when(~F.col("lost"), F.md5("restored")).alias("digest")).distinct()


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4.restore(requests(spark, folder)).filter("garbled").select("request_id").distinct()


def p4_restored(spark: SparkSession, folder: str) -> DataFrame:
    return p4.restore(requests(spark, folder)).filter("garbled").select("request_id", F.col("restored").alias("text")).distinct()


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5.shapes(requests(spark, folder)).filter("text_shape != 'prose'").select("request_id", "text_shape").distinct()


def p5_statistics(spark: SparkSession, folder: str) -> DataFrame:
    return p5.shapes(requests(spark, folder)).distinct()


def p5_ascii(spark: SparkSession, folder: str) -> DataFrame:
    """Some statistics of pure ASCII texts, of which nothing has to be restored first."""
    texts = requests(spark, folder).filter(F.col("text").isNotNull() & ~F.col("text").rlike(r"[^\x00-\x7F]"))
    return p5.shapes(texts).select("request_id", "n_chars", "n_words", "n_lines", F.round(F.col("digit_ratio") + 1e-9, 6).alias("digit_ratio")).distinct()


def p7_order(spark: SparkSession, folder: str) -> DataFrame:
    """Faults in the order of segments, in their codes and confidences: there are none."""
    s = p7_segments(spark, folder)
    w = W.partitionBy("request_id").orderBy("seg_no")
    s = s.withColumns({"before": F.lag("seg_no").over(w), "language": F.lag("lang_code").over(w)})

    def faults(c: Column, name: str) -> Column:
        return F.coalesce(F.sum(c.cast("bigint")), F.lit(0)).alias(name)

    return s.agg(faults(F.col("seg_no") != F.coalesce(F.col("before") + 1, F.lit(0)), "gaps"), faults(F.col("lang_code") == F.col("language"), "repeats"), faults(~F.col("lang_code").isin(*p7.CODES), "unknown_codes"), faults(~F.col("confidence").between(0, 1), "off_scale"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    return p7.wrong_labels(requests(spark, folder, "request_id", "text", "language_code"))


def p7_segments(spark: SparkSession, folder: str) -> DataFrame:
    return p7.segments(requests(spark, folder, "request_id", "text", "language_code")).distinct()


def _leaks(spark: SparkSession, folder: str) -> DataFrame:
    return p8.leaks(table(spark, folder, "documents", "doc_id", "text"), table(spark, folder, "eval_items", "item_id", "text"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder).select("doc_id", "item_id")


def p8_leaks(spark: SparkSession, folder: str) -> DataFrame:
    return _leaks(spark, folder)


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    return p9.mix(table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets"))


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[0]


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    return _mix(spark, folder)[1]


def p9_budgets(spark: SparkSession, folder: str) -> DataFrame:
    """Faults of the mixes: sources off their budget by more than half their largest document, repeated too often, shares that don't add up."""
    docs, targets = table(spark, folder, "documents", "doc_id", "source", "text"), table(spark, folder, "mix_targets")
    rows = p9.sized(docs)
    plan = p9.budgets(rows, targets)
    shares = p9.shares(p9.select(rows, plan), plan)
    largest = rows.groupBy("source").agg(F.max("tokens").alias("largest"))
    s = shares.join(plan.select("mix_name", "source", "budget"), ["mix_name", "source"]).join(largest, "source", "left").na.fill(0, ["largest"])
    s = s.withColumn("whole", F.sum("actual_share").over(W.partitionBy("mix_name")))
    faults = {"off_budget": F.abs(F.col("tokens") - F.col("budget")) > F.col("largest") / 2 + 1, "repeated_too_often": F.col("repeats") > F.col("max_repeats"), "off_sum": F.abs(F.col("whole") - 1) > 1e-9}
    return s.select("mix_name", "source", *[c.cast("bigint").alias(n) for n, c in faults.items()])


def p10_rest(spark: SparkSession, folder: str) -> DataFrame:
    """Texts, spans that overlap, texts whose redaction changed more than the spans, and mail addresses that it left."""
    texts = table(spark, folder, "documents", "doc_id", "text").filter("text IS NOT NULL")
    spans = p10.spans(texts)
    before = F.lag("end_char").over(W.partitionBy("doc_id").orderBy("start_char"))
    overlaps = spans.withColumn("o", before > F.col("start_char")).groupBy("doc_id").agg(F.sum(F.col("o").cast("bigint")).alias("o"), F.sum(F.col("end_char") - F.col("start_char") - F.length("pii_type") - 2).alias("shorter"))
    red = p10.redact(texts).join(texts, "doc_id").join(overlaps, "doc_id", "left").na.fill(0, ["o", "shorter"])
    changed = F.length("redacted") + F.col("shorter") != F.length("text")
    left = F.col("redacted").rlike(r"[A-Za-z0-9]@[A-Za-z0-9][A-Za-z0-9-]*\.[A-Za-z]{2,}")
    return red.agg(F.count("*").alias("texts"), *[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(n) for n, c in (("overlaps", F.col("o")), ("changed_rest", changed.cast("bigint")), ("addresses_left", left.cast("bigint")))])


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    return p10.spans(table(spark, folder, "documents", "doc_id", "text"))


def p10_redacted(spark: SparkSession, folder: str) -> DataFrame:
    return p10.redact(table(spark, folder, "documents", "doc_id", "text"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_canonical, p1_classes, p2_found, p2_sentences, p2_tiling, p3_found, p3_levels, p3_scale, p4_found, p4_restored, p4_certain, p5_found, p5_statistics, p5_ascii, p7_found, p7_segments, p7_order, p8_found, p8_leaks, p9_mix, p9_shares, p9_budgets, p10_found, p10_redacted, p10_rest)}


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
