"""The whole analysis of documents: windows and the feature tables keyed by (doc_id, win_idx)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.operators import baseline, entropy, micro, telemetry, wave, windows


def analyze(docs: DataFrame, size: int = 1000, stride: int = 500, key: str = "doc_id", text: str = "text") -> dict[str, DataFrame]:
    """Tables of one analysis: windows, telemetry, micro, entropy, wave, and baselines of the micro axes."""
    w = windows.windows(docs, size, stride, key, text)
    k = [key, "win_idx"]
    axes = micro.vectors(w, k)
    names = ["intensity", "anxiety", "attention", "emotion", "agitation", "complexity"]
    long = axes.unpivot(k, names, "variable", "value")
    return {
        "windows": w,
        "telemetry": telemetry.hidden(telemetry.word_counts(w)).drop("text"),
        "micro": axes,
        "entropy": entropy.entropy(w, k),
        "wave": wave.summary(w, k),
        "baselines": baseline.running(long, ["variable"], k),
    }


def flagship(docs: DataFrame) -> DataFrame:
    """Windows with their telemetry and letter-weight axes."""
    w = windows.windows(docs)
    t = telemetry.word_counts(w).drop("text")
    axes = micro.axes(w, ["doc_id", "win_idx"])
    return t.join(axes, ["doc_id", "win_idx"], "left").withColumn("words_per_line", F.round(F.col("total_words") / (F.col("end_line") - F.col("start_line") + 1), 2))
