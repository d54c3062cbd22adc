"""Segments, sliding windows and places in a text. Offsets are code points.

Defined results: null, empty and blank texts have no segment and no window; repeated documents give equal rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let, prefix_sums
from textloom.functions.text import breaks, is_blank

# Words that open a heading line.
HEADING = r"(?:chapter|section|part|prologue|epilogue|\d+\.)\s+"
MARK = "\u0001"


def marked(text: Column) -> Column:
    """A mark before and after each run of line breaks and before each heading that follows a single line break."""
    text = F.regexp_replace(text, r"([^\n])(\n\n+)", f"$1{MARK}$2{MARK}")
    return F.regexp_replace(text, rf"(?i)([^\n{MARK}]\n)({HEADING})", f"$1{MARK}$2")


def _parts(text: Column) -> Column:
    """(seg, seg_text, offset, line, eof) of every part between boundaries, with the characters and line breaks before it."""

    def placed(p: Column) -> Column:
        return let(
            F.struct(p.alias("p"), prefix_sums(F.transform(p, F.length)).alias("o"), prefix_sums(F.transform(p, breaks)).alias("l")),
            lambda s: F.transform(s["p"], lambda x, k: F.struct(k.alias("seg"), x.alias("seg_text"), F.element_at(s["o"], k + 1).cast("int").alias("offset"), F.element_at(s["l"], k + 1).alias("line"), (k == F.size(s["p"]) - 1).alias("eof"))),
        )

    return F.filter(let(F.split(marked(text), MARK), placed), lambda s: ~is_blank(s["seg_text"]))


def segments(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seg, offset, seg_text, eof: the parts between boundaries that aren't blank. All within the row: nothing is shuffled."""
    s = docs.filter(F.length(text) > 0).select(key, F.explode(_parts(F.col(text))).alias("s"))
    return s.select(key, "s.seg", "s.seg_text", "s.offset", "s.eof")


def _cut(s: Column, size: int, stride: int) -> Column:
    """The windows of a part. It is cut into strides once, and each window puts together the strides it covers."""
    strides = -(-size // stride)
    count = F.greatest(F.lit(0), F.ceil((F.length(s["seg_text"]) - size) / stride)).cast("int")

    def windows_of(x: Column) -> Column:
        def one(i: Column) -> Column:
            t = F.substring(F.array_join(F.slice(x["c"], i + 1, strides), ""), 1, size)
            start = (s["offset"] + i * stride).cast("int")
            line = (s["line"] + F.element_at(x["l"], i + 1) + 1).cast("int")
            reason = F.when((i == 0) & ~s["eof"], "structural_boundary").otherwise("stride")
            return F.struct(start.alias("start_char"), (start + F.length(t)).cast("int").alias("end_char"), reason.alias("reset_reason"), line.alias("start_line"), (line + breaks(t)).cast("int").alias("end_line"), t.alias("text"))

        return F.transform(F.sequence(F.lit(0), count), one)

    chunks = F.regexp_extract_all(s["seg_text"], F.lit(f"(?s).{{1,{stride}}}"), F.lit(0))
    return let(chunks, lambda c: let(F.struct(c.alias("c"), prefix_sums(F.transform(c, breaks)).alias("l")), windows_of))


def windows(docs: DataFrame, size: int = 1000, stride: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, win_idx, start_char, end_char, reset_reason, start_line, end_line, text of every window.

    The last window of a segment is the first that reaches its end; blank windows are skipped and use no index. All is done
    within the document's row, in time linear in its length: no shuffle, no join.
    """
    if not 0 < stride < size:
        raise ValueError("stride must lie between 0 and the window size")
    found = F.filter(F.flatten(F.transform(_parts(F.col(text)), lambda s: _cut(s, size, stride))), lambda w: ~is_blank(w["text"]))
    w = docs.filter(F.length(text) > 0).select(key, F.posexplode(found).alias("win_idx", "w"))
    return w.select(key, "win_idx", "w.start_char", "w.end_char", "w.reset_reason", "w.start_line", "w.end_line", "w.text")


def plain_windows(docs: DataFrame, size: int = 1000, stride: int = 500, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, win_idx and text of every window."""
    return windows(docs, size, stride, key, text).select(key, "win_idx", "text")


def line_index(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, line_no (from 1), start_char of every line."""
    starts = let(F.split(F.col(text), "\n"), lambda p: prefix_sums(F.transform(p, lambda x: F.length(x) + 1)))
    lines = docs.filter(F.col(text).isNotNull()).select(key, F.posexplode(starts).alias("k", "start_char"))
    return lines.select(key, (F.col("k") + 1).alias("line_no"), "start_char")


def excerpt(text: Column, most: int = 140) -> Column:
    """A text of at most `most` characters: cut before its last blank, with an ellipsis, where it is longer."""
    head = F.regexp_replace(F.substring(text, 1, most - 1), r" [^ ]*\z", "")
    return F.when(F.length(text) <= most, text).otherwise(F.concat(head, F.lit("…")))


def snippets(w: DataFrame, text: str = "text", length: int = 60) -> DataFrame:
    """The first and last `length` characters of a text, cut at a word."""
    t = F.col(text)
    short = F.length(t) <= length
    head = F.regexp_replace(F.substring(t, F.lit(1), F.lit(length)), r"\s\S*\z", "")
    tail = F.regexp_replace(F.substring(t, F.length(t) - length + 1, F.lit(length)), r"^\S*\s", "")
    return w.withColumns({"head": F.when(short, t).otherwise(head), "tail": F.when(short, t).otherwise(tail)})
