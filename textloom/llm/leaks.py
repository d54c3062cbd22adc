"""Evaluation texts leaking into training text (problem 8).

One rule makes words of every text, test item or document: widths, ligatures, accents and invisible characters are
brought to one form, letters that look alike or differ by case only become one letter, marks stay with their
letter, all else parts words; in scripts without spaces every character is a word. One Aho-Corasick automaton
holds the normalised questions and answers, cut into all their runs of five words, and scans the normalised
document once. Its hits alone decide which words of an item a document holds; the places of the first and the last
are mapped back to the original text.

The automaton grows with the test items, not with the corpus. Items whose runs have more than AUTOMATON_CHARS
characters are parted by hash, and the corpus is scanned once for each part.

Defined results: null and empty documents leak nothing, nor does an item of fewer than five words; an item
whose words a document holds by half or more is leaked; every copy of a document counts; repeated items count
once; where an id has several texts, each is looked for and the largest share is told.
"""

from __future__ import annotations

import re
import unicodedata as ud
from collections.abc import Iterable, Iterator
from functools import lru_cache

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.canonical import INVISIBLE, looks_alike, transducer
from textloom.llm.worker import Shared

#: Words in an unbroken run, and the share of an item's words that make a leak.
RUN, SHARE = 5, 0.5
#: Characters of runs that one automaton may hold: a node takes about 50 bytes, so this bounds it to 200 MB a worker.
AUTOMATON_CHARS = 4_000_000

JOINERS = "‌‍"
#: A character with what belongs to it: marks, invisible characters, vowels and finals of Hangul.
CLUSTER = re.compile(rf"[\s\S][{INVISIBLE}{JOINERS}̀-ͯ҃-֑҇-ׇؐ-ًؚ-ٰٟۖ-ۭᅠ-ᇿ᪰-᫿᷀-᷿⃐-⃿゙゚ﾞﾟ︠-︯]*")
#: Characters outside ASCII, with the ASCII character before them, to which a mark may belong.
OTHER = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+")
ALONE = re.compile("[฀-໿က-႟ក-៿ぁ-ヿㇰ-ㇿ㐀-鿿豈-﫿\U00020000-\U0003ffff]")


@lru_cache(1)
def _letters() -> dict[int, str]:
    """Letters that look alike or differ by case only -> one of them."""
    parent: dict[str, str] = {}

    def find(c: str) -> str:
        while parent.get(c, c) != c:
            c = parent[c]
        return c

    for a, b in looks_alike().items():
        x, y = find(a.casefold()), find(b.casefold())
        if x != y and len(x) == len(y) == 1:
            parent[max(x, y)] = min(x, y)
    return {ord(c): find(c) for c in parent}


@lru_cache(1)
def _ascii() -> dict[int, str]:
    """ASCII in lower case, all but letters and digits a space."""
    to = _letters()
    return {o: to.get(ord(chr(o).lower()), chr(o).lower()) if chr(o).isalnum() else " " for o in range(128)}


@lru_cache(100_000)
def _cluster(cluster: str) -> str:
    out = ""
    for ch in transducer().resolve(cluster).casefold().translate(_letters()):
        if ALONE.match(ch):
            out += f" {ch} "
        elif ch.isalnum() or ud.category(ch)[0] == "M" and out[-1:].strip():
            out += ch
        elif ch not in JOINERS:
            out += " "
    return out


@lru_cache(50_000)
def _short(run: str) -> str:
    return "".join(map(_cluster, CLUSTER.findall(run)))


def _run(m: re.Match) -> str:
    run = m.group()
    return _short(run) if len(run) <= 40 else "".join(map(_cluster, CLUSTER.findall(run)))


def words(text: str) -> list[str]:
    """The words of a text, in their one form."""
    if not text.isascii():
        text = OTHER.sub(_run, text)
    return text.translate(_ascii()).split()


def places(text: str) -> list[tuple[str, int, int]]:
    """The same words, with their offsets in the text as it is."""
    out: list[tuple[str, int, int]] = []
    word, start, end = "", 0, 0
    for m in CLUSTER.finditer(text):
        c = m.group()
        for ch in _cluster(c).translate(_ascii()) if not c.isascii() else c.translate(_ascii()):
            if ch == " ":
                if word:
                    out.append((word, start, end))
                word = ""
            else:
                start = start if word else m.start()
                word, end = word + ch, m.end()
    return [*out, (word, start, end)] if word else out


class Scanner:
    """The automaton over items (id, text)."""

    def __init__(self, items: Iterable[tuple[int, str]]) -> None:
        runs: dict[str, list[tuple[int, int]]] = {}
        self.ids: list[int] = []
        self.size: list[int] = []
        for n, (item, text) in enumerate(items):
            w = words(text)
            self.ids.append(item)
            self.size.append(len(w))
            for k in range(len(w) - RUN + 1):
                runs.setdefault(f" {' '.join(w[k : k + RUN])} ", []).append((n, k))
        self.automaton = ahocorasick.Automaton()
        for run, at in runs.items():
            self.automaton.add_word(run, tuple(at))
        if runs:
            self.automaton.make_automaton()
        self.empty = not runs

    def leaks(self, text: str) -> list[tuple[int, float, int, int]]:
        """(item, share of its words, start, end) of each leaked item."""
        if self.empty:
            return []
        normal = f" {' '.join(words(text))} "
        held: dict[int, set[int]] = {}
        span: dict[int, tuple[int, int]] = {}
        for end, at in self.automaton.iter(normal):
            for n, k in at:
                held.setdefault(n, set()).update(range(k, k + RUN))
                span[n] = (span[n][0] if n in span else end, end)
        out: dict[int, tuple[float, int, int]] = {}
        where = None
        for n, got in held.items():
            share = len(got) / self.size[n]
            if share < SHARE or self.ids[n] in out and out[self.ids[n]][0] >= share:
                continue
            where = where or places(text)
            first, last = (normal.count(" ", 0, e) - 1 for e in span[n])  # the words at which the hits end
            out[self.ids[n]] = (share, where[first - RUN + 1][1], where[last][2])
        return [(item, *x) for item, x in out.items()]


def _parts(items: DataFrame, item: str, column: str) -> int:
    """Into how many parts the items are cut, so that each automaton keeps within its bound."""
    chars = items.agg(F.sum(F.length(column).cast("long") * RUN)).first()[0] or 0
    return max(1, -(-chars // AUTOMATON_CHARS))


def leaks(docs: DataFrame, items: DataFrame, key: str = "doc_id", item: str = "item_id", column: str = "text") -> DataFrame:
    """One row per document and leaked item: key, item, share, start_char, end_char (from the first to the last word held)."""
    spark = docs.sparkSession
    rows = items.filter((F.length(column) > 0) & F.col(item).isNotNull()).select(item, column).distinct()
    kinds = f"{key} {docs.schema[key].dataType.simpleString()}, {item} {items.schema[item].dataType.simpleString()}, share double, start_char long, end_char long"
    parts = _parts(rows, item, column)
    out = None
    for part in range(parts):
        own = rows if parts == 1 else rows.filter(F.pmod(F.xxhash64(item), F.lit(parts)) == part)
        shared = Shared(spark, sorted(tuple(r) for r in own.toLocalIterator()), Scanner)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            scan = shared.get()
            for b in batches:
                found = [(k, *x) for k, t in zip(b[key], b[column], strict=True) if t for x in scan.leaks(t)]
                if found:
                    yield pd.DataFrame(found, columns=[key, item, "share", "start_char", "end_char"])

        df = docs.select(key, column).mapInPandas(run, kinds)
        out = df if out is None else out.unionAll(df)
    return out
