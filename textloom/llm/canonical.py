"""One consistent form of visually identical text (problem 1).

A longest-match transducer over grapheme clusters is compiled once per Python worker from the Unicode
character data: widths, ligature and presentation forms, composed accents, spaces, invisible characters and joiners
that join nothing are mapped in one pass. Look-alike letters of other scripts map to one letter each; in the
canonical text they take the script of their word, in the key they all become that letter. When the table is
compiled it is checked that no key has two outputs and that every output maps to itself.

Defined results: null stays null, the empty text stays empty; texts of any length are mapped whole.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata as ud
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.session import checkpoint

# Characters that show nothing. U+200C and U+200D show in the joining of Arabic letters, see _joined.
INVISIBLE = "\u00ad\u034f\u061c\u115f\u1160\u17b4\u17b5\u180b\u180c\u180d\u180e\u200b\u200e\u200f\u202a\u202b\u202c\u2060\u2061\u2062\u2063\u2064\u2066\u2067\u2068\u2069\u206a\u206b\u206c\u206d\u206e\u206f\ufeff"
JOINERS = "\u200c\u200d"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"

# Letters of other scripts, each followed by the Latin letter that looks the same.
CYRILLIC = "аa сc еe оo рp хx уy іi ѕs јj һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЅS ЈJ ҮY ԌG ԚQ ԜW ѴV"
GREEK = "οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ"
ARMENIAN = "օo ոn սu հh յj զq ցg ՕO ՍU ՏS"
CHEROKEE = "ᎠD ᎡR ᎢT ᎪA ᎫJ ᎬE ᎳW ᎷM ᎻH ᏀG ᏃZ ᏢP ᏤV ᏚS ᏞL ᏟC ᏦK ᏴB"
LISU = "ꓐB ꓑP ꓓD ꓔT ꓖG ꓗK ꓙJ ꓚC ꓜZ ꓝF ꓟM ꓠN ꓡL ꓢS ꓣR ꓦV ꓧH ꓪW ꓫX ꓬY ꓮA ꓰE ꓲI ꓳO ꓴU"
COPTIC = "ⲟo ⲥc ⲣp ⲎH ⲒI ⲔK ⲘM ⲚN ⲞO ⲢP ⲤC ⲦT ⲬX"
BEYOND = "𐊆E 𐊠A 𐊡B 𐊢C 𐊫O 𐊰M 𐊱T 𐊴X 𐐄O 𐐬o 𐐛L 𐑈s 𐓂O 𐓪o 𐓎U 𐓶u"
CYRILLIC_LOOKS, GREEK_LOOKS, *_OTHER_LOOKS = ({pair[0]: pair[1] for pair in pairs.split()} for pairs in (CYRILLIC, GREEK, ARMENIAN, CHEROKEE, LISU, COPTIC, BEYOND))
SCRIPTS = {"C": CYRILLIC_LOOKS, "G": GREEK_LOOKS} | dict(zip("AEUPB", _OTHER_LOOKS, strict=True))
#: Where the scripts lie: first and last code point.
RANGES = (("L", 0x41, 0x24F), ("G", 0x370, 0x3FF), ("C", 0x400, 0x52F), ("A", 0x530, 0x58F), ("E", 0x13A0, 0x13FF), ("L", 0x1E00, 0x1EFF), ("P", 0x2C80, 0x2CFF), ("U", 0xA4D0, 0xA4FF), ("B", 0x10280, 0x104FF))
# Other characters with one look.
SAME_LOOK = {"‐": "-", "‑": "-", "ʼ": "’", "µ": "μ", "Ω": "Ω"} | dict(zip("۰۱۲۳۷۸۹", "٠١٢٣٧٨٩", strict=True))

APART = re.compile(r"[.!?…。！？\n]")
WORDS = re.compile(r"[^\W\d_]+")
WIDTH_TAGS = ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>")
LIGATURES = ((0xFB00, 0xFB07), (0xFB13, 0xFB18), (0x2E80, 0x2FD6), (0x0132, 0x0134), (0x01C4, 0x01CD), (0x01F1, 0x01F4), (0x2160, 0x2180))
# Arabic letters that join only to the letter before them, or to none: nothing joins after them.
NOT_JOINING_ON = set("اأإآٱدذرزژڑوؤةىءۀہ") - {"ى"}


def _single(ch: str) -> str | None:
    """What a single character stands for, if not for itself."""
    if ch in SAME_LOOK:
        return SAME_LOOK[ch]
    if ch in SPACES:
        return " "
    tag, _, rest = ud.decomposition(ch).partition(" ")
    if not tag:
        return None
    o = ord(ch)
    if tag in WIDTH_TAGS and not 0xFDF0 <= o <= 0xFDFD:
        out = ud.normalize("NFKC", ch)
        return None if out.startswith(" ") and len(out) > 1 else out
    if tag == "<compat>" and any(a <= o < b for a, b in LIGATURES):
        return "".join(chr(int(x, 16)) for x in rest.split())
    if not tag.startswith("<"):
        out = ud.normalize("NFC", ch)
        return out if out != ch else None
    return None


def looks_alike() -> dict[str, str]:
    """Look-alike letter -> the letter it is set to, letters with accents included."""
    table: dict[str, str] = {}
    for pairs in SCRIPTS.values():
        for ch, latin in pairs.items():
            _put(table, ch, latin)
    for o in (*range(0x370, 0x530), *range(0x1F00, 0x2000)):
        parts = ud.normalize("NFD", chr(o))
        if len(parts) > 1 and parts[0] in table and len(out := ud.normalize("NFC", table[parts[0]] + parts[1:])) == 1:
            _put(table, chr(o), out)
    return table


def _put(table: dict[str, str], key: str, out: str) -> None:
    """Enter a key, which must have one output only."""
    if table.setdefault(key, out) != out:
        raise ValueError(f"{key!r} has two outputs: {table[key]!r} and {out!r}")


def mapping() -> dict[str, str]:
    """The whole table: cluster -> canonical characters."""
    table: dict[str, str] = {}
    for o in (*range(0xA0, 0xD800), *range(0xF900, 0x10000), *range(0x2F800, 0x2FA1E)):
        ch = chr(o)
        out = _single(ch)
        if out is not None and out != ch:
            _put(table, ch, out)
        if 0xAC00 <= o <= 0xD7A3 or ud.normalize("NFC", ch) != ch:
            continue
        parts = ud.normalize("NFD", ch)
        if len(parts) > 1:
            for k in range(len(parts) - 1, 0, -1):
                head = ud.normalize("NFC", parts[:k])
                for key in (parts, head + parts[k:]):
                    if key != ch:
                        _put(table, key, ch)
    for o in range(0xAC00, 0xD7A4):  # Hangul syllables, from their letters and from a syllable without final
        parts = ud.normalize("NFD", chr(o))
        _put(table, parts, chr(o))
        if len(parts) == 3:
            _put(table, ud.normalize("NFC", parts[:2]) + parts[2], chr(o))
    for o in range(0xFF66, 0xFF9E):  # half-width kana with a voicing mark
        for mark in "ﾞﾟ゙゚":
            out = ud.normalize("NFKC", chr(o) + mark)
            if len(out) == 1:
                _put(table, chr(o) + mark, out)
    return table


def unclosed(table: dict[str, str]) -> list[str]:
    """Keys whose output is mapped again, so that one pass would not be enough."""
    return [k for k, v in table.items() if any(c in table for c in v)]


class Transducer:
    """The compiled table. `canonical` maps a text in one pass; `key` is the same for equal-looking texts."""

    def __init__(self) -> None:
        table = mapping()
        for k in unclosed(table):
            table[k] = "".join(table.get(c, c) for c in table[k])
        if left := unclosed(table):
            raise ValueError(f"the mapping isn't closed: {left[:5]}")
        self.trie: dict = {}
        for k, v in table.items():
            node = self.trie
            for c in k:
                node = node.setdefault(c, {})
            node[""] = v
        singles = "".join(sorted({k for k in table if len(k) == 1} | {k[0] for k in table if len(k) > 1 and ord(k[0]) in range(0x1100, 0x1200)}))
        marks = "".join(sorted({c for k in table if len(k) > 1 for c in k[1:]}))
        marks = "".join(sorted(set(marks) | {chr(o) for o in range(0x300, 0x370) if chr(o) not in INVISIBLE}))
        # A run of characters that start or continue a cluster of the table; the base before a mark belongs to it.
        # Astral characters stand apart: within the class they would turn its bitmap into a list.
        self.runs = re.compile(f"(?:[{re.escape(''.join(c for c in singles + marks + INVISIBLE + JOINERS if c <= '\uffff'))}]|[\U0002f800-\U0002fa1d])+")
        self.bare = set(singles)
        self.resolve = lru_cache(200_000)(self._resolve)
        looks = looks_alike()
        self.skeleton = str.maketrans(looks)
        self.scripts = {name: {latin: ch for ch, latin in pairs.items()} for name, pairs in SCRIPTS.items()}
        self.foreign = re.compile(f"[{''.join(chr(a) + '-' + chr(b) for name, a, b in RANGES if name != 'L')}]")
        self.forms = lru_cache(10_000)(self._forms)

    def _resolve(self, cluster: str) -> str:
        text = "".join(c for c in cluster if c not in INVISIBLE)
        if len(text) > 2 and sum(ud.combining(c) > 0 for c in text) > 1:
            text = ud.normalize("NFC", text)  # several marks: their canonical order first
        out, at = [], 0
        while at < len(text):
            node, best, end, k = self.trie, None, at, at
            while k < len(text) and (node := node.get(text[k])) is not None:
                k += 1
                if "" in node:
                    best, end = node[""], k
            if best is None:
                out.append(text[at])
                at += 1
            else:
                out.append(best)
                at = end
        done = "".join(out)
        return done if done == text or len(done) < 2 else ud.normalize("NFC", done)

    @staticmethod
    def _script(ch: str) -> str | None:
        o = ord(ch)
        for name, a, b in RANGES:
            if o <= b:
                return name if a <= o and ch.isalpha() else None
        return None

    def _forms(self, ch: str) -> dict[str, str]:
        """Script -> the letter of that script which looks like ch."""
        own = self._script(ch)
        if own is None:
            return {}
        latin = ch.translate(self.skeleton)
        forms = {name: to[latin] for name, to in self.scripts.items() if latin in to}
        if self._script(latin) == "L":
            forms["L"] = latin
        return forms | {own: ch}

    def _own_script(self, text: str) -> str:
        """A word of look-alike letters takes the script that all its letters have a form in; of several the one of the nearest word that leaves no doubt, in its sentence if there is one."""
        if not self.foreign.search(text):
            return text
        has = {s for s in map(self._script, set(text)) if s}
        if len(has) < 2 and has <= {"L", "C", "G"}:
            return text
        words = list(WORDS.finditer(text))
        choice: list[set[str]] = []
        for m in words:
            forms = [f for ch in m.group() if (f := self.forms(ch))]
            choice.append(set(forms[0]).intersection(*forms) if forms else set())
        before: list[tuple[int, str] | None] = []
        part: list[int] = []  # the sentence or line of each word, about
        last = None
        for k, to in enumerate(choice):
            part.append(part[-1] + (APART.search(text, words[k - 1].end(), words[k].start()) is not None) if part else 0)
            last = (k, next(iter(to))) if len(to) == 1 else last
            before.append(last)
        out, at, after = [], len(text), None
        for k in range(len(words) - 1, -1, -1):
            to, m = choice[k], words[k]
            if len(to) == 1:
                after = (k, next(iter(to)))
            near = sorted((part[x[0]] != part[k], abs(x[0] - k), x[0] > k, x[1]) for x in (before[k], after) if x and x[1] in to)
            name = near[0][3] if near else "L" if "L" in to else min(to, default=None)
            word = m.group()
            out.append(text[m.end() : at])
            out.append("".join(self.forms(ch).get(name, ch) for ch in word) if name else word)
            at = m.start()
        out.append(text[:at])
        return "".join(reversed(out))

    def _joined(self, run: str, left: str, right: str) -> str:
        """A run with joiners between its neighbours: a (non-)joiner stays only where it changes how letters are drawn."""
        parts = re.split(f"([{JOINERS}]+)", "".join(c for c in run if c not in INVISIBLE))
        parts[::2] = map(self._resolve, parts[::2])
        for k in range(1, len(parts), 2):
            a, b = (parts[k - 1] or left)[-1:], (parts[k + 1] or right)[:1]
            arabic = [c != "" and 0x620 <= ord(c) < 0x780 and c.isalpha() for c in (a, b)]
            joins = arabic[0] and a not in NOT_JOINING_ON
            if "\u200c" in parts[k]:
                parts[k] = "\u200c" if joins and arabic[1] and b != "ء" else ""
            elif any(c != "" and ud.category(c) == "So" for c in (a, b)):
                parts[k] = "\u200d"
            else:
                parts[k] = "\u200d" if any(arabic) and not (joins and arabic[1]) else ""
        return self._resolve("".join(parts))  # marks that a joiner kept apart

    def _pass(self, text: str) -> str:
        out, at = [], 0
        for m in self.runs.finditer(text):
            start = m.start() - (m.start() > at and text[m.start()] not in self.bare)
            run = text[start : m.end()]
            if "\u200c" in run or "\u200d" in run:
                done = self._joined(run, text[max(0, start - 1) : start], text[m.end() : m.end() + 1])
            else:
                done = self.resolve(run) if len(run) <= 40 else self._resolve(run)
            out += text[at:start], done
            at = m.end()
        return "".join((*out, text[at:])) if at else text

    def canonical(self, text: str) -> str:
        return text if text.isascii() else self._own_script(self._pass(text))

    def key(self, text: str) -> bytes:
        return hashlib.blake2b((text if text.isascii() else self._pass(text).translate(self.skeleton)).encode("utf-8", "surrogatepass"), digest_size=16).digest()


@lru_cache(1)
def transducer() -> Transducer:
    return Transducer()


@F.pandas_udf(T.StringType())
def _canonical(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    t = transducer()
    for s in texts:
        yield s.map(t.canonical, na_action="ignore")


@F.pandas_udf(T.BinaryType())
def _key(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    t = transducer()
    for s in texts:
        yield s.map(t.key, na_action="ignore")


def canonical(df: DataFrame, column: str = "text", to: str = "canonical_text") -> DataFrame:
    """`column` in its canonical form, as `to`."""
    return df.withColumn(to, _canonical(F.col(column)))


#: Rows of one text that one task may hold on one side of the pair join; larger groups are salted.
GROUP_ROWS = 10_000


def _looked_at(df: DataFrame, key: str, column: str) -> DataFrame:
    """id, k (16-byte key of the look), h (16-byte hash of the text) of the rows with an id and a text; kept, for the keys are dear."""
    rows = df.filter(F.col(column).isNotNull() & F.col(key).isNotNull())
    return checkpoint(rows.select(F.col(key).alias("id"), _key(F.col(column)).alias("k"), F.unhex(F.md5(column)).alias("h")).distinct())


def classes(df: DataFrame, key: str = "request_id", column: str = "text") -> DataFrame:
    """One row per document with a text: key, class_id (smallest key of those that look the same), links (documents of other texts in the class).

    Copies are counted, not paired; a class may hold any share of the rows.
    """
    rows = _looked_at(df, key, column)
    texts = rows.groupBy("k", "h").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    looks = texts.groupBy("k").agg(F.sum("copies").alias("n"), F.min("first").alias("class_id"))
    of = texts.join(looks, "k").select("k", "h", "class_id", (F.col("n") - F.col("copies")).alias("links"))
    return rows.join(of, ["k", "h"]).select(F.col("id").alias(key), "class_id", "links")


def look_alikes(df: DataFrame, key: str = "request_id", column: str = "text") -> DataFrame:
    """Pairs (smaller id first) of rows whose texts differ as strings and look the same.

    Only (id, 16-byte key, 16-byte hash of the text) are shuffled. Different texts of one look are paired first, then
    their rows. The rows of one text are split by salt beyond GROUP_ROWS, and those of the other repeated once
    for each salt, so that what is repeated stays below a GROUP_ROWS-th of the pairs that come out.
    """
    rows = _looked_at(df, key, column)
    texts = rows.groupBy("k", "h").agg(F.count("*").alias("n"))
    several = texts.groupBy("k").agg(F.count("*").alias("texts")).filter("texts > 1").select("k")
    texts = texts.join(several, "k")
    a = texts.select("k", F.col("h").alias("ha"), F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("salts"))
    pairs = a.join(texts.select("k", F.col("h").alias("hb")), "k").filter("ha < hb")
    left = rows.select(F.col("id").alias("a"), "k", F.col("h").alias("ha")).join(pairs, ["k", "ha"])
    left = left.select("a", "k", "ha", "hb", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    right = rows.select(F.col("id").alias("b"), "k", F.col("h").alias("hb")).join(pairs, ["k", "hb"])
    right = right.select("b", "k", "ha", "hb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    both = left.join(right, ["k", "ha", "hb", "salt"]).filter("a != b")
    return both.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
