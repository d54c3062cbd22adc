"""Text that was decoded with the wrong character encoding (problem 4).

A noisy channel: each piece of a text (between ASCII white space) may have passed a channel "bytes of encoding
R, read as encoding W". The channels' inverse gives byte lattices; a lost byte is a wildcard in them. A Viterbi search
through a piece's lattice, whose states are the vocabulary's prefixes, finds its likeliest reading under the frequencies of
words (of character pairs in scripts without spaces) in the whole corpus, and a second one over the pieces finds the
likeliest channels. A text with a piece that a channel other than none explains is garbled.

The VOCABULARY most frequent units are broadcast. Where the corpus has more, the rarer ones that a text or one of its
readings needs are looked up by a join and travel with the text, so that no word is taken for unknown. A Bloom filter of the
corpus's units goes before that join, so that of the many units of wrong readings hardly one is asked for.

Defined results: null, empty and pure ASCII texts are never garbled and come back as they are; a replacement
character (U+FFFD) always is a trace of lost bytes; what can't be restored stays as it is.
"""

from __future__ import annotations

import math
import re
import sys
from array import array
from bisect import bisect_left
from collections import ChainMap, Counter
from collections.abc import Callable, Iterator
from copy import copy
from functools import lru_cache
from hashlib import md5
from itertools import chain, compress, islice, product
from struct import Struct
from typing import Any
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from textloom.llm.canonical import transducer
from textloom.llm.worker import Shared
from textloom.session import checkpoint

#: Most frequent units of the corpus that are broadcast (about 10 MB); rarer ones are joined.
VOCABULARY = 150_000

#: Most bits of the filter of all units (8 MB), and bits a unit below that; with more units it only lets more through.
FILTER_BITS, UNIT_BITS = 1 << 26, 32

#: Pieces that a worker remembers: (up to so many characters, so many of them). Long ones take the room and hardly come again.
REMEMBERED = ((40, 100_000), (300, 5_000))

#: Rows of asked units that a worker holds before it passes them on.
ASKED_ROWS = 10_000

SINGLE = ("cp1252", "cp1250", "cp1251", "cp1253", "cp1254", "cp1256", "cp437", "cp850", "cp852", "cp866", "koi8-r", "mac_roman", "mac_cyrillic", "iso8859-2", "iso8859-5", "iso8859-6", "iso8859-15")
DOUBLE = ("gbk", "big5", "cp932", "cp949", "euc_jp")
LATIN_READERS = ("cp1252", "cp437", "cp850", "mac_roman", "cp1250", "cp1251", "iso8859-15", "koi8-r", "cp866", "cp1254", "cp852")
#: (W, R): read as W, written in R.
CHANNELS = (
    [(w, "utf-8") for w in SINGLE + DOUBLE]
    + [(w, r) for r in ("cp1251", "koi8-r", "cp866", "iso8859-5", "mac_cyrillic") for w in ("cp1252", "cp1251", "koi8-r", "cp866", "iso8859-5", "mac_roman", "cp437", "cp850", "mac_cyrillic") if w != r]
    + [(w, r) for r in ("cp1256", "iso8859-6") for w in ("cp1252", "cp1251", "cp437", "cp850", "mac_roman", "cp1256", "koi8-r") if w != r]
    + [(w, r) for r in ("cp1252", "cp850", "cp437", "mac_roman", "cp1250") for w in LATIN_READERS if w != r]
    + [(w, r) for r in DOUBLE for w in ("cp1252", "cp1251", "mac_roman", "cp437", "cp850", *DOUBLE) if w != r]
)

NO_SPACE = "ᄀ-ᇿㄅ-㆏぀-ヿ㐀-鿿가-힯豈-﫿"
UNIT = re.compile(rf"[{NO_SPACE}々ー]+|[^\W\d_{NO_SPACE}]+|[^\w\s]|�+")
IDEOGRAPH = re.compile(rf"[{NO_SPACE}]")
#: A text is cut into pieces at white space, where a script without spaces begins or ends, and after its full stops.
BROKEN = re.compile(r"[^\W\d_]*(?:�+[^\W\d_]+)+�*|[^\W\d_]+�+")
NOT_ASCII = re.compile(r"[^\x00-\x7f]+")
CONTROL = re.compile("[\x00-\x1f]")
C1 = re.compile("[\x80-\x9f]")
NEXT_TO = re.compile(r"[^\x00-\x7f]{2}")
WIDE = "　-〿！-ﾟ" + NO_SPACE
MORE = f"[{WIDE}�]|[∀-⋿─-◿､](?=[{WIDE}�])"  # within such a run, what double-byte tables hold besides
PIECE = re.compile(rf"[ \t\n\r]+|[{WIDE}](?:{MORE})*?(?:(?<=[。！？])|(?!{MORE}))|[^ \t\n\r{WIDE}]+")
# Signs that are common in some language's typography.
TYPOGRAPHIC = set("“”‘’„«»‹›…–—°º£€¿¡§±•·№©®™、。「」『』《》〈〉【】！？，：；（）・～，؛؟،٪¥")


def units(text: str) -> list[str]:
    """Lower-case words, pairs of characters in scripts without spaces, and single signs outside ASCII."""
    out = []
    for m in UNIT.finditer(text):
        w = m.group()
        if w[0] >= "ᄀ" and IDEOGRAPH.match(w):
            out += [w[k : k + 2] for k in range(len(w) - 1)] or [w]
        elif w[0].isalpha():
            out.append(w.lower())
        elif not w.isascii():
            out.append(w[0])
    return out


def _table(codec: str) -> dict[int, int]:
    """Character -> character of the byte's number, for a single-byte codec; undefined bytes stand for themselves."""
    to: dict[int, int] = {o: 0x10FFFF for o in range(0x80, 0x100)}
    for b in range(0x80, 0x100):
        try:
            to[ord(bytes([b]).decode(codec))] = b
        except UnicodeDecodeError:
            to[b] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):  # C1 controls: the same bytes, read as Latin-1
            to[b] = b
    return to


TABLES = {codec: _table(codec) for codec in SINGLE}


def _bytes(text: str, codec: str) -> bytes | None:
    try:
        return text.translate(TABLES[codec]).encode("latin-1") if codec in TABLES else text.encode(codec)
    except UnicodeEncodeError:
        return None


#: Bytes that a reader has no character for (a double-byte one may find none for any), so that they get lost.
LOST = {**dict.fromkeys(DOUBLE, tuple(range(0x80, 0xC0))), "cp1252": (0x81, 0x8D, 0x8F, 0x90, 0x9D), "cp1250": (0x81, 0x83, 0x88, 0x90, 0x98), "cp1251": (0x98,)}


def _raw(text: str, w: str) -> bytes | None:
    """The bytes that were read as w; the first byte that w loses stands for a lost one."""
    if "�" not in text:
        return _bytes(text, w)
    parts = [_bytes(p, w) for p in text.split("�")]
    return None if None in parts else bytes([LOST.get(w, b"?")[0]]).join(parts)


#: A whole character of UTF-8 beyond ASCII; bytes without one are no UTF-8 that some reader took for another encoding.
MULTIBYTE = re.compile(rb"[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3}")


HIGH = bytes(range(0x80, 0x100))


def _read(raw: bytes, r: str) -> str | None:
    """Bytes read as r. A few lost ones are wildcards (U+FFFD)."""
    if r == "utf-8" and not MULTIBYTE.search(raw):
        return raw.decode("ascii") if raw.isascii() else None
    try:
        return raw.decode(r)
    except UnicodeDecodeError:
        if r == "utf-8" and sum(map(len, MULTIBYTE.findall(raw))) < len(raw) - len(raw.translate(None, HIGH)) >> 1:
            return None  # fewer than half of the bytes beyond ASCII are in whole characters
        out = raw.decode(r, "replace")
        lost = out.count("�")
        return out if len(out) - len(NOT_ASCII.sub("", out)) - lost > 2 * lost else None


def _invert(text: str, w: str, r: str) -> str | None:
    """What was written in r, if `text` is it read as w."""
    raw = _raw(text, w)
    return None if raw is None else _read(raw, r)


#: The channels by W: (number, R).
BY_READER: dict[str, list[tuple[int, str]]] = {}
for _c, (_w, _r) in enumerate(CHANNELS):
    BY_READER.setdefault(_w, []).append((_c, _r))


#: Places of a unit in the filter, from its MD5; one more is from its CRC.
PLACES = Struct(">4I").unpack


class Vocabulary(dict[str, int]):
    """Units with their counts; `single` are those that one text alone uses, however often it is there."""

    single: frozenset[str] = frozenset()
    characters: frozenset[str] = frozenset()
    total: int = 0
    rest: DataFrame | None = None
    _models: Shared | None = None

    def packed(self) -> tuple[bytes, bytes, bytes, frozenset[str], int]:
        """What a model is built of, in little memory: a worker keeps it as long as the model."""
        return "\n".join(self).encode("utf-8", "surrogatepass"), array("q", self.values()).tobytes(), bytes(u in self.single for u in self), self.characters, self.total

    @classmethod
    def unpacked(cls, packed: tuple[bytes, bytes, bytes, frozenset[str], int]) -> Vocabulary:
        names, counts, single, characters, total = packed
        names = names.decode("utf-8", "surrogatepass").split("\n") if counts else []
        out = cls(zip(names, memoryview(counts).cast("q"), strict=True))
        out.single, out.characters, out.total = frozenset(compress(names, single)), characters, total
        return out

    def models(self, spark: SparkSession) -> Shared:
        """The workers' model, one for all that use this vocabulary."""
        if self._models is None:
            self._models = Shared(spark, self.packed(), lambda x: Model(Vocabulary.unpacked(x)))
        return self._models


def remembering(of: Callable[[str], Any]) -> Callable[[str], Any]:
    """A function of pieces that remembers what it gave for them, within the bounds of REMEMBERED."""
    (short, many), (long, few) = REMEMBERED
    often, seldom = lru_cache(many)(of), lru_cache(few)(of)
    return lambda piece: often(piece) if len(piece) <= short else seldom(piece) if len(piece) <= long else of(piece)


class Filter:
    """A Bloom filter of units: what it lacks, the corpus lacks."""

    def __init__(self, data: bytes) -> None:
        self.data, self.mask = data, 8 * len(data) - 1

    def __contains__(self, unit: str) -> bool:
        data, mask, raw = self.data, self.mask, unit.encode("utf-8", "surrogatepass")
        k = crc32(raw) & mask  # most units are off here
        return data[k >> 3] >> (k & 7) & 1 == 1 and all(data[(k & mask) >> 3] >> (k & 7) & 1 for k in PLACES(md5(raw).digest()))

    @classmethod
    def of(cls, counts: DataFrame) -> Filter:
        """Of the column `unit`; what comes to the driver is bounded by the filter's size."""
        bits = 1 << 16
        while bits < FILTER_BITS and bits < UNIT_BITS * counts.count():
            bits *= 2
        hashes = [F.crc32("unit"), *(F.conv(F.substring(F.md5("unit"), k, 8), 16, 10).cast("long") for k in (1, 9, 17, 25))]
        places = F.array(*(F.pmod(h, F.lit(bits)) for h in hashes))
        place = F.explode(places).alias("place")
        words = counts.select(place).groupBy(F.expr("place DIV 64").alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, int(place % 64))")).alias("set"))
        data = array("q", bytes(bits // 8))
        for r in words.toLocalIterator():
            data[r["word"]] = r["set"]
        if sys.byteorder == "big":
            data.byteswap()
        return cls(data.tobytes())


class Model:
    """The channel model over given unit counts."""

    def __init__(self, counts: dict[str, int]) -> None:
        self.single = getattr(counts, "single", frozenset())
        self.total = getattr(counts, "total", 0) or sum(counts.values()) or 1
        self.log: dict[str, float] = {u: math.log(n / self.total) for u, n in counts.items()}
        self.sorted = sorted(u for u in counts if not u.isascii() and len(u) > 1 and u[0].isalpha())
        self.by_ascii: dict[str, list[str]] = {}  # by the letters in ASCII, for words that have some
        self.by_end: dict[object, list[str]] = {}  # the others by length, and by length with the first and the last letter
        for u in self.sorted:
            self._file(u)
        self.rarer: Model | None = None  # what a text's rare units add
        self.top = max((p * (0.6 if IDEOGRAPH.match(u) else 1.0) for u, p in self.log.items() if len(u) > 1 and not u.isascii() and u[0].isalpha()), default=-math.inf)
        seen: Counter[str] = Counter()
        for u, n in counts.items():
            for ch in set(u):
                seen[ch] += n
        self.characters = {ch for ch, n in seen.items() if n >= 5} | TYPOGRAPHIC | getattr(counts, "characters", frozenset())
        self.candidates = remembering(self._candidates)

    def _file(self, u: str) -> None:
        if key := NOT_ASCII.sub("", u):
            self.by_ascii.setdefault(key, []).append(u)
        else:
            for k in (len(u), (len(u), 0, u[0]), (len(u), 1, u[-1])):
                self.by_end.setdefault(k, []).append(u)

    def knowing(self, rare: dict[str, tuple[int, bool]]) -> Model:
        """This model and some rarer units: unit -> (count, in one text alone). What it has itself isn't copied."""
        more, add = copy(self), Model.__new__(Model)
        more.log = ChainMap({u: math.log(n / self.total) for u, (n, _) in rare.items()}, self.log)
        add.single = frozenset(u for u, (_, single) in rare.items() if single)
        add.sorted = sorted(u for u in rare if not u.isascii() and len(u) > 1 and u[0].isalpha())
        add.by_ascii, add.by_end, add.rarer = {}, {}, None
        for u in add.sorted:
            add._file(u)
        more.rarer, more.candidates = add, more._candidates
        return more

    def _single(self, u: str) -> bool:
        return u in self.single or self.rarer is not None and u in self.rarer.single

    def _with_letters(self, key: str) -> list[str]:
        """Words by their letters in ASCII."""
        of = self.by_ascii.get(key, [])
        return of + self.rarer._with_letters(key) if self.rarer else of

    def _with_end(self, key: object) -> list[str]:
        """Words without letters in ASCII by a key of `by_end`."""
        of = self.by_end.get(key, [])
        return of + self.rarer._with_end(key) if self.rarer else of

    def score(self, text: str, own: bool = False) -> tuple[float, int, int]:
        """Log probability; how many of the characters in words outside ASCII stand in known words; how many there are.

        own: the text stands there as it is, so that units of one text alone are its own and tell nothing of it.
        """
        total, known, n = 0.0, 0, 0
        for u in units(text):
            p = None if own and not u.isascii() and self._single(u) else self.log.get(u)
            if u[0] == "�":
                total -= 6.0
            elif not u[0].isalpha():
                total -= 6.0 if u in TYPOGRAPHIC else 11.0
            else:
                wide, met = u[0] >= "ᄀ" and IDEOGRAPH.match(u), p is not None
                if p is None:
                    p = -22.0 if wide else -6.0 - (2.5 if u.isascii() else 3.5) * len(u)
                total += 0.6 * p if wide else p  # pairs overlap
                if len(u) > 1 and not u.isascii():
                    n += len(u)
                    known += len(u) if met else 0
        return total - 4.0 * len(C1.findall(text)), known, n

    @staticmethod
    def _asked(w: str, base: float) -> float:
        """The gain that a reading needs, by a channel other than right UTF-8, where the piece's own words are known."""
        return max(6.0, -(0.3 if w in DOUBLE else 0.15) * base)

    def _candidates(self, piece: str) -> list[tuple[float, str, int]]:
        """(gain over the piece as it is, reading, channel), the best readings first."""
        if 4 * sum(map(str.isalpha, piece)) < sum(1 for ch in piece if ord(ch) > 127) and not any(ch in TYPOGRAPHIC or ch.isalpha() for ch in piece if ord(ch) > 127):
            return []  # signs alone, no trace of a letter
        base, base_known, base_n = max(self.score(piece, True), self.score(transducer().canonical(piece), True))  # disguise isn't damage
        seen = {piece}
        out = []
        # a reading by such a channel has a known word, so it scores no more than the corpus's likeliest: is what is asked of it within reach?
        reach = self.top - base if base_known > 0.5 * base_n else math.inf
        readings = []
        apart = "�" not in piece and not NEXT_TO.search(piece)  # UTF-8 has two bytes at least for each character
        for w, of in BY_READER.items():
            within = reach >= self._asked(w, base)
            if not within and (apart or w in DOUBLE):
                continue
            raw = _raw(piece, w)
            if raw is not None:
                readings += [(c, w, r, raw) for c, r in of if (not apart or w in DOUBLE if r == "utf-8" else within)]
        for c, w, r, raw in sorted(readings):
            text = self._lattice(piece, w) if r == "utf-8" and w in LOST and "�" in piece else _read(raw, r)
            if text is None or text in seen:
                continue
            seen.add(text)
            if CONTROL.search(text):
                continue
            if r == "utf-8":
                again = _invert(text, w, r) if not text.isascii() else None
                if again is not None and again != text and "�" not in again:
                    text = again
            elif not self._words(text):
                continue
            s, known, n = self.score(text)
            gain = s - base
            if r == "utf-8" and w in TABLES and "�" not in text:
                # bytes that happen to be right UTF-8 are hardly chance
                gain += 1.5 * min(3, sum(1 for ch in text if ord(ch) > 127))
                odd = [ch for ch in text if ord(ch) > 127]
                if n and known < 0.3 * n or all(ch.isspace() for ch in odd) or not self.characters.issuperset(odd):
                    continue
            elif n < 3 or known < 0.6 * n or (base_known > 0.5 * base_n and gain < self._asked(w, base)):
                continue
            elif any((x := _invert(text, v, "utf-8")) is not None and "�" not in x for v in SINGLE):
                continue  # a reading that is garbled itself
            if gain > 0:
                out.append((gain, text, c))
        out.sort(key=lambda x: (-x[0], x[2]))
        return out

    def _words(self, text: str) -> bool:
        """Are six in ten of the characters in words outside ASCII in known words, and at least three? (A quick look, before `score`.)

        It ends as soon as too many are not: no more than two for each character of the text can be counted at all.
        """
        known = unknown = 0
        most = 0.8 * len(text)
        log = self.log
        for m in UNIT.finditer(text):
            w = m.group()
            if w[0] >= "ᄀ" and IDEOGRAPH.match(w):
                for u in [w[k : k + 2] for k in range(len(w) - 1)]:
                    if u in log:
                        known += 2
                    else:
                        unknown += 2
                        if unknown > most:
                            return False
            elif len(w) > 1 and w[0].isalpha() and not w.isascii():
                if w.lower() in log:
                    known += len(w)
                else:
                    unknown += len(w)
                    if unknown > most:
                        return False
        n = known + unknown
        return n >= 3 and known >= 0.6 * n

    def _lattice(self, piece: str, w: str) -> str | None:
        """The likeliest UTF-8 text whose bytes, read as w, with any of the bytes that w loses lost, give the piece."""
        places = self._places(piece, w)
        lost = sum(p == ["�"] for p in places)
        return self._likeliest(places) if len(places) - lost > 2 * lost else None

    @staticmethod
    def _places(piece: str, w: str) -> list[list[str]]:
        """The characters that each place of the UTF-8 text can have; none at all if w can't have read the piece."""
        parts = [_bytes(p, w) for p in piece.split("�")]
        if None in parts:
            return []
        row: list[int | None] = []
        for k, part in enumerate(parts):
            row += [*([None] if k else []), *part]
        places: list[list[str]] = []
        k = 0
        while k < len(row):
            b = row[k]
            n = 1 if b is None or b < 0xC2 else 2 if b < 0xE0 else 3 if b < 0xF0 else 4
            of = set()
            if b is not None and (b < 0x80 or n > 1):
                for bs in product([b], *([x] if x is not None else LOST[w] for x in row[k + 1 : k + n])):
                    try:
                        of.add(bytes(bs).decode("utf-8"))
                    except UnicodeDecodeError:
                        continue
            places.append(sorted(c for c in of if len(c) == 1) or ["�"])
            k += n if of else 1
        return places

    def _starts(self, prefix: str) -> bool:
        k = bisect_left(self.sorted, prefix)
        return k < len(self.sorted) and self.sorted[k].startswith(prefix) or self.rarer is not None and self.rarer._starts(prefix)

    def _likeliest(self, places: list[list[str]]) -> str:
        """Viterbi through the alternatives of each place. A state is the part of a word read so far, if the vocabulary has a word
        that starts with it, else that no known word can come of it any more; a word that ends gets its frequency. In scripts
        without spaces the state is the last character, and each pair gets its frequency."""

        def end(word: str) -> float:
            if len(word) < 2 or word.isascii() or IDEOGRAPH.match(word):
                return 0.0
            p = self.log.get(word)
            return p if p is not None else -6.0 - 3.5 * len(word)

        states: dict[str, tuple[float, str, str]] = {"": (0.0, "", "")}  # prefix ("*" for none) -> score, text, word so far
        for of in places:
            new: dict[str, tuple[float, str, str]] = {}
            for state, (score, text, word) in states.items():
                for ch in of:
                    if IDEOGRAPH.match(ch):  # pairs of characters are the units
                        pair = word + ch if IDEOGRAPH.match(word) else ""
                        to, got = ch, (score + (0.6 * self.log.get(pair, -22.0) if pair else end(word)), text + ch, ch)
                    elif ch.isalpha():
                        word = "" if IDEOGRAPH.match(word) else word
                        low = word + ch.lower()
                        to = "*" if state == "*" or not low.isascii() and not self._starts(low) else low
                        got = (score - (0.5 if ch not in self.characters else 0.0), text + ch, low)
                    else:
                        got = (score + end(word) - (6.0 if ch == "�" else 0.0), text + ch, "")
                        to = ""
                    if to not in new or new[to][0] < got[0]:
                        new[to] = got
            states = new
        return max(((score + end(word), text) for score, text, word in states.values()), key=lambda x: x[0])[1]

    def _matching(self, broken: str) -> list[str]:
        """Words of the vocabulary that a word with replacement characters can be; k of them stand for 1 to k characters outside ASCII."""
        pattern = re.compile(re.sub("�+", lambda x: "[^\\x00-\\x7f]{1,%d}" % len(x.group()), re.escape(broken)))
        if key := NOT_ASCII.sub("", broken):
            of = self._with_letters(key)
        else:
            longest, least = len(broken), len(re.sub("�+", "�", broken))
            end, ch = (0, broken[0]) if broken[0] != "�" else (1, broken[-1])
            of = [u for n in range(least, longest + 1) for u in self._with_end((n, end, ch) if ch != "�" else n)]
        return [u for u in of if pattern.fullmatch(u)]

    def unmatched(self, text: str) -> Iterator[tuple[str, str]]:
        """(pattern, key) of the damaged words of a text that no word of the vocabulary fits; a rarer word that fits has the same key."""
        for piece in PIECE.findall(text):
            if "�" not in piece:
                continue
            words = [[[x] for x in m.group().lower()] for m in BROKEN.finditer(piece)]
            for w in LOST:
                word: list[list[str]] = []
                for of in [*self._places(piece, w), [" "]]:
                    if of[0].isalpha():
                        word.append(sorted({c.lower() for c in of if c.isalpha()}))
                        continue
                    if any(len(x) > 1 for x in word):
                        words.append(word)
                    word = []
            for word in words:
                holes = sum(x == ["�"] for x in word)
                fixed = "".join(x[0] for x in word if len(x) == 1 and x[0] != "�" and x[0].isascii())
                runs = [re.escape(x[0]) if len(x) == 1 else f"[{''.join(map(re.escape, x))}]" for x in word]
                pattern = re.sub("�+", lambda x: "[^\\x00-\\x7f]{1,%d}" % len(x.group()), "".join(runs))
                exact = re.compile(pattern)
                if fixed:
                    keys, known = [f"a{fixed}"], self._with_letters(fixed)
                else:
                    lengths = range(len(word) - holes + bool(holes), len(word) + 1)
                    first, last = word[0], word[-1]
                    keys = [f"f{n}{first[0]}" if len(first) == 1 and first[0] != "�" else f"z{n}{last[0]}" if len(last) == 1 and last[0] != "�" else f"n{n}" for n in lengths]
                    known = [u for n in lengths for u in self._with_end(n)]
                if not any(exact.fullmatch(u) for u in known):
                    yield from ((pattern, k) for k in keys)

    def _fill(self, piece: str) -> str:
        """Put the likeliest words in the place of replacement characters, in any script."""

        def word(m: re.Match) -> str:
            w = m.group()
            found = self._matching(w.lower())
            if not found:
                return w
            best = max(found, key=lambda u: (self.log[u], u))
            upper = w.isupper() and sum(map(str.isalpha, w)) > 1
            return best.upper() if upper else best[0].upper() + best[1:] if w[0].isupper() else best

        return BROKEN.sub(word, piece)

    def restore(self, text: str) -> tuple[bool, str]:
        """(garbled, the restored text)."""
        if text.isascii():
            return False, text
        parts = PIECE.findall(text)
        readings = [[] if p.isascii() else self.candidates(p) for p in parts]
        lost = "�" in text
        if not lost and not any(readings):
            return False, text
        # Viterbi over the pieces; state -1 is "no channel", a change of channel costs
        switch = 1.0
        best: dict[int, tuple[float, tuple]] = {-1: (0.0, ())}
        for k, options in enumerate(readings):
            if not options:
                continue
            top, top_path = max(best.values(), key=lambda x: x[0])
            new: dict[int, tuple[float, tuple]] = {}
            for gain, reading, c in [(0.0, None, -1), *options]:
                stay = best.get(c)
                from_, path = (top - switch, top_path) if stay is None or stay[0] < top - switch else stay
                if c not in new or new[c][0] < from_ + gain:
                    new[c] = (from_ + gain, (path, k, reading, c) if reading is not None else path)
            best = new
        total, path = max(best.values(), key=lambda x: x[0])
        chosen: list[tuple[int, str, int]] = []
        while path:
            path, k, reading, c = path
            chosen.append((k, reading, c))
        found = total > 3.0 and bool(chosen)
        if found:
            at = {k: reading for k, reading, _ in chosen}
            used = {k: c for k, _, c in chosen}
            for k, part in enumerate(parts):  # pieces that are too short to tell go with their neighbours
                if k not in at and part and not part.isascii():
                    c = used[min(used, key=lambda j: (abs(j - k), j))]
                    reading = _invert(part, *CHANNELS[c])
                    if reading is not None and reading != part and "�" not in reading and self.score(reading)[0] > self.score(part)[0]:
                        at[k] = reading
            parts = [at.get(k, part) for k, part in enumerate(parts)]
        if lost:
            parts = [self._fill(p) if "�" in p else p for p in parts]
        return found or lost, "".join(parts)


def unit_counts(df: DataFrame, column: str = "text") -> DataFrame:
    """unit, n over all texts, and how many texts use it; counted per batch first, so that only distinct units are shuffled.

    A text that is there k times counts 1 + log2(k) times: a damaged text that is resent often doesn't make its damage usual.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter[str] = Counter()
            of: Counter[str] = Counter()
            for t, k in zip(b[column], b["copies"], strict=True):
                for u, n in Counter(units(t)).items():
                    c[u] += n * (1.0 + math.log2(k))
                    of[u] += 1
            if c:
                yield pd.DataFrame({"unit": list(c), "n": list(c.values()), "texts": [of[u] for u in c]})

    texts = df.filter(F.length(column) > 0).groupBy(column).agg(F.count("*").alias("copies"))
    units_of = texts.mapInPandas(count, "unit string, n double, texts long")
    return units_of.groupBy("unit").agg(F.round(F.sum("n")).cast("long").alias("n"), F.sum("texts").alias("texts"))


def _characters(units_of: DataFrame) -> frozenset[str]:
    """Characters that stand in at least five units, by their counts: as many as Unicode has at most."""
    of = units_of.select(F.explode(F.array_distinct(F.split("unit", ""))).alias("ch"), "n").groupBy("ch").agg(F.sum("n").alias("n")).filter("n >= 5 AND ch != ''")
    return frozenset(r["ch"] for r in of.toLocalIterator())


def vocabulary(df: DataFrame, column: str = "text", size: int = VOCABULARY) -> Vocabulary:
    """The `size` most frequent units with their counts over all texts, repeats damped; `rest` has the table if there are more."""
    out, single, more = Vocabulary(), set(), False
    counts = checkpoint(unit_counts(df, column).filter("n > 1"))  # a unit used once speaks for nothing: damage makes such units
    for r in counts.orderBy(F.desc("n"), "unit").limit(size + 1).toLocalIterator():
        if len(out) == size:
            more = True
            break
        out[r["unit"]] = r["n"]
        if r["texts"] == 1:
            single.add(r["unit"])
    out.single = frozenset(single)
    if more:
        out.rest = counts
        out.total = out.rest.agg(F.sum("n")).first()[0]
        out.characters = _characters(out.rest)
    return out


class Asked:
    """Known units, and those that the corpus has besides, by its filter: they are remembered and taken for known ones."""

    def __init__(self, known: dict[str, float], others: Filter) -> None:
        self.known, self.others = known, others
        self.missed: set[str] = set()

    def __contains__(self, unit: str) -> bool:
        if unit in self.known:
            return True
        if unit in self.missed or unit in self.others:
            self.missed.add(unit)
            return True
        return False

    def get(self, unit: str, default: float | None = None) -> float | None:
        p = self.known.get(unit)
        if p is None:
            unit in self  # noqa: B015
            return default
        return p


class Asking:
    """What rarer units do texts need that a model lacks?"""

    def __init__(self, model: Model, others: Filter) -> None:
        self.model, self.top = copy(model), model.top
        self.model.log = self.log = Asked(model.log, others)
        self.of_piece = remembering(self._of_piece)

    def _of_piece(self, piece: str) -> frozenset[str]:
        self.log.missed = set()
        self.model.score(piece, True)
        self.model.score(transducer().canonical(piece), True)
        self.model.top = math.inf if self.log.missed else self.top  # a piece with a rarer unit of its own: no channel is out of reach
        self.model._candidates(piece)
        return frozenset(self.log.missed) or NOTHING

    def needed(self, text: str) -> set[str]:
        """Units that the text's restoring asks for and the model lacks."""
        return set().union(*(self.of_piece(p) for p in PIECE.findall(text) if not p.isascii()))


NOTHING: frozenset[str] = frozenset()


def asking_rows(column: str, asking: Callable[[], Asking]) -> Callable[[Iterator[pd.DataFrame]], Iterator[pd.DataFrame]]:
    """What batches of texts ask for, a few rows at once: MD5 of the text, unit, or key and pattern of a damaged word."""

    def of(text: str, asker: Asking) -> Iterator[tuple[str, str, str | None]]:
        name = md5(text.encode("utf-8", "surrogatepass")).hexdigest()
        yield from ((name, u, None) for u in sorted(asker.needed(text)))
        if "�" in text:
            yield from ((name, k, p) for p, k in sorted(set(asker.model.unmatched(text))))

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asker = asking()
        for b in batches:
            rows = chain.from_iterable(of(t, asker) for t in b[column].drop_duplicates())
            while some := list(islice(rows, ASKED_ROWS)):
                yield pd.DataFrame(some, columns=["_md5", "unit", "pattern"])

    return ask


def with_rare(df: DataFrame, key: str, column: str, counts: Vocabulary) -> DataFrame:
    """Adds `rare`: units beyond the broadcast ones that a text needs, with their counts. One shuffle by unit, one by text.

    It is one string (lines of unit, count, 1 if in one text alone), so that a batch of texts holds no object for each of their units.

    Texts are asked for their units where they stand; only the MD5 of a text goes on, with what it needs.
    """
    shared = counts.models(df.sparkSession)
    asking = Shared(df.sparkSession, Filter.of(counts.rest), lambda x: Asking(shared.get(), x))
    texts = df.filter(F.length(column) > 0).filter(F.col(column).rlike(r"[^\x00-\x7F]")).select(column)
    asked = checkpoint(texts.mapInPandas(asking_rows(column, asking.get), "_md5 string, unit string, pattern string").distinct())
    whole = asked.filter("pattern IS NULL").drop("pattern").join(counts.rest, "unit")
    # damaged words: every pattern's likeliest word, among the words of its key
    ascii_letters, n = F.regexp_replace("unit", r"[^\x00-\x7F]+", ""), F.length("unit").cast("string")
    keys = F.when(ascii_letters != "", F.array(F.concat(F.lit("a"), ascii_letters))).otherwise(F.array(F.concat(F.lit("f"), n, F.substring("unit", 1, 1)), F.concat(F.lit("z"), n, F.substring("unit", -1, 1)), F.concat(F.lit("n"), n)))
    words = counts.rest.filter(F.col("unit").rlike(r"[^\x00-\x7F]") & F.col("unit").rlike(r"^\p{L}")).select(F.struct("unit", "n", "texts").alias("word"), F.explode(keys).alias("key"))
    wanted = asked.filter("pattern IS NOT NULL").select(F.col("unit").alias("key"), "pattern").distinct()
    fits = words.join(wanted, "key").filter(F.rlike(F.col("word.unit"), F.concat(F.lit("^(?:"), F.col("pattern"), F.lit(")$"))))
    best = fits.groupBy("pattern").agg(F.max_by("word", F.struct("word.n", "word.unit")).alias("word"))
    fitted = asked.filter("pattern IS NOT NULL").select("_md5", "pattern").join(best, "pattern").select("word.unit", "_md5", "word.n", "word.texts")
    line = F.concat_ws(" ", "unit", F.col("n").cast("string"), (F.col("texts") == 1).cast("int").cast("string"))  # no unit has white space
    found = whole.unionByName(fitted).distinct().groupBy("_md5").agg(F.array_join(F.collect_list(line), "\n").alias("rare"))
    return df.withColumn("_md5", F.md5(column)).join(found, "_md5", "left").drop("_md5")


def shared_model(df: DataFrame, key: str, column: str, size: int | None = None) -> tuple[DataFrame, Vocabulary]:
    """(the table, with the column `rare` in any case, and the vocabulary)."""
    counts = vocabulary(df, column, size or VOCABULARY)
    if counts.rest is None:
        return df.withColumn("rare", F.lit(None).cast("string")), counts
    df = with_rare(df, key, column, counts)
    counts.rest = None  # what is broadcast holds no table
    return df, counts


def model_for(model: Model, rare: object) -> Model:
    """The model that knows a text's rare units too."""
    if not isinstance(rare, str) or not rare:
        return model
    return model.knowing({u: (int(n), single == "1") for u, n, single in (x.rsplit(" ", 2) for x in rare.split("\n"))})


def restore(df: DataFrame, key: str = "request_id", column: str = "text", size: int | None = None) -> DataFrame:
    """key, `garbled`, and the text as restored, of every row."""
    rows, counts = shared_model(df.select(key, column), key, column, size)
    shared = counts.models(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = shared.get()
        for b in batches:
            done = [model_for(model, rare).restore(t) if isinstance(t, str) else (False, None) for t, rare in zip(b[column], b["rare"], strict=True)]
            yield pd.DataFrame({key: b[key], "garbled": [g for g, _ in done], "restored": [t for _, t in done]})

    return rows.mapInPandas(run, f"{key} {kind}, garbled boolean, restored string")
