"""Letter-weight scoring of words and windows.

Where a letter stands in its word decides what it counts, and no letter's part depends on the score of another: a half
of a doubled pair; else half of the first pair it forms with a letter one or two places away; else its weight by place.
So a word's score is a sum over its letters: an expression for distinct words, and for windows a lookup among the words that a
worker has met (Arrow batches). Nothing is shuffled.

Defined results: texts without letters have no row; a window without words has raw score 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from textloom.functions.arrays import let, total
from textloom.operators.telemetry import ARABIC_FOLD, counts_of, scripts_ja


@dataclass(frozen=True)
class Alphabet:
    """Letters with their weights, multipliers of doubled letters, pairs that act on each other, letters that mark a word, and axes.

    `kinds`: letters that count as another one in pairs, marks and axes.
    """

    weights: dict[str, int]
    doubles: dict[str, float]
    pairs: dict[str, float]
    marks: str
    axes: dict[str, str]
    silent: str = ""
    kinds: dict[str, str] = field(default_factory=dict)

    @property
    def letters(self) -> str:
        return "".join(self.weights)

    def kind(self, text: Column) -> Column:
        return F.translate(text, "".join(self.kinds), "".join(self.kinds.values())) if self.kinds else text


# Multipliers by place, and of a word with a marking letter.
FIRST, LAST, MARKED = 1.5, 0.75, 1.2
# Weights, multipliers of doubled letters, pairs, marking letters and axes of the alphabets.
EN = Alphabet(
    weights={"A": 8, "B": 7, "C": 5, "D": 6, "E": 4, "F": 6, "G": 5, "H": 7, "I": 9, "J": 4, "K": 8, "L": 6, "M": 8, "N": 7, "O": 5, "P": 7, "Q": 6, "R": 7, "S": 6, "T": 7, "U": 5, "V": 6, "W": 8, "X": 7, "Y": 5, "Z": 9},
    doubles={"S": 1.8, "F": 1.8, "V": 1.8, "Z": 1.8, "B": 1.6, "D": 1.6, "P": 1.6, "T": 1.6, "K": 1.6, "G": 1.6, "C": 1.6, "L": 1.4, "M": 1.4, "N": 1.4, "R": 1.4, "A": 1.3, "E": 1.3, "I": 1.3, "O": 1.3, "U": 1.3},
    pairs={"BH": 1.5, "KZ": 1.8, "CO": 1.4, "ES": 0.8, "CI": 0.7, "AS": 1.7, "MW": 2.0},
    marks="WMK",
    axes={"anxiety": "SN", "attention": "AK", "emotion": "MW", "agitation": "RZ"},
)
ES = replace(EN, doubles=EN.doubles | {"R": 2.0, "L": 1.5})
FR = replace(EN, silent="STXD")
RU = Alphabet(
    weights={"А": 8, "Б": 7, "В": 6, "Г": 5, "Д": 5, "Е": 4, "Ё": 5, "Ж": 8, "З": 9, "И": 9, "Й": 6, "К": 8, "Л": 6, "М": 8, "Н": 7, "О": 5, "П": 7, "Р": 7, "С": 6, "Т": 7, "У": 5, "Ф": 6, "Х": 7, "Ц": 6, "Ч": 8, "Ш": 7, "Щ": 8, "Ъ": 3, "Ы": 8, "Ь": 4, "Э": 6, "Ю": 7, "Я": 8},
    doubles={"Ж": 1.8, "З": 1.8, "С": 1.8, "Ф": 1.8, "Х": 1.8, "Ш": 1.8, "Щ": 1.8, "Б": 1.6, "Г": 1.6, "Д": 1.6, "К": 1.6, "П": 1.6, "Т": 1.6, "Ц": 1.6, "Ч": 1.6, "Л": 1.4, "М": 1.4, "Н": 1.4, "Р": 1.4, "А": 1.3, "Е": 1.3, "Ё": 1.3, "И": 1.3, "О": 1.3, "У": 1.3, "Ы": 1.3, "Э": 1.3, "Ю": 1.3, "Я": 1.3},
    pairs={"БХ": 1.5, "КШ": 1.8, "ГО": 1.4, "НС": 0.8, "ВИ": 0.7, "АС": 1.7, "МЮ": 2.0},
    marks="ЖШЩЫЮ",
    axes={"anxiety": "НС", "attention": "АК", "emotion": "МЮ", "agitation": "РЗ"},
)
AR = Alphabet(
    weights={"ا": 5, "ب": 7, "ت": 6, "ث": 5, "ج": 8, "ح": 8, "خ": 7, "د": 6, "ذ": 5, "ر": 8, "ز": 7, "س": 6, "ش": 7, "ص": 8, "ض": 9, "ط": 8, "ظ": 7, "ع": 9, "غ": 8, "ف": 6, "ق": 8, "ك": 7, "ل": 6, "م": 7, "ن": 6, "ه": 4, "و": 5, "ي": 5},
    doubles={"ح": 1.8, "خ": 1.8, "ص": 1.8, "ض": 1.8, "ط": 1.8, "ظ": 1.8, "ع": 1.8, "غ": 1.8, "ق": 1.8, "ز": 1.6, "س": 1.6, "ش": 1.6, "ب": 1.5, "ت": 1.5, "ج": 1.5, "د": 1.5, "ر": 1.5, "ك": 1.5, "ل": 1.4, "م": 1.4, "ن": 1.4, "ا": 1.3, "و": 1.3, "ي": 1.3},
    pairs={"رع": 1.8, "بص": 1.7, "ام": 1.5, "سن": 0.8, "خق": 0.7, "ذه": 1.6, "جع": 2.0},
    marks="شصضطظعغ",
    axes={"anxiety": "نس", "attention": "اع", "emotion": "مو", "agitation": "رج"},
)
FA = replace(AR, weights=AR.weights | {"پ": 7, "چ": 7, "ژ": 7, "گ": 6}, doubles=AR.doubles | {"پ": 1.5, "چ": 1.5, "ژ": 1.6, "گ": 1.5})

# Parts of a Hangul syllable in the order of their code points (leading consonants from U+1100, vowels from
# U+1161, final consonants from U+11A8), each as (the letter it counts as, its weight).
HANGUL_FIRST = [("ㄱ", 7), ("ㄱ", 9), ("ㄴ", 5), ("ㄷ", 7), ("ㄷ", 9), ("ㄹ", 6), ("ㅁ", 6), ("ㅂ", 7), ("ㅂ", 9), ("ㅅ", 8), ("ㅅ", 9), ("ㅇ", 5), ("ㅈ", 7), ("ㅈ", 9), ("ㅊ", 8), ("ㅋ", 8), ("ㅌ", 8), ("ㅍ", 8), ("ㅎ", 6)]
HANGUL_VOWEL = [("ㅏ", 7), ("ㅏ", 6), ("ㅑ", 6), ("ㅑ", 5), ("ㅓ", 6), ("ㅓ", 5), ("ㅕ", 5), ("ㅕ", 5), ("ㅗ", 7), ("ㅗ", 6), ("ㅗ", 5), ("ㅗ", 6), ("ㅛ", 5), ("ㅜ", 7), ("ㅜ", 6), ("ㅜ", 5), ("ㅜ", 6), ("ㅠ", 5), ("ㅡ", 5), ("ㅡ", 5), ("ㅣ", 7)]
HANGUL_FINAL = [("ㄱ", 7), ("ㄱ", 9), ("ㅅ", 7), ("ㄴ", 5), ("ㄴ", 5), ("ㄴ", 5), ("ㄷ", 7), ("ㄹ", 6), ("ㄹ", 6), ("ㄹ", 6), ("ㄹ", 6), ("ㄹ", 6), ("ㄹ", 6), ("ㄹ", 6), ("ㄹ", 6), ("ㅁ", 6), ("ㅂ", 7), ("ㅂ", 7), ("ㅅ", 8), ("ㅅ", 9), ("ㅇ", 5), ("ㅈ", 7), ("ㅊ", 8), ("ㅋ", 8), ("ㅌ", 8), ("ㅍ", 8), ("ㅎ", 6)]
JAMO = {chr(base + k): part for base, parts in ((0x1100, HANGUL_FIRST), (0x1161, HANGUL_VOWEL), (0x11A8, HANGUL_FINAL)) for k, part in enumerate(parts)}
#: The 24 letters, in dictionary order.
HANGUL = "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎㅏㅑㅓㅕㅗㅛㅜㅠㅡㅣ"
KO = Alphabet(
    weights={jamo: weight for jamo, (_, weight) in JAMO.items()},
    doubles={"ㄱ": 1.5, "ㄴ": 1.4, "ㄷ": 1.5, "ㄹ": 1.4, "ㅁ": 1.4, "ㅂ": 1.5, "ㅅ": 1.8, "ㅇ": 1.2, "ㅈ": 1.6, "ㅊ": 1.6, "ㅋ": 1.5, "ㅌ": 1.5, "ㅍ": 1.5, "ㅎ": 1.2, "ㅏ": 1.3, "ㅑ": 1.3, "ㅓ": 1.3, "ㅕ": 1.3, "ㅗ": 1.3, "ㅛ": 1.3, "ㅜ": 1.3, "ㅠ": 1.3, "ㅡ": 1.3, "ㅣ": 1.3},
    pairs={"ㄱㄹ": 1.7, "ㅅㄴ": 0.8, "ㄷㅇ": 0.7, "ㅁㅏ": 1.5, "ㄹㅡ": 1.4, "ㅈㅣ": 1.6, "ㅎㄱ": 1.9},
    marks="ㄹㅊㅌㅍㅎㅠ",
    axes={"anxiety": "ㅅㄴ", "attention": "ㄱㅇ", "emotion": "ㅁㅏ", "agitation": "ㄹㅈ"},
    kinds={jamo: kind for jamo, (kind, _) in JAMO.items()},
)
ALPHABETS = {"EN": EN, "DE": EN, "ES": ES, "FR": FR, "RU": RU, "AR": AR, "FA": FA, "KO": KO}
# Archetypes of letters.
ARCHETYPES = {"KO": {"origin": "ㅏㅓㅗㅜㅣ", "kinetic": "ㄱㄷㅂㅈㅊㅋㅌㅍ", "resonant": "ㄴㄹㅁㅅㅎ", "liminal": "ㅑㅕㅛㅠㅡ", "sovereign": "ㅇ"}}


def jamo(text: Column) -> Column:
    """Hangul syllables as leading consonant, vowel and final consonant; all else as it is."""
    first, vowel, final = (F.array(*[F.lit(chr(base + k)) for k in range(n)]) for base, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)))

    def parts(ch: Column) -> Column:
        k = F.ascii(ch) - 0xAC00
        last = k % 28
        whole = F.concat(F.element_at(first, F.floor(k / 588).cast("int") + 1), F.element_at(vowel, F.floor(k % 588 / 28).cast("int") + 1), F.when(last > 0, F.element_at(final, F.greatest(last, F.lit(1)))).otherwise(""))
        return F.when((ch >= "가") & (ch <= "힣"), whole).otherwise(ch)

    return F.array_join(F.transform(F.split(text, ""), parts), "")


def prepared(text: Column, language: str) -> Column:
    """Upper case, letter variants folded and marks dropped, or syllables taken apart."""
    if language in ("AR", "FA"):
        return F.translate(F.regexp_replace(text, r"[\x{064B}-\x{065F}\x{0640}]", ""), *ARABIC_FOLD)
    return jamo(text) if language == "KO" else F.upper(text)


def words_of(text: Column, language: str) -> Column:
    return F.regexp_extract_all(prepared(text, language), F.lit(f"[{ALPHABETS[language].letters}]+"), F.lit(0))


def _at(table: dict[str, float], letter: Column) -> Column:
    """The table's value for a letter, null for none: the letter's place in the alphabet is the value's in an array."""
    place = F.instr(F.lit("".join(table)), letter)
    return F.when(place > 0, F.element_at(F.array(*[F.lit(float(v)) for v in table.values()]), F.greatest(place, F.lit(1))))


def _acts(pairs: dict[str, float], a: Column, b: Column) -> Column:
    """The factor of a pair of letters in either order, null for none."""
    both = [p for pair, f in pairs.items() for p in ((pair, f), (pair[::-1], f))]
    place = F.instr(F.lit(",".join(p for p, _ in both)), F.concat(a, b))
    return F.when(place > 0, F.element_at(F.array(*[F.lit(f) for _, f in both]), F.greatest(F.floor((place - 1) / 3).cast("int") + 1, F.lit(1))))


def word_score(word: Column, alphabet: Alphabet = EN) -> Column:
    """Score of one word of the alphabet's letters."""

    def scored(w: Column) -> Column:
        def letter(k: Column) -> Column:  # k counts from 1; the padded strings have two blanks before the word
            def near(step: int) -> Column:
                return F.substring(w["kinds"], k + 2 + step, F.lit(1))

            def weight(step: int) -> Column:
                return _at(alphabet.weights, F.substring(w["letters"], k + 2 + step, F.lit(1)))

            kind = near(0)
            part = F.substring(w["doubled"], k + 2, F.lit(1))
            double = F.coalesce(_at(alphabet.doubles, kind), F.lit(1.0)) / 2
            halves = [(weight(0) + weight(step)) * _acts(alphabet.pairs, near(step), kind) * (1.0 if abs(step) == 1 else 0.5) / 2 for step in (-2, -1, 1, 2)]
            last = F.when(kind.isin(*alphabet.silent), 0.0).otherwise(LAST) if alphabet.silent else F.lit(LAST)
            place = F.when(k == 1, FIRST).when(k == w["n"], last).otherwise(1.0)
            return F.when(part == "1", weight(0) * double).when(part == "2", weight(-1) * double).otherwise(F.coalesce(*halves, weight(0) * place))

        score = total(F.transform(F.sequence(F.lit(1), w["n"]), letter), F.lit(0.0))
        return score * F.when(w["kinds"].rlike(f"[{alphabet.marks}]"), MARKED).otherwise(1.0)

    def padded(s: Column) -> Column:
        return F.concat(F.lit("  "), s, F.lit("  "))

    kinds = alphabet.kind(word)
    return let(F.struct(F.length(word).alias("n"), padded(word).alias("letters"), padded(kinds).alias("kinds"), padded(F.regexp_replace(kinds, r"(.)\1", "12")).alias("doubled")), scored)


def vocabulary(df: DataFrame, text: str = "text", language: str = "EN") -> DataFrame:
    """Distinct words."""
    return df.select(F.explode(words_of(F.col(text), language)).alias("word")).distinct()


def score_words(vocab: DataFrame, language: str = "EN") -> DataFrame:
    """word, score."""
    return vocab.select("word", word_score(F.col("word"), ALPHABETS[language]).alias("score"))


def pair_events(df: DataFrame, key: list[str], text: str = "text", language: str = "EN") -> DataFrame:
    """key, word_no, pair, distance, score: every pair of letters that act on each other, whether or not both still count."""
    a = ALPHABETS[language]
    w = df.select(*key, F.posexplode(words_of(F.col(text), language)).alias("word_no", "word"))
    w = w.select(*key, "word_no", "word", a.kind(F.col("word")).alias("kinds"), F.explode(F.sequence(F.lit(1), F.length("word"))).alias("k"))
    w = w.withColumn("distance", F.explode(F.array(F.lit(1), F.lit(2))))

    def at(column: str, k: Column) -> Column:
        return F.substring(F.col(column), k, F.lit(1))

    w = w.filter(F.col("k") + F.col("distance") <= F.length("word"))
    k, j = F.col("k"), F.col("k") + F.col("distance")
    w = w.withColumn("f", _acts(a.pairs, at("kinds", k), at("kinds", j))).filter("f IS NOT NULL")
    score = (_at(a.weights, at("word", k)) + _at(a.weights, at("word", j))) * F.col("f") / F.col("distance")
    return w.select(*key, "word_no", F.concat(at("kinds", k), at("kinds", j)).alias("pair"), "distance", F.round(score + 1e-9, 4).alias("score"))


def double_events(df: DataFrame, key: list[str], text: str = "text", language: str = "EN") -> DataFrame:
    """key, word_no, pair, score: every doubled letter, from left to right, without overlap."""
    a = ALPHABETS[language]
    w = df.select(*key, F.posexplode(words_of(F.col(text), language)).alias("word_no", "word"))
    w = w.select(*key, "word_no", F.explode(F.regexp_extract_all(a.kind(F.col("word")), F.lit(r"(.)\1"), F.lit(0))).alias("pair"))
    letter = F.substring("pair", 1, 1)
    return w.select(*key, "word_no", "pair", F.round(_at(a.weights, letter) * F.coalesce(_at(a.doubles, letter), F.lit(1.0)) + 1e-9, 4).alias("score"))


def scorer(language: str) -> Callable[[str], float]:
    """`word_score` for words met one by one; words that were met lately are remembered."""
    a = ALPHABETS[language]
    pairs = {q: f for pair, f in a.pairs.items() for q in (pair, pair[::-1])}
    kinds = str.maketrans(a.kinds)
    marks = frozenset(a.marks)

    @lru_cache(200_000)
    def score(word: str) -> float:
        kind = word.translate(kinds)
        doubled = re.sub(r"(.)\1", "12", kind)
        weight = [a.weights[c] for c in word]
        last = len(word) - 1

        def part(k: int) -> float:
            if doubled[k] in "12":
                return weight[k - (doubled[k] == "2")] * a.doubles.get(kind[k], 1.0) / 2
            for step, reach in ((-2, 0.5), (-1, 1.0), (1, 1.0), (2, 0.5)):
                if 0 <= k + step <= last and (f := pairs.get(kind[k] + kind[k + step])) is not None:
                    return (weight[k] + weight[k + step]) * f * reach / 2
            return weight[k] * (FIRST if k == 0 else (0.0 if kind[k] in a.silent else LAST) if k == last else 1.0)

        return sum(map(part, range(last + 1))) * (1.0 if marks.isdisjoint(kind) else MARKED)

    return score


SUMS = "raw double, chars bigint, words bigint, visual bigint, twice bigint, mute bigint"


def _sums(language: str) -> Callable[[Column], Column]:
    """Sums over the words of a prepared text: scores, letters, words, words with a marking letter, RR, mute ends.

    The words of a window are looked up in what the worker remembers, for most have been met before.
    """
    a = ALPHABETS[language]

    @F.pandas_udf(SUMS)
    def sums(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        score, words = scorer(language), re.compile(f"[{a.letters}]+").findall
        marked = re.compile(f"[{''.join(c for c in a.letters if a.kinds.get(c, c) in a.marks)}]").search
        mute = frozenset(a.silent)
        for s in texts:
            rows = []
            for t in s:
                w = words(t) if isinstance(t, str) else []
                rows.append((sum(map(score, w)), sum(map(len, w)), len(w), sum(marked(x) is not None for x in w), sum(x.count("RR") for x in w) if language == "ES" else 0, sum(x[-1] in mute for x in w) if mute else 0))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SUMS.split(", ")])

    return sums


def window_scores(df: DataFrame, key: list[str], text: str = "text", language: str = "EN") -> DataFrame:
    """key, raw_score, total_chars, words_with_visual of each row with words."""
    w = df.select(*key, _sums(language)(prepared(F.col(text), language)).alias("_s")).filter("_s.words > 0")
    return w.select(*key, F.round(F.col("_s.raw") + 1e-9, 4).alias("raw_score"), F.col("_s.chars").alias("total_chars"), F.col("_s.visual").alias("words_with_visual"))


def letter_totals(df: DataFrame, key: list[str], text: str = "text", language: str = "EN") -> DataFrame:
    """key, letter, total: the weight of all uses of each letter that occurs."""
    a = ALPHABETS[language]
    only = F.regexp_replace(prepared(F.col(text), language), f"[^{a.letters}]+", "")
    found = df.select(*key, F.explode(counts_of(only, a.letters)).alias("c"))
    weight = _at(a.weights, F.col("c.letter"))
    if not a.kinds:
        return found.select(*key, F.col("c.letter").alias("letter"), (weight * F.col("c.n")).alias("total"))
    return found.groupBy(*key, a.kind(F.col("c.letter")).alias("letter")).agg(F.sum(weight * F.col("c.n")).alias("total"))


def _shares(only: Column, a: Alphabet) -> dict[str, Column]:
    """The axes that only need letter counts, in per cent of all weight, not rounded."""
    weigh = {x: (F.length(only) - F.length(F.replace(only, F.lit(x), F.lit("")))) * w for x, w in a.weights.items()}
    everything = sum(weigh.values(), F.lit(0))
    return {name: 100.0 * sum((c for x, c in weigh.items() if a.kinds.get(x, x) in of), F.lit(0)) / everything for name, of in a.axes.items()}


def axes(df: DataFrame, key: list[str], text: str = "text", language: str = "EN") -> DataFrame:
    """key, anxiety, attention, emotion, agitation of each row with letters."""
    a = ALPHABETS[language]
    only = df.select(*key, F.regexp_replace(prepared(F.col(text), language), f"[^{a.letters}]+", "").alias("_o")).filter(F.length("_o") > 0)
    return only.select(*key, *[F.round(c + 1e-9, 6).alias(name) for name, c in _shares(F.col("_o"), a).items()])


def vectors(df: DataFrame, key: list[str], text: str = "text", language: str = "EN") -> DataFrame:
    """All six axes of each row with words, in one pass.

    In Spanish agitation grows by the share of RR in the raw score, in French anxiety falls with the share of mute word ends;
    in Korean the characters are syllables.
    """
    a = ALPHABETS[language]
    w = df.select(*key, prepared(F.col(text), language).alias("_t"), *([F.regexp_count(text, F.lit("[가-힣]")).alias("_n")] if language == "KO" else []))
    w = w.select("*", _sums(language)(F.col("_t")).alias("_s"), F.regexp_replace("_t", f"[^{a.letters}]+", "").alias("_o")).filter("_s.words > 0")
    chars = F.when(F.col("_n") > 0, F.col("_n")).otherwise(F.col("_s.chars")) if language == "KO" else F.col("_s.chars")
    share = _shares(F.col("_o"), a)
    if language == "ES":
        share["agitation"] += F.col("_s.twice") * (a.weights["R"] * a.doubles["R"]) / F.greatest(F.lit(1.0), F.col("_s.raw")) * 100
    if language == "FR":
        share["anxiety"] *= 1 - 0.3 * F.col("_s.mute") / F.col("_s.words")
    intensity = F.round(F.round(F.col("_s.raw") + 1e-9, 4) / F.greatest(F.lit(1), chars) + 1e-9, 4).alias("intensity")
    return w.select(*key, intensity, *[F.round(c + 1e-9, 6).alias(name) for name, c in share.items()], F.col("_s.visual").cast("double").alias("complexity"))


def script_axes(df: DataFrame, key: list[str], text: str = "text", strokes: DataFrame | None = None) -> DataFrame:
    """Japanese: axes from the shares of kanji, hiragana and katakana; texts without any have no row.

    With a table of strokes (ch, n) `complexity` is the mean over the kanji, of which those not in the table count 8.
    """
    s = scripts_ja(df, text).filter("kanji + hiragana + katakana > 0")
    out = s.select(*key, *[F.round(F.col(c) * f + 1e-9, 4).alias(name) for name, c, f in (("intensity", "kanji_ratio", 100), ("attention", "kanji_ratio", 80), ("emotion", "hiragana_ratio", 100), ("agitation", "katakana_ratio", 100))], F.lit(0.0).alias("anxiety"))
    if strokes is None:
        return out
    means = stroke_means(df, strokes, key, text)
    return out.join(means, key, "left").select(*out.columns, F.round(F.coalesce("d", F.lit(0.0)) + 1e-9, 4).alias("complexity"))


def stroke_means(df: DataFrame, strokes: DataFrame, key: list[str], text: str = "text", unknown: int = 8) -> DataFrame:
    """key, d: mean strokes of the ideographs of a text; `strokes` (ch, n) is a parameter table, other ideographs count `unknown`."""
    chars = df.select(*key, F.explode(F.split(F.regexp_replace(text, r"[^\x{4E00}-\x{9FFF}]+", ""), "")).alias("ch")).filter("ch != ''").groupBy(*key, "ch").agg(F.count("*").alias("uses"))
    d = F.sum(F.coalesce("n", F.lit(unknown)) * F.col("uses")) / F.sum("uses")
    return chars.join(strokes, "ch", "left").groupBy(*key).agg(d.alias("d"))


def stroke_axes(df: DataFrame, strokes: DataFrame, key: list[str], text: str = "text", unknown: int = 8) -> DataFrame:
    """Chinese: axes from the mean number of strokes."""
    m = stroke_means(df, strokes, key, text, unknown)
    return m.select(*key, *[F.round(F.least(F.lit(100.0), f * F.col("d")) + 1e-9, 4).alias(name) for name, f in (("intensity", 8), ("attention", 6), ("complexity", 10))])


def hangul_letters(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, letter, n: uses of the 24 letters of Hangul in syllables and single letters."""
    taken = F.regexp_replace(KO.kind(jamo(F.col(text))), f"[^{HANGUL}]+", "")
    only = df.select(*key, taken.alias("_o")).filter(F.length("_o") > 0)
    return only.select(*key, F.explode(counts_of(F.col("_o"), HANGUL)).alias("c")).select(*key, "c.letter", "c.n")


def archetypes(df: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, archetype, n: uses of Korean letters by archetype."""
    kind = F.lit(None).cast("string")
    for name, of in ARCHETYPES["KO"].items():
        kind = F.when(F.col("letter").isin(*of), name).otherwise(kind)
    return hangul_letters(df, key, text).groupBy(*key, kind.alias("archetype")).agg(F.sum("n").alias("n"))


def japanese(df: DataFrame, strokes: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """key, and the six axes of Japanese with shares of all characters that are neither blanks nor punctuation; complexity is the mean of strokes.

    Texts without such a character have no row; kanji that the table of strokes (ch, n) lacks count 8.
    """
    n = {name: F.regexp_count(F.col(text), F.lit(p)) for name, p in (("kanji", r"[\x{4E00}-\x{9FFF}]"), ("hiragana", r"[\x{3040}-\x{309F}]"), ("katakana", r"[\x{30A0}-\x{30FF}]"))}
    solid = F.length(F.regexp_replace(text, r"[\p{P}\p{Z}\n\t]+", ""))
    s = df.select(*key, *[c.alias(name) for name, c in n.items()], solid.alias("_n")).filter("_n > 0")
    axes_ = [F.round(100.0 * F.col(c) * f / F.col("_n") + 1e-9, 4).alias(name) for name, c, f in (("intensity", "kanji", 1.0), ("attention", "kanji", 0.8), ("emotion", "hiragana", 1.0), ("agitation", "katakana", 1.0))]
    means = stroke_means(df, strokes, key, text)
    return s.select(*key, *axes_, F.lit(0.0).alias("anxiety")).join(means, key, "left").withColumn("complexity", F.round(F.coalesce("d", F.lit(0.0)) + 1e-9, 4)).drop("d")
