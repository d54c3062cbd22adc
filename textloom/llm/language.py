"""Language of every text and of every single-language segment (problem 7).

Cross-parsing entropy: for each language a suffix automaton is built over labelled text. A sentence is parsed,
greedily, into the longest phrases that occur in that text; the language that needs the fewest phrases, each
weighed with the bits of a pointer into its text, wins. A Viterbi pass with a price for each change joins the
sentences to segments. The labelled sample is cleaned first: sentences that a word model of the other labels
explains better are wrongly labelled and left out.

Defined results: null, empty and letterless texts have no segment; a text that no language parses better than
in pieces of a letter or two (random keys, encoded bytes) has none either. Confidence is 1 - phrases of the best
language / phrases of the second. The given label only decides between languages that need exactly the same.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache
from hashlib import blake2b

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from textloom.llm import garbled
from textloom.llm.canonical import transducer
from textloom.llm.sentences import spans
from textloom.llm.worker import Shared

#: Labelled texts per language, about, that are drawn (by hash of their id), and the characters of their sentences, in the
#: order of their hashes, that an automaton holds: bounds of the fitting sample.
SAMPLE_TEXTS = 400
SAMPLE_CHARS = 24_000
#: Price of a change of language, in phrases, and the phrases a letter beyond which a text is in no language.
CHANGE = 2.0
NO_LANGUAGE = 0.25
#: Phrases that even a short text may need, at up to SHORT a letter.
FREE, SHORT = 5.0, 0.45
#: The least share of letters, in whole words, among the characters of a text.
LETTER_SHARE = 0.22

# Codes and names of the ten languages.
CODES = {
    "EN": "en eng english anglais englisch inglés ingles",
    "DE": "de deu ger german deutsch allemand alemán",
    "FR": "fr fra fre french français francais französisch francés",
    "ES": "es spa spanish español espanol castellano spanisch espagnol",
    "RU": "ru rus russian русский russisch russe ruso",
    "ZH": "zh zho chi chinese 中文 汉语 漢語 普通话 cmn chinesisch chinois chino",
    "JA": "ja jpn jp japanese 日本語 japanisch japonais japonés",
    "AR": "ar ara arabic العربية عربي arabisch arabe árabe",
    "FA": "fa fas per pes persian farsi فارسی",
    "KO": "ko kor kr korean 한국어 koreanisch coréen coreano",
}
ALIASES = {alias: code for code, names in CODES.items() for alias in names.split()}


def normal_code(code: str | None) -> str | None:
    """One of the ten codes, or null for a missing or unusable one."""
    if not code:
        return None
    return ALIASES.get(re.split(r"[-_ .(@]", code.strip().lower())[0])


class Automaton:
    """Suffix automaton of a text."""

    def __init__(self, text: str) -> None:
        self.bits = math.log2(len(text) + 2)
        link, length = [-1], [0]
        self.next: list[dict[str, int]] = [{}]
        last, nxt = 0, self.next
        for ch in text:
            cur = len(nxt)
            nxt.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != -1 and ch not in nxt[p]:
                nxt[p][ch] = cur
                p = link[p]
            if p != -1:
                q = nxt[p][ch]
                if length[p] + 1 == length[q]:
                    link[cur] = q
                else:
                    clone = len(nxt)
                    nxt.append(dict(nxt[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p != -1 and nxt[p].get(ch) == q:
                        nxt[p][ch] = clone
                        p = link[p]
                    link[q] = link[cur] = clone
            last = cur

    def phrases(self, text: str) -> int:
        """Longest-match phrases that the text falls into."""
        nxt = self.next
        root = nxt[0]
        node, n = None, 0
        for ch in text:
            if node is not None:
                s = node.get(ch)
                if s is not None:
                    node = nxt[s]
                    continue
            n += 1
            s = root.get(ch)
            node = None if s is None else nxt[s]
        return n


LETTERS = re.compile(r"(?<![\w/])[^\W\d_]+(?:[’'\-][^\W\d_]+)*(?![\d_/])")
ADDRESS = re.compile(r"[a-z][a-z0-9+.\-]{0,15}://\S+")


def _letters(text: str) -> str:
    """Words only, lower case, one space between them."""
    text = text.lower()
    return " ".join(LETTERS.findall(ADDRESS.sub(" ", text) if "://" in text else text))


def clean_sample(labelled: list[tuple[str, str]]) -> dict[str, str]:
    """Code -> training text, from (code, text): sentences that agree with their label."""
    texts = [(code, [s for a, b in spans(text) if (s := _letters(text[a:b]))]) for code, text in labelled]
    keep = texts

    def model(texts: list[tuple[str, list[str]]]):  # noqa: ANN202
        counts: dict[str, Counter] = defaultdict(Counter)
        for code, sentences in texts:
            for s in sentences:
                counts[code].update(garbled.units(s))
        vocabulary = len({u for c in counts.values() for u in c}) + 1
        totals = {code: sum(c.values()) + vocabulary for code, c in counts.items()}

        def best(s: str) -> str:
            us = garbled.units(s)
            return max(sorted(counts), key=lambda code: sum(math.log((counts[code][u] + 1) / totals[code]) for u in us))

        return best

    for _ in range(2):  # whole texts with a wrong label first, then foreign sentences
        best = model(keep)
        keep = [(code, sentences) for code, sentences in texts if sentences and best(" ".join(sentences)) == code]
    for _ in range(2):
        best = model(keep)
        keep = [(code, own) for code, sentences in keep if (own := [s for s in sentences if best(s) == code])]
    rows = sorted({(code, s) for code, sentences in keep for s in sentences}, key=lambda r: blake2b(r[1].encode(), digest_size=8).digest())
    out: dict[str, str] = {}
    for code in sorted({c for c, _ in rows}):
        total, parts = 0, []
        for c, s in rows:
            if c == code and total < SAMPLE_CHARS:
                parts.append(s)
                total += len(s)
        out[code] = "\n".join(parts)
    return out


# Where scripts lie; other letters are of none of them.
SCRIPTS = re.compile("(?P<latin>[A-Za-zÀ-ɏ])|(?P<cyrillic>[Ѐ-ӿ])|(?P<arabic>[؀-ݿ])|(?P<hangul>[ᄀ-ᇿ가-힣])|(?P<kana>[぀-ヿ])|(?P<han>[㐀-鿿])")


def alphabet(text: str) -> frozenset[str]:
    """The letters of a text but those of a script that holds less than a twentieth of them: foreign words among a language's own."""
    count: Counter[str | None] = Counter()
    letters: dict[str | None, set[str]] = defaultdict(set)
    for ch, n in Counter(text).items():
        if not ch.isspace():
            m = SCRIPTS.match(ch)
            count[m and m.lastgroup] += n
            letters[m and m.lastgroup].add(ch)
    return frozenset(ch for script, of in letters.items() if 20 * count[script] >= sum(count.values()) for ch in of)


class Identifier:
    """Segments of texts, by the automata of the given training texts."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.codes = sorted(texts)
        self.automata = [Automaton(texts[c]) for c in self.codes]
        self.alphabets = [alphabet(texts[c]) for c in self.codes]
        self.costs = lru_cache(50_000)(self._costs)

    def _costs(self, letters: str) -> tuple[int, ...]:
        own = set(letters) - {" "}  # where no letter is the language's own, each is a phrase
        return tuple(len(letters) if own.isdisjoint(alphabet) else a.phrases(letters) for a, alphabet in zip(self.automata, self.alphabets, strict=True))

    def segments(self, text: str, given: str | None = None) -> list[tuple[str, float, int, int]]:
        """(code, confidence, start, end) of each longest run of sentences in one language."""
        units = [(a, b, s) for a, b in spans(text) if (s := _letters(text[a:b]))]
        solid = sum(1 for c in text if not c.isspace())
        if not units or not self.codes or sum(len(s) for _, _, s in units) < LETTER_SHARE * solid:
            return []
        own = self.codes.index(given) if given in self.codes else -1  # decides between languages that need the same
        weigh = [a.bits for a in self.automata]
        low = min(weigh)
        n = len(self.codes)
        table = [self.costs(s) if len(s) <= 300 else self._costs(s) for _, _, s in units]
        best = [0.0] * n
        back: list[list[int]] = []
        for row in table:
            top = min(range(n), key=lambda k: (best[k], own != k, k))
            turn = best[top] + CHANGE if back else 0.0
            came = [k if best[k] <= turn else top for k in range(n)] if back else list(range(n))
            best = [(best[k] if came[k] == k else turn) + row[k] * weigh[k] / low for k in range(n)]
            back.append(came)
        k = min(range(n), key=lambda k: (best[k], own != k, k))
        path = []
        for came in reversed(back):
            path.append(k)
            k = came[k]
        path.reverse()
        out = []
        at = 0
        while at < len(path):
            end = at
            while end < len(path) and path[end] == path[at]:
                end += 1
            sums = [sum(table[j][k] for j in range(at, end)) for k in range(n)]
            letters = sum(len(units[j][2]) for j in range(at, end))
            if sums[path[at]] <= max(NO_LANGUAGE * letters, min(FREE, SHORT * letters)):
                second = min((sums[k] for k in range(n) if k != path[at]), default=letters)
                out.append((self.codes[path[at]], max(0.0, 1 - sums[path[at]] / max(1, second)), units[at][0], units[end - 1][1]))
            at = end
        merged: list[tuple[str, float, int, int]] = []
        for seg in out:  # what no language explains doesn't part two segments of one language
            if merged and merged[-1][0] == seg[0]:
                m = merged.pop()
                seg = (seg[0], min(m[1], seg[1]), m[2], seg[3])
            merged.append(seg)
        return merged


@F.pandas_udf(T.StringType())
def _normal_code(codes: pd.Series) -> pd.Series:
    return codes.map(normal_code, na_action="ignore")


def labelled(df: DataFrame, key: str, column: str, code: str) -> DataFrame:
    """key, text and code (t, c) of the rows with a text and a usable label."""
    read_once = _normal_code.asNondeterministic()  # else filters repeat it, and a task has two Python workers, which may each build all models later on
    return df.filter(F.length(column) > 0).select(key, F.col(column).alias("t"), read_once(F.col(code)).alias("c")).filter("c IS NOT NULL")


def labelled_sample(df: DataFrame, key: str, column: str, code: str) -> list[tuple[str, str]]:
    """About SAMPLE_TEXTS texts of each usable label, drawn by the hash of their id."""
    rows = labelled(df, key, column, code)
    sizes = [(r["c"], r["count"]) for r in rows.groupBy("c").count().collect()]  # one row for each of ten labels
    chosen = F.lit(False)
    for c, n in sizes:
        chosen = chosen | ((F.col("c") == c) & (F.pmod(F.xxhash64(key), F.lit(n)) < SAMPLE_TEXTS))
    return sorted((r["c"], r["t"]) for r in rows.filter(chosen).select("c", "t").distinct().collect())


def _repair(model: garbled.Model, text: str) -> str:
    return transducer().canonical(model.restore(text)[1])


def segments(df: DataFrame, key: str = "request_id", column: str = "text", code: str = "language_code") -> DataFrame:
    """One row per segment: key, the normalised label `given_code`, seg_no (from 0), lang_code, confidence, n_segments.

    Wrongly decoded text is restored and disguised text brought to its canonical form first.
    """
    spark = df.sparkSession
    rows, counts = garbled.shared_model(df.select(key, column, code), key, column)
    model = garbled.Model(counts)
    sample = [(c, _repair(model, t)) for c, t in labelled_sample(df, key, column, code)]
    models, finders = counts.models(spark), Shared(spark, clean_sample(sample), Identifier)
    kind = df.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, find = models.get(), finders.get()
        for b in batches:
            out = []
            for k, text, given, rare in zip(b[key], b[column], b[code], b["rare"], strict=True):
                own = normal_code(given if isinstance(given, str) else None)
                found = find.segments(_repair(garbled.model_for(model, rare), text), own) if isinstance(text, str) and text else []
                out += [(k, own, n, c, conf, len(found)) for n, (c, conf, _, _) in enumerate(found)]
            if out:
                yield pd.DataFrame(out, columns=[key, "given_code", "seg_no", "lang_code", "confidence", "n_segments"])

    return rows.mapInPandas(run, f"{key} {kind}, given_code string, seg_no long, lang_code string, confidence double, n_segments int")


def wrong_labels(df: DataFrame, key: str = "request_id", column: str = "text", code: str = "language_code") -> DataFrame:
    """key, seg_no, lang_code: one row for a text in one language whose label is missing or another, one for each segment of a mixed text."""
    s = segments(df, key, column, code)
    return s.filter("n_segments > 1 OR given_code IS NULL OR given_code != lang_code").select(key, "seg_no", "lang_code").distinct()
