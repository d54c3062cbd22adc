"""Sentence units in any language and script (problem 2).

The boundary rules are compiled into finite machines. A lexer turns the text into symbols: terminators with the
verdict of a decision table on their class (what they are, the kind of word before, the kind of character after), line
and paragraph breaks with what opens the next line, quote marks. Three machines read the symbols:

* lines, from the left, with the states "a sentence ended", "none ended" and "in a heading": which breaks and ends count;
* quotes, from the right: does a quotation of each kind close before its paragraph does (else it is none);
* quotations, from the left: is an end inside an open quotation, where it ends no sentence.

A block of symbols is, for each machine, a function from its entry to its exit. The functions of a text's blocks are
composed by a parallel prefix scan, and then each block emits its boundaries on its own. Texts of more than LONG
characters are cut into rows of about LONG characters each, which are spread over all tasks; only the functions of
their blocks come together. Blocks are cut inside words, so every block length gives the same boundaries.

Defined results: null and blank texts have no sentence; offsets count code points of the text as it is, end
exclusive, without surrounding white space; a paragraph always ends a sentence, a heading line is a unit. A heading line
with more than HEADING_CHARS characters after its number is none.
"""

from __future__ import annotations

import json
import re
import unicodedata as ud
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from textloom.llm.canonical import CYRILLIC_LOOKS, GREEK_LOOKS, INVISIBLE
from textloom.session import checkpoint

LOOKS = str.maketrans(CYRILLIC_LOOKS | GREEK_LOOKS)

# Abbreviations after which no sentence ends, whatever follows.
TITLES = """dr mr mrs ms prof gen col lt sgt capt cmdr maj adm rev hon st sen gov rep pres messrs mt
hr fr frl dipl ing mag dra sr sra srta sres ud uds vd don dna lic mme mlle mm me mgr vve
fig figs sec secs no nos nr nrs num vol vols p pp pag pags par para art arts chap cap ch kap abs bd bzw vgl ca approx cf vs v ed eds
núm pág págs párr apdo tel ext incl bes ggf sog evtl z u d s i e av env bât bd bld ave tel ref réf
проф акад им ул пер пл наб просп г д кв корп стр рис см гл ст табл тел тов гр гос св напр ср т м с и о к э
د أ م ص ج""".split()
# Abbreviations that end a sentence when a capital follows.
ENDERS = """etc usw ff f p.m a.m p.m. a.m. pm am jr sr. ltd inc corp co plc gmbh т.д т.п т.д. т.п. др пр н.э руб коп млн тыс bros esq u.s.w""".split()
# Words before a German ordinal number.
ORDINAL_AFTER = set("am im vom zum zur der dem den des die das beim bis ab seit und jeder jedem jeden dieser diesem ihrem seinem einem".split())
HEADING_WORDS = r"chapter|section|part|prologue|epilogue|book|appendix|kapitel|abschnitt|teil|anhang|chapitre|partie|titre|annexe|livre|cap[ií]tulo|secci[oó]n|parte|libro|anexo|глава|раздел|часть|приложение|الفصل|القسم|الجزء|الباب|فصل|بخش|قسمت"

_no_end = {w.translate(LOOKS) for w in TITLES}
_enders = {w.translate(LOOKS) for w in ENDERS}

TERMINATORS = ".!?…。！？؟۔‼⁇⁈⁉｡．"
OPEN = {"„": 1, "“": 2, "«": 3, "「": 4, "『": 5, '"': 6, "《": 0, "‹": 7, "〝": 8}
CLOSES = {1: "“”", 2: "”", 3: "»", 4: "」", 5: "』", 6: '"', 7: "›", 8: "〟〞"}
STATES = 9
#: Characters of a text, about, that one task scans at once.
LONG = 200_000
#: The longest title of a heading line.
HEADING_CHARS = 80
CLOSERS = "”“\"»›’'」』）)]】〟〞"

EVENTS = re.compile(rf"\n[^\S\n]*\n\s*|\n|[   ]?[{re.escape(TERMINATORS)}](?:[   ]?[{re.escape(TERMINATORS)}])*|[„“”«»「」『』\"‹›〝〟〞]")
HEADING = re.compile(
    rf"[^\S\n]*(?:(?:{HEADING_WORDS})[^\S\n]+[\dIVXLC٠-٩۰-۹]+\b(?:[^\S\n]*[-–—:.][^\n]{{0,{HEADING_CHARS}}})?|第\s*[\d〇一二三四五六七八九十百]+\s*[章节節部回編篇][^\n]{{0,40}}|제\s*\d+\s*[장절부편][^\n]{{0,40}})[^\S\n]*(?=\n|$)",
    re.I,
)
NUMBERED = re.compile(r"[^\S\n]*\d{1,3}\.[^\S\n]+[^\s.!?。！？][^\n.!?。！？]{0,68}(?=\n|$)")
BULLET = re.compile(r"[^\S\n]*(?:[-*•‣▪◦·–—]|\[[ xX]\]|\(?[a-z\d]{1,2}\)|\d{1,3}[.)])[^\S\n]+\S")

LETTER, UPPER, LOWER, DIGIT = 1, 2, 3, 4
UNCLEAN = re.compile(f"[{INVISIBLE}\u200c\u200dＡ-ｚ０-９．]")


def _clean(text: str) -> tuple[str, np.ndarray | None]:
    """The text without invisible characters and with single-character widths folded, and the places of its characters."""
    if text.isascii():
        return text, None
    if not UNCLEAN.search(text):
        return text, None
    keep = [k for k, c in enumerate(text) if c not in INVISIBLE and c not in "‌‍"]
    folded = "".join(ud.normalize("NFKC", text[k]) if "Ａ" <= text[k] <= "ｚ" or "０" <= text[k] <= "９" or text[k] == "．" else text[k] for k in keep)
    return folded, np.array(keep, dtype=np.int64)


def _kind(ch: str) -> int:
    if ch.isupper() or ch.istitle():
        return UPPER
    if ch.islower():
        return LOWER
    return LETTER if ch.isalpha() else DIGIT if ch.isdigit() else 0


def _is_cjk(ch: str) -> bool:
    return "぀" <= ch <= "鿿" or "豈" <= ch <= "﫿"


WORD_BEFORE = re.compile(r"[^\W_]+(?:\.[  ]?[^\W_]{1,2})*$")
NEAR = 64


class Word:
    """What a full stop can tell from the word before it."""

    __slots__ = ("co", "degree", "digit", "dotted", "ender", "glued_letter", "glued_upper", "none", "opens", "ordinal", "short")

    def __init__(self, text: str, at: int) -> None:
        line = text.rfind("\n", max(0, at - NEAR), at) + 1
        m = WORD_BEFORE.search(text, max(line, at - NEAR, 0), at)
        word = m.group() if m else ""
        last = re.split(r"[.  ]", word)[-1]
        low, low_last = word.replace(" ", "").replace(" ", "").lower().translate(LOOKS), last.lower().translate(LOOKS)
        single = len(last) == 1 and last.isalpha() and not _is_cjk(last)
        self.none = not word
        self.degree = word != "" and m.start() > 0 and text[m.start() - 1] in "°º"
        self.ender = low in _enders or low_last in _enders and "." not in low
        self.co = low_last == "co"
        self.digit = last.isdigit()
        before = text[max(0, m.start() - 14) : m.start()] if self.digit else ""
        lead = m.start() if self.digit and len(last) <= 3 else -1
        while lead > 0 and text[lead - 1] != "\n" and text[lead - 1].isspace():
            lead -= 1
        self.opens = lead == 0 or lead > 0 and text[lead - 1] == "\n"  # a number that opens the line
        self.ordinal = bool(before.split()) and before.split()[-1].lower() in ORDINAL_AFTER
        self.short = single or low_last in _no_end or (len(last) == 2 and last[0] == last[1] and last.isupper())
        self.dotted = len(low) > 1 and "." in low and all(len(x) <= 2 for x in low.split(".")) and last.isupper()
        self.glued_upper = len(last) > 1 and not (single or last.isupper() and len(last) < 4) and "." not in word
        self.glued_letter = len(last) > 1 and not last.isdigit()

    def key(self) -> tuple[bool, ...]:
        return tuple(getattr(self, name) for name in self.__slots__)


@lru_cache(None)
def _stop_ends(word: tuple[bool, ...], gap: bool, kind: int, alnum: bool, cjk: bool, is_k: bool) -> bool:
    """Rules of a single full stop, by the class of the word before it and the kind of the character after it."""
    w = dict(zip(Word.__slots__, word, strict=True))
    if w["none"]:
        return kind != LOWER or not gap
    if not gap:
        return w["glued_upper"] or w["degree"] if kind == UPPER else kind == LETTER and w["glued_letter"] and not cjk
    if kind == LOWER:
        return False
    if w["ender"]:
        return not (is_k and w["co"]) and (kind in (UPPER, LETTER) or not alnum)
    if w["degree"]:
        return True
    if w["digit"]:
        return not w["opens"] and not (kind == UPPER and w["ordinal"])
    return not w["short"] and not w["dotted"]


@lru_cache(None)
def _ends(tok: str, nxt: str, quoted: bool, gap: bool, line: bool, kind: int, cjk: bool, kana: bool, corner: bool, stop: bool, letter_before: bool) -> bool:
    """The decision table: does a terminator end a sentence? It is filled class by class as the classes are met.

    tok: "." one full stop, "…" dots only, "。" wide, "?." others that end with a full stop, "?" others; nxt: class of the next
    character; stop: the verdict of `_stop_ends`.
    """
    if nxt == "":
        return True
    if nxt == ",":
        return False
    if nxt == "-" and gap:
        out = line and kind == UPPER or (not quoted and kind in (UPPER, LETTER))
    elif tok == "…":
        out = gap and kind == UPPER and not cjk
    elif tok == "。" or tok == "？":
        out = tok == "。" and not kana and not corner if quoted else True
    elif quoted:
        if kind == LETTER:
            out = (gap or cjk) and tok in (".", "?.")
        else:
            out = kind != LOWER and gap and (kind != DIGIT or tok in (".", "?."))
    elif tok == ".":
        out = stop or gap and kind == LOWER and nxt == "(" or not gap and nxt in ("“", "¿") and letter_before
    elif kind == LOWER:
        out = nxt == "¿"
    else:
        out = gap or kind in (UPPER, LETTER) or nxt in ("“", "¿", "(")
    return out and not (not gap and kind == DIGIT and tok in (".", "?."))


def _next_class(ch: str) -> str:
    if ch == "" or ch in ",;:、，；：،؛.":
        return ch and ","
    return "-" if ch in "–—-" else "¿" if ch in "¿¡" else "“" if ch in "“„«「《" else "(" if ch in "(（" else "x"


# Symbols. Breaks: paragraph or line, with what opens the next line. Ends: a terminator that ends a sentence, or doesn't.
# Quotes: 10 + q opens quotation q, 100 + q closes it; “ and " can do either.
START, START_HEADING, PARAGRAPH, PARAGRAPH_HEADING, LINE, ENDS, STAYS, EITHER, STRAIGHT, CLOSE_EITHER, CLOSE_STRAIGHT = 0, 1, 2, 3, 4, 190, 191, 150, 160, 151, 161
CLOSING = {"”": 102, "»": 103, "」": 104, "』": 105, "›": 107, "〟": 108, "〞": 108, "“": CLOSE_EITHER, '"': CLOSE_STRAIGHT}
ENDED, NONE_ENDED, HEAD = 0, 1, 2  # states of the line machine


def _line_symbol(bullet: bool, heading: int) -> int:
    return LINE + 3 * bullet + heading


@lru_cache(None)
def _line_step(symbol: int, state: int) -> tuple[int, tuple[int, ...]]:
    """The line machine: (next state, boundaries 1 that always count and 0 that count outside quotations) of a symbol.

    In a heading only the line's end counts. Heading 1 needs an ended sentence before it, heading 2 doesn't.
    """
    if symbol in (START, START_HEADING):
        return (HEAD if symbol == START_HEADING else ENDED), ()
    if symbol in (PARAGRAPH, PARAGRAPH_HEADING):
        return (HEAD if symbol == PARAGRAPH_HEADING else ENDED), (1,)
    if LINE <= symbol < LINE + 6:
        bullet, heading = divmod(symbol - LINE, 3)
        out = (1,) if state == HEAD else ()
        if bullet:
            out += (0 if state != NONE_ENDED else 1,)
        if heading == 2 or heading == 1 and state != NONE_ENDED:
            return HEAD, (*out, 1)
        return NONE_ENDED, out
    if state == HEAD:
        return HEAD, ()
    if symbol in (ENDS, STAYS):
        return (ENDED, (0,)) if symbol == ENDS else (NONE_ENDED, ())
    return state, ()


def _quote_step(state: int, code: int) -> int:
    """The quotation machine's next state; a paragraph or another boundary that always counts ends all quotations."""
    if code == EITHER:  # “ closes „, opens otherwise
        return 0 if state == 1 else 2 if state == 0 else state
    if code == CLOSE_EITHER:
        return 0 if state in (1, 2) else state
    if code in (STRAIGHT, CLOSE_STRAIGHT):
        return 0 if state == 6 else 6 if state == 0 and code == STRAIGHT else state
    if code >= 100:
        return 0 if state == code - 100 or (state == 1 and code == 102) else state
    return code - 10 if state == 0 else state


QUOTES = [*(10 + q for q in range(1, STATES)), *(100 + q for q in range(1, STATES)), EITHER, CLOSE_EITHER, STRAIGHT, CLOSE_STRAIGHT]
#: symbol -> next state of each state; the kind it opens; the kinds it closes.
STEP = {c: [_quote_step(s, c) for s in range(STATES)] for c in QUOTES}
OPENS = {c: STEP[c][0] for c in QUOTES}
SHUTS = {c: sum(1 << s for s in range(1, STATES) if STEP[c][s] == 0) for c in QUOTES}
ALL = (1 << STATES) - 1

Symbol = tuple[int, int]


def _heading(text: str, at: int, last: bool) -> int:
    m = HEADING.match(text, at)
    if m is None and (m := NUMBERED.match(text, at)) is not None and last and m.end() == len(text):
        m = None
    return int(m is not None)


def _closers(text: str, k: int, in_low: bool) -> list[int]:
    """The quote marks and brackets that close at k; “ before a word closes only within „."""
    first, n, out = k, len(text), []
    while k < n:
        c = text[k]
        after = text[k + 1 : k + 2].isalnum()
        if c in CLOSERS and not (c == "“" and after and text[k - 1 : k] in ("\u00a0", "\u2009")) and not (c in "“\"'" and k > first and text[k - 1].isspace()):
            if c == "“" and after and not in_low:
                break
            out.append(k)
            k += 1
        elif c in "  \u202f" and text[k + 1 : k + 2] in ("»", "›"):
            k += 1
        else:
            break
    return [*out, k]


def _terminator(text: str, tok: str, s: int, e: int, in_low: bool) -> tuple[list[Symbol], int]:
    """Symbols of a terminator with what closes after it, and where they end."""
    *closing, k = _closers(text, e, in_low)
    n, j = len(text), k
    while j < n and text[j].isspace():
        j += 1
    nxt = look = text[j : j + 1]
    if nxt and nxt in "\"'“„«‹「『¿¡([（《〝–—-":
        i = j + 1
        while i < n and (text[i].isspace() or text[i] in "\"'“„«‹「『¿¡([（《"):
            i += 1
        look = text[i : i + 1]
    gap, kind = j > k, _kind(look) if look else 0
    core = tok.strip("  \u202f")
    if ("…" in core or core.startswith("..")) and not core.strip(".…"):
        t = "…"
    elif core[-1] in "。！？｡":
        t = "。" if core[-1] in "。｡" else "？"
    else:
        t = "." if core == "." else "?." if core[-1] in ".．" else "?"
    stop = letter = False
    if t == ".":
        at = text.rfind(".", s, e)
        letter = text[at - 1 : at].isalpha() if at else False
        if gap or kind in (UPPER, LETTER):
            stop = _stop_ends(Word(text, at).key(), gap, kind, look.isalnum(), bool(look) and _is_cjk(look), look == "K")
    kana, corner = bool(nxt) and "぀" <= nxt <= "ゟ", text[k - 1] in "」』"
    end = _ends(t, _next_class(nxt), bool(closing), gap, "\n" in text[k:j], kind, bool(look) and _is_cjk(look), kana, corner, stop, letter)
    return [*((CLOSING[text[p]], p + 1) for p in closing if text[p] in CLOSING), (ENDS if end or nxt == "" else STAYS, k)], k


def _symbols(text: str, begin: int, stop: int, first: bool, last: bool) -> list[Symbol | tuple[list[Symbol], list[Symbol]]]:
    """Symbols and their places for the part begin..stop of a text (or of a slice of one that has what is looked at around it).

    A pair of lists stands for what is read within „, and otherwise.
    """
    out: list = []
    if first:
        out.append((START_HEADING if _heading(text, 0, last) else START, 0))
    skip = begin
    for m in EVENTS.finditer(text, begin):
        s, e = m.span()
        if s >= stop:
            break
        if e <= skip:
            continue
        tok = m.group()
        c = tok[0]
        if c == "\n":
            heading = _heading(text, e, last)
            if len(tok) > 1 and tok.count("\n") > 1:
                out.append((PARAGRAPH_HEADING if heading else PARAGRAPH, s))
                continue
            bullet = BULLET.match(text, e) is not None
            if bullet:  # a dash before a small letter goes on with reported speech, one before a capital opens a turn
                ahead = text[e : e + 12].lstrip(" \t")
                bullet = ahead[:1] not in "–—" or not ahead.lstrip("–— \t")[:1].islower()
            if heading and text[max(0, s - 40) : s].rstrip()[-1:] in (*TERMINATORS, *CLOSERS):
                heading = 2
            out.append((_line_symbol(bullet, heading), s))
        elif c in OPEN or c in "”»」』›〟〞":
            if c == "“":
                out.append((EITHER, e))
            elif c == '"':
                out.append((STRAIGHT, e))
            elif c not in OPEN:
                out.append((CLOSING[c], e))
            elif OPEN[c]:
                out.append((10 + OPEN[c], e))
        else:
            got, skip = _terminator(text, tok, s, e, False)
            if text[skip : skip + 1] == "“" and text[skip + 1 : skip + 2].isalnum():
                within, at = _terminator(text, tok, s, e, True)
                out.append((within, [*got, (EITHER, skip + 1)]))
                skip = max(skip + 1, at)
            else:
                out += got
    return out


class Block:
    """A block of symbols as functions of the three machines."""

    def __init__(self, symbols: list) -> None:
        self.symbols = symbols

    def resolved(self, state: int) -> tuple[list, int]:
        """What the line machine makes of the symbols from its entry state: (boundary or quote code, place), and its exit state."""
        out: list = []
        for x in self.symbols:
            if isinstance(x[0], list):
                if state != HEAD:
                    out.append(tuple([(0 if c == ENDS else c, p) for c, p in part if c != STAYS] for part in x))
                    state = ENDED if any(c == ENDS for c, _ in x[1]) else NONE_ENDED
                continue
            c, p = x
            if state == HEAD and c >= 10:
                continue
            state, found = (state, None) if 10 <= c < ENDS else _line_step(c, state)
            if found is None:
                out.append((c, p))
            else:
                out += [(f, p) for f in found]
        return out, state

    @staticmethod
    def ahead(codes: list, after: int) -> list[int]:
        """The machine from the right: after each code, the kinds of quotation (bits) that close before their paragraph does; last, before all of them."""
        out = [0] * len(codes)
        for k in range(len(codes) - 1, -1, -1):
            out[k] = after
            for part, mask in ((codes[k][0], 1 << 1), (codes[k][1], ALL ^ (1 << 1))) if isinstance(codes[k][0], list) else (([codes[k]], ALL),):
                for c, _ in reversed(part):
                    after = after & ~mask if c == 1 else after | SHUTS[c] & mask if c >= 10 else after
        out.append(after)
        return out

    @staticmethod
    def quotations(codes: list, ahead: list[int], state: int, cuts: list[int] | None = None) -> int:
        """The quotation machine: its exit state; the places of the boundaries are added to `cuts`."""
        for k, x in enumerate(codes):
            part = x[0 if state == 1 else 1] if isinstance(x[0], list) else (x,)
            for c, p in part:
                if c == 1 or c == 0 and state == 0:
                    if cuts is not None:
                        cuts.append(p)
                    state = 0 if c else state
                elif c and (state or ahead[k] >> OPENS[c] & 1 or not OPENS[c]):
                    state = STEP[c][state]
        return state

    def functions(self) -> list[tuple[int, int, int, list[tuple[list[int], int]]]]:
        """For each entry state of the line machine: its exit state; of the machine from the right the kinds that close here and
        those that pass; of the quotation machine, for each entry state, kinds opened here whose end lies beyond the block,
        in order, and the state if none of these ends."""
        out = []
        for entry in range(3):
            codes, to = self.resolved(entry)
            shut, through = self.ahead(codes, 0), self.ahead(codes, ALL)
            steps = []
            for state in range(STATES):
                pending, final = [], self.quotations(codes, shut, state)
                for q in range(1, STATES):  # a kind that ends only beyond the block, if it does
                    if self.quotations(codes, [s | t & 1 << q for s, t in zip(shut, through, strict=True)], state) == q != final:
                        pending.append(q)
                steps.append((self._in_order(codes, shut, through, state, pending), final))
            out.append((to, shut[-1], through[-1], steps))
        return out

    def _in_order(self, codes: list, shut: list[int], through: list[int], state: int, pending: list[int]) -> list[int]:
        """Of several kinds, the one that is opened first wins."""

        def first(a: int, b: int) -> bool:
            mask = 1 << a | 1 << b
            return self.quotations(codes, [s | t & mask for s, t in zip(shut, through, strict=True)], state) == a

        out: list[int] = []
        for q in pending:
            at = next((k for k, r in enumerate(out) if first(q, r)), len(out))
            out.insert(at, q)
        return out


def _scan(items: list, compose) -> list:  # noqa: ANN001
    """Inclusive prefix composition by doubling: after the step of width d each entry spans 2 d blocks."""
    out, d = list(items), 1
    while d < len(out):
        out = [out[k] if k < d else compose(out[k - d], out[k]) for k in range(len(out))]
        d *= 2
    return out


def entries(functions: list) -> list[tuple[int, int, int]]:
    """For each block: the line machine's entry state, the kinds that close beyond it, the quotation machine's entry state."""
    lines = _scan([tuple(f[e][0] for e in range(3)) for f in functions], lambda a, b: tuple(b[x] for x in a))
    line = [ENDED, *(x[ENDED] for x in lines[:-1])]
    # from the right: (kinds that close, kinds that pass)
    right = [(functions[k][line[k]][1], functions[k][line[k]][2]) for k in range(len(functions))][::-1]
    right = _scan(right, lambda a, b: (b[0] | b[1] & a[0], b[0] | b[1] & a[1]))[::-1]
    beyond = [*(x[0] for x in right[1:]), 0]
    steps = [tuple(next((q for q in pending if beyond[k] >> q & 1), final) for pending, final in functions[k][line[k]][3]) for k in range(len(functions))]
    quotes = _scan(steps, lambda a, b: tuple(b[x] for x in a))
    return list(zip(line, beyond, [0, *(x[0] for x in quotes[:-1])], strict=True))


def _cuts(symbols: list, entry: tuple[int, int, int]) -> list[int]:
    line, beyond, quote = entry
    codes, _ = Block(symbols).resolved(line)
    cuts: list[int] = []
    Block.quotations(codes, Block.ahead(codes, beyond), quote, cuts)
    return cuts


def _between(text: str, cuts: list[int], places: np.ndarray | None) -> list[tuple[int, int]]:
    out, at = [], 0
    for b in sorted({*cuts, len(text)}):
        a, cut = at, b
        while a < b and text[a].isspace():
            a += 1
        while b > a and text[b - 1].isspace():
            b -= 1
        if b > a:
            out.append((a, b) if places is None else (int(places[a]), int(places[b - 1]) + 1))
        at = cut
    return out


def spans(text: str) -> list[tuple[int, int]]:
    """The sentences of a text, as offsets."""
    if not text or text.isspace():
        return []
    clean, places = _clean(text)
    return _between(clean, _cuts(_symbols(clean, 0, len(clean), True, True), (ENDED, 0, 0)), places)


def blocks(text: str, length: int) -> list[tuple[int, int, int, str]]:
    """(start, end, start of the slice, slice) of blocks of about `length` characters, cut inside words; the slice has what the lexer looks at around the block."""
    ends, at = [], length
    while at < len(text):
        while at < len(text) and not (text[at - 1].isalnum() and text[at].isalnum()):
            at += 1
        if at < len(text):
            ends.append(at)
        at += length
    out = []
    for a, b in zip([0, *ends], [*ends, len(text)], strict=True):
        lo, seen = a, 0
        while lo > 0 and seen < NEAR + 16:
            lo -= 1
            seen += text[lo] not in INVISIBLE
        hi, seen = b, 0
        while hi < len(text) and text[hi] != "\n" and seen < 4 * HEADING_CHARS:
            seen += not text[hi].isspace() and text[hi] not in INVISIBLE
            hi += 1
        out.append((a, b, lo, text[lo : hi + 1]))
    return out


def _block(part: tuple[int, int, int, str], n: int) -> tuple[list, str, np.ndarray]:
    """Symbols of a block, its cleaned slice, and the places of the slice's characters in the text."""
    a, b, lo, piece = part
    clean, places = _clean(piece)
    places = np.arange(len(piece)) if places is None else places
    begin, stop = (int(np.searchsorted(places, x - lo)) for x in (a, b))
    return _symbols(clean, begin, stop if b < n else len(clean) + 1, a == 0, lo + len(piece) == n), clean, places + lo


def _pieces(part: tuple[int, int, int, str], n: int, entry: tuple[int, int, int]) -> list[tuple[int, int]]:
    """(end of a sentence, start of the next) of each boundary of a block, without white space, in the text's offsets."""
    symbols, clean, places = _block(part, n)
    out = []
    for cut in sorted(set(_cuts(symbols, entry))):
        b, a = cut, cut
        while b > 0 and clean[b - 1].isspace():
            b -= 1
        while a < len(clean) and clean[a].isspace():
            a += 1
        out.append((int(places[b - 1]) + 1 if b else 0, int(places[a]) if a < len(clean) else n))
    return out


def spans_in_blocks(text: str, length: int) -> list[tuple[int, int]]:
    """As `spans`, block by block: the way long texts take, in one process."""
    if not text or text.isspace():
        return []
    parts = blocks(text, length)
    where = entries([Block(_block(p, len(text))[0]).functions() for p in parts])
    clean, places = _clean(text)
    end = len(clean.rstrip())
    begin = len(clean) - len(clean.lstrip())
    out, at = [], begin if places is None else int(places[begin])
    for p, entry in zip(parts, where, strict=True):
        for b, a in _pieces(p, len(text), entry):
            if b > at:
                out.append((at, b))
            at = max(at, a)
    last = end if places is None else int(places[end - 1]) + 1
    return [*out, (at, last)] if at < last else out


SPANS = T.ArrayType(T.StructType([T.StructField("start_char", T.LongType()), T.StructField("end_char", T.LongType())]))


@F.pandas_udf(SPANS)
def _spans(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in texts:
        yield s.map(lambda t: [{"start_char": a, "end_char": b} for a, b in spans(t)] if isinstance(t, str) else [])


def _long(df: DataFrame, key: str, column: str, length: int) -> DataFrame:
    """key, sent_idx, start_char, end_char of long texts: their blocks are rows, and only the blocks' functions are gathered by text."""
    kind = df.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for k, t, copy in zip(b[key], b[column], b["_text"], strict=True):
                rows = [(k, copy, n, len(t), *part) for n, part in enumerate(blocks(t, length))]
                yield pd.DataFrame(rows, columns=[key, "_text", "block", "n", "a", "b", "lo", "piece"])

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [json.dumps(Block(_block((r.a, r.b, r.lo, r.piece), r.n)[0]).functions()) for r in b.itertuples(index=False)]
            yield b[["_text", "block"]].assign(functions=out)

    def compose(b: pd.DataFrame) -> pd.DataFrame:
        b = b.sort_values("block")
        where = entries([json.loads(f) for f in b["functions"]])
        return b[["_text", "block"]].assign(**{name: [w[k] for w in where] for k, name in enumerate(("line", "beyond", "quote"))})

    def emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            cuts = []
            for r in b.itertuples(index=False):
                found = _pieces((r.a, r.b, r.lo, r.piece), r.n, (r.line, r.beyond, r.quote))
                clean, places = _clean(r.piece)
                if r.block == 0:
                    lead = len(clean) - len(clean.lstrip())
                    found.insert(0, (0, int(lead if places is None else places[lead])))
                if r.b == r.n:
                    tail = len(clean.rstrip())
                    found.append((r.lo + int(tail if places is None else places[tail - 1] + 1), r.n))
                cuts.append([{"e": e, "s": s} for e, s in found])
            yield b[[key, "_text", "block"]].assign(cuts=cuts)

    ids = df.withColumn("_text", F.concat_ws(" ", F.xxhash64(key).cast("string"), F.md5(column)))
    parts = ids.mapInPandas(cut, f"{key} {kind}, _text string, block int, n long, a long, b long, lo long, piece string")
    # by block, into a number of parts that isn't made smaller again: every task gets its share of any text
    spread = max(df.sparkSession.sparkContext.defaultParallelism, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    parts = checkpoint(parts.repartition(spread, key, "_text", "block").dropDuplicates([key, "_text", "block"]))
    functions = parts.mapInPandas(work, "_text string, block int, functions string")
    where = functions.groupBy("_text").applyInPandas(compose, "_text string, block int, line int, beyond int, quote int")
    cuts = parts.join(where, ["_text", "block"]).mapInPandas(emit, f"{key} {kind}, _text string, block int, cuts array<struct<e:bigint,s:bigint>>")
    w = W.partitionBy(key, "_text").orderBy("block")
    before = F.last(F.element_at(F.when(F.size("cuts") > 0, F.col("cuts")), -1)["s"], True).over(w.rowsBetween(W.unboundedPreceding, -1))
    cuts = cuts.withColumn("before", before)
    starts = F.concat(F.array(F.col("before")), F.transform("cuts", lambda x: x["s"]))
    pairs = F.filter(F.zip_with(starts, F.transform("cuts", lambda x: x["e"]), lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda x: x["s"] < x["e"])
    cuts = cuts.select(key, "_text", "block", pairs.alias("pairs")).withColumn("idx", F.coalesce(F.sum(F.size("pairs")).over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rows = cuts.select(key, "idx", F.posexplode("pairs").alias("k", "p"))
    return rows.select(key, (F.col("idx") + F.col("k")).cast("int").alias("sent_idx"), F.col("p.s").alias("start_char"), F.col("p.e").alias("end_char"))


def sentences(df: DataFrame, key: str = "request_id", column: str = "text", length: int | None = None) -> DataFrame:
    """One row per sentence: key, sent_idx (from 0), start_char, end_char.

    Equal rows with a long text count once; with short texts each row gives its sentences.
    """
    length = length or LONG
    rows = df.select(key, column)
    short = rows.filter(F.length(column) <= length).select(F.col(key), F.posexplode(_spans(F.col(column))).alias("sent_idx", "s"))
    short = short.select(key, "sent_idx", F.col("s.start_char").alias("start_char"), F.col("s.end_char").alias("end_char"))
    long = rows.filter(F.length(column) > length)
    return short.unionByName(_long(long, key, column, length)) if not long.isEmpty() else short
