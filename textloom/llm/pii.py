"""Personal information in free text (problem 10).

Candidates (e-mail addresses, numbers, street addresses, names) are proposed by wide patterns, by the gazetteer and
by context: a name after a title or a signature is a candidate whether or not the gazetteer knows it, and so are its
other mentions in the text. Labelers vote on each: formats (regular expressions), check digits, a gazetteer of
names that is gathered from the whole corpus, and context words. Expectation-maximisation estimates from the votes
how far each labeler can be relied on, and the posteriors train a logistic span classifier over the votes and features
of the span and of what stands around it, which decides on every candidate; accepted spans become typed placeholders.

Defined results: null and empty texts hold nothing and come back as they are; offsets count code points of the
text as it is, end exclusive; where accepted spans overlap, the longer one stays.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from textloom.llm.sentences import _clean
from textloom.llm.worker import Shared
from textloom.session import checkpoint

#: Documents, about, (drawn by hash of their id) on whose candidates reliabilities and classifier are fitted.
FIT_DOCS = 4_000
#: Name words that are broadcast at once; rarer ones are looked up in the texts block by block, and joined back.
GAZETTEER = 200_000
#: Mentions after a context word that make a word a name.
MENTIONS = 2

UP = "A-ZÀ-ÖØ-ÞŒŠŽА-ЯЁ"
CAP = rf"(?:[dD]['’])?[{UP}](?:\w|['’\-](?=\w))+"
INITIAL = rf"[{UP}]\."
FULL = rf"(?:(?:{CAP}|{INITIAL})(?:[ ]{INITIAL})?[ ]{CAP}|{CAP},[ ]{CAP})"
WORD = re.compile(rf"{INITIAL}(?!\w)|(?:[dD]['’])?[^\W\d_](?:\w|['’\-](?=\w))*")

# Context words before a name in scripts with capitals (titles, signatures, requests).
NAME_CUES = ["Signed: ", "Dear Dr ", "Dear Dr. ", "Dear Mr ", "Dear Mrs ", "Dear Ms ", "Dear Prof ", "ask for ", "write to ", "Attn: ", "Mr ", "Mrs ", "Ms ", "Mr. ", "Mrs. ",
    "Gezeichnet: ", "Frau ", "Herr ", "Herrn ", "beantwortet ", "schreiben Sie an ", "Signé : ", "Signé: ", "appelez ", "écrire à ", "Mme ", "Mlle ", " M. ", "Firmado: ", "pregunte por ",
    "por favor a ", "La señora ", "El señor ", "Sr. ", "Sra. ", "Подпись: ", "Гражданин ", "Гражданка ", "отвечает ", "спросить ", "Господин ", "Госпожа "]
# The same where the script has no capitals; the name stands between two marks.
HAN, KANA, HANGUL, ARAB = "一-鿿々〆ヶ", "ぁ-んァ-ヶー", "가-힣", "ء-يآ-ۓ‌"
OPEN_NAMES = [
    (r"(?:联系人|聯繫人|收件人|签名|姓名)[：:]\s?([%s]{2,5})(?=[，,。\n]|$)" % HAN), (r"请联系([%s]{2,5})(?=[，,])" % HAN), (r"(?:^|[。！？\n，])([%s]{2,5})(?=的(?:身份证|护照|账号))" % HAN),
    (r"担当[はの：:]([%s%s]{2,9}?)(?=です|さん|[。、\n])" % (HAN, KANA)), (r"(?:^|[。！？\n、])\s?([%s%s]{2,9}?)(?=さん|様|の個人番号|の旅券)" % (HAN, KANA)), (r"(?:署名|氏名)[：:]\s?([%s%s]{2,9})(?=[。、\n]|$)" % (HAN, KANA)),
    (r"담당자[ :]\s?([%s]{2,4})(?=[ .,\n]|$)" % HANGUL), (r"(?:^|[\s.?!”])([%s]{2,4})(?= 씨)" % HANGUL), (r"(?:서명|성명)[ :]+([%s]{2,4})" % HANGUL),
    (r"(?:بالسيدة?|المسؤولة?|السيدة?|التوقيع:) ([%s]{2,12} [%s]{2,14})" % (ARAB, ARAB)), (r"رقم هوية ([%s]{2,12} [%s]{2,14})(?= هو)" % (ARAB, ARAB)),
    (r"(?:مسئول:|امضا:|آقای|خانم) ([%s]{2,12} [%s]{2,14})" % (ARAB, ARAB)), (r"(?:لطفاً با|با) ([%s]{2,12} [%s]{2,14})(?= به شمار)" % (ARAB, ARAB)), (r"کد ملی ([%s]{2,12} [%s]{2,14})(?= برابر)" % (ARAB, ARAB)),
]
OPEN_MARKS = ["联系人", "聯繫人", "收件人", "签名", "姓名", "请联系", "的身份证", "的护照", "的账号", "担当", "さん", "様", "の個人番号", "の旅券", "署名", "氏名", "담당자", " 씨", "서명", "성명", "بالسيد", "المسؤول", "السيد", "التوقيع", "رقم هوية", "مسئول", "امضا", "آقای", "خانم", " به شمار", "کد ملی"]
# Context words before an identity or account number, a telephone number, a number of neither kind.
ID_CUES = ["social security no", "social security number", "passport", "account", "national id", "tax no", "Ausweisnr", "Konto", "Steuernr", "Pass", "sécurité sociale", "compte", "passeport", "DNI", "NIE", "cuenta", "pasaporte", "паспорт", "ИНН", "СНИЛС", "счёт", "身份证", "护照", "账号", "個人番号", "旅券", "口座", "رقم هوية", "جواز", "حساب", "کد ملی", "گذرنامه", "주민등록번호", "여권", "계좌"]
PHONE_CUES = ["Call ", "call ", "phone ", "Tel.", "tel.", "Phone", "mobile", "Fax", "Telefon", "Tél.", "appelez ", "téléphone", "Llame al ", "teléfono", "Телефон", "телефон", "тел.", "电话", "電話", "さん（", "さん(", "على الرقم", "هاتف", "به شمارهٔ", "تلفن", "에게 ", "전화", "Rückfragen"]
OTHER_CUES = ["file no", "paragraph ", "row ", "edition ", "section ", "page ", "table ", "dossier n", "Zeichen", "Akte", "expediente", "Дело", "档案编号", "文書番号", "الملف رقم", "پروندهٔ شمارهٔ", "문서 번호", "from ", "invoice", "version"]
MAIL_CUES = ["mail", "Mail", "MAIL", "courriel", "correo", "почт", "邮", "メール", "بريد", "ایمیل", "이메일", "write to", "schreiben", "écrire", "escriba", "пишите"]
# Words that make a place or a body of the name before them.
BODIES = set("Institute Institut Bridge Bank University House Hall Foundation Company College School Museum Hospital Library Society Station Harbour Harbor Tower Park Gate River Lake Island Valley Press Group Party Award Prize Street Road Lane Avenue Square".split())
# Words for streets.
STREET_EN = "Street|St|Lane|Ln|Row|Yard|Road|Rd|Avenue|Ave|Drive|Dr|Close|Court|Ct|Place|Square|Terrace|Way|Walk|Hill|Gardens|Mews|Boulevard|Blvd|Crescent|Grove|Park|Quay"
STREET_FR = "rue|avenue|av\\.|boulevard|bd|quai|impasse|place|allée|chemin|route|cours|passage|square|sentier"
STREET_ES = "C/|Calle|Avda\\.?|Avenida|Plaza|Pza\\.?|Paseo|Camino|Ronda|Travesía"

DIGIT = r"[\d]"
CHUNK = r"(?:[A-Z]{0,2}\d[\dA-Z]*|[A-Z]{1,2}(?![\w]))"
GAP = r"(?:[ ]?[-–./‐][ ]?|[ ]|[ ]?[(（][ ]?|[)）][ ]?-?)"
NUMBER = re.compile(rf"(?<![0-9A-Za-z_.@/\-])(?:\+|[(（]\+?)?{CHUNK}(?:{GAP}{CHUNK})*")
ANCHOR = re.compile(r"\d[\d .\-–‐/()（）]{2,}[\dA-Z]|\d{3,}|[A-Z]\d\d")
EXTENSION = re.compile(r",?[ ]?(?:ext\.?|extension|poste|Durchwahl|DW|доб\.?|内线|内線|내선)[ ]?\d{1,6}", re.I)
AT = r"(?:[ ]?[@＠][ ]?|[ ]?[\[(（][ ]?at[ ]?[\])）][ ]?)"
DOT = r"(?:\.|[ ]?[\[(（][ ]?dot[ ]?[\])）][ ]?)"
EMAIL = re.compile(rf"[A-Za-z0-9][A-Za-z0-9._%+\-]*{AT}[A-Za-z0-9][A-Za-z0-9\-]*(?:{DOT}[A-Za-z0-9][A-Za-z0-9\-]*)+", re.I)
AT_PARTS = ("@", "＠", "at]", "at)", "at ]", "at )", "AT]", "AT)", "At]", "At)", "at）", "AT）")
LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
LOCAL_BEFORE = re.compile(r"[A-Za-z0-9._%+\-]*[ ]?$")
AT_SIGN = re.compile(r"[@＠]|[\[(（][ ]?at[ ]?[\])）]", re.I)

L = r"(?:,[ ]?|[ ]?\n[ ]?)"
ADDRESSES = [
    rf"(?:(?:Flat|Apt\.?|Apartment|Unit|Suite|Room)[ ]\d+\w?,[ ])?(?<![\d.\-/])[1-9]\d{{0,4}}(?:-?[A-Z])?[ ](?:{CAP}[ ]){{1,3}}(?:{STREET_EN})\b\.?(?:{L}(?:Apt\.?|Flat|Unit|Suite|#)[ ]?\d+\w?)?(?:{L}[A-Z][a-z]+(?:[ ][A-Z][a-z]+)?(?:,?[ ][A-Z]{{2}}[ ]\d{{5}}|[ ]\d{{5}}|,[ ][A-Z]{{1,2}}\d{{1,3}}[ ]\d[A-Z]{{2}})?)?",
    r"P\.?[ ]?O\.?[ ]?Box[ ]\d+(?:,[ ][A-Z][a-z]+(?:[ ][A-Z][a-z]+)?(?:,?[ ][A-Z]{2}[ ]\d{5}|[ ]\d{5}|,[ ][A-Z]{1,2}\d{1,3}[ ]\d[A-Z]{2})?)?",
    rf"(?:{CAP}\.?[ ]){{0,3}}{CAP}\.?[ ]\d+[ ]?[a-z]?{L}(?:[A-Z]{{1,2}}-)?\d{{5}}[ ]{CAP}(?:[ ](?:am|an[ ]der|bei)[ ]{CAP})?",
    rf"Postfach[ ]\d[\d ]*(?:{L}(?:[A-Z]{{1,2}}-)?\d{{5}}[ ]{CAP})?",
    rf"(?:(?:bât\.|bâtiment|apt\.)[ ][A-Z\d]+,[ ])?(?<![\d.\-/])[1-9]\d{{0,4}}(?:[ ]?(?:bis|ter|quater))?,?[ ](?:{STREET_FR})[ ](?:(?:de[ ]la|de[ ]l['’]|des|du|de|d['’])[ ]?)?{CAP}(?:[ ]{CAP})?(?:{L}\d{{5}}[ ]{CAP}(?:[ ]{CAP})?)?",
    rf"B\.?P\.?[ ]\d+(?:{L}\d{{5}}[ ]{CAP})?",
    rf"(?:{STREET_ES})[ ]?(?:(?:de|del|la|las|los|el)[ ]){{0,3}}{CAP}(?:[ ](?:(?:de|del|la|las|los)[ ])?{CAP}){{0,3}},?[ ]\d+\w?(?:,[ ]\d{{1,2}}(?!\d)\.?[ºª]?[ ]?[A-Z]?(?!\w))?(?:{L}\d{{5}}[ ]{CAP}(?:[ ]{CAP})?)?",
    rf"(?:Apartado(?:[ ]de[ ]Correos)?|Apdo\.)[ ]\d+(?:{L}\d{{5}}[ ]{CAP}(?:[ ]{CAP})?)?",
    rf"(?:\d{{6}},[ ])?(?:г\.[ ]{CAP},[ ])?(?:ул|пер|просп|пр|наб|пл|бул)\.[ ]{CAP}(?:[ ]{CAP})?,[ ](?:д\.[ ])?\d+[а-я]?(?:,[ ](?:корп|стр)\.[ ]\d+)?(?:,[ ]кв\.[ ]\d+)?(?:,[ ]г\.[ ]{CAP})?",
    rf"(?:\d{{6}},[ ])?(?:г\.[ ]{CAP},[ ])?а/я[ ]\d+(?:,[ ]г\.[ ]{CAP})?",
    rf"(?<=[往：:，。\n在])(?:(?![往寄请到给])[{HAN}]){{1,8}}?(?:省|市|区|县|镇)[{HAN}]{{1,8}}?(?:路|街|巷|道|弄|里|大道)\d+号(?:\d+(?:栋|幢|号楼|座))?(?:\d+单元)?(?:\d+[室号])?",
    rf"(?:〒\d{{3}}-\d{{4}}[ ]?)?(?<![{HAN}{KANA}])[{HAN}]{{1,4}}?[都道府県][{HAN}{KANA}]{{1,8}}?[市区町村郡][{HAN}{KANA}]*?(?:[{HAN}\d]+丁目)?\d+(?:-\d+)*(?:番地?)?(?:\d+号)?|〒\d{{3}}-\d{{4}}[ ]?[{HAN}{KANA}]+\d+(?:-\d+)*(?:番地?)?(?:\d+号)?|(?<=は)[{HAN}]{{1,4}}?[都道府県][{HAN}{KANA}]{{1,8}}?[市区町村郡][{HAN}{KANA}]*?(?:[{HAN}\d]+丁目)?\d+(?:-\d+)*(?:番地?)?(?:\d+号)?",
    rf"[{HANGUL}]{{1,6}}(?:시|도|군)[ ](?:[{HANGUL}]{{1,6}}(?:구|군)[ ])?[{HANGUL}]{{1,8}}(?:동|로|길|읍|면|리)[ ]\d+(?:-\d+)?(?:번지)?(?:[ ,]+\d+동)?(?:[ ,]+\d+호)?|사서함[ ]?\d+호?",
    rf"شارع[ ][{ARAB}]+(?:[ ][{ARAB}]+)?[ ]\d+(?:،[ ](?:شقة[ ]\d+،[ ])?[{ARAB}]+(?:[ ][{ARAB}]+)?)?|صندوق بريد[ ]\d+(?:،[ ][{ARAB}]+(?:[ ][{ARAB}]+)?)?",
    rf"خیابان[ ][{ARAB}]+(?:[ ][{ARAB}]+)?،[ ]پلاک[ ]\d+(?:،[ ]واحد[ ]\d+)?(?:،[ ][{ARAB}]+(?:[ ][{ARAB}]+)?)?|صندوق پستی[ ]\d+(?:،[ ][{ARAB}]+)?",
]
ADDRESS = [re.compile(p) for p in ADDRESSES]
#: Literal parts, one of which every address of the pattern has; a pattern is tried only near them.
ADDRESS_MARKS = [[f" {w}" for w in STREET_EN.split("|")], ["Box "], None, ["Postfach"], ["rue ", "avenue ", "av. ", "boulevard ", "bd ", "quai ", "impasse ", "place ", "allée ", "chemin ", "route ", "cours ", "passage ", "square ", "sentier "],
    ["B.P. ", "BP "], ["C/", "Calle ", "Avda", "Avenida ", "Plaza ", "Pza", "Paseo ", "Camino ", "Ronda ", "Travesía "], ["Apartado", "Apdo."], ["ул. ", "пер. ", "просп. ", "пр. ", "наб. ", "пл. ", "бул. "], ["а/я "],
    ["路", "街", "巷", "道", "弄", "里"], ["県", "都", "府", "道", "〒"], ["동 ", "로 ", "길 ", "읍 ", "면 ", "리 ", "사서함"], ["شارع ", "صندوق بريد"], ["خیابان ", "صندوق پستی"]]
_PLACES: dict[str, tuple] = {}
for _k, _marks in enumerate(ADDRESS_MARKS):
    for _w in _marks or ():
        _PLACES[_w] = (*_PLACES.get(_w, ()), _k)
TYPES = ("email", "phone", "id_number", "address", "name")
POSTCODE = re.compile(r"(?:[A-Z]{1,2}-)?\b\d{5}[ ]")


def _automaton(words: dict[str, tuple]) -> ahocorasick.Automaton | None:
    a = ahocorasick.Automaton()
    for w, v in words.items():
        a.add_word(w, (len(w), v))
    if words:
        a.make_automaton()
        return a
    return None


def _before(spans: list[tuple], a: int, most: int) -> bool:
    """Does one of the spans, which are in order, end at most so many characters before a?"""
    k = bisect_left(spans, (a,))
    return k > 0 and 0 <= a - spans[k - 1][1] <= most


def _free(kept: list[tuple], a: int, b: int) -> bool:
    """Does a..b touch none of the kept spans, which are in order and apart?"""
    k = bisect_left(kept, (a,))
    return (k == len(kept) or b <= kept[k][0]) and (k == 0 or kept[k - 1][1] <= a)


_CUES: dict[str, tuple] = {}
for _kind, _list in (("name", NAME_CUES), ("open", OPEN_MARKS), ("id", ID_CUES), ("phone", PHONE_CUES), ("other", OTHER_CUES), ("mail", MAIL_CUES)):
    for _w in _list:
        _CUES[_w] = (*_CUES.get(_w, ()), _kind)
_CUE_AUTOMATON = _automaton(_CUES)
_PLACE_AUTOMATON = _automaton(_PLACES)
_FULL, _OPEN = re.compile(FULL), [re.compile(p) for p in OPEN_NAMES]


def _cue_hits(text: str) -> dict[str, list[tuple[int, int]]]:
    hits: dict[str, list[tuple[int, int]]] = {}
    for end, (n, kinds) in _CUE_AUTOMATON.iter(text):
        for kind in kinds:
            hits.setdefault(kind, []).append((end - n + 1, end + 1))
    return hits


def _open_names(text: str, marks: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Names between marks, in scripts without capitals."""
    out = set()
    for s, e in marks:
        a, b = max(0, s - 16), min(len(text), e + 34)
        part = text[a:b]
        for p in _OPEN:
            for m in p.finditer(part):
                if not (m.start() == m.start(1) and a > 0 and m.start() == 0 and p.pattern.startswith("(?:^")):
                    out.add((a + m.start(1), a + m.end(1)))
    return sorted(out)


def mentions(text: str) -> list[str]:
    """Names after context words: 'first\tlast', or the whole name where the script has no capitals."""
    out = []
    hits = _cue_hits(text)
    for _, e in hits.get("name", ()):
        m = _FULL.match(text, e)
        if m and "\n" not in m.group():
            w = m.group()
            if "," in w:
                last, first = w.split(", ", 1)
            else:
                parts = w.split(" ")
                first, last = parts[0], parts[-1]
            out.append(f"{first.casefold()}\t{last.casefold()}")
    if "open" in hits:
        out += [text[a:b] for a, b in _open_names(text, hits["open"])]
    return out


def _around(p: re.Pattern, text: str, at: int, before: int = 70, after: int = 170, margin: int = 60) -> list[re.Match]:
    """Matches of p over a place; the part of the text that is looked at grows until no match comes near its ends."""
    while True:
        lo, hi = max(0, at - before), min(len(text), at + after)
        if not re.search(r"\d", text[lo:hi]):
            return []
        while 0 < lo < at and not text[lo - 1].isspace() and text[lo - 1] not in "：:，。往は":
            lo += 1
        found = [m for m in p.finditer(text, lo, hi) if m.start() <= at + 1 and at < m.end()]
        if all((m.end() + margin <= hi or hi == len(text)) and (m.start() > lo or lo == 0 or text[lo - 1] in "\n：:，。往は") for m in found) or lo == 0 and hi == len(text) or before > 4000:
            return found
        before, after = 2 * before, 2 * after


def _luhn(d: str) -> bool:
    return sum(int(c) if k % 2 == 0 else sum(divmod(2 * int(c), 10)) for k, c in enumerate(reversed(d))) % 10 == 0


def _weighed(d: str, weights: tuple[int, ...], mod: int = 11) -> int:
    return sum(int(c) * w for c, w in zip(d, weights, strict=False)) % mod


# Weights of check digits (tax numbers of 10 and 12 digits, resident numbers of 18).
INN, INN_A, INN_B, RESIDENT = (2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (3, 7, 2, 4, 10, 3, 5, 9, 4, 6, 8), (7, 9, 10, 5, 8, 4, 2, 1, 6, 3, 7, 9, 10, 5, 8, 4, 2)


def checked(number: str) -> bool:
    """Do the check digits of a kind of number that has this form hold?"""
    s = re.sub(r"[^0-9A-Z]", "", number)
    if re.fullmatch(r"[A-Z]{2}\d{2}[0-9A-Z]{11,30}", s):  # account numbers
        return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1
    if re.fullmatch(r"[XYZ\d]\d{7}[A-Z]", s):  # national numbers with a letter
        return "TRWAGMYFPDXBNJZSQVHLCKE"[int(s[:-1].translate(str.maketrans("XYZ", "012"))) % 23] == s[-1]
    if re.fullmatch(r"\d{17}[\dX]", s):
        return "10X98765432"[_weighed(s, RESIDENT)] == s[-1]
    if not s.isdigit() or len(set(s)) == 1:
        return False
    if len(s) == 15 and s[0] in "12":
        return 97 - int(s[:13]) % 97 == int(s[13:])
    if len(s) == 10:
        return _weighed(s, INN) % 10 == int(s[9])
    if len(s) == 12:
        return _weighed(s, INN_A) % 10 == int(s[10]) and _weighed(s, INN_B) % 10 == int(s[11])
    if len(s) == 11:
        return sum(int(c) * (9 - k) for k, c in enumerate(s[:9])) % 101 % 100 == int(s[9:])
    return 13 <= len(s) <= 19 and _luhn(s)


class Finder:
    """Candidates with their votes, given the gazetteer (word -> number of mentions)."""

    def __init__(self, gazetteer: Iterable[str], base: Finder | None = None) -> None:
        self.base, self.names_given = base, frozenset(gazetteer)
        self.words = {w for w in gazetteer if w[0] != "="}
        whole = {w[1:] for w in gazetteer if w[0] == "="}
        table: dict[str, tuple] = {}
        for w in self.words:
            if not w.endswith("."):
                for form in {w.title(), w.upper(), w[:1].upper() + w[1:], re.sub(r"(^|[-'’ ])(\w)", lambda m: m.group(1) + m.group(2).upper(), w), re.sub(r"^d(['’])(\w)", lambda m: "d" + m.group(1) + m.group(2).upper(), w)}:
                    table[form] = ("word",)
        for w in whole:
            table[w] = ("whole",)
        self.names = _automaton(table)

    def known(self, word: str) -> bool:
        return word in self.words or self.base is not None and self.base.known(word)

    def hits(self, text: str) -> list[tuple[int, tuple[int, tuple]]]:
        """Places of the gazetteer's words, by their ends."""
        own = list(self.names.iter(text)) if self.names is not None else []
        return sorted({*own, *self.base.hits(text)}) if self.base is not None else own

    def met(self, text: str) -> set[str]:
        """The words of the gazetteer (whole names with =) that a text may hold."""
        out = {w for m in WORD.finditer(text) if (w := m.group().casefold()) in self.words}
        for end, (n, kind) in self.hits(text):
            form = text[end - n + 1 : end + 1]
            if kind[0] == "whole":
                out.add(f"={form}")
            elif form.casefold() in self.words and not text[end + 1 : end + 2].isalnum():
                out.add(form.casefold())
        return out

    def candidates(self, text: str) -> list[tuple[int, int, str, tuple[int, ...]]]:
        """(start, end, type, votes 1 / 0 / -1 for abstains)."""
        out: list[tuple[int, int, str, tuple[int, ...]]] = []
        hits: dict[str, list[tuple[int, int]]] | None = None

        def cues() -> dict[str, list[tuple[int, int]]]:
            nonlocal hits
            if hits is None:
                hits = _cue_hits(text)
            return hits

        emails = []
        for m in AT_SIGN.finditer(text) if any(x in text for x in AT_PARTS) else ():
            lo = LOCAL_BEFORE.search(text[max(0, m.start() - 256) : m.start()]).start() + max(0, m.start() - 256)
            while lo > 0 and text[lo - 1] in LOCAL:
                lo -= 1
            for e in EMAIL.finditer(text, lo):
                if e.start() <= m.start() < e.end():
                    span = (e.start(), e.end())
                    host = re.split(AT, text[span[0] : span[1]], maxsplit=1, flags=re.I)[-1]
                    good = int(re.search(r"[A-Za-z]{2,}$", host) is not None)
                    local_letter = int(re.match(r"[A-Za-z]", text[span[0]]) is not None)
                    if span not in emails:
                        emails.append(span)
                        out.append((*span, "email", (good, local_letter, 1 if _before(cues().get("mail", ()), span[0], 30) else -1)))
                break
        emails.sort()
        addresses = []
        numbers = [m for m in ANCHOR.finditer(text)]
        has_digit = bool(numbers) or re.search(r"\d", text) is not None
        if has_digit:
            addresses = self._addresses(text)
            for a, b, strong in addresses:
                before = text[max(0, a - 40) : a]
                cue = int(re.search(r"(?:\bto|\ban|\bpour|\bir a|адресу:|往|は|إلى|نشانی:|소포는|[:：]|\n)[ ]?$", before) is not None)
                out.append((a, b, "address", (strong, cue if cue else -1 if strong else 0, -1)))
        if numbers:
            seen_to = -1
            for m in numbers:
                if m.start() < seen_to:
                    continue
                got = self._number(text, m.start())
                if got is None:
                    continue
                a, b = got
                seen_to = b
                if not _free(addresses, a, b) or not _free(emails, a, b):
                    continue
                out += self._numeric(text, a, b, cues(), emails, addresses)
        out += self._persons(text, cues)
        return out

    @staticmethod
    def _addresses(text: str) -> list[tuple[int, int, int]]:
        found: list[tuple[int, int, int]] = []
        near: dict[int, list[int]] = {ADDRESS_MARKS.index(None): [m.start() for m in POSTCODE.finditer(text)]}
        for end, (n, kinds) in _PLACE_AUTOMATON.iter(text):
            for k in kinds:
                near.setdefault(k, []).append(end - n + 1)
        for k, places in near.items():
            p = ADDRESS[k]
            for at in sorted(places):
                for m in _around(p, text, at):
                    strong = int(bool(re.search(r"\d{5}|\d[A-Z]{2}$|,[ ][A-ZА-Я]|号|番|번지|，|،|\n", m.group())))
                    found.append((m.start(), m.end(), strong))
        found.sort(key=lambda x: (-(x[1] - x[0]), x[0]))
        kept: list[tuple[int, int, int]] = []
        for f in found:
            if _free(kept, f[0], f[1]):
                insort(kept, f)
        return kept

    @staticmethod
    def _number(text: str, at: int) -> tuple[int, int] | None:
        lo = at
        while lo > 0 and at - lo < 12 and (text[lo - 1] in "+(（ -" or text[lo - 1].isascii() and text[lo - 1].isupper()):
            lo -= 1
        best, reach = None, 60
        while True:
            best = next((m for m in NUMBER.finditer(text, lo, min(len(text), at + reach)) if m.start() <= at < m.end()), None)
            if best is None or best.end() + 8 < at + reach or at + reach >= len(text):
                break
            reach *= 2
        if best is None:
            return None
        a, b = best.start(), best.end()
        s = text[a:b]
        if (x := re.match(r"([A-Z]{1,2})[ ](?=\d)", s)) and not re.match(r"[A-Z]{2}(?:[ ]?\d\d){3}[ ]?[A-Z]$", s):
            a += x.end()  # a word's letter before the number
            s = text[a:b]
        if (x := re.search(r"[ ](?:[-–./][ ]?)?[A-Z]{1,2}$", s)) and not re.match(r"[A-Z]{2}(?:[ ]?\d\d){3}[ ]?[A-Z]$", s):
            b = a + x.start()
            s = text[a:b]
        s2 = s.rstrip(" -–./(（")
        b = a + len(s2)
        if s2.count("(") + s2.count("（") < s2.count(")") + s2.count("）"):
            b = a + max(s2.rfind(")"), s2.rfind("）"))
        if s2[:1] in "(（" and not re.search("[)）]", s2):
            a += 1
        if sum(map(str.isdigit, text[a:b])) < 5 or (sum(map(str.isdigit, text[a:b])) < 7 and not re.search("[A-Z]", text[a:b])):
            return None
        return a, b

    @staticmethod
    def _nearest(hits: dict[str, list[tuple[int, int]]], text: str, a: int) -> tuple[str | None, int]:
        """The kind of the context word that ends nearest before `a`, within the sentence."""
        best = (None, -1, 0)
        for kind in ("id", "phone", "other"):
            spans = hits.get(kind, ())
            k = bisect_left(spans, (a, 0)) - 1
            while k >= 0 and k > -1 and a - spans[k][0] < 64:
                s, e = spans[k]
                if e <= a + 1 and a - e <= 44 and not SENTENCE_END.search(NO_END.sub("", text[e:a])):
                    if (e, e - s) > (best[1], best[2]):
                        best = (kind, e, e - s)
                k -= 1
        return best[0], best[1]

    def _numeric(self, text: str, a: int, b: int, hits: dict, emails: list, addresses: list) -> list[tuple[int, int, str, tuple[int, ...]]]:
        s = text[a:b]
        digits = sum(map(str.isdigit, s))
        letters = re.search(r"[A-Z]", s) is not None
        cue, _ = self._nearest(hits, text, a)
        left = text[max(0, a - 8) : a]
        near = _before(emails, a, 5)
        line = (left.endswith("\n") or left.rstrip().endswith(("Tel.", "Tél."))) and _before(addresses, a, 14)
        right = text[b : b + 6]
        asked = near or line or right.startswith((" 번으로", "번으로", " تماس"))
        plain = s.lstrip("(（+")
        phone_form = int(not letters and 7 <= digits <= 15 and (s[0] in "+(（" or plain[:1] in "0٠۰０" or s[:2] in ("8 ", "8(") or re.fullmatch(r"(?:\d{3}[-. ]?){1,2}\d{3,4}|(?:\d ?-? ?){7,12}", s) is not None))
        id_form = int(letters or digits >= 11 and s[0] != "+" or re.fullmatch(r"\d{3}[- ]\d\d[- ]\d{4}|\d\d[ ]\d\d[ ]\d{6}|\d{3}-\d{3}-\d{3}[ ]\d\d|\d{10}|\d{7}-\d{7}", s) is not None)
        end = b
        if (m := EXTENSION.match(text, b)) is not None:
            end = m.end()
        c = -1 if cue is None else 1
        # the check digit of a short number holds by chance one time in ten: it speaks beside a context word only
        sure = (letters or digits >= 13 or cue == "id") and checked(s)
        return [
            (a, end, "phone", (phone_form, 1 if asked or cue == "phone" else 0 if c == 1 else -1, 0 if cue == "other" and not asked else -1, 0 if cue == "id" and not asked else -1)),
            (a, b, "id_number", (id_form, 1 if cue == "id" and not asked else 0 if c == 1 or asked else -1, 0 if cue == "other" else -1, 0 if cue == "phone" or asked else -1, 1 if sure else -1)),
        ]

    def _persons(self, text: str, cues) -> list[tuple[int, int, str, tuple[int, ...]]]:  # noqa: ANN001
        found: dict[tuple[int, int], list[int]] = {}
        last = -1
        for end, (n, kind) in self.hits(text):
            s, e = end - n + 1, end + 1
            if kind[0] == "whole":
                if IDEOGRAPHIC.match(text[s]) or not (text[s - 1 : s].isalpha() or text[e : e + 1].isalpha()):
                    found[s, e] = [1, 1, -1]
                continue
            if s < last or text[e : e + 1].isalnum() or (s > 0 and (text[s - 1].isalnum() or text[s - 1] in "@._+-")) or text[e : e + 1] in ("@", "_", "＠"):
                continue
            got = self._expand(text, s, e)
            if got:
                a, b, known = got
                found[a, b] = [1, int(known > 1), -1]
                last = b
        hits = cues()
        if hits:
            for a, b in _open_names(text, hits.get("open", [])) if self._quick(text) or found else ():
                found.setdefault((a, b), [-1, -1, 1])[2] = 1
            starts = {s for s, _ in hits.get("name", ())}
            for _, e in hits.get("name", ()):
                m = _FULL.match(text, e) if e not in starts else None  # "write to Mr ": the name stands after the last
                if m and "\n" not in m.group():
                    known = [w for w in re.split(r"[ ,]+", m.group()) if self.known(w.casefold())]
                    if (m.start(), m.end()) not in found and not any(x < m.end() and m.start() < y for x, y in found):
                        found[m.start(), m.end()] = [1, int(len(known) > 1), 1] if known else [-1, -1, 1]  # a name that the gazetteer hasn't met: it abstains
                    elif (m.start(), m.end()) in found:
                        found[m.start(), m.end()][2] = 1
            taken = sorted(found)
            for name in {text[a:b] for (a, b), v in found.items() if v[2] == 1}:  # its other mentions in the text
                at = text.find(name)
                while at >= 0:
                    b = at + len(name)
                    if _free(taken, at, b) and (IDEOGRAPHIC.match(name) or not (text[at - 1 : at].isalnum() or text[b : b + 1].isalnum())):
                        found[at, b] = [-1, -1, 1]
                        insort(taken, (at, b))
                    at = text.find(name, b)
        return [(a, b, "name", (v[0], v[1], v[2], self._whole(text, b))) for (a, b), v in found.items()]

    @staticmethod
    def _whole(text: str, end: int) -> int:
        """0 if the next word makes a place or a body of the name, else 1."""
        m = re.compile(r" ([^\W\d_]+)").match(text, end)
        return 0 if m and m.group(1) in BODIES else 1

    @staticmethod
    def _quick(text: str) -> tuple[str, ...]:
        return ("open",) if not text.isascii() and OPEN_SCRIPT.search(text) else ()

    def _expand(self, text: str, s: int, e: int) -> tuple[int, int, int] | None:
        """The whole name around a gazetteer word: neighbours that are gazetteer words or initials."""

        def neighbour(at: int, step: int) -> tuple[int, int, str, str] | None:
            if step > 0:
                m = re.compile(r"(,?[ ])").match(text, at)
                w = WORD.match(text, m.end()) if m else None
                return (w.start(), w.end(), w.group(), m.group(1)) if w else None
            lo = max(0, at - 64)
            part = text[lo:at]
            m = re.search(rf"({INITIAL}|(?:[dD]['’])?[^\W\d_](?:\w|['’\-](?=\w))*)(,?[ ])$", part)
            if m and (m.start() == 0 or not part[m.start() - 1].isalnum()):
                return lo + m.start(1), lo + m.end(1), m.group(1), m.group(2)
            return None

        def name_word(w: str) -> int:
            return 1 if (w[0].isupper() or w[:2] in ("d'", "d’")) and self.known(w.casefold()) else 2 if re.fullmatch(INITIAL, w) else 0

        a, b, known, initials = s, e, 1, 0
        for _ in range(2):
            n = neighbour(b, 1)
            if not n or not (k := name_word(n[2])) or (n[3] != " " and (k == 2 or known > 1 or initials)):
                break
            b = n[1]
            known, initials = known + (k == 1), initials + (k == 2)
            if n[3] != " ":
                return a, b, known
        if known == 1 and initials and text[b - 1] == ".":  # "Will T." needs its last name
            n = neighbour(b, 1)
            if n and n[3] == " " and name_word(n[2]) == 1:
                b, known = n[1], known + 1
        for _ in range(2):
            n = neighbour(a, -1)
            if not n or not (k := name_word(n[2])) or n[3] != " " or known + initials >= 3 or (k == 2 and (known > 1 or initials)):
                break
            a = n[0]
            known, initials = known + (k == 1), initials + (k == 2)
        return (a, b, known) if known + initials > 1 else None


SENTENCE_END = re.compile(r"[.!?。！？][\s”]|\n\n")
#: Full stops that end no sentence: of the context word itself, of initials.
NO_END = re.compile(rf"^\.|Tel\. |(?<!\w){INITIAL}")
IDEOGRAPHIC = re.compile(rf"[{HAN}{KANA}{HANGUL}]")
OPEN_SCRIPT = re.compile(rf"[{HAN}{HANGUL}ء-ي]")


class Reliability:
    """Two-class Dawid-Skene model of one type's votes, fitted by expectation-maximisation."""

    def __init__(self, votes: np.ndarray) -> None:
        n, k = votes.shape
        known = votes >= 0
        # a vote against weighs double at the start: formats agree with much that is none
        weight = np.where(votes == 0, 2.0, 1.0) * known
        p = np.where(known.any(1), (weight * np.maximum(votes, 0)).sum(1) / np.maximum(1, weight.sum(1)), 0.5)
        p = np.clip((p - 0.5) * 2 + 0.5, 0.02, 0.98)
        self.prior, self.hit, self.miss = 0.5, np.full(k, 0.8), np.full(k, 0.2)
        for _ in range(30):
            self.prior = float(np.clip(p.mean(), 0.02, 0.98))
            w1, w0 = p[:, None] * known, (1 - p)[:, None] * known
            self.hit = ((w1 * votes).sum(0) + 4.0) / (w1.sum(0) + 5.0)
            self.miss = ((w0 * votes).sum(0) + 1.0) / (w0.sum(0) + 5.0)
            p = self.posterior(votes)

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        known = votes >= 0
        one = np.where(votes == 1, np.log(self.hit / self.miss), np.log((1 - self.hit) / (1 - self.miss)))
        z = np.log(self.prior / (1 - self.prior)) + np.where(known, one, 0.0).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


#: What the classifier sees of a span and its surroundings.
SHAPE = ("digits", "letters", "words", "plus", "brackets", "starts_line", "ends_clause", "long")


def shape(text: str, a: int, b: int) -> tuple[int, ...]:
    """The features of SHAPE, in steps, so that few different ones occur."""
    s = text[a:b]
    digits, letters = sum(map(str.isdigit, s)), sum(map(str.isalpha, s))
    return (min(digits // 3, 5), min(letters // 6, 5), min(s.count(" "), 5), int("+" in s), int(any(c in "()（）" for c in s)), int(text[a - 1 : a] in ("", "\n")), int(text[b : b + 1] in (*".,;:!?。，、\n", "")), int(b - a > 30))


def _features(votes: np.ndarray, shapes: np.ndarray) -> np.ndarray:
    """Votes for, votes against, pairs of votes for, and the shape of the span."""
    yes, no = (votes == 1).astype(float), (votes == 0).astype(float)
    k = votes.shape[1]
    pairs = [yes[:, i] * yes[:, j] for i in range(k) for j in range(i + 1, k)]
    return np.stack([np.ones(len(votes)), *yes.T, *no.T, *pairs, *(shapes.T / 5.0)], 1)


class SpanClassifier:
    """Logistic regression on votes and shapes, one for each type, trained on the label model's posteriors."""

    def __init__(self, sample: list[tuple[str, tuple[int, ...], tuple[int, ...]]]) -> None:
        self.weights: dict[str, np.ndarray] = {}
        for kind in TYPES:
            rows = [(v, f) for t, v, f in sample if t == kind]
            if not rows:
                continue
            votes = np.array([v for v, _ in rows])
            target = Reliability(votes).posterior(votes)
            x = _features(votes, np.array([f for _, f in rows], dtype=float))
            w = np.zeros(x.shape[1])
            for _ in range(25):  # Newton steps with a small ridge
                p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
                h = x.T @ (x * (p * (1 - p))[:, None]) + 0.5 * np.eye(len(w))
                w += np.linalg.solve(h, x.T @ (target - p) - 0.5 * w)
            self.weights[kind] = w

    def probability(self, kind: str, votes: tuple[int, ...], features: tuple[int, ...]) -> float:
        w = self.weights.get(kind)
        if w is None:  # nothing to learn from: the share of votes for
            known = [v for v in votes if v >= 0]
            return sum(known) / max(1, len(known))
        return float(1 / (1 + np.exp(-np.clip(_features(np.array([votes]), np.array([features], dtype=float)) @ w, -30, 30))[0]))


class Tagger:
    """Accepted spans of a text."""

    def __init__(self, finder: Finder, classifier: SpanClassifier) -> None:
        self.finder, self.classifier = finder, classifier
        self.probability = lru_cache(100_000)(classifier.probability)

    def spans(self, text: str) -> list[tuple[int, int, str]]:
        clean, places = _clean(text)
        scored = []
        for a, b, kind, votes in self.finder.candidates(clean):
            p = self.probability(kind, votes, shape(clean, a, b))
            if p > 0.5:
                scored.append((a, b, kind, p))
        scored.sort(key=lambda x: (-(x[1] - x[0]) if x[2] == "address" else 0, -x[3], -(x[1] - x[0]), x[0]))
        kept: list[tuple[int, int, str]] = []
        for a, b, kind, _ in scored:
            if _free(kept, a, b):
                insort(kept, (a, b, kind))
        if places is not None:
            kept = [(int(places[a]), int(places[b - 1]) + 1, kind) for a, b, kind in kept]
        return sorted(kept)

    def redact(self, text: str) -> str:
        out, at = [], 0
        for a, b, kind in self.spans(text):
            out += text[at:a], f"<{kind.upper()}>"
            at = b
        return "".join((*out, text[at:]))


def name_words(df: DataFrame, column: str = "text") -> DataFrame:
    """w, n: name words (and, marked with =, whole names of scripts without capitals) with their mentions over all rows."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            c: Counter[str] = Counter()
            for t in b[column]:
                if t:
                    for m in mentions(_clean(t)[0]):
                        c.update([w for w in m.split("\t") if not w.endswith(".")] if "\t" in m else [f"={m}"])
            if c:
                yield pd.DataFrame({"w": list(c), "n": list(c.values())})

    return df.select(column).mapInPandas(count, "w string, n long").groupBy("w").agg(F.sum("n").alias("n")).filter(F.col("n") >= MENTIONS)


def gather_names(df: DataFrame, column: str = "text", size: int | None = None) -> dict[str, int]:
    """The `size` most frequent name words (GAZETTEER), and one more if there are rarer ones."""
    top = name_words(df, column).orderBy(F.desc("n"), "w").limit((size or GAZETTEER) + 1)
    return {r["w"]: r["n"] for r in top.toLocalIterator()}


def rare_names(df: DataFrame, key: str, column: str, size: int) -> DataFrame:
    """key, `rare`: the name words that a text holds, out of all of them, looked up in blocks of about `size`."""
    names = checkpoint(name_words(df, column).select("w"))
    blocks = -(-names.count() // size)
    kind = df.schema[key].dataType.simpleString()
    out = None
    for k in range(blocks):
        words = [r["w"] for r in names.filter(F.pmod(F.xxhash64("w"), F.lit(blocks)) == k).toLocalIterator()]
        shared = Shared(df.sparkSession, words, Finder)

        def run(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:  # noqa: ANN001
            finder = shared.get()
            for b in batches:
                rows = [(i, w) for i, t in zip(b[key], b[column], strict=True) if t for w in sorted(finder.met(_clean(t)[0]))]
                if rows:
                    yield pd.DataFrame(rows, columns=[key, "w"])

        part = df.select(key, column).mapInPandas(run, f"{key} {kind}, w string")
        out = part if out is None else out.unionAll(part)
    return out.groupBy(key).agg(F.collect_set("w").alias("rare"))


def fit(df: DataFrame, key: str = "doc_id", column: str = "text") -> tuple[dict[str, int], SpanClassifier]:
    """Gazetteer from all rows, and classifier from the candidates of FIT_DOCS of them."""
    names = gather_names(df, column)
    finder = Finder(names)
    rows = df.filter(F.length(column) > 0)
    every = max(1, rows.count())  # about FIT_DOCS rows, wherever they lie: nothing is sorted or gathered but these
    rows = rows.filter(F.pmod(F.xxhash64(key), F.lit(every)) < FIT_DOCS).select(column).toLocalIterator()
    texts = (_clean(r[0])[0] for r in rows)
    sample = [(kind, votes, shape(t, a, b)) for t in texts for a, b, kind, votes in finder.candidates(t)]
    return names, SpanClassifier(sample)


def _tag(df: DataFrame, key: str, column: str, schema: str, rows: Callable[[Tagger, pd.DataFrame], pd.DataFrame | None]) -> DataFrame:
    """What `rows` makes of the texts, with a tagger that knows all name words that stand in them."""
    names, classifier = fit(df, key, column)
    shared = Shared(df.sparkSession, (names, classifier), lambda x: Tagger(Finder(x[0]), x[1]))
    texts = df.select(key, column)
    if len(names) > GAZETTEER:
        texts = texts.join(rare_names(df, key, column, GAZETTEER), key, "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tagger = shared.get()
        for b in batches:
            if "rare" not in b:
                parts = [rows(tagger, b)]
            else:
                parts = []
                for k, rare in enumerate(b["rare"]):
                    more = [] if rare is None else [w for w in rare if w not in tagger.finder.names_given]
                    parts.append(rows(Tagger(Finder(more, tagger.finder), tagger.classifier) if more else tagger, b.iloc[k : k + 1]))
            yield from (p for p in parts if p is not None)

    return texts.mapInPandas(run, schema)


def spans(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """One row per mention: key, start_char, end_char, pii_type."""

    def rows(tagger: Tagger, b: pd.DataFrame) -> pd.DataFrame | None:
        out = [(k, *x) for k, t in zip(b[key], b[column], strict=True) if t for x in tagger.spans(t)]
        return pd.DataFrame(out, columns=[key, "start_char", "end_char", "pii_type"]) if out else None

    kind = df.schema[key].dataType.simpleString()
    return _tag(df, key, column, f"{key} {kind}, start_char long, end_char long, pii_type string", rows)


def redact(df: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key and the text with placeholders <EMAIL>, <PHONE>, <ID_NUMBER>, <ADDRESS>, <NAME>; null stays null."""

    def rows(tagger: Tagger, b: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({key: b[key], "redacted": [tagger.redact(t) if isinstance(t, str) else None for t in b[column]]})

    kind = df.schema[key].dataType.simpleString()
    return _tag(df, key, column, f"{key} {kind}, redacted string", rows)
