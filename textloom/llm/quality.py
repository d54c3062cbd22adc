"""Text quality statistics per document, and the shape they tell (problem 5).

Every text gets its statistics (words, word length, symbols, lines, shares). Rules that abstain when in doubt
label a part of the texts weakly; gradient-boosted trees (softmax over prose, list, table, junk) are trained on
a bounded sample of these and grade every text. That a text was decoded wrongly is one of the statistics: whoever
reads it, it was written to be read, and the weak labels say so. The scores are calibrated (one temperature, fitted by
gradient descent) on a holdout that was written and checked by hand.

Defined results: a null text has no row; an empty or blank text has zero statistics and the shape prose (there is
nothing that isn't written to be read); repeated rows give equal rows.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from textloom.llm import garbled
from textloom.llm.canonical import transducer
from textloom.llm.worker import Shared, only

SHAPES = ("prose", "list", "table", "junk")
#: Weakly labelled texts of each shape that the trees are trained on (the first by hash of the text).
TRAIN_TEXTS = 1_500
#: Rows, about, (drawn by hash of the text) that are looked at for weak labels.
FIT_ROWS = 40_000
#: Common words are the so many most frequent units of the corpus: a definition, not a bound.
COMMON = 20_000
#: Texts that were decoded wrongly are few: each weighs as much in the training as so many others.
DAMAGED = 5.0
#: Rows of a batch that a worker restores and measures at once.
ROWS = 1_000
ROUNDS, DEPTH, RATE, BINS = 60, 3, 0.25, 48

WORD = re.compile(rf"[{garbled.NO_SPACE}]|[^\W\d_{garbled.NO_SPACE}]+(?:['’‌][^\W\d_]+)*")
BULLET = re.compile(r"\s*(?:[-*•‣▪◦·–—+>]|\[[ xX]?\]|[☐☑✓✗]|\(?(?:\d{1,3}|[A-Za-z]|[ivxIVX]{1,4})[.)])\s+\S")
ENDS = re.compile(r"[.!?…。！？؟۔][\"'”“»’」』）)\]]*\s*$")
TERMINATOR = re.compile(r"[.!?…؟۔](?=[\s\"'”“»’)]|$)|[。！？]")
SEPARATORS = ("\t", "|", ";", ",", "  ")
HEX = re.compile(r"(?:[0-9a-f]{2}){1,8}|(?:[0-9A-F]{2}){1,8}")
PARTS = re.compile(r"[\n,;،、·•|/]+|\s[-–—]\s|\.\s")
VOWEL = re.compile("[aeiouyAEIOUY]")
#: Any character that counts as a digit, raised and circled ones too.
DIGIT = re.compile("[" + "".join(chr(o) for o in range(0x30, 0x20000) if chr(o).isdigit()) + "]")
CELL = re.compile(r"^\s*(?:-|—|n/a|\d[\d.,:%]*|\d+%)\s*$")

NAMES = (
    "n_chars n_words n_lines mean_word_length symbol_ratio digit_ratio upper_ratio common_share lines_ending_share bullet_share lower_start_share "
    "mean_line_length line_length_spread words_per_line terminators_per_word words_per_part parts separator_share columns column_spread cell_share "
    "number_share top_token_share distinct_share letter_share wide_sign_share short_line_share longest_word vowelless_share sentence_char_share url_share wide_share hex_share upper_start_share line_weight part_weight damaged"
).split()


def _separator(lines: list[str]) -> tuple[float, float, float, float]:
    """Of the separator that parts the lines most evenly: share of lines that have it, columns, their spread, share of value cells."""
    best = (0.0, 1.0, 0.0, 0.0)
    if len(lines) < 2:
        return best
    for sep in SEPARATORS:
        rows = [re.split(r"\s{2,}", x.strip()) if sep == "  " else x.strip().strip("|").split(sep) for x in lines]
        counts = Counter(len(r) for r in rows)
        n, hits = max(((c, k) for c, k in counts.items() if c > 1), key=lambda x: (x[1], x[0]), default=(1, 0))
        share = hits / len(lines)
        if n > 1 and share > best[0]:
            cells = [c for r in rows if len(r) == n for c in r[1:]]
            spread = float(np.std([len(r) for r in rows]))
            best = (share, float(n), spread, sum(bool(CELL.match(c)) for c in cells) / max(1, len(cells)))
    return best


def _hex_share(tokens: list[str]) -> float:
    """Share of the tokens that are bytes in hexadecimal; numbers alone, without a single letter among them, are none."""
    found = [t for t in tokens if HEX.fullmatch(t)]
    lettered = sum(not t.isdigit() for t in found)
    return len(found) / max(1, len(tokens)) if 5 * lettered > len(found) else 0.0


def statistics(text: str, common: frozenset[str] | set[str], damaged: bool = False) -> list[float]:
    """The statistics of NAMES; `damaged`: the text was decoded wrongly (and is given as it was restored)."""
    n = len(text)
    lines = [x for x in text.split("\n") if x.strip()]
    words = WORD.findall(text)
    tokens = text.split()
    solid = max(1, sum(map(len, tokens)))
    nw, nl = len(words), max(1, len(lines))
    letters = sum(map(len, words))
    kinds = Counter(text)  # each different character is looked at once
    digits = sum(k for c, k in kinds.items() if c.isdigit())
    lengths = [len(x) for x in lines] or [0]
    us = garbled.units(text)
    known = sum(u in common for u in us)
    terms = len(TERMINATOR.findall(text))
    parts = [p for p in PARTS.split(text) if p.strip()]
    sep, columns, spread, cells = _separator(lines)
    top = Counter(tokens).most_common(1)[0][1] if tokens else 1
    sentence_chars = sum(len(x) for x in lines if ENDS.search(x) and not BULLET.match(x) and len(x) > 20)
    wide = 0.0 if text.isascii() else sum(w >= "ᄀ" and garbled.IDEOGRAPH.match(w) is not None for w in words) / max(1, nw)
    asc = words if text.isascii() else [w for w in words if w.isascii()]
    return [
        float(n),
        float(nw),
        float(len(lines)),
        letters / max(1, nw),
        sum(k for c, k in kinds.items() if not c.isalnum() and not c.isspace()) / solid,
        digits / solid,
        sum(k for c, k in kinds.items() if c.isupper()) / max(1, letters),
        known / max(1, len(us)),
        sum(bool(ENDS.search(x)) for x in lines) / nl,
        sum(bool(BULLET.match(x)) for x in lines) / nl,
        sum(x.lstrip()[:1].islower() for x in lines) / nl,
        sum(lengths) / nl,
        float(np.std(lengths)),
        nw / nl,
        terms / max(1, nw),
        nw / max(1, len(parts)),
        float(len(parts)),
        sep,
        columns,
        spread,
        cells,
        sum(not t.isalpha() and DIGIT.search(t) is not None for t in tokens) / max(1, len(tokens)),
        (top - 1) / max(1, len(tokens) - 1),
        len(set(tokens)) / max(1, len(tokens)),
        letters / solid,
        sum(k for c, k in kinds.items() if "\u2190" <= c < "\u2c00") / solid,
        sum(len(x) < 40 for x in lines) / nl,
        float(max(map(len, tokens), default=0)),
        sum(VOWEL.search(w) is None for w in asc) / max(1, nw),
        sentence_chars / max(1, sum(lengths)),
        sum("://" in t for t in tokens) / max(1, len(tokens)),
        wide,
        _hex_share(tokens),
        sum(x.lstrip("-–—•*¿¡“\"«„ ")[:1].isupper() for x in lines) / nl,
        nw / nl * (1 - 0.6 * wide),  # a word of a script without spaces counts two characters or so
        nw / max(1, len(parts)) * (1 - 0.6 * wide),
        float(damaged),
    ]


AT = {name: k for k, name in enumerate(NAMES)}


def weak_label(x: list[float]) -> int:
    """Index in SHAPES, or -1 in doubt."""
    label = _rules(x)
    return SHAPES.index("prose") if label == SHAPES.index("junk") and x[AT["damaged"]] else label


def _rules(x: list[float]) -> int:
    v = {name: x[k] for name, k in AT.items()}
    prose, items, table, junk = range(4)
    words, known, lines, digits = v["n_words"], v["common_share"], v["n_lines"], v["digit_ratio"]
    if words < 3:
        return junk if v["n_chars"] >= 30 and v["cell_share"] < 0.5 else -1
    if v["url_share"] > 0.5 or v["hex_share"] > 0.7 or v["wide_sign_share"] > 0.3 or v["top_token_share"] > 0.8 and words > 8 or v["distinct_share"] < 0.15 and words > 12 and digits < 0.1:
        return junk
    if v["letter_share"] < 0.25 and v["cell_share"] < 0.3 or known < 0.15 and v["wide_share"] < 0.5 and v["letter_share"] < 0.95 and v["bullet_share"] < 0.5 and words > 8:
        return junk
    if v["vowelless_share"] > 0.12 and known < 0.3 and v["terminators_per_word"] < 0.02 and digits < 0.1:
        return junk
    if lines >= 3 and v["separator_share"] > 0.9 and v["cell_share"] > 0.5 and v["columns"] >= 2:
        return table
    per_line, per_part = v["line_weight"], v["part_weight"]
    cased = v["upper_ratio"] > 0 or v["lower_start_share"] > 0
    if known > 0.4 and digits < 0.15 and v["terminators_per_word"] < 0.02:
        if lines >= 4 and v["bullet_share"] > 0.75 and v["lines_ending_share"] < 0.3 and per_line < 8:
            return items
        if lines >= 4 and v["lower_start_share"] > 0.6 and v["short_line_share"] > 0.85 and v["lines_ending_share"] < 0.3 and v["bullet_share"] < 0.1:
            return items
        if lines >= 4 and not cased and v["lines_ending_share"] < 0.3 and per_line < 4.6 and v["bullet_share"] < 0.1:
            return items
        if lines <= 2 and v["parts"] >= 5 and per_part < 5 and (v["lower_start_share"] > 0.9 or not cased) and v["lines_ending_share"] < 0.5:
            return items
    if known > 0.4 and digits < 0.08:
        if v["bullet_share"] < 0.5 and v["sentence_char_share"] > 0.8 and v["terminators_per_word"] > 0.008:
            return prose
        if v["bullet_share"] < 0.5 and v["terminators_per_word"] > 0.02 and v["mean_line_length"] > 45:
            return prose
        if v["bullet_share"] > 0.5 and v["lines_ending_share"] > 0.8 and per_line > 3:
            return prose  # dialogue
        if v["bullet_share"] < 0.2 and lines >= 3 and v["separator_share"] < 0.6 and per_line >= (3.0 if v["upper_start_share"] > 0.9 else 6.5):
            return prose  # verse: lines that are sentences
    return -1


class Trees:
    """Softmax gradient boosting with histogram trees."""

    def __init__(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> None:
        k = len(SHAPES)
        self.trees: list[list[list[tuple]]] = []
        self.temperature = 1.0
        if not len(y):  # nothing to learn from: all is prose
            self.cuts, self.base = [np.zeros(0) for _ in NAMES], np.log(np.array([0.97, 0.01, 0.01, 0.01]))
            return
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        prior = np.array([weight[y == c].sum() for c in range(k)]) + 1.0
        self.base = np.log(prior / prior.sum())
        score = np.tile(self.base, (len(y), 1))
        target = np.eye(k)[y]
        for _ in range(ROUNDS):
            p = _softmax(score)
            grown = []
            for c in range(k):
                g, h = weight * (target[:, c] - p[:, c]), weight * p[:, c] * (1 - p[:, c]) + 1e-6
                tree = self._grow(binned, g, h, np.arange(len(y)), 0)
                grown.append(tree)
                score[:, c] += RATE * self._apply(tree, binned)
            self.trees.append(grown)

    def _grow(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int) -> tuple:
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = ("leaf", float(gs / (hs + 1.0)))
        if depth == DEPTH or len(rows) < 20:
            return leaf
        best = (1e-3, -1, -1)
        for j in range(b.shape[1]):
            n = len(self.cuts[j]) + 1
            if n < 2:
                continue
            col = b[rows, j]
            gl = np.cumsum(np.bincount(col, g[rows], n))[:-1]
            hl = np.cumsum(np.bincount(col, h[rows], n))[:-1]
            gain = gl**2 / (hl + 1.0) + (gs - gl) ** 2 / (hs - hl + 1.0) - gs**2 / (hs + 1.0)
            gain[(hl < 0.5) | (hs - hl < 0.5)] = -1.0
            at = int(gain.argmax()) if len(gain) else 0
            if len(gain) and gain[at] > best[0]:
                best = (float(gain[at]), j, at)
        _, j, at = best
        if j < 0:
            return leaf
        left = b[rows, j] <= at
        return ("node", j, at, self._grow(b, g, h, rows[left], depth + 1), self._grow(b, g, h, rows[~left], depth + 1))

    def _apply(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        if tree[0] == "leaf":
            return np.full(len(b), tree[1])
        left = b[:, tree[1]] <= tree[2]
        return np.where(left, self._apply(tree[3], b), self._apply(tree[4], b))

    def raw(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(self.cuts)], 1)
        score = np.tile(self.base, (len(x), 1))
        for grown in self.trees:
            for c, tree in enumerate(grown):
                score[:, c] += RATE * self._apply(tree, b)
        return score

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return _softmax(self.raw(x) / self.temperature)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> None:
        """The temperature under which the holdout is likeliest, by gradient descent with a small ridge.

        It is the only number fitted: the shapes' shares in the holdout aren't those of a corpus, so offsets would be wrong there.
        """
        raw, target = self.raw(x), np.eye(len(SHAPES))[y]
        inverse = 1.0
        for step in range(400):
            g = (_softmax(raw * inverse) - target) / len(y)
            inverse = min(5.0, max(0.1, inverse - 0.05 / (1 + step / 100) * float((g * raw).sum() + 0.05 * (inverse - 1.0))))
        self.temperature = 1.0 / inverse


def _softmax(s: np.ndarray) -> np.ndarray:
    p = np.exp(s - s.max(1, keepdims=True))
    return p / p.sum(1, keepdims=True)


#: Holdout, written and checked by hand: (shape, text).
HOLDOUT = [
    ("prose", "The ferry left at dawn. Nobody on the pier waved, and the clerk shut his book."),
    ("prose", "We walked home in the rain\nShe sang an old song to the dog\nThe lamp in the hall was still burning\nNobody asked where we had been"),
    ("prose", "– Did you see the letter?\n– I did not open it.\n– Then who did?\n– Ask the porter."),
    ("prose", "THE COUNCIL MET TWICE LAST WEEK. IT DID NOT AGREE ON ANYTHING."),
    ("prose", "Der Bote kam zu spät. Niemand hatte den Brief gelesen, und das Tor war zu."),
    ("prose", "Le courrier arriva tard. On demanda au gardien :\n\n- la clé du quai\n- le registre\n\nIl ne répondit pas, car personne ne l'avait prévenu."),
    ("prose", "The committee has decided that the harbour\nshould remain closed until the inquiry has\nheard every witness who asked to speak. No\nfurther notice will be given."),
    ("prose", "没有人知道信是谁写的。委员会决定等到明天再讨论。"),
    ("prose", "昨日、議長は書簡を受け取った。返事はまだない。"),
    ("prose", "Никто не ответил. Совет решил ждать до утра, хотя времени почти не осталось."),
    ("prose", "It was late."),
    ("list", "- the old mill\n- a brass key\n- two maps\n- the harbour gate\n- a letter"),
    ("list", "1. behind the church\n2. the night train\n3. under the stairs\n4. a red coat"),
    ("list", "the old mill\na brass key\nunder the stairs\nthe harbour gate\ntwo maps\nlast week"),
    ("list", "a brass key, two maps, the harbour gate, under the stairs, the night train, a red coat, behind the church"),
    ("list", "[ ] bread\n[x] lamp oil\n[ ] rope\n[x] tins\n[ ] matches"),
    ("list", "旧磨坊\n两张地图\n港口大门\n夜班火车\n红色外套"),
    ("list", "• старая мельница\n• две карты\n• ночной поезд\n• красное пальто\n• ворота порта"),
    ("table", "item\tcount\tshare\nrope\t14\t12%\ntins\t220\t41%\nmaps\t7\t-"),
    ("table", "| place | hour | fee |\n| --- | --- | --- |\n| mill | 10:30 | 4.50 |\n| quay | 11:15 | - |\n| gate | 12:00 | 3.20 |"),
    ("table", "the mill;12.40;88\nthe quay;7.15;-\nthe gate;19:30;41"),
    ("table", "the mill        12.40     88\nthe quay         7.15      -\nthe gate        19:30     41"),
    ("junk", "asdkf jhlkwe rtkjh; sdkfj wkjrht lskdjf; wwekrj hsdf kjwer ;lskdf kjhs"),
    ("junk", "!!! !!! !!! !!! !!! !!! !!! !!! !!! !!! !!! !!!"),
    ("junk", "QmFzZTY0IGlzIG5vdCBwcm9zZSBhdCBhbGwsIGl0IGlzIGp1c3QgYnl0ZXMgaW4gYW5vdGhlciBkcmVzcw=="),
    ("junk", "http://a1.invalid/x?id=1 http://b2.invalid/y?id=2 http://c3.invalid/z?id=3 http://d4.invalid/q?id=4"),
    ("junk", "00000000  4a ce 68 01 55 b1 77 c8 04 da 3b 6d\n00000010  da 1a 9e 31 d7 a0 4b b0 c0 ba b4 1d"),
    ("prose", "Dear Mrs Hale,\n\nthank you for the lamp. It came on Friday and has not been out of use since.\n\nYours,\nT. Brook"),
    ("prose", "Three things are needed:\n- rope\n- bread\n- a lamp\nWithout them nobody should go down, said the guide, and he meant it."),
    ("prose", "Le conseil n'a pas répondu. Les lettres restaient sur la table, et personne n'osait les ouvrir avant le soir."),
    ("prose", "El barco salió de noche. Nadie en el muelle dijo nada, aunque todos habían oído la noticia."),
    ("prose", "Der Fluss steigt\nund keiner geht ans Tor\ndie Lampe brennt noch\nwo die Kinder schliefen"),
    ("prose", "لم يصل الرسول إلا في المساء. لم يسأله أحد عن الرسالة، وكان الباب مغلقا."),
    ("prose", "قایق سپیده دم رفت. کسی در اسکله دست تکان نداد و دفتردار کتابش را بست."),
    ("prose", "배는 새벽에 떠났다. 부두에 있던 사람은 아무도 손을 흔들지 않았다."),
    ("prose", "「手紙を読みましたか。」\n「まだ開けていません。」\n「では、誰が開けたのですか。」"),
    ("prose", "— Ты видел письмо?\n— Нет, не видел.\n— Тогда кто его взял?"),
    ("prose", "In 1921 the mill burned for 3 days; 14 men were hurt, and the loss was put at 2,400 crowns. It was never rebuilt."),
    ("prose", "wir kamen spät an. das tor war zu. niemand öffnete, obwohl wir lange klopften."),
    ("list", "Milch\nBrot\nKerzen\nSeil\nSalz\nZucker"),
    ("list", "1) la clé du quai\n2) le vieux moulin\n3) deux cartes\n4) le train de nuit"),
    ("list", "el molino viejo; dos mapas; la puerta del puerto; el tren nocturno; un abrigo rojo; la llave"),
    ("list", "- مفتاح الميناء\n- خريطتان\n- القطار الليلي\n- معطف أحمر"),
    ("list", "* کلید بندر\n* دو نقشه\n* قطار شب\n* کت قرمز"),
    ("list", "・古い水車\n・二枚の地図\n・港の門\n・夜行列車\n・赤い上着"),
    ("list", "낡은 방앗간\n지도 두 장\n항구의 문\n야간열차\n빨간 외투"),
    ("list", "– the blue door\n– a pair of boots\n– the ferry clock\n– salt\n– the ledger"),
    ("list", "a. the quay\nb. the mill\nc. the gate\nd. the bridge\ne. the tower"),
    ("table", "Ort,Stunde,Betrag\nMühle,10:30,4.50\nKai,11:15,-\nTor,12:00,3.20"),
    ("table", "место\tчас\tсумма\nмельница\t10:30\t450\nпричал\t11:15\t-\nворота\t12:00\t320"),
    ("table", "项目\t数量\t比例\n绳子\t14\t12%\n罐头\t220\t41%\n地图\t7\t-"),
    ("table", "lieu | heure | prix\nmoulin | 10:30 | 4,50\nquai | 11:15 | -\nporte | 12:00 | 3,20"),
    ("table", "rope   14   12%   ok\ntins   220  41%   ok\nmaps   7    -     -"),
    ("table", "2031-04-01;12;88.5\n2031-04-02;14;87.1\n2031-04-03;9;90.0\n2031-04-04;11;-"),
    ("junk", "zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz zzzz"),
    ("junk", "x9$k2 !!pq0 ##zt7 v%%8r q@1w2 ~~m3 8^kk2 &&y7 p*4t n))3"),
    ("junk", "aGVsbG8gd29ybGQgYW5kIG1vcmUgYnl0ZXMgdGhhdCBzYXkgbm90aGluZw== c29tZSBtb3JlIGJ5dGVzIGhlcmU="),
    ("junk", "ff d8 ff e0 00 10 4a 46 49 46 00 01 01 01 00 48 00 48 00 00 ff db"),
    ("junk", "████▓▓▒▒░░ ░░▒▒▓▓████ ▓▓▒▒░░ ████"),
    ("junk", "test test test test test test test test test test test test test test"),
    ("junk", "qwfpgj luyzxc vbkmnh rstdgh qwfpgj zxcvbk luymnh trsdfg pgjqwf"),
    ("junk", "=+=_~~_~--==#_~=~-:#*:--*==~\n~*:~~--~*=**~-++##:~_.__--~"),
    ("junk", "╻ ╍☆ ◕┒ ◬◖◍☠╨┹ ◐┠ ▍┝╤└ ▛├ ┓◴▲ ▋│╕▀◝ ┢┘☈"),
]


def train(sample: list[tuple[list[float], int]], common: set[str]) -> Trees:
    """Trees from weakly labelled statistics; the holdout's own rows stay out of the training."""
    x = np.array([s for s, _ in sample], dtype=float).reshape(-1, len(NAMES))
    y = np.array([v for _, v in sample], dtype=int)
    n = np.bincount(y, minlength=len(SHAPES))
    weight = (len(y) / len(SHAPES) / np.maximum(1, n))[y] ** 0.5 if len(y) else np.zeros(0)
    if len(y):
        weight = weight * np.where(x[:, AT["damaged"]] > 0, DAMAGED, 1.0)
    model = Trees(x, y, weight)
    hold = np.array([statistics(t, common) for _, t in HOLDOUT])
    model.calibrate(hold, np.array([SHAPES.index(s) for s, _ in HOLDOUT]))
    return model


def _repair(model: garbled.Model, text: str, rare: object) -> tuple[bool, str]:
    damaged, text = garbled.model_for(model, rare).restore(text)
    return damaged, transducer().canonical(text)


def _parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The batches, a few rows at once: restored texts and statistics of a whole batch would take several times its memory."""
    for b in batches:
        for k in range(0, len(b), ROWS):
            yield b.iloc[k : k + ROWS]


COLUMNS = ", ".join(f"{name} double" for name in NAMES)


def shapes(df: DataFrame, key: str = "request_id", column: str = "text") -> DataFrame:
    """key, the statistics of NAMES, text_shape and its calibrated probability, of each row with a text.

    Wrongly decoded text is restored and disguised characters are brought to their canonical form first, so that
    they don't count as signs.
    """
    spark = df.sparkSession
    rows = df.select(key, column).filter(F.col(column).isNotNull())
    kind = df.schema[key].dataType.simpleString()
    every = max(1, rows.count())
    rows, counts = garbled.shared_model(rows, key, column)
    common = frozenset(sorted(counts, key=lambda u: (-counts[u], u))[:COMMON])
    models, words = counts.models(spark), Shared(spark, common, lambda x: x)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known = only(models, words)
        for b in _parts(batches):
            repaired = (_repair(model, x, rare) for x, rare in zip(b[column], b["rare"], strict=True))
            stats = [statistics(x, known, damaged) for damaged, x in repaired]
            yield pd.DataFrame({"h": b["h"].to_numpy(), "stats": stats, "label": [weak_label(s) for s in stats]})

    drawn = rows.select(F.xxhash64(column).alias("h"), column, "rare").filter(F.pmod("h", F.lit(every)) < FIT_ROWS).dropDuplicates(["h"])
    weak = drawn.mapInPandas(measure, "h long, stats array<double>, label int").filter("label >= 0")
    rank = F.row_number().over(W.partitionBy("label").orderBy("h", "stats"))
    sample = weak.withColumn("n", rank).filter(F.col("n") <= TRAIN_TEXTS).orderBy("label", "n").collect()
    trees = Shared(spark, train([(list(r["stats"]), r["label"]) for r in sample], common), lambda x: x)

    def grade(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model, known, forest = only(models, words, trees)
        for b in _parts(batches):
            repaired = (_repair(model, x, rare) for x, rare in zip(b[column], b["rare"], strict=True))
            x = np.array([statistics(s, known, damaged) for damaged, s in repaired], dtype=float)
            p = forest.probabilities(x)
            p[x[:, AT["n_chars"]] == 0] = np.eye(len(SHAPES))[0]
            out = pd.DataFrame(x, columns=NAMES)
            out.insert(0, key, b[key].to_numpy())
            out["text_shape"] = [SHAPES[k] for k in p.argmax(1)]
            out["probability"] = p.max(1)
            yield out

    return rows.mapInPandas(grade, f"{key} {kind}, {COLUMNS}, text_shape string, probability double")
