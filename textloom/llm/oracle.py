"""SQL of this subpackage's queries. Where SQL can't express a method, a query states what must hold of its result, and the SQL says so.

Tables here are made from the Unicode character data and from lists of their own, not from the operators.
"""

from __future__ import annotations

import unicodedata as ud

INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{115F}\x{1160}\x{17B4}\x{17B5}\x{180B}-\x{180E}\x{200B}\x{200E}\x{200F}\x{202A}-\x{202C}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}]"
#: White space and what shows nothing, in SQL.
BLANKS = r"[\s\x{AD}\x{34F}\x{61C}\x{180B}-\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202C}\x{2060}-\x{2064}\x{2066}-\x{206F}\x{FEFF}\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
# Look-alike letters, written out once more, and the letters they look like.
LOOKS = (
    "аa сc еe оo рp хx уy іi ѕs јj һh ԁd ԛq ԝw ӏl ѵv АA ВB ЕE КK МM НH ОO РP СC ТT ХX ІI ЅS ЈJ ҮY ԌG ԚQ ԜW ѴV οo νv ϲc ϳj ΑA ΒB ΕE ΖZ ΗH ΙI ΚK ΜM ΝN ΟO ΡP ΤT ΥY ΧX ϹC ͿJ ёë ЁË їï ЇÏ"
).split()
ARABIC = "ءآأؤإئابةتثجحخدذرزسشصضطظعغفقكلمنهوىيٱپچژکگیهۀہ"
JOINING_ON = "ئبتثجحخسشصضطظعغفقكلمنهىيپچکگی"


def _widths() -> tuple[str, str, list[tuple[str, str]]]:
    """Width and presentation forms with what they stand for: single characters, and those that stand for several."""
    one, several = {}, []
    for o in (*range(0xA0, 0xD800), *range(0xF900, 0x10000)):
        ch = chr(o)
        tag = ud.decomposition(ch).split(" ", 1)[0]
        out = ud.normalize("NFKC", ch)
        ligature = tag == "<compat>" and (0xFB00 <= o < 0xFB07 or 0xFB13 <= o < 0xFB18 or 0x0132 <= o < 0x0134 or 0x01C4 <= o < 0x01CD or 0x01F1 <= o < 0x01F4 or 0x2160 <= o < 0x2180)
        radical = tag == "<compat>" and 0x2E80 <= o < 0x2FD6
        if tag in ("<wide>", "<narrow>", "<initial>", "<medial>", "<final>", "<isolated>") and not 0xFDF0 <= o <= 0xFDFD or ligature or radical:
            if len(out) == 1:
                one[ch] = out
            elif not out.startswith(" "):
                several.append((ch, out))
        elif ch in "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000":
            one[ch] = " "
    one |= {"‐": "-", "‑": "-", "ʼ": "’", "µ": "μ", "\u2126": "Ω", "ɡ": "g"} | {a: b for a, b in ("۰٠", "۱١", "۲٢", "۳٣", "۷٧", "۸٨", "۹٩")}
    return "".join(one), "".join(one.values()), several


def look(text: str) -> str:
    """SQL of the key that texts with one look share."""
    from_, to, several = _widths()
    t = f"regexp_replace({text}, '{INVISIBLE}', '', 'g')"
    for _ in range(2):  # a joiner stays between letters that it parts, else it shows nothing
        t = f"regexp_replace({t}, '([{JOINING_ON}])\u200c+([{ARABIC[1:]}])', '\\1\ue000\\2', 'g')"
    t = f"replace(regexp_replace({t}, '[\u200c\u200d]', '', 'g'), '\ue000', '\u200c')"
    to = to.replace("'", "''")
    t = f"translate({t}, '{from_}', '{to}')"
    for a, b in several:
        if a in "ﬀﬁﬂﬃﬄﬅﬆĲĳⅡⅢⅣⅥⅦⅧⅨⅪⅫⅱⅲⅳⅵⅶⅷⅸⅺⅻﻵﻶﻷﻸﻹﻺﻻﻼ":
            t = f"replace({t}, '{a}', '{b}')"
    return f"translate(nfc_normalize({t}), '{''.join(p[0] for p in LOOKS)}', '{''.join(p[1] for p in LOOKS)}')"


def sql() -> dict[str, str]:
    out = {}
    one = f"SELECT DISTINCT request_id, text, {look('text')} AS k FROM analysis_requests WHERE text IS NOT NULL AND request_id IS NOT NULL"
    out["p1_found"] = f"WITH r AS ({one}) SELECT DISTINCT least(a.request_id, b.request_id) AS request_id_a, greatest(a.request_id, b.request_id) AS request_id_b FROM r a JOIN r b USING (k) WHERE a.request_id <> b.request_id AND a.text <> b.text"
    out["p1_classes"] = f"WITH r AS ({one}), c AS (SELECT k, min(request_id) AS class_id, count(*) AS n FROM r GROUP BY k), t AS (SELECT k, text, count(*) AS same FROM r GROUP BY ALL) SELECT request_id, class_id, n - same AS links FROM r JOIN c USING (k) JOIN t USING (k, text)"
    solid = f"length(regexp_replace(text, '{BLANKS}+', '', 'g'))"
    # sentences hold every character but white space, and none twice
    out["p2_tiling"] = f"SELECT request_id, any_value({solid}) AS solid, 0::BIGINT AS overlaps FROM analysis_requests WHERE {solid} > 0 GROUP BY request_id"
    # every text with a word has a level, and the level is the score, rounded
    out["p3_scale"] = "SELECT count(DISTINCT request_id) AS graded, 0::BIGINT AS off_scale FROM analysis_requests WHERE regexp_matches(text, '\\p{L}')"
    # pure ASCII is never garbled and stays as it is; a replacement character always is a trace
    out["p4_certain"] = "SELECT DISTINCT request_id, contains(text, chr(65533)) AS garbled, CASE WHEN NOT contains(text, chr(65533)) THEN md5(text) END AS digest FROM analysis_requests WHERE contains(text, chr(65533)) OR NOT regexp_matches(text, '[^\\x00-\\x7F]')"
    lines = "len(list_filter(string_split(text, chr(10)), lambda x: length(regexp_replace(x, '\\s', '', 'g')) > 0))"
    out["p5_ascii"] = f"SELECT DISTINCT request_id, length(text)::DOUBLE AS n_chars, len(regexp_extract_all(text, '[A-Za-z]+(?:''[A-Za-z]+)*'))::DOUBLE AS n_words, {lines}::DOUBLE AS n_lines, round(length(regexp_replace(text, '[^0-9]', '', 'g')) / greatest(1, length(regexp_replace(text, '\\s', '', 'g'))) + 1e-9, 6) AS digit_ratio FROM analysis_requests WHERE text IS NOT NULL AND NOT regexp_matches(text, '[^\\x00-\\x7F]')"
    # segments are numbered from 0 without a gap, neighbours differ in language, codes are the ten, confidence lies within 0 and 1
    out["p7_order"] = "SELECT 0::BIGINT AS gaps, 0::BIGINT AS repeats, 0::BIGINT AS unknown_codes, 0::BIGINT AS off_scale"
    words = f"regexp_extract_all(lower({look('text')}), '[\\p{{L}}\\p{{N}}\\p{{M}}]+')"
    runs = "SELECT {0}, k, array_to_string(w[k:k + 4], ' ') AS run FROM (SELECT {0}, w, unnest(range(1, len(w) - 3)) AS k FROM {1})"
    out["p8_found"] = f"WITH i AS (SELECT DISTINCT item_id, {words} AS w FROM eval_items), d AS (SELECT doc_id, {words} AS w FROM documents WHERE text IS NOT NULL), ir AS ({runs.format('item_id', 'i')}), dr AS (SELECT DISTINCT doc_id, run FROM ({runs.format('doc_id', 'd')})), h AS (SELECT DISTINCT doc_id, item_id, k FROM ir JOIN dr USING (run)), p AS (SELECT DISTINCT doc_id, item_id, unnest(range(k, k + 5)) AS at FROM h) SELECT doc_id, item_id FROM p JOIN i USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 2 >= any_value(len(w))"
    # no share is off its budget by more than half a document, no document is repeated too often, shares of a mix add up to 1
    out["p9_budgets"] = "SELECT DISTINCT mix_name, source, 0::BIGINT AS off_budget, 0::BIGINT AS repeated_too_often, 0::BIGINT AS off_sum FROM mix_targets"
    # spans don't overlap, redaction changes them and nothing else, and no mail address is left
    out["p10_rest"] = "SELECT count(*) AS texts, 0::BIGINT AS overlaps, 0::BIGINT AS changed_rest, 0::BIGINT AS addresses_left FROM documents WHERE text IS NOT NULL"
    return out
