"""The core queries in DuckDB's SQL, written from the operators' definitions."""

from __future__ import annotations

from textloom import oracle_values as v

HEADING = r"(?:chapter|section|part|prologue|epilogue|\d+\.)\s+"
WIN = rf"""
p AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '([^\n])(\n\n+)', '\1' || chr(1) || '\2' || chr(1), 'g'),
      '(?i)([^\n' || chr(1) || ']\n)({HEADING})', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents WHERE length(text) > 0),
q AS (SELECT doc_id, unnest(parts) AS seg_text, generate_subscripts(parts, 1) - 1 AS seg FROM p),
s AS (SELECT *, CAST(coalesce(sum(length(seg_text)) OVER (PARTITION BY doc_id ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offs,
      seg = max(seg) OVER (PARTITION BY doc_id) AS eof FROM q),
g AS (SELECT * FROM s WHERE length(regexp_replace(seg_text, '\s', '', 'g')) > 0),
i AS (SELECT *, unnest(range(0, CAST(greatest(0, ceil((length(seg_text) - 1000) / 500.0)) AS BIGINT) + 1)) AS i FROM g),
w AS (SELECT doc_id, seg, i, offs + i * 500 AS start_char, substring(seg_text, i * 500 + 1, 1000) AS text, CASE WHEN i = 0 AND NOT eof THEN 'structural_boundary' ELSE 'stride' END AS reset_reason FROM i),
win AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY seg, i) - 1 AS win_idx, start_char, start_char + length(text) AS end_char, reset_reason, text
        FROM w WHERE length(regexp_replace(text, '\s', '', 'g')) > 0)"""
ZERO = "chr(8203) || chr(8204) || chr(8205) || chr(8288) || chr(65279)"
#: Words of the texts, and sentences: marks replace the look-behind that the engine lacks.
TOK = r"t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents WHERE text IS NOT NULL), tok AS (SELECT * FROM t WHERE len(w) > 0)"
SENT = r"""ss AS (SELECT doc_id, text, list_filter(list_transform(string_split(regexp_replace(text, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 0) AS l
 FROM documents WHERE text IS NOT NULL),
sent AS (SELECT doc_id, unnest(l) AS s, generate_subscripts(l, 1) - 1 AS sent FROM ss),
sw AS (SELECT doc_id, sent, s, regexp_extract_all(lower(s), '\p{L}+') AS w FROM sent)"""


def quoted(words: list[str] | tuple[str, ...]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


def letter_scores(arabic: str) -> dict[str, str]:
    """Word scores, one row for each letter, and what windows make of them."""

    def scores(source: str, language: str, text: str, weights: dict, doubles: dict, pairs: dict, marks: str, silent: str = "") -> str:
        """CTEs: uses (key..., word, uses), scored (word, score) of a source with `text`."""

        def case(letter: str, table: dict, other: str) -> str:
            return f"CASE {letter} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in table.items()) + f" ELSE {other} END"

        def acts(other: str) -> str:
            return "CASE " + " ".join(f"WHEN c || {other} IN ('{p}', '{p[::-1]}') THEN {f}" for p, f in pairs.items()) + " END"

        def half(other: str, reach: float) -> str:
            return f"({case('c', weights, '0')} + {case(other, weights, '0')}) * {acts(other)} * {reach} / 2"

        last = f"CASE WHEN c IN ({quoted(tuple(silent))}) THEN 0.0 ELSE 0.75 END" if silent else "0.75"
        return f"""u AS (SELECT * EXCLUDE (text), unnest(regexp_extract_all({text}, '[{''.join(weights)}]+')) AS word FROM {source}),
dw AS (SELECT DISTINCT word, regexp_replace(word, '{"|".join(x * 2 for x in weights)}', '12', 'g') AS d FROM u),
lk AS (SELECT word, d, '  ' || word || '  ' AS p, unnest(range(1, length(word) + 1)) AS k FROM dw),
lt AS (SELECT word, k, substring(p, k + 2, 1) AS c, substring(d, k, 1) AS f, substring(p, k, 1) AS a, substring(p, k + 1, 1) AS b, substring(p, k + 3, 1) AS e, substring(p, k + 4, 1) AS g FROM lk),
scored AS (SELECT word, sum(CASE WHEN f IN ('1', '2') THEN {case('c', weights, '0')} * {case('c', doubles, '1.0')} / 2
 ELSE coalesce({half('a', 0.5)}, {half('b', 1.0)}, {half('e', 1.0)}, {half('g', 0.5)}, {case('c', weights, '0')} * CASE WHEN k = 1 THEN 1.5 WHEN k = length(word) THEN {last} ELSE 1.0 END) END)
 * CASE WHEN regexp_matches(word, '[{marks}]') THEN 1.2 ELSE 1.0 END AS score FROM lt GROUP BY word)"""

    def window(by: str, marks: str) -> str:
        return f"ws AS (SELECT {by}, round(sum(score) + 1e-9, 4) AS raw_score, CAST(sum(length(word)) AS BIGINT) AS total_chars, CAST(sum(CASE WHEN regexp_matches(word, '[{marks}]') THEN 1 ELSE 0 END) AS BIGINT) AS words_with_visual, sum(score) AS raw FROM u JOIN scored USING (word) GROUP BY {by})"

    def shares(by: str, weights: dict, axes: dict) -> str:
        w = "CASE l " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in weights.items()) + " END"
        parts = ", ".join(f"100.0 * sum(CASE WHEN l IN ({quoted(tuple(of))}) THEN {w} ELSE 0 END) / sum({w}) AS {name}" for name, of in axes.items())
        return f"ll AS (SELECT {by}, unnest(string_split(word, '')) AS l FROM u), sh AS (SELECT {by}, {parts} FROM ll GROUP BY {by})"

    def vectors(source: str, by: str, language: str, text: str, agitation: str = "agitation", anxiety: str = "anxiety", more: str = "") -> str:
        w, d, p = tables[language]
        m, ax = v.MARKS.get(language, v.MARKS["AR" if language == "FA" else "EN"]), v.AXES.get(language, v.AXES["AR" if language == "FA" else "EN"])
        return f"""{scores(source, language, text, w, d, p, m, "STXD" if language == "FR" else "")}, {window(by, m)}, {shares(by, w, ax)}{more}
SELECT {by}, round(raw_score / greatest(1, total_chars) + 1e-9, 4) AS intensity, round({anxiety} + 1e-9, 6) AS anxiety, round(attention + 1e-9, 6) AS attention, round(emotion + 1e-9, 6) AS emotion, round({agitation} + 1e-9, 6) AS agitation, words_with_visual::DOUBLE AS complexity FROM ws JOIN sh USING ({by})"""

    def documents(language: str) -> str:
        return f"WITH s AS (SELECT doc_id, text FROM documents WHERE lower(lang) = '{language}' AND text IS NOT NULL), "

    tables = {
        "EN": (v.EN_WEIGHTS, v.EN_DOUBLES, v.EN_PAIRS), "ES": (v.EN_WEIGHTS, v.EN_DOUBLES | {"R": 2.0, "L": 1.5}, v.EN_PAIRS), "FR": (v.EN_WEIGHTS, v.EN_DOUBLES, v.EN_PAIRS),
        "RU": (v.RU_WEIGHTS, v.RU_DOUBLES, v.RU_PAIRS), "AR": (v.AR_WEIGHTS, v.AR_DOUBLES, v.AR_PAIRS), "FA": (v.AR_WEIGHTS | v.FA_MORE, v.AR_DOUBLES | v.FA_DOUBLES, v.AR_PAIRS),
    }
    upper, bare = "upper(replace(text, 'ß', 'ss'))", arabic.replace("(text,", r"(regexp_replace(text, '[\x{064B}-\x{065F}\x{0640}]', '', 'g'),")
    folded = "replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss')"
    w, d, p = tables["EN"]
    whole = scores("src", "EN", upper, w, d, p, v.MARKS["EN"])
    win = f"WITH {WIN}, src AS (SELECT doc_id, win_idx, text FROM win), "
    by = "doc_id, win_idx"
    rr = ", rr AS (SELECT doc_id, sum(len(regexp_extract_all(word, 'RR'))) * 14.0 / greatest(1.0, any_value(raw)) * 100 AS boost FROM u JOIN ws USING (doc_id) GROUP BY doc_id)"
    mute = ", mt AS (SELECT doc_id, avg(CASE WHEN regexp_matches(word, '[STXD]$') THEN 1.0 ELSE 0 END) AS mute FROM u GROUP BY doc_id)"
    events = f"WITH s AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), w AS (SELECT doc_id, l[n] AS word, n - 1 AS word_no FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS n FROM (SELECT doc_id, regexp_extract_all({upper}, '[A-Z]+') AS l FROM s)))"
    weigh = "CASE {} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in v.EN_WEIGHTS.items()) + " END"
    act = "CASE " + " ".join(f"WHEN pair IN ('{x}', '{x[::-1]}') THEN {f}" for x, f in v.EN_PAIRS.items()) + " END"
    twice = "CASE substring(pair, 1, 1) " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in v.EN_DOUBLES.items()) + " ELSE 1.0 END"
    first, second = weigh.format("substring(pair, 1, 1)"), weigh.format("substring(pair, 2, 1)")
    return {
        "bpv_words": f"WITH src AS (SELECT text FROM documents), {whole} SELECT word, score::DOUBLE AS score FROM scored",
        "bpv_window": f"{win}{whole}, {window(by, 'WMK')} SELECT {by}, raw_score, total_chars, words_with_visual FROM ws",
        "micro_vectors": win + vectors("src", by, "EN", upper),
        "micro_es": documents("es") + vectors("s", "doc_id", "ES", upper, agitation="agitation + (SELECT boost FROM rr WHERE rr.doc_id = ws.doc_id)", more=rr),
        "micro_fr": documents("fr") + vectors("s", "doc_id", "FR", upper, anxiety="anxiety * (1 - 0.3 * (SELECT mute FROM mt WHERE mt.doc_id = ws.doc_id))", more=mute),
        "micro_de": documents("de") + vectors("s", "doc_id", "EN", f"upper({folded})"),
        "micro_ru": documents("ru") + vectors("s", "doc_id", "RU", "upper(text)"),
        "micro_ar": documents("ar") + vectors("s", "doc_id", "AR", bare),
        "micro_fa": documents("fa") + vectors("s", "doc_id", "FA", bare),
        "bpv_pairs": f"{events}, x AS (SELECT doc_id, word_no, word, unnest(range(1, length(word) + 1)) AS k FROM w), y AS (SELECT doc_id, word_no, dist AS distance, substring(word, k, 1) || substring(word, k + dist, 1) AS pair FROM x, (VALUES (1), (2)) AS t(dist) WHERE k + dist <= length(word)) SELECT doc_id, CAST(word_no AS BIGINT) AS word_no, pair, CAST(distance AS BIGINT) AS distance, round(({first} + {second}) * {act} / distance + 1e-9, 4)::DOUBLE AS score FROM y WHERE {act} IS NOT NULL",
        "bpv_doubles": f"{events}, x AS (SELECT doc_id, CAST(word_no AS BIGINT) AS word_no, unnest(regexp_extract_all(word, '{'|'.join(c * 2 for c in v.LATIN)}')) AS pair FROM w) SELECT *, round({first} * {twice} + 1e-9, 4)::DOUBLE AS score FROM x",
        "bpv_letters": f"WITH lt AS (SELECT doc_id, unnest(string_split(regexp_replace({upper}, '[^A-Z]+', '', 'g'), '')) AS letter FROM documents) SELECT doc_id, letter, CAST(sum({weigh.format('letter')}) AS DOUBLE) AS total FROM lt WHERE letter <> '' GROUP BY ALL",
        "letter_freq_latin26": f"SELECT doc_id, chr(64 + k::INT) AS letter, length({upper}) - length(replace({upper}, chr(64 + k::INT), '')) AS n FROM (SELECT doc_id, text, unnest(range(1, 27)) AS k FROM documents WHERE text IS NOT NULL)",
    }


def sql() -> dict[str, str]:
    weight = "CASE letter " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in v.EN_WEIGHTS.items()) + " END"
    fw, pron = quoted(v.FUNCTION_WORDS), quoted((*v.FIRST, *v.SECOND, *v.THIRD))
    latin = "SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', '', 'g'), '')) AS letter FROM documents) WHERE letter <> '' GROUP BY ALL"
    fold_from, fold_to = v.WAVE_FOLD
    folded = f"regexp_replace(translate(upper(replace(text, 'ß', 'ss')), '{fold_from}', '{fold_to}'), '[^A-ZÄÖÜ\\s]+', '', 'g')"
    value = "CASE letter WHEN 'Ä' THEN 1.5 WHEN 'Ö' THEN 15.5 WHEN 'Ü' THEN 21.5 ELSE unicode(letter) - 64.0 END"
    signal = f"""sg AS (SELECT doc_id, unnest(l) AS letter, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, list_filter(string_split(regexp_replace({folded}, '\\s+', '', 'g'), ''), lambda x: x <> '') AS l FROM documents WHERE text IS NOT NULL)),
sig AS (SELECT *, CAST({value} AS DOUBLE) AS x FROM sg)"""
    category = "CASE " + " ".join(f"WHEN letter IN ({quoted(tuple(of))}) THEN '{name}'" for name, of in v.WAVE_CATEGORIES.items()) + " END"
    somatic = f"""ws AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array({folded}, '\\s+'), lambda x: x <> '')) AS word FROM documents WHERE text IS NOT NULL),
dw AS (SELECT DISTINCT word FROM ws), dl AS (SELECT word, unnest(string_split(word, '')) AS letter FROM dw),
wd AS (SELECT word, sum(CAST({value} AS DOUBLE)) AS total, round(stddev_pop(CAST({value} AS DOUBLE)) + 1e-9, 4) AS sigma FROM dl GROUP BY word),
wr AS (SELECT word, total, sigma, (CAST(floor(total) AS BIGINT) - 1) % 9 + 1 AS root, CASE WHEN sigma < 2 THEN 1 WHEN sigma < 5 THEN 2 ELSE 3 END::BIGINT AS tier FROM wd)"""
    syll = {
        "en": "greatest(1, len(regexp_extract_all(w, '[aeiouy]+')) - CASE WHEN w LIKE '%e' AND len(regexp_extract_all(w, '[aeiouy]+')) > 1 THEN 1 ELSE 0 END)",
        "de": "greatest(1, len(regexp_extract_all(w, '[aeiouyäöü]+')) - CASE WHEN (w LIKE '%en' OR w LIKE '%er') AND len(regexp_extract_all(w, '[aeiouyäöü]+')) > 1 THEN 1 ELSE 0 END)",
        "fr": "greatest(1, len(regexp_extract_all(w, '[aeiouyàâéèêëîïôùûüœæ]+')) - CASE WHEN ((w LIKE '%e' AND NOT regexp_matches(w, '(?:ée|ie)$')) OR (w LIKE '%es' AND NOT regexp_matches(w, '(?:ées|ies)$'))) AND len(regexp_extract_all(w, '[aeiouyàâéèêëîïôùûüœæ]+')) > 1 THEN 1 ELSE 0 END)",
    }
    base = {"en": (206.835, 1.015, 84.6), "de": (180.0, 1.0, 58.5), "fr": (207.0, 1.015, 73.6)}

    def read(lang: str) -> str:
        b, s, y = base[lang]
        return f"""WITH {SENT}, n AS (SELECT doc_id, greatest(1, count(*)) AS s FROM sent GROUP BY doc_id), {TOK},
x AS (SELECT doc_id, unnest(w) AS w FROM tok WHERE doc_id IN (SELECT doc_id FROM documents WHERE lower(lang) = '{lang}'))
SELECT x.doc_id, round({b} - {s} * count(*) / coalesce(any_value(n.s), 1) - {y} * sum({syll[lang]}) / count(*) + 1e-9, 1) AS score FROM x LEFT JOIN n USING (doc_id) GROUP BY x.doc_id"""

    pauses = "CASE c WHEN ',' THEN 1 WHEN '.' THEN 2 WHEN ':' THEN 2 WHEN '-' THEN 2 WHEN '–' THEN 2 WHEN ';' THEN 3 WHEN '—' THEN 3 WHEN '!' THEN 4 WHEN '?' THEN 4 WHEN '،' THEN 1 WHEN '؟' THEN 4 END"
    prose = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '(?s)```.*?```', ' ', 'g'), '`[^`\\n]+`', ' ', 'g'), '(?m)^[ \\t]*[-*=]{3,}[ \\t]*$', ' ', 'g'), '(?m)^[ \\t]*(?:#{1,6}|[*\\->|]|=>)[ \\t]*', '', 'g'), '(?m)([^\\s.!?])[ \\t]*$', '\\1.', 'g'), '[*_~]{1,3}', '', 'g'), '\\s+', ' ', 'g'), '^\\s+|\\s+$', '', 'g')"
    run = "PARTITION BY event_type ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    graph = f"""e AS (SELECT 'd' || doc_id AS doc, letter AS feature, CAST(n AS DOUBLE) AS w FROM ({latin}) WHERE letter IN ('B', 'K', 'M', 'Q', 'W', 'X', 'Z')),
c AS (SELECT 'd' || doc_id AS doc, coalesce(source, 'none') AS corpus FROM documents)"""

    def matrix(name: str, corpus: str) -> str:
        own = f"SELECT e.* FROM e WHERE doc IN (SELECT doc FROM c WHERE corpus = '{corpus}')"
        return f"{name} AS (SELECT a.feature AS i, b.feature AS j, sum(a.w * b.w) AS value FROM ({own}) a JOIN ({own}) b USING (doc) GROUP BY ALL)"

    def jac(name: str, of: str) -> str:
        return f"{name} AS (SELECT m.i, m.j, CASE WHEN coalesce(x.value, 0) + coalesce(y.value, 0) > 0 THEN 2 * m.value / (coalesce(x.value, 0) + coalesce(y.value, 0)) ELSE 0 END AS value FROM {of} m LEFT JOIN {of} x ON x.i = m.i AND x.j = m.i LEFT JOIN {of} y ON y.i = m.j AND y.j = m.j)"

    lexicon = r"""f AS (SELECT DISTINCT file_name, line_no, raw_line FROM lexicon_raw WHERE line_no <> 1 AND length(regexp_replace(raw_line, '\s', '', 'g')) > 0),
a AS (SELECT *, regexp_matches(raw_line, '(?s)^(?: *"(?:[^"]|"")*"[ \r]*|[^"\t]*)(?:\t(?: *"(?:[^"]|"")*"[ \r]*|[^"\t]*))*$') AS ok,
 regexp_extract_all(chr(9) || raw_line, '(?s)\t( *"(?:[^"]|"")*"[ \r]*|[^"\t]*)', 1) AS r, CASE WHEN file_name LIKE '%\_en\_%' ESCAPE '\' THEN 3 ELSE 4 END AS want FROM f),
b AS (SELECT *, list_transform(r, lambda x: CASE WHEN regexp_replace(x, '^[\s ]+|[\s ]+$', '', 'g') LIKE '"%' THEN trim(replace(regexp_replace(regexp_replace(x, '^[\s ]+|[\s ]+$', '', 'g'), '^"|"$', '', 'g'), '""', '"')) ELSE regexp_replace(x, '^[\s ]+|[\s ]+$', '', 'g') END) AS v FROM a),
d AS (SELECT *, CASE WHEN NOT ok THEN 'quoting' WHEN len(v) <> want THEN 'column_count' WHEN lower(v[2]) NOT IN ('anger', 'fear', 'anticipation', 'trust', 'surprise', 'sadness', 'joy', 'disgust') THEN 'emotion'
 WHEN NOT regexp_matches(v[3], '^[+-]?(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)$') THEN 'score' WHEN want = 4 AND v[4] <> '' AND NOT regexp_matches(v[4], '\p{L}') THEN 'translated_word' END AS fail_reason FROM b)"""

    out = {
        "p6_found": f"WITH {lexicon} SELECT file_name, CAST(line_no AS BIGINT) AS line_no, fail_reason FROM d WHERE fail_reason IS NOT NULL",
        "p6_loaded": f"WITH {lexicon} SELECT file_name, CAST(line_no AS BIGINT) AS line_no, v[1] AS english_word, lower(v[2]) AS emotion, least(1.0, greatest(0.0, CAST(v[3] AS DOUBLE))) AS score, CASE WHEN want = 4 THEN nullif(v[4], '') END AS translated_word FROM d WHERE fail_reason IS NULL",
        "win_boundaries": f"WITH {WIN} SELECT doc_id, seg, offs AS \"offset\", length(seg_text) AS length, eof FROM g",
        "win_slide": f"WITH {WIN} SELECT win.doc_id, win_idx, start_char, end_char, reset_reason, length(substring(d.text, 1, start_char)) - length(replace(substring(d.text, 1, start_char), chr(10), '')) + 1 AS start_line, length(substring(d.text, 1, end_char)) - length(replace(substring(d.text, 1, end_char), chr(10), '')) + 1 AS end_line, md5(win.text) AS digest FROM win JOIN documents d USING (doc_id)",
        "win_counts_per_doc": f"WITH {WIN} SELECT doc_id, count(*) AS n_windows FROM win GROUP BY doc_id",
        "line_index": "SELECT doc_id, unnest(range(1, len(l) + 1)) AS line_no, CAST(unnest(list_transform(range(1, len(l) + 1), lambda k: coalesce(list_sum(list_transform(l[1:k - 1], lambda x: length(x) + 1)), 0))) AS BIGINT) AS start_char FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents WHERE text IS NOT NULL)",
        "snippets": r"SELECT doc_id, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substring(text, 1, 60), '\s\S*$', '') END AS head, CASE WHEN length(text) <= 60 THEN text ELSE regexp_replace(substring(text, length(text) - 59, 60), '^\S*\s', '') END AS tail FROM documents WHERE text IS NOT NULL",
        "sent_split": f"WITH {SENT} SELECT doc_id, sent, s FROM sent",
        "sanitize_prose": f"SELECT doc_id, {prose} AS prose FROM documents WHERE text IS NOT NULL",
        "german_fold": "SELECT doc_id, replace(replace(replace(replace(replace(replace(replace(text, 'ä', 'ae'), 'ö', 'oe'), 'ü', 'ue'), 'Ä', 'Ae'), 'Ö', 'Oe'), 'Ü', 'Ue'), 'ß', 'ss') AS folded FROM documents WHERE text IS NOT NULL",
        "tel_words": f"WITH {WIN} SELECT doc_id, win_idx, len(regexp_extract_all(text, '[A-Za-z]+')) AS total_words, length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) AS total_chars, round(length(regexp_replace(text, '[^A-Za-z]+', '', 'g')) / greatest(1, len(regexp_extract_all(text, '[A-Za-z]+'))) + 1e-9, 2) AS avg_word_length FROM win",
        "tel_top5": f"SELECT * FROM (SELECT doc_id, letter, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, letter) AS rank FROM ({latin})) WHERE rank <= 5",
        "tel_doubles": "SELECT doc_id, pair, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', ' ', 'g'), '" + "|".join(c * 2 for c in v.LATIN) + "')) AS pair FROM documents) GROUP BY ALL",
        "letter_freq_latin": latin,
        "letter_freq_ru": f"SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(upper(text), '[^{v.CYRILLIC}]+', '', 'g'), '')) AS letter FROM documents) WHERE letter <> '' GROUP BY ALL",
        "letter_freq_ar": f"SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(translate(text, '{v.ARABIC_FOLD[0]}', '{v.ARABIC_FOLD[1]}'), '[^{v.ARABIC}]+', '', 'g'), '')) AS letter FROM documents) WHERE letter <> '' GROUP BY ALL",
        "letter_freq_fa": f"SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(translate(text, '{v.ARABIC_FOLD[0]}', '{v.ARABIC_FOLD[1]}'), '[^{v.FARSI}]+', '', 'g'), '')) AS letter FROM documents) WHERE letter <> '' GROUP BY ALL",
        "letter_freq_ko": r"SELECT doc_id, CAST(floor((unicode(ch) - 44032) / 588) AS BIGINT) AS onset, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\x{AC00}-\x{D7A3}]+', '', 'g'), '')) AS ch FROM documents) WHERE ch <> '' GROUP BY ALL",
        "stego_flag": f"WITH x AS (SELECT doc_id, length(text) - length(translate(text, {ZERO}, '')) + length(text) - length(regexp_replace(text, '(?m)[ \\t]+$', '', 'g')) AS hidden_unicode_count FROM documents WHERE text IS NOT NULL) SELECT *, hidden_unicode_count > 0 AS stego_anomaly_flag FROM x",
        "punct_wave": f"SELECT doc_id, pos, CAST({pauses} AS BIGINT) AS value FROM (SELECT doc_id, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS pos FROM (SELECT doc_id, regexp_extract_all(text, '[,.:\\-–;—!?،؟]') AS l FROM documents))",
        "ja_scripts": r"WITH x AS (SELECT doc_id, len(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}]')) AS kanji, len(regexp_extract_all(text, '[\x{3041}-\x{3096}]')) AS hiragana, len(regexp_extract_all(text, '[\x{30A1}-\x{30FA}]')) AS katakana FROM documents WHERE text IS NOT NULL) SELECT *, round(kanji / greatest(1, kanji + hiragana + katakana) + 1e-9, 6) AS kanji_ratio, round(hiragana / greatest(1, kanji + hiragana + katakana) + 1e-9, 6) AS hiragana_ratio, round(katakana / greatest(1, kanji + hiragana + katakana) + 1e-9, 6) AS katakana_ratio FROM x",
        "micro_axes": f"SELECT doc_id, {', '.join(f'round(100.0 * sum(CASE WHEN letter IN ({quoted(tuple(of))}) THEN n * {weight} ELSE 0 END) / sum(n * {weight}) + 1e-9, 6) AS {name}' for name, of in (('anxiety', 'SN'), ('attention', 'AK'), ('emotion', 'MW'), ('agitation', 'RZ')))} FROM ({latin}) GROUP BY doc_id",
        "ent_burstiness": f"WITH c AS (SELECT doc_id, {prose} AS t FROM documents WHERE text IS NOT NULL), l AS (SELECT doc_id, t, list_filter(list_transform(string_split(regexp_replace(t, '([.!?])\\s+', '\\1' || chr(1), 'g'), chr(1)), lambda x: len(regexp_extract_all(x, '[A-Za-z'']+'))), lambda n: n > 0) AS l, regexp_extract_all(lower(t), '[a-z'']+') AS w FROM c), b AS (SELECT doc_id, greatest(1, len(l)) AS n_sentences, CASE WHEN len(l) < 2 THEN 0 ELSE list_stddev_samp(l) END AS b, CASE WHEN len(w) = 0 THEN 0 ELSE len(list_distinct(w)) / len(w) END AS e FROM l) SELECT doc_id, n_sentences, round(b + 1e-9, 4) AS burstiness, round(e + 1e-9, 4) AS lexical, round(0.65 * greatest(0, 1 - b / 10) + 0.35 * least(1, greatest(0, (e - 0.4) / 0.4)) + 1e-9, 4) AS ai_score FROM b",
        "som_word": f"WITH {somatic} SELECT * FROM wr",
        "som_window": f"WITH {somatic}, u AS (SELECT doc_id, word, count(*) AS uses FROM ws GROUP BY ALL), j AS (SELECT * FROM u JOIN wr USING (word)), m AS (SELECT doc_id, round(sum(sigma * uses) / sum(uses) + 1e-9, 4) AS mean_sigma FROM j GROUP BY doc_id), r AS (SELECT doc_id, root FROM (SELECT doc_id, root, row_number() OVER (PARTITION BY doc_id ORDER BY sum(uses) DESC, root) AS k FROM j GROUP BY doc_id, root) WHERE k = 1), t AS (SELECT doc_id, tier FROM (SELECT doc_id, tier, row_number() OVER (PARTITION BY doc_id ORDER BY sum(uses) DESC, tier) AS k FROM j GROUP BY doc_id, tier) WHERE k = 1) SELECT doc_id, mean_sigma, root, CAST(tier AS BIGINT) AS tier, CASE root " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in v.WAVE_ROOTS.items()) + " END AS label FROM m JOIN r USING (doc_id) JOIN t USING (doc_id)",
        "som_envelope": f"WITH {signal}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sig) SELECT doc_id, CAST(floor(((pos + 1) * 100 - 1) / n) AS BIGINT) AS bucket, round(avg(x) + 1e-9, 4) AS value FROM n GROUP BY ALL",
        "som_categories": f"WITH {signal} SELECT doc_id, {category} AS category, count(*) AS n FROM sig GROUP BY ALL",
        "base_welford": f"WITH x AS (SELECT event_id, event_type, value, count(value) OVER ({run}) AS n, avg(value) OVER ({run}) AS mu, var_samp(value) OVER ({run}) AS v FROM events WHERE value IS NOT NULL), y AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE sqrt(greatest(v, 1e-9)) END AS sigma FROM x) SELECT event_id, event_type, n, round(mu + 1e-9, 5) AS mu, round(sigma + 1e-9, 5) AS sigma, round(CASE WHEN n < 2 THEN value ELSE (value - mu) / sigma END + 1e-9, 4) AS z FROM y",
        "base_seed": "WITH h AS (SELECT CAST(floor((epoch_us(min(ts)) + epoch_us(max(ts))) / 2) AS BIGINT) AS half FROM events), t AS (SELECT *, CASE WHEN epoch_us(ts) < half THEN 0 ELSE 1 END AS turn FROM events, h WHERE value IS NOT NULL), x AS (SELECT *, count(value) OVER r AS n, avg(value) OVER r AS mu, var_samp(value) OVER r AS v FROM t WINDOW r AS (PARTITION BY event_type ORDER BY turn, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)), y AS (SELECT *, CASE WHEN n < 2 THEN 1.0 ELSE sqrt(greatest(v, 1e-9)) END AS sigma FROM x) SELECT event_id, event_type, n, round(mu + 1e-9, 5) AS mu, round(sigma + 1e-9, 5) AS sigma, round(CASE WHEN n < 2 THEN value ELSE (value - mu) / sigma END + 1e-9, 4) AS z FROM y WHERE turn = 1",
        "base_state": "WITH x AS (SELECT event_type, event_id, list_reduce(list_prepend(0.0::DOUBLE, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 400 PRECEDING AND CURRENT ROW)), lambda a, x: 0.1 * x + 0.9 * a) AS ema FROM events WHERE value IS NOT NULL), l AS (SELECT event_type, arg_max(ema, event_id) AS ema FROM x GROUP BY event_type) SELECT event_type, count(value) AS n, round(avg(value) + 1e-9, 5) AS mu, round(sqrt(greatest(var_samp(value), 1e-9)) + 1e-9, 5) AS sigma, round(any_value(ema) + 1e-9, 5) AS ema FROM events JOIN l USING (event_type) GROUP BY event_type",
        "base_ema": "SELECT event_id, event_type, round(list_reduce(list_prepend(0.0::DOUBLE, list(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 400 PRECEDING AND CURRENT ROW)), lambda a, x: 0.1 * x + 0.9 * a) + 1e-9, 5) AS ema FROM events WHERE value IS NOT NULL",
        "base_snapshot": "SELECT event_type, count(value) AS n, round(avg(value) + 1e-9, 5) AS mu, round(sqrt(greatest(var_samp(value), 1e-9)) + 1e-9, 5) AS sigma FROM events GROUP BY event_type",
        "macro_centroids": "WITH x AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label) SELECT CAST(label AS BIGINT) AS label, dim, round(x / n + 1e-9, 5) AS value FROM m JOIN n USING (label)",
        "macro_cosine": "WITH x AS (SELECT vec_id, label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), m AS (SELECT label, dim, avg(CAST(x AS DOUBLE)) AS x FROM x GROUP BY ALL), n AS (SELECT label, sqrt(sum(x * x)) AS n FROM m GROUP BY label), c AS (SELECT m.label AS pole, dim, m.x / n AS v FROM m JOIN n USING (label)), d AS (SELECT vec_id, pole, sum(x.x * c.v) AS dot FROM x JOIN c USING (dim) GROUP BY ALL), q AS (SELECT vec_id, sqrt(sum(CAST(x AS DOUBLE) * x)) AS n FROM x GROUP BY vec_id) SELECT vec_id, CAST(pole AS BIGINT) AS pole, round(dot / q.n + 1e-9, 4) AS sim FROM d JOIN q USING (vec_id) WHERE dot / q.n > 0.1",
        "lex_intensity": f"WITH {lexicon}, z AS (SELECT regexp_extract(file_name, '_([a-z]{{2}})_', 1) AS lang, lower(v[2]) AS emotion, lower(trim(coalesce(CASE WHEN want = 4 THEN nullif(v[4], '') END, v[1]))) AS word, least(1.0, greatest(0.0, CAST(v[3] AS DOUBLE))) AS score FROM d WHERE fail_reason IS NULL) SELECT lang, emotion, word, max(score) AS score FROM z WHERE length(word) > 0 AND NOT regexp_matches(word, '\\s') AND length(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(word) >= 0.5 GROUP BY ALL",
        "sty_ttr": f"WITH {TOK}, u AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id, unnest(w) AS w FROM tok) GROUP BY ALL) SELECT doc_id, CAST(sum(n) AS BIGINT) AS n_tokens, count(*) AS n_types, round(count(*) / sum(n) + 1e-9, 4) AS ttr, round(sum(CASE WHEN n = 1 THEN 1 ELSE 0 END) / count(*) + 1e-9, 4) AS hapax_ratio, round(count(*) / (10 * sqrt(sum(n))) + 1e-9, 4) AS heaps FROM u GROUP BY doc_id",
        "sty_funcwords": f"WITH {TOK}, x AS (SELECT doc_id, len(w) AS total, unnest(w) AS word FROM tok) SELECT doc_id, word, round(1000.0 * count(*) / total + 1e-9, 2) AS rate FROM x WHERE word IN ({fw}) GROUP BY doc_id, word, total",
        "sty_sentlen": f"WITH {SENT}, x AS (SELECT doc_id, len(w) AS n FROM sw WHERE len(w) > 0) SELECT doc_id, count(*) AS n_sentences, round(avg(n) + 1e-9, 4) AS mean_length, round(stddev_pop(n) + 1e-9, 4) AS sd_length, min(n) AS shortest, max(n) AS longest, round(stddev_pop(n) / avg(n) + 1e-9, 4) AS cv FROM x GROUP BY doc_id",
        "sty_wordlen": f"WITH {TOK}, x AS (SELECT doc_id, length(unnest(w)) AS n FROM tok) SELECT doc_id, round(avg(n) + 1e-9, 4) AS mean_length, round(avg(CASE WHEN n <= 3 THEN 1.0 ELSE 0 END) + 1e-9, 4) AS short_share, round(avg(CASE WHEN n BETWEEN 4 AND 6 THEN 1.0 ELSE 0 END) + 1e-9, 4) AS middle_share, round(avg(CASE WHEN n >= 7 THEN 1.0 ELSE 0 END) + 1e-9, 4) AS long_share FROM x GROUP BY doc_id",
        "sty_punct": f"WITH {TOK}, x AS (SELECT doc_id, len(w) AS total, unnest(regexp_extract_all(text, '[,.;:!?—–]')) AS mark FROM tok) SELECT doc_id, mark, round(1000.0 * count(*) / total + 1e-9, 2) AS rate FROM x GROUP BY doc_id, mark, total",
        "nar_voice": f"WITH {TOK}, x AS (SELECT doc_id, unnest(w) AS w FROM tok) SELECT doc_id, {', '.join(f'round(avg(CASE WHEN w IN ({quoted(ws)}) THEN 1.0 ELSE 0 END) + 1e-9, 4) AS voice_{name}' for name, ws in (('first', v.FIRST), ('second', v.SECOND), ('third', v.THIRD)))} FROM x WHERE w IN ({pron}) GROUP BY doc_id",
        "nar_speech": "SELECT doc_id, round(coalesce(list_sum(list_transform(regexp_extract_all(text, '\"[^\"]*\"|“[^”]*”|‘[^’]*’|«[^»]*»'), lambda x: length(x))), 0) / length(text) + 1e-9, 4) AS direct_speech_ratio FROM documents WHERE length(text) > 0",
        "nar_mattr": f"WITH {TOK}, x AS (SELECT doc_id, len(w) AS n, least(len(w), 100) AS k, w FROM tok), r AS (SELECT doc_id, k, len(list_distinct(w[s:s + k - 1])) / k AS t FROM (SELECT *, unnest(range(1, n - k + 2)) AS s FROM x)) SELECT doc_id, round(avg(t) + 1e-9, 4) AS mattr FROM r GROUP BY doc_id",
        "lex_curve": f"WITH {TOK}, x AS (SELECT doc_id, w, len(w) AS n, unnest(range(0, 10)) AS point FROM tok WHERE len(w) >= 10), y AS (SELECT *, CAST(floor(point / 9.0::DOUBLE * (n - 1)) AS BIGINT) AS c FROM x) SELECT doc_id, point, round(len(list_distinct(w[greatest(0, c - 25) + 1:least(n, c + 25)])) / (least(n, c + 25) - greatest(0, c - 25)) + 1e-9, 3) AS ttr FROM y",
        "read_en": read("en"),
        "read_de": read("de"),
        "read_fr": read("fr"),
        "rh_alliteration": f"WITH {SENT}, x AS (SELECT doc_id, sent, unnest(w) AS w FROM sw), y AS (SELECT doc_id, sent, substring(w, 1, 1) AS initial FROM x WHERE length(w) > 1 AND w NOT IN ({fw})) SELECT doc_id, sent, initial, count(*) AS n, round(least(0.97, 0.6 + 0.1 * count(*)), 2)::DOUBLE AS confidence FROM y WHERE regexp_matches(initial, '^[b-df-hj-np-tv-z]$') GROUP BY doc_id, sent, initial HAVING count(*) >= 3",
        "rh_anaphora": f"WITH {SENT}, x AS (SELECT doc_id, sent, list_filter(w, lambda v: v NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those'))[1] AS word FROM sw), y AS (SELECT *, CASE WHEN word IS NOT NULL AND word = lag(word) OVER (PARTITION BY doc_id ORDER BY sent) THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sent) AS run FROM y) SELECT doc_id, word, min(sent) AS first_sent, count(*) AS n, CASE WHEN count(*) >= 3 THEN 0.9::DOUBLE ELSE 0.72::DOUBLE END AS confidence FROM z WHERE word IS NOT NULL GROUP BY doc_id, run, word HAVING count(*) >= 2",
        "rh_epistrophe": f"WITH {SENT}, x AS (SELECT doc_id, sent, list_filter(w, lambda v: v NOT IN ('the', 'a', 'an', 'this', 'that', 'these', 'those'))[-1] AS word FROM sw), y AS (SELECT *, CASE WHEN word IS NOT NULL AND word = lag(word) OVER (PARTITION BY doc_id ORDER BY sent) THEN 0 ELSE 1 END AS new FROM x), z AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY sent) AS run FROM y) SELECT doc_id, word, min(sent) AS first_sent, count(*) AS n, CASE WHEN count(*) >= 3 THEN 0.88::DOUBLE ELSE 0.7::DOUBLE END AS confidence FROM z WHERE word IS NOT NULL GROUP BY doc_id, run, word HAVING count(*) >= 2",
        "rh_polysyndeton": f"WITH {SENT}, x AS (SELECT doc_id, sent, unnest(w) AS conjunction FROM sw) SELECT doc_id, sent, conjunction, count(*) AS n FROM x WHERE conjunction IN ('and', 'or', 'nor', 'but') GROUP BY ALL HAVING count(*) >= 3",
        "rh_asyndeton": f"WITH {SENT} SELECT doc_id, sent FROM sw WHERE len(regexp_extract_all(s, ',')) >= 2 AND len(list_filter(w, lambda v: v IN ('and', 'or', 'nor', 'but'))) = 0",
        "rh_question": f"WITH {SENT} SELECT doc_id, sent, CASE WHEN len(list_filter(w, lambda v: v IN ('anyone', 'everyone', 'nobody', 'no', 'one', 'whoever', 'whatever', 'we', 'you'))) > 0 OR len(list_filter(w, lambda v: v NOT IN ({fw}))) <= 8 THEN 0.78::DOUBLE ELSE 0.55::DOUBLE END AS confidence FROM sw WHERE s LIKE '%?' AND len(list_filter(w, lambda v: v IN ({quoted(v.INTERROGATIVES)}))) > 0",
        "g_cooc": f"WITH {graph}, {matrix('m', 'op_ed')} SELECT i, j, value FROM m",
        "g_laplacian": f"WITH {graph}, {matrix('m', 'op_ed')}, o AS (SELECT i, j, -value AS value FROM m WHERE i <> j) SELECT i, j, value FROM o UNION ALL SELECT i, i AS j, -sum(value) AS value FROM o GROUP BY i",
        "g_jaccard": f"WITH {graph}, {matrix('m', 'op_ed')}, {jac('jj', 'm')} SELECT i, j, round(value + 1e-9, 6) AS value FROM jj",
        "g_divergence": f"WITH {graph}, {matrix('m', 'op_ed')}, {matrix('k', 'letters')}, {jac('x', 'm')}, {jac('y', 'k')} SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, round(coalesce(x.value, 0) - coalesce(y.value, 0) + 1e-9, 6) AS value FROM x FULL JOIN y ON x.i = y.i AND x.j = y.j",
        "g_bfs": "WITH a AS (SELECT DISTINCT entity_id AS src, coalesce(source, 'none') AS dst FROM documents WHERE entity_id IS NOT NULL), s AS (SELECT min(entity_id) AS id FROM documents), one AS (SELECT a.src, a.dst FROM a JOIN s ON a.src = s.id) SELECT src, dst FROM one UNION ALL SELECT a.dst AS src, a.src AS dst FROM a WHERE a.dst IN (SELECT dst FROM one)",
        "cmp_align": "WITH x AS (SELECT w.request_id, win_idx, (start_char + end_char) / 2 / max(end_char) OVER (PARTITION BY w.request_id) AS m FROM (SELECT DISTINCT request_id, win_idx, start_char, end_char FROM window_results) w) SELECT a.request_id, CAST(a.win_idx AS BIGINT) AS win_idx, round(greatest(0.0, 1 - abs(a.m - b.m)) + 1e-9, 6) AS score FROM x a JOIN x b ON b.request_id = a.request_id + 1 AND b.win_idx = a.win_idx",
    }
    def count_in(ws: list[str]) -> str:
        return f"len(list_filter(w, lambda v: v IN ({quoted(ws)})))"

    appeal = {n: count_in(ws) + "".join(f" + CASE WHEN contains(lower(s), '{p}') THEN 2 ELSE 0 END" for p in v.PHRASES[n]) for n, ws in (("logos", v.LOGOS), ("ethos", v.ETHOS), ("pathos", v.PATHOS))}
    args = f"WITH {SENT}, x AS (SELECT doc_id, sent, {', '.join(f'{e} AS {n}' for n, e in appeal.items())} FROM sw), y AS (SELECT *, CASE WHEN logos >= ethos AND logos >= pathos THEN 'logos' WHEN ethos >= pathos THEN 'ethos' ELSE 'pathos' END AS dominant FROM x WHERE greatest(logos, ethos, pathos) >= 2)"
    out["arg_score"] = f"{args} SELECT * FROM y"
    out["arg_ratios"] = f"{args}, r AS (SELECT doc_id, {', '.join(f'round(avg(CASE WHEN dominant = {chr(39)}{n}{chr(39)} THEN 1.0 ELSE 0 END) + 1e-9, 4) AS {n}' for n in appeal)} FROM y GROUP BY doc_id) SELECT *, CASE WHEN greatest(logos, ethos, pathos) < 0.4 THEN 'balanced' WHEN logos = greatest(logos, ethos, pathos) THEN 'logos' WHEN ethos = greatest(logos, ethos, pathos) THEN 'ethos' ELSE 'pathos' END AS balance FROM r"
    out["rh_assonance"] = f"WITH {SENT}, x AS (SELECT doc_id, sent, unnest(w) AS w FROM sw), y AS (SELECT doc_id, sent, regexp_extract(w, '[aeiou]+') AS vowels FROM x WHERE length(w) > 2 AND w NOT IN ({fw})) SELECT doc_id, sent, vowels, count(*) AS n FROM y WHERE vowels <> '' GROUP BY ALL HAVING count(*) >= 3"
    out["rh_simile"] = f"WITH {SENT} SELECT doc_id, sent FROM sw WHERE regexp_matches(s, '{v.SIMILE}')"
    out["rh_hyperbole"] = f"WITH {SENT} SELECT doc_id, sent FROM sw WHERE regexp_matches(s, '{v.HYPERBOLE}')"
    table = ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(v.OXYMORA))
    toks = f"WITH {SENT}, x AS (SELECT doc_id, sent, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM sw)"
    out["rh_oxymoron"] = f"{toks} SELECT a.doc_id, a.sent, arg_min(o.a || ' ' || o.b, o.ord) AS pair FROM x a JOIN (VALUES {table}) AS o(ord, a, b) ON a.word = o.a JOIN x b ON b.doc_id = a.doc_id AND b.sent = a.sent AND b.word = o.b WHERE abs(a.pos - b.pos) <= 7 GROUP BY a.doc_id, a.sent"
    side = f"CASE WHEN word IN ({fw}, {quoted(v.CONTRASTIVE)}) THEN 0 ELSE 1 END"
    out["rh_antithesis"] = f"{toks}, y AS (SELECT *, sum({side}) OVER (PARTITION BY doc_id, sent ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, sum({side}) OVER (PARTITION BY doc_id, sent ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS f FROM x) SELECT doc_id, sent, arg_min(word, pos) AS pivot FROM y WHERE word IN ({quoted(v.CONTRASTIVE)}) AND p >= 3 AND f >= 3 GROUP BY doc_id, sent"
    out["rh_litotes"] = f"{toks} SELECT DISTINCT a.doc_id, a.sent FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.sent = a.sent AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.word = 'not' AND (b.word IN ({quoted(v.NEGATIVE)}) OR regexp_matches(b.word, '^(?:un|in|im|ir|il|dis|non)[a-z]{{4,}}$'))"

    def axes_of(weights: dict[str, int], axes: dict[str, str], text: str) -> str:
        w = "CASE letter " + " ".join(f"WHEN '{k}' THEN {n}" for k, n in weights.items()) + " END"
        shares = ", ".join(f"round(100.0 * sum(CASE WHEN letter IN ({quoted(tuple(of))}) THEN n * {w} ELSE 0 END) / sum(n * {w}) + 1e-9, 6) AS {name}" for name, of in axes.items())
        return f"SELECT doc_id, {shares} FROM (SELECT doc_id, letter, count(*) AS n FROM (SELECT doc_id, unnest(string_split(regexp_replace({text}, '[^{''.join(weights)}]+', '', 'g'), '')) AS letter FROM documents) WHERE letter <> '' GROUP BY ALL) GROUP BY doc_id"

    arabic = f"translate(text, '{v.ARABIC_FOLD[0]}', '{v.ARABIC_FOLD[1]}')"
    out |= {"micro_axes_ru": axes_of(v.RU_WEIGHTS, v.AXES["RU"], "upper(text)"), "micro_axes_ar": axes_of(v.AR_WEIGHTS, v.AXES["AR"], arabic), "micro_axes_fa": axes_of(v.AR_WEIGHTS | v.FA_MORE, v.AXES["AR"], arabic)}
    out["micro_ja"] = f"SELECT doc_id, round(kanji_ratio * 100 + 1e-9, 4) AS intensity, round(kanji_ratio * 80 + 1e-9, 4) AS attention, round(hiragana_ratio * 100 + 1e-9, 4) AS emotion, round(katakana_ratio * 100 + 1e-9, 4) AS agitation, 0.0::DOUBLE AS anxiety FROM ({out['ja_scripts']}) WHERE kanji + hiragana + katakana > 0"
    from textloom.parameters import STROKES

    strokes = "CASE ch " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in STROKES) + " ELSE 8 END"
    out["micro_zh"] = f"WITH c AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '[^\\x{{4E00}}-\\x{{9FFF}}]+', '', 'g'), '')) AS ch FROM documents), m AS (SELECT doc_id, avg({strokes}) AS d FROM c WHERE ch <> '' GROUP BY doc_id) SELECT doc_id, {', '.join(f'round(least(100.0, {f} * d) + 1e-9, 4) AS {n}' for n, f in (('intensity', 8), ('attention', 6), ('complexity', 10)))} FROM m"

    out |= letter_scores(arabic)

    def script(marks: str, ends: str) -> str:
        t = "text"
        for p, by in (("(?s)```.*?```", " "), ("`[^`\\n]+`", " "), ("(?m)^[ \\t]*[-*=]{3,}[ \\t]*$", " "), ("(?m)^[ \\t]*(?:#{1,6}|[*\\->|]|=>)[ \\t]*", ""), ("[A-Za-z]+", " "), (marks, ""), ("[\\t\\f\\r ]+", " "), (f"(?m)([^\\s{ends}])[ \\t]*$", "\\1."), ("\\s+", " "), ("^\\s+|\\s+$", "")):
            t = f"regexp_replace({t}, '{p}', '{by}', 'g')" if p else t
        return f"SELECT doc_id, {t} AS prose FROM documents WHERE text IS NOT NULL"

    out |= {"sanitize_ru": script("", ".!?"), "sanitize_abjad": script("[\\x{0610}-\\x{061A}\\x{0640}\\x{064B}-\\x{065F}\\x{0670}]", ".!?،؟")}
    forms = {s: " + ".join(f"(length(text) - length(replace(text, '{p}', ''))) / {len(p)} * {abs(w)}" for p, w in v.KEIGO.items() if w * s > 0) for s in (1, -1)}
    out["macro_keigo"] = f"SELECT doc_id, round(({forms[1]}) * 100 / length(text) + 1e-9, 4) AS formal, round(({forms[-1]}) * 100 / length(text) + 1e-9, 4) AS casual FROM documents WHERE length(text) > 0"

    def z(source: str, name: str) -> str:
        r = "PARTITION BY variable ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return f"""{name} AS (SELECT doc_id, variable, CASE WHEN n < 2 THEN value ELSE (value - mu) / sqrt(greatest(v, 1e-9)) END AS z FROM
(SELECT doc_id, variable, value, count(*) OVER ({r}) AS n, avg(value) OVER ({r}) AS mu, var_samp(value) OVER ({r}) AS v FROM (UNPIVOT ({source}) ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME variable VALUE value)))"""

    lengths = out["sty_wordlen"].replace("AS mean_length", "AS kinetic_aggression").replace("AS short_share", "AS power_control").replace("AS middle_share", "AS power_submission").replace("AS long_share", "AS visibility_exposure")
    pairs = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in v.BRIDGE) + ") AS bridge(micro_var, macro_var)"
    verdict = "CASE WHEN d > 4 THEN 'fracture' WHEN y > x THEN 'posturing' ELSE 'suppressed' END"
    events = f"WITH {z(out['micro_axes'], 'a')}, {z(lengths, 'b')}, ev AS (SELECT a.doc_id, micro_var, macro_var, a.z AS x, b.z AS y, abs(b.z - a.z) AS d FROM a JOIN {pairs} ON a.variable = micro_var JOIN b ON b.doc_id = a.doc_id AND b.variable = macro_var)"
    out["dis_bridge"] = f"{events} SELECT doc_id, micro_var, macro_var, round(d + 1e-9, 4) AS delta, {verdict} AS conclusion FROM ev WHERE d > 2.5"

    def top(name: str, of: str) -> str:
        return f"{name} AS (SELECT * FROM (SELECT doc_id, variable, z, row_number() OVER (PARTITION BY doc_id ORDER BY abs(z) DESC, variable) AS rank FROM {of}) WHERE rank <= 3)"

    out["dis_fallback"] = f"{events}, {top('ta', 'a')}, {top('tb', 'b')}, f AS (SELECT ta.doc_id, ta.variable AS micro_var, tb.variable AS macro_var, ta.z AS x, tb.z AS y, abs(tb.z - ta.z) AS d FROM ta JOIN tb USING (doc_id, rank) WHERE doc_id NOT IN (SELECT doc_id FROM ev WHERE d > 2.5)) SELECT doc_id, micro_var, macro_var, round(d + 1e-9, 4) AS delta, {verdict} AS conclusion FROM f WHERE d > 2.5"
    words = f"{TOK}, tw AS (SELECT doc_id, (SELECT lower(lang) FROM documents d WHERE d.doc_id = tok.doc_id) AS lang, unnest(w) AS word FROM tok), lex AS ({out['lex_intensity']})"
    out["pds_affect"] = f"WITH {words} SELECT doc_id, emotion, count(*) AS matched, round(avg(score) + 1e-9, 4) AS mean_score, round(stddev_pop(score) + 1e-9, 4) AS sd_score FROM tw JOIN lex USING (lang, word) GROUP BY ALL"
    out["macro_exact"] = f"WITH {words}, seed AS (SELECT lang, word, emotion || '_' || CASE WHEN score >= 0.5 THEN 'strong' ELSE 'weak' END AS pole_name FROM (SELECT *, row_number() OVER (PARTITION BY lang, word ORDER BY emotion || CAST(score AS VARCHAR) DESC) AS k FROM lex) WHERE k = 1), n AS (SELECT doc_id, count(*) AS total FROM tw GROUP BY doc_id) SELECT doc_id, pole_name, round(count(*) / any_value(total) + 1e-9, 6) AS score FROM tw JOIN seed USING (lang, word) JOIN n USING (doc_id) GROUP BY ALL"
    s = {e: f"coalesce(max(score) FILTER (WHERE emotion = '{e}'), 0.0)" for e in ("joy", "trust", "anger", "surprise", "disgust", "anticipation")}
    out["pds_rotate"] = f"WITH lex AS ({out['lex_intensity']}), x AS (SELECT lang, word, greatest({s['joy']}, {s['trust']}) AS v, greatest({s['anger']}, {s['surprise']}) AS a, greatest({s['disgust']}, {s['anticipation']}) AS d FROM lex GROUP BY ALL), y AS (SELECT *, greatest(-1.0, least(1.0, d * 2 - 1)) AS p, greatest(-1.0, least(1.0, -0.7 * (v * 2 - 1) + 0.3 * (a * 2 - 1))) AS g, greatest(-1.0, least(1.0, -(a * 2 - 1))) AS t FROM x) SELECT lang, word, v, a, d, round(p + 1e-9, 4) AS power, round(g + 1e-9, 4) AS danger, round(t + 1e-9, 4) AS structure, CASE WHEN p >= 0 AND g >= 0 THEN 'Apex Threat' WHEN p >= 0 THEN 'Benevolent Authority' WHEN g < 0 THEN 'Composed Submission' ELSE 'Desperate Panic' END AS quadrant FROM y"
    out["vad_agg"] = f"WITH {words}, pds AS ({out['pds_rotate']}) SELECT doc_id, count(*) AS matched, {', '.join(f'round(avg({c}) + 1e-9, 4) AS {c}_mean, round(stddev_pop({c}) + 1e-9, 4) AS {c}_sd' for c in 'vad')} FROM tw JOIN pds USING (lang, word) GROUP BY doc_id"
    emo = ", ".join(f"max(mean_score) FILTER (WHERE emotion = '{e}') AS {e}" for e in ("anger", "disgust", "fear", "anticipation"))
    out["pds_triggers"] = f"WITH v AS ({out['vad_agg']}), e AS (SELECT doc_id, {emo}, max(sd_score) FILTER (WHERE emotion = 'anger') AS anger_sd FROM ({out['pds_affect']}) GROUP BY doc_id), x AS (SELECT *, greatest(-1.0, least(1.0, d_mean * 2 - 1)) AS p, greatest(-1.0, least(1.0, -0.7 * (v_mean * 2 - 1) + 0.3 * (a_mean * 2 - 1))) AS g FROM v JOIN e USING (doc_id)) SELECT doc_id, p >= 0 AND g >= 0 AND (coalesce(anger, 0) > 0.75 OR coalesce(anger_sd, 0) > 0.4) AS escalation, p >= 0 AND g >= 0 AND coalesce(anger, 0) > 0.6 AND coalesce(disgust, 0) > 0.5 AS contempt, p < 0 AND g >= 0 AND coalesce(fear, 0) > 0.6 AND coalesce(anticipation, 0) > 0.6 AS paranoia FROM x"
    out["lex_fallback"] = f"WITH lex AS ({out['lex_intensity']}), a AS (SELECT unnest(['de', 'es', 'en']) AS lang), b AS (SELECT a.lang, emotion, word FROM a JOIN lex ON lex.lang = CASE WHEN a.lang IN (SELECT lang FROM lex) THEN a.lang ELSE 'en' END) SELECT lang, emotion, count(*) AS words FROM b GROUP BY ALL"
    cluster = "CASE " + " ".join(f"WHEN upper(substring(w, 1, 1)) IN ({quoted(tuple(of))}) THEN '{name}'" for name, of in v.LETTER_CLUSTERS.items()) + " END"
    out["lar_radar"] = f"WITH {TOK}, x AS (SELECT doc_id, unnest(w) AS w FROM tok), y AS (SELECT doc_id, {cluster} AS cluster FROM x WHERE w NOT IN ({fw})), n AS (SELECT doc_id, cluster, count(*) AS n FROM y WHERE cluster IS NOT NULL GROUP BY ALL) SELECT doc_id, cluster, round(100.0 * n / sum(n) OVER (PARTITION BY doc_id) + 1e-9, 1) AS percent FROM n"
    out["lex_trend"] = f"WITH c AS ({out['lex_curve']}), d AS (SELECT doc_id, avg(ttr) FILTER (WHERE point > 4) - avg(ttr) FILTER (WHERE point <= 4) AS d, max(ttr) - min(ttr) AS s, count(*) AS n FROM c GROUP BY doc_id) SELECT doc_id, CASE WHEN d > 0.05 + 1e-9 THEN 'rising' WHEN d < -0.05 - 1e-9 THEN 'falling' ELSE 'stable' END AS trend, n >= 3 AND s > 0.25 + 1e-9 AS register_shift FROM d"
    out["lex_label"] = f"SELECT doc_id, CASE WHEN mattr >= 0.75 THEN 'rich' WHEN mattr >= 0.5 THEN 'moderate' ELSE 'sparse' END AS label FROM ({out['nar_mattr']})"
    found = f"SELECT DISTINCT 'd' || doc_id AS src, 'device_alliteration' AS dst, 'EXHIBITS_DEVICE' AS relation, 1.0::DOUBLE AS weight FROM ({out['rh_alliteration']}) UNION ALL SELECT DISTINCT 'd' || doc_id, 'device_anaphora', 'EXHIBITS_DEVICE', 1.0 FROM ({out['rh_anaphora']}) UNION ALL SELECT 'd' || doc_id, 'affect_' || emotion, 'HAS_AFFECT', mean_score FROM ({out['pds_affect']}) WHERE abs(mean_score) >= 0.05"
    out["g_index_doc"] = f"{found} UNION ALL SELECT 'd' || doc_id, source, 'BELONGS_TO', 1.0 FROM documents WHERE source IS NOT NULL"
    out["g_correlations"] = f"SELECT src, relation, count(DISTINCT dst) AS features FROM ({out['g_index_doc']}) GROUP BY ALL"
    out["g_counts"] = f"SELECT type, count(*) AS nodes FROM (SELECT 'd' || doc_id AS id, 'Document' AS type FROM documents UNION SELECT source, 'Corpus' FROM documents WHERE source IS NOT NULL UNION SELECT dst, CASE relation WHEN 'HAS_AFFECT' THEN 'AffectNode' ELSE 'StylisticDevice' END FROM ({found})) GROUP BY type"
    out["ent_records"] = "SELECT entity_id, count(DISTINCT doc_id) AS documents, round(least(1.0, count(DISTINCT doc_id) / 10) + 1e-9, 4) AS confidence FROM documents WHERE entity_id IS NOT NULL GROUP BY entity_id"
    out["ent_ledger"] = "SELECT entity_id, trigger_type, algorithmic_conclusion AS conclusion, count(*) AS events, max(delta_score) AS worst FROM (SELECT DISTINCT event_id, request_id, trigger_type, algorithmic_conclusion, delta_score FROM dissonance_events) JOIN (SELECT DISTINCT request_id, entity_id FROM analysis_requests WHERE entity_id IS NOT NULL) USING (request_id) GROUP BY ALL"
    out["cmp_burrows"] = f"WITH r AS ({out['sty_funcwords']}), m AS (SELECT word, avg(rate) AS mu, stddev_samp(rate) AS sd FROM r GROUP BY word) SELECT doc_id, round(avg(abs((rate - mu) / sd)) + 1e-9, 6) AS delta FROM r JOIN m USING (word) WHERE sd > 0 GROUP BY doc_id"
    win_letters = f"WITH {WIN}, lt AS (SELECT doc_id, win_idx, letter, count(*) AS n FROM (SELECT doc_id, win_idx, unnest(string_split(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', '', 'g'), '')) AS letter FROM win) WHERE letter <> '' GROUP BY ALL), ax AS ({out['micro_axes'].replace('SELECT doc_id,', 'SELECT doc_id, win_idx,', 1).replace(f'({latin})', 'lt').replace('GROUP BY doc_id', 'GROUP BY doc_id, win_idx')})"
    out["cmp_delta"] = f"{win_letters} SELECT count(*) AS windows, {', '.join(f'round(avg(abs(a.{v} - b.{v})) + 1e-9, 6) AS {v}' for v in ('anxiety', 'attention', 'emotion', 'agitation'))} FROM ax a JOIN ax b ON b.doc_id = a.doc_id + 1 AND b.win_idx = a.win_idx"
    out["som_fft"] = f"WITH {signal}, f AS (SELECT doc_id, pos, x - avg(x) OVER (PARTITION BY doc_id) AS x FROM sig WHERE pos < 256), b AS (SELECT doc_id, pos, x, unnest(range(1, 128)) AS bin FROM f), m AS (SELECT doc_id, bin, round(sqrt(pow(sum(x * cos(2 * pi() * ((pos * bin) % 256) / 256)), 2) + pow(sum(x * sin(2 * pi() * ((pos * bin) % 256) / 256)), 2)) + 1e-9, 4) AS magnitude FROM b GROUP BY ALL) SELECT doc_id, bin, magnitude, round(bin / 256, 6) AS norm_freq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY magnitude DESC, bin) AS k FROM m) WHERE k <= 5"
    from textloom.oracle_layers import layers

    return out | layers(out)
