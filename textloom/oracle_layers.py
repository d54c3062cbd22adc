"""SQL of the lexicon, seed, narrative and graph queries. `out`: the queries that these build on."""

from __future__ import annotations

from textloom import oracle_values as v
from textloom import parameters as p
from textloom.oracle import SENT, WIN, quoted


def values(rows: list[tuple]) -> str:
    def one(x: object) -> str:
        if x is None:
            return "NULL"
        return "'" + str(x).replace("'", "''") + "'" if isinstance(x, str) else str(x)

    return ", ".join("(" + ", ".join(map(one, r)) + ")" for r in rows)


# Fixed values, written out once more: tenses, subordinate clauses, verbs of people, and what arguments do.
PAST = "was were had did said went came saw made took gave knew thought told left felt kept began ran fell rose stood found held met".split()
PRESENT = "is are am has have do does says goes seems remains".split()
FUTURE = "will shall ll".split()
SUBORDINATING = "after although as because before if once since that though unless until when whenever where whereas which while who whom whose why".split()
HUMAN = "whisper speak talk call cry shout murmur moan groan sob laugh smile weep sigh sing dance walk run march think dream feel love hate fear desire remember forget mourn grieve yearn hunger breathe reach embrace stretch kneel bow beckon sleep wake watch listen see hear touch weave creep crawl stir rage brood".split()
CLAIM_VERBS = "argue claim assert maintain contend propose believe insist posit state hold submit advance".split()
OPENERS = ["i believe", "i argue", "i contend", "i maintain", "i propose", "we believe", "we argue", "we contend", "one must", "it is clear", "it is obvious", "it is evident", "it must be", "clearly", "obviously", "undoubtedly", "certainly", "without doubt", "it is beyond question", "there is no doubt"]
MARKERS = "because since given considering seeing provided assuming inasmuch".split()
PREMISE = ["for the reason that", "given that", "in light of", "on the grounds that", "owing to", "due to", "in view of", "based on", "taking into account", "as a consequence of"]
EVIDENCE = ["for example", "for instance", "as shown by", "according to", "data shows", "research shows", "studies indicate", "statistics show", "the figures show", "in the case of", "as illustrated by", "such as", "a case in point", "to illustrate"]
JAMO = {  # Hangul letters in the order of their code points, as the 24 they count as
    "first": "ㄱㄱㄴㄷㄷㄹㅁㅂㅂㅅㅅㅇㅈㅈㅊㅋㅌㅍㅎ",
    "vowel": "ㅏㅏㅑㅑㅓㅓㅕㅕㅗㅗㅗㅗㅛㅜㅜㅜㅜㅠㅡㅡㅣ",
    "final": "ㄱㄱㅅㄴㄴㄴㄷㄹㄹㄹㄹㄹㄹㄹㄹㅁㅂㅂㅅㅅㅇㅈㅊㅋㅌㅍㅎ",
}


def literary(out: dict[str, str], language: str) -> dict[str, str]:
    """The English literary SQL with the lists of another language, on the documents of that language."""
    own = v.LANGUAGES[language]
    vowels = own["vowels"]
    like = {"DE": ("so", "wie"), "FR": ("aussi", "que")}[language]
    swaps = [
        (quoted(v.FUNCTION_WORDS), quoted(own["function_words"])), (quoted(v.CONTRASTIVE), quoted(own["contrastive"])), (quoted(v.INTERROGATIVES), quoted(own["interrogatives"])),
        ("'the', 'a', 'an', 'this', 'that', 'these', 'those'", quoted(own["determiners"])), ("'and', 'or', 'nor', 'but'", quoted(own["coordinating"])),
        ("'anyone', 'everyone', 'nobody', 'no', 'one', 'whoever', 'whatever', 'we', 'you'", quoted(own["rhetorical"])),
        ("regexp_matches(initial, '^[b-df-hj-np-tv-z]$')", f"regexp_matches(initial, '^\\p{{L}}$') AND NOT regexp_matches(initial, '[{vowels}]')"), ("'[aeiou]+'", f"'[{vowels}]+'"),
        (v.SIMILE, v.SIMILE.replace("as\\s+", f"{like[0]}\\s+", 1).replace("\\s+as(", f"\\s+{like[1]}(")),
        ("FROM documents", f"FROM (SELECT * FROM documents WHERE lower(lang) = '{language.lower()}')"),
    ]

    def count_in(ws: list[str]) -> str:
        return f"len(list_filter(w, lambda v: v IN ({quoted(ws)})))"

    def has(phrase: str) -> str:
        return " + CASE WHEN contains(lower(s), '" + phrase.replace("'", "''") + "') THEN 2 ELSE 0 END"

    appeal = {n: count_in(own[n]) + "".join(map(has, own["phrases"][n])) for n in ("logos", "ethos", "pathos")}
    args = f"WITH {SENT}, x AS (SELECT doc_id, sent, {', '.join(f'{e} AS {n}' for n, e in appeal.items())} FROM sw), y AS (SELECT *, CASE WHEN logos >= ethos AND logos >= pathos THEN 'logos' WHEN ethos >= pathos THEN 'ethos' ELSE 'pathos' END AS dominant FROM x WHERE greatest(logos, ethos, pathos) >= 2)"
    of = out["arg_ratios"].split(", r AS (", 1)[1]
    sql = {name: out[name] for name in ("sty_funcwords", "cmp_burrows", "rh_alliteration", "rh_assonance", "rh_anaphora", "rh_epistrophe", "rh_polysyndeton", "rh_asyndeton", "rh_question", "rh_antithesis", "rh_simile")}
    sql |= {"arg_score": f"{args} SELECT * FROM y", "arg_ratios": f"{args}, r AS ({of}"}
    done = {}
    for name, text in sql.items():
        for a, b in swaps:
            text = text.replace(a, b)
        done[f"{name}_{language.lower()}"] = text
    return done


def layers(out: dict[str, str]) -> dict[str, str]:
    sql: dict[str, str] = {}
    fw = quoted(v.FUNCTION_WORDS)
    lines = f"(VALUES {values(p.VAD_LINES)}) AS x(file_name, line_no, raw_line)"
    parsed = f"f AS (SELECT regexp_extract(file_name, '_([a-z]{{2}})\\.', 1) AS lang, line_no, string_split(raw_line, chr(9)) AS f FROM {lines}), n AS (SELECT lang, line_no, f, try_cast(trim(f[2]) AS DOUBLE) AS v, try_cast(trim(f[3]) AS DOUBLE) AS a, try_cast(trim(f[4]) AS DOUBLE) AS d, CASE WHEN lang <> 'en' AND len(f) >= 5 AND trim(f[5]) <> '' THEN f[5] ELSE f[1] END AS k FROM f WHERE len(f) >= 4), g AS (SELECT *, lower(trim(k)) AS word FROM n WHERE v IS NOT NULL AND a IS NOT NULL AND d IS NOT NULL)"
    sql["src_vad_tsv"] = f"WITH {parsed} SELECT lang, word, arg_max(v, line_no) AS v, arg_max(a, line_no) AS a, arg_max(d, line_no) AS d FROM g WHERE word <> '' GROUP BY lang, word"
    clip = "greatest(0.0, least(1.0, {}))"
    sql["src_lex_vad"] = f"WITH {parsed} SELECT lang, word, arg_min({clip.format('v')}, line_no) AS v, arg_min({clip.format('a')}, line_no) AS a, arg_min({clip.format('d')}, line_no) AS d FROM g WHERE word <> '' AND NOT regexp_matches(word, '\\s') AND length(regexp_replace(word, '[^\\p{{L}}\\p{{N}}]', '', 'g')) / length(word) >= 0.5 GROUP BY lang, word"
    sql["lex_axis"] = f"SELECT lang, word, score FROM ({out['lex_intensity']}) WHERE emotion = 'fear'"
    sql["lex_installed"] = f"SELECT lang, emotion, count(*) AS words FROM ({out['lex_intensity']}) GROUP BY ALL"

    content = f"{SENT}, cw AS (SELECT doc_id, sent, sent * 100000 + k - 1 AS pos, w[k] AS word FROM (SELECT doc_id, sent, w, unnest(range(1, len(w) + 1)) AS k FROM sw) WHERE w[k] NOT IN ({fw}))"
    look = f"seed AS (SELECT lang, lower(word) AS word, arg_max(cluster || '_' || pole, ord) AS pole_name FROM (VALUES {values(p.rows(p.SEEDS))}) AS s(lang, cluster, pole, word, ord) GROUP BY ALL)"
    hits = f"{content}, {look}, h AS (SELECT cw.*, pole_name FROM cw JOIN seed ON seed.word = cw.word), n AS (SELECT doc_id, count(*) AS total FROM cw GROUP BY doc_id)"
    sql["macro_seed_hits"] = f"WITH {hits} SELECT doc_id, pole_name, round(count(*) / any_value(total) + 1e-9, 6) AS score FROM h JOIN n USING (doc_id) GROUP BY ALL"
    poles = sorted({f"{c}_{q}" for _, c, q in p.SEEDS})
    scores = f"ps AS (SELECT n.doc_id, pole_name, round(coalesce(c, 0) / total + 1e-9, 6) AS score FROM n CROSS JOIN (VALUES {values([(x,) for x in poles])}) AS t(pole_name) LEFT JOIN (SELECT doc_id, pole_name, count(*) AS c FROM h GROUP BY ALL) USING (doc_id, pole_name))"
    sql["macro_normalise"] = f"WITH {hits}, {scores} SELECT * FROM ps"
    sql["macro_pos_fallback"] = f"WITH {hits}, f AS (SELECT doc_id, word, min(pos) AS pos FROM cw WHERE length(word) > 1 AND doc_id NOT IN (SELECT doc_id FROM h) GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS k FROM f) SELECT doc_id, word, 'baseline_structural' AS pole_name FROM r WHERE k <= 10"
    sql["macro_entities"] = f"WITH {hits}, e AS (SELECT DISTINCT doc_id, sent, unnest(regexp_extract_all(s, '[A-Z][a-z]+ [A-Z][a-z]+')) AS entity FROM sent), w AS (SELECT doc_id, sent, pole_name, count(*) AS weight FROM h GROUP BY ALL), j AS (SELECT doc_id, entity, pole_name, weight, row_number() OVER (PARTITION BY doc_id, entity ORDER BY weight DESC, pole_name DESC) AS k FROM e JOIN w USING (doc_id, sent)), t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY weight DESC, entity) AS r FROM j WHERE k = 1) SELECT doc_id, entity, pole_name, weight FROM t WHERE r <= 5"
    sql["tel_drivers"] = f"WITH {hits}, c AS (SELECT doc_id, pole_name, word, count(*) AS weight FROM h GROUP BY ALL) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, pole_name ORDER BY weight DESC, word) AS rank FROM c) WHERE rank <= 5"
    others = p.rows(p.OTHER_SEEDS)
    prefixes = ("وال", "فال", "بال", "لل", "و", "ف", "ب", "ل", "ال")
    ar = [(w, f"{c}_{q}", 1, k) for lang, c, q, w, k in others if lang == "ar"] + [(x + w, f"{c}_{q}", 0, -k) for lang, c, q, w, k in others if lang == "ar" for x in prefixes]
    marks = r"[\x{0610}-\x{061A}\x{064B}-\x{065F}\x{0670}]"
    sql["macro_multi"] = f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(text, '{marks}', '', 'g'), '\\p{{Arabic}}+')) AS word FROM documents WHERE text IS NOT NULL), seed AS (SELECT word, arg_max(pole_name, prio * 1000 + ord) AS pole_name FROM (VALUES {values(ar)}) AS t(word, pole_name, prio, ord) GROUP BY word), n AS (SELECT doc_id, count(*) AS total FROM w GROUP BY doc_id) SELECT doc_id, pole_name, round(count(*) / any_value(total) + 1e-9, 6) AS score FROM w JOIN seed USING (word) JOIN n USING (doc_id) GROUP BY ALL"
    ko = [(w, f"{c}_{q}") for lang, c, q, w, _ in others if lang == "ko"]
    sql["macro_ko"] = f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[가-힣]+')) AS word FROM documents WHERE text IS NOT NULL), n AS (SELECT doc_id, count(*) AS total FROM w GROUP BY doc_id) SELECT doc_id, pole_name, round(count(*) / any_value(total) + 1e-9, 6) AS score FROM w JOIN (VALUES {values(ko)}) AS t(word, pole_name) USING (word) JOIN n USING (doc_id) GROUP BY ALL"
    zh = [(c, q, w, k) for lang, c, q, w, k in others if lang == "zh"]
    sql["macro_zh"] = f"WITH w AS (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]+')) AS word FROM documents WHERE text IS NOT NULL), d AS (SELECT word, arg_min(cluster, ord) AS cluster, arg_min(pole, ord) AS pole FROM (SELECT DISTINCT word FROM w) JOIN (VALUES {values(zh)}) AS t(cluster, pole, seed, ord) ON contains(word, seed) GROUP BY word) SELECT doc_id, cluster, pole, count(*) AS hits FROM w JOIN d USING (word) GROUP BY ALL"
    fields = [(f, w) for f, ws in p.FIELDS.items() for w in ws.split()]
    sql["wf_score"] = f"WITH {content}, n AS (SELECT doc_id, count(*) AS total FROM cw GROUP BY doc_id) SELECT doc_id, field, count(*) AS hits, round(count(*) / any_value(total) + 1e-9, 6) AS density FROM cw JOIN (VALUES {values(fields)}) AS t(field, word) USING (word) JOIN n USING (doc_id) GROUP BY doc_id, field"

    def z(source: str, name: str) -> str:
        r = "PARTITION BY variable ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
        return f"{name} AS (SELECT doc_id, variable, CASE WHEN n < 2 THEN value ELSE (value - mu) / sqrt(greatest(q, 1e-9)) END AS z FROM (SELECT doc_id, variable, value, count(*) OVER ({r}) AS n, avg(value) OVER ({r}) AS mu, var_samp(value) OVER ({r}) AS q FROM ({source})))"

    axes = out["micro_vectors"].split("u AS (SELECT * EXCLUDE (text)", 1)[1].replace("doc_id, win_idx", "doc_id")
    axes = "WITH src AS (SELECT doc_id, text FROM documents WHERE text IS NOT NULL), u AS (SELECT * EXCLUDE (text)" + axes
    micro = f"UNPIVOT (SELECT * FROM ({axes})) ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME variable VALUE value"
    macro = f"SELECT doc_id, pole_name AS variable, score AS value FROM ({sql['macro_normalise']}) UNION ALL SELECT doc_id, variable, value FROM (SELECT doc_id, unnest(['keigo_formal', 'keigo_casual']) AS variable, unnest([formal, casual]) AS value FROM ({out['macro_keigo']})) WHERE doc_id IN (SELECT doc_id FROM ({sql['macro_normalise']}))"
    pairs = "(VALUES " + values(v.BRIDGE) + ") AS bridge(micro_var, macro_var)"
    verdict = "CASE WHEN d > 4 THEN 'fracture' WHEN y > x THEN 'posturing' ELSE 'suppressed' END"
    events = f"WITH {z(micro, 'a')}, {z(macro, 'b')}, ev AS (SELECT a.doc_id, micro_var, macro_var, a.z AS x, b.z AS y, abs(b.z - a.z) AS d FROM a JOIN {pairs} ON a.variable = micro_var JOIN b ON b.doc_id = a.doc_id AND b.variable = macro_var)"
    sql["dis_bridge_poles"] = f"{events} SELECT doc_id, micro_var, macro_var, round(d + 1e-9, 4) AS delta, {verdict} AS conclusion FROM ev WHERE d > 2.5"

    def top(name: str, of: str) -> str:
        return f"{name} AS (SELECT * FROM (SELECT doc_id, variable, z, row_number() OVER (PARTITION BY doc_id ORDER BY abs(z) DESC, variable) AS rank FROM {of}) WHERE rank <= 3)"

    sql["dis_fallback_poles"] = f"{events}, {top('ta', 'a')}, {top('tb', 'b')}, f AS (SELECT ta.doc_id, ta.variable AS micro_var, tb.variable AS macro_var, ta.z AS x, tb.z AS y, abs(tb.z - ta.z) AS d FROM ta JOIN tb USING (doc_id, rank) WHERE doc_id NOT IN (SELECT doc_id FROM ev WHERE d > 2.5)) SELECT doc_id, micro_var, macro_var, round(d + 1e-9, 4) AS delta, {verdict} AS conclusion FROM f WHERE d > 2.5"

    lex = f"lex AS (SELECT * FROM ({sql['src_lex_vad']}) WHERE lang = 'en'), m AS (SELECT cw.doc_id, cw.pos, cw.word, v, a, d FROM cw JOIN lex USING (word))"
    stats = ", ".join(f"round(avg({c}) + 1e-9, 4) AS {c}_mean, round(stddev_pop({c}) + 1e-9, 4) AS {c}_sd" for c in "vad")
    filled = ", ".join(f"coalesce({c}_mean, 0.5) AS {c}_mean, coalesce({c}_sd, 0.0) AS {c}_sd" for c in "vad")
    sql["vad_all"] = f"WITH {content}, {lex}, g AS (SELECT doc_id, count(*) AS matched, {stats} FROM m GROUP BY doc_id) SELECT doc_id, coalesce(matched, 0) AS matched, {filled}, CASE WHEN matched IS NULL THEN 'no word of the text is in the lexicon' END AS note FROM (SELECT DISTINCT doc_id FROM documents) LEFT JOIN g USING (doc_id)"
    plane = "greatest(-1.0, least(1.0, d * 2 - 1)) AS power, greatest(-1.0, least(1.0, -0.7 * (v * 2 - 1) + 0.3 * (a * 2 - 1))) AS danger, greatest(-1.0, least(1.0, -(a * 2 - 1))) AS structure"
    emotions = ("anger", "anticipation", "disgust", "fear", "joy", "sadness", "surprise", "trust")
    wide = ", ".join(f"coalesce(max(score) FILTER (WHERE emotion = '{e}'), 0.0) AS {e}" for e in emotions)
    both = ", ".join(f"round(avg({c}) + 1e-9, 4) AS {c}_mean, round(stddev_pop({c}) + 1e-9, 4) AS {c}_sd" for c in ("power", "danger", "structure"))
    both += ", " + ", ".join(f"round(avg(coalesce({c}, 0.0)) + 1e-9, 4) AS {c}_mean, round(stddev_pop(coalesce({c}, 0.0)) + 1e-9, 4) AS {c}_sd" for c in emotions)
    sql["pds_agg"] = f"WITH {content}, {lex}, em AS (SELECT word, {wide} FROM ({out['lex_intensity']}) WHERE lang = 'en' GROUP BY word), x AS (SELECT m.*, {plane}, em.* EXCLUDE (word) FROM m LEFT JOIN em ON em.word = m.word) SELECT doc_id, count(*) AS matched, {both} FROM x GROUP BY doc_id"
    sql["pds_top60"] = f"WITH {content}, {lex}, x AS (SELECT doc_id, pos, word, {plane} FROM m), y AS (SELECT doc_id, pos, word, round(power + 1e-9, 4) AS power, round(danger + 1e-9, 4) AS danger FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(sqrt(power * power + danger * danger), 9) DESC, pos) AS rank FROM y) SELECT doc_id, rank, word, power, danger FROM z WHERE rank <= 60"

    t = "text"
    for pattern, by in (("(?s)```.*?```", " "), ("`[^`\\n]+`", " "), ("(?m)^[ \\t]*(?:#{1,6}|[*\\->|])[ \\t]*", ""), ("[A-Za-z]+", " "), ("[^가-힣ᄀ-ᇿ㄰-㆏\\s.,!?]", " "), ("[^\\S\\n]+", " "), ("(?m)([^\\s.!?])[ \\t]*$", "\\1."), ("\\s+", " "), ("^\\s+|\\s+$", "")):
        t = f"regexp_replace({t}, '{pattern}', '{by}', 'g')"
    sql["sanitize_ko"] = f"SELECT doc_id, {t} AS prose FROM documents WHERE text IS NOT NULL"
    taken = "list_transform(string_split(text, ''), lambda c: CASE WHEN c BETWEEN '가' AND '힣' THEN {0} || {1} || {2} ELSE c END)"
    o, u, f = "CAST(floor((unicode(c) - 44032) / 588) AS INT)", "CAST(floor(((unicode(c) - 44032) % 588) / 28) AS INT)", "((unicode(c) - 44032) % 28)"
    parts = taken.format(f"chr(4352 + {o})", f"chr(4449 + {u})", f"CASE WHEN {f} > 0 THEN chr(4519 + {f}) ELSE '' END")
    sql["hangul_decompose"] = f"SELECT doc_id, array_to_string({parts}, '') AS jamo FROM documents WHERE text IS NOT NULL"
    single = "".join(chr(b + k) for b, n in ((0x1100, 19), (0x1161, 21), (0x11A8, 27)) for k in range(n))
    counted = "".join(JAMO.values())
    ko24 = f"kl AS (SELECT doc_id, unnest(string_split(translate(jamo, '{single}', '{counted}'), '')) AS letter FROM ({sql['hangul_decompose']})), kc AS (SELECT doc_id, letter, count(*) AS n FROM kl WHERE letter IN ({quoted(tuple('ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎㅏㅑㅓㅕㅗㅛㅜㅠㅡㅣ'))}) GROUP BY ALL)"
    sql["letter_freq_ko24"] = f"WITH {ko24} SELECT * FROM kc"
    kind = "CASE WHEN letter IN ('ㅏ','ㅓ','ㅗ','ㅜ','ㅣ') THEN 'origin' WHEN letter IN ('ㄱ','ㄷ','ㅂ','ㅈ','ㅊ','ㅋ','ㅌ','ㅍ') THEN 'kinetic' WHEN letter IN ('ㄴ','ㄹ','ㅁ','ㅅ','ㅎ') THEN 'resonant' WHEN letter = 'ㅇ' THEN 'sovereign' ELSE 'liminal' END"
    sql["bpv_archetype"] = f"WITH {ko24} SELECT doc_id, {kind} AS archetype, CAST(sum(n) AS BIGINT) AS n FROM kc GROUP BY ALL"
    strokes = "CASE ch " + " ".join(f"WHEN '{c}' THEN {n}" for c, n in p.STROKES) + " ELSE 8 END"
    sql["micro_ja_all"] = f"WITH c AS (SELECT doc_id, text, length(regexp_replace(text, '[\\p{{P}}\\p{{Z}}\\n\\t]+', '', 'g')) AS n, len(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS k, len(regexp_extract_all(text, '[\\x{{3040}}-\\x{{309F}}]')) AS h, len(regexp_extract_all(text, '[\\x{{30A0}}-\\x{{30FF}}]')) AS t FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, avg({strokes}) AS d FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[\\x{{4E00}}-\\x{{9FFF}}]')) AS ch FROM c) GROUP BY doc_id) SELECT doc_id, round(100.0 * k / n + 1e-9, 4)::DOUBLE AS intensity, round(80.0 * k / n + 1e-9, 4)::DOUBLE AS attention, round(100.0 * h / n + 1e-9, 4)::DOUBLE AS emotion, round(100.0 * t / n + 1e-9, 4)::DOUBLE AS agitation, 0.0::DOUBLE AS anxiety, round(coalesce(d, 0.0) + 1e-9, 4)::DOUBLE AS complexity FROM c LEFT JOIN s USING (doc_id) WHERE n > 0"
    sql["truncate140"] = "SELECT doc_id, CASE WHEN length(text) <= 140 THEN text ELSE regexp_replace(substring(text, 1, 139), ' [^ ]*$', '') || '…' END AS excerpt FROM documents WHERE text IS NOT NULL"
    signal = out["som_categories"].split(" SELECT doc_id, CASE")[0]
    sql["som_wave"] = f"{signal} SELECT doc_id, pos, round(x - avg(x) OVER (PARTITION BY doc_id) + 1e-9, 4) AS value FROM sig WHERE pos < 256"
    sql["som_envelope20"] = f"{signal}, n AS (SELECT *, count(*) OVER (PARTITION BY doc_id) AS n FROM sig), e AS (SELECT doc_id, CAST(floor(((pos + 1) * 20 - 1) / n) AS BIGINT) AS bucket, round(avg(x) + 1e-9, 4) AS value FROM n GROUP BY ALL), d AS (SELECT DISTINCT doc_id, unnest(range(0, 20)) AS bucket FROM e) SELECT doc_id, d.bucket, coalesce(value, 0.0) AS value FROM d LEFT JOIN e USING (doc_id, bucket)"
    somatic = out["som_word"].rsplit(" SELECT * FROM wr", 1)[0]
    tiers = ", ".join(f"round(avg(CASE WHEN tier = {k} THEN 1.0 ELSE 0 END) + 1e-9, 4) AS tier_{k}" for k in (1, 2, 3))
    kinds = ", ".join(f"round(coalesce(sum(n) FILTER (WHERE category = '{c}'), 0) / sum(n) + 1e-9, 4) AS {c}" for c in v.WAVE_CATEGORIES)
    sql["som_shares"] = f"{somatic}, t AS (SELECT doc_id, {tiers} FROM ws JOIN wr USING (word) GROUP BY doc_id), k AS (SELECT doc_id, {kinds} FROM ({out['som_categories']}) GROUP BY doc_id) SELECT * FROM t JOIN k USING (doc_id)"

    def among(ws: list[str]) -> str:
        return f"len(list_filter(w, lambda x: x IN ({quoted(ws)})))"

    tok = r"t AS (SELECT doc_id, text, regexp_extract_all(lower(text), '\p{L}+') AS w FROM documents WHERE text IS NOT NULL)"
    sql["nar_tense"] = f"WITH {tok}, n AS (SELECT doc_id, len(list_filter(w, lambda x: x IN ({quoted(PAST)}) OR regexp_matches(x, '^[a-z]{{3,}}ed$'))) AS a, {among(PRESENT)} AS b, {among(FUTURE)} AS c FROM t WHERE len(w) > 0) SELECT doc_id, {', '.join(f'round({x} / (a + b + c) + 1e-9, 3) AS tense_{name}' for x, name in (('a', 'past'), ('b', 'present'), ('c', 'future')))} FROM n WHERE a + b + c > 0"
    sql["nar_subord"] = f"WITH {SENT}, n AS (SELECT doc_id, count(*) AS s FROM sent GROUP BY doc_id), {tok} SELECT doc_id, round({among(SUBORDINATING)} / greatest(1, s) + 1e-9, 4) AS subordination_ratio FROM t JOIN n USING (doc_id) WHERE len(w) > 0"
    sql["rh_places"] = f"WITH c AS (SELECT doc_id, text, string_split(regexp_replace(text, '([.!?]\\s+)', '\\1' || chr(1), 'g'), chr(1)) AS l FROM documents WHERE text IS NOT NULL), x AS (SELECT doc_id, text, l[k] AS c, k, coalesce(list_sum(list_transform(l[1:k - 1], lambda y: length(y))), 0) AS o FROM (SELECT *, unnest(range(1, len(l) + 1)) AS k FROM c)), y AS (SELECT doc_id, text, k, regexp_replace(c, '^\\s+|\\s+$', '', 'g') AS s, CAST(o + length(c) - length(regexp_replace(c, '^\\s+', '')) AS BIGINT) AS start_char FROM x), z AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY k) - 1 AS sent FROM y WHERE length(s) > 0) SELECT doc_id, sent, start_char, length(substring(text, 1, start_char)) - length(replace(substring(text, 1, start_char), chr(10), '')) + 1 AS line_no, CASE WHEN length(s) <= 140 THEN s ELSE regexp_replace(substring(s, 1, 139), ' [^ ]*$', '') || '…' END AS excerpt FROM z"

    made = f"FROM (SELECT doc_id, text FROM documents UNION ALL SELECT * FROM (VALUES {values(p.DEVICES)}) AS dv(doc_id, text))"

    def on_made(query: str) -> str:
        return query.replace("FROM documents", made)

    def has(phrases: list[str], where: str) -> str:
        return "(" + " OR ".join(f"contains({where}, '{x}')" for x in phrases) + ")"

    words = {"logos": v.LOGOS, "ethos": v.ETHOS, "pathos": v.PATHOS}
    found = "CASE dominant " + " ".join(f"WHEN '{n}' THEN list_concat(list_filter([{quoted(v.PHRASES[n])}], lambda q: contains(lower(s), q)), list_filter(w, lambda x, i: x IN ({quoted(ws)}) AND list_position(w, x) = i))" for n, ws in words.items()) + " END"
    function = f"CASE WHEN {has(EVIDENCE, 'lower(s)')} THEN 'evidence' WHEN {has(OPENERS, 'substring(lower(s), 1, 60)')} OR {among(CLAIM_VERBS)} > 0 THEN 'claim' WHEN {has(PREMISE, 'lower(s)')} OR {among(MARKERS)} > 0 THEN 'premise' ELSE 'appeal' END"
    sql["arg_function"] = on_made(f"WITH {SENT}, g AS ({out['arg_score']}), j AS (SELECT sw.doc_id, sw.sent, s, w, dominant, greatest(logos, ethos, pathos) AS best FROM sw JOIN g ON g.doc_id = sw.doc_id AND g.sent = sw.sent), f AS (SELECT *, {found} AS q FROM j) SELECT doc_id, sent, dominant, {function} AS \"function\", CASE WHEN best >= 4 THEN 0.85::DOUBLE ELSE 0.78::DOUBLE END AS confidence, array_to_string((list_filter(q, lambda x, i: list_position(q, x) = i))[1:8], '|') AS triggers FROM f")
    for name in ("rh_simile", "rh_hyperbole", "rh_litotes", "rh_polysyndeton", "rh_oxymoron"):
        sql[f"{name}_made"] = on_made(out[name])
    pattern = f"(?i)\\b(?:the|a|an|this|that|these|those)\\s+([a-z]+)\\s+((?:{'|'.join(HUMAN)})(?:s|es|ed|d)?)\\b"
    sql["rh_personification_made"] = on_made(f"WITH {SENT} SELECT doc_id, sent, lower(regexp_extract(s, '{pattern}', 1)) AS noun, lower(regexp_extract(s, '{pattern}', 2)) AS verb FROM sent WHERE regexp_matches(s, '{pattern}')")
    extent = r"(?i)\b(?:in\s+(?:the\s+)?(?:world|history|existence|all\s+creation)|of\s+all\s+time|ever(?:\s+made|\s+seen|\s+written|\s+lived)?|since\s+(?:the\s+)?(?:beginning|dawn)\s+of\s+(?:time|history))\b"
    likers = quoted("i you we they to would not don t people who ll d could might will".split())
    no_top = quoted("forest interest request harvest honest protest contest guest west rest test quest priest chest arrest invest suggest modest earnest tempest conquest".split())
    like = f"len(list_filter(range(2, len(w) + 1), lambda k: w[k] = 'like' AND w[k - 1] NOT IN ({likers}))) > 0"
    best = f"len(list_filter(w, lambda x: regexp_matches(x, '^(?:most|best|worst|least|[a-z]{{3,}}est)$') AND x NOT IN ({no_top}))) > 0"
    three = r"len(list_filter(string_split(s, ','), lambda x: regexp_matches(x, '\p{L}'))) >= 3"

    def device(name: str, confidence: str, source: str) -> str:
        return f"SELECT doc_id, sent, '{name}' AS device, round(max({confidence}), 2)::DOUBLE AS confidence FROM ({source}) GROUP BY doc_id, sent"

    toks = f"WITH {SENT}, x AS (SELECT doc_id, sent, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS pos FROM sw)"
    deny = f"{toks} SELECT a.doc_id, a.sent, CASE WHEN regexp_matches(b.word, '^(?:un|in|im|ir|il|dis|non)[a-z]{{4,}}$') THEN 0.8 WHEN b.word IN ({quoted(v.NEGATIVE)}) THEN 0.7 END AS c FROM x a JOIN x b ON b.doc_id = a.doc_id AND b.sent = a.sent AND b.pos BETWEEN a.pos + 1 AND a.pos + 3 WHERE a.word = 'not'"
    sql["rh_findings"] = on_made(" UNION ALL ".join([
        f"SELECT * FROM (WITH {SENT} SELECT doc_id, sent, 'simile' AS device, (CASE WHEN {like} THEN 0.88 WHEN regexp_matches(s, '{v.SIMILE}') THEN 0.82 END)::DOUBLE AS confidence FROM sw) WHERE confidence IS NOT NULL",
        f"SELECT * FROM (WITH {SENT} SELECT doc_id, sent, 'hyperbole' AS device, (CASE WHEN {best} AND regexp_matches(s, '{extent}') THEN 0.82 WHEN regexp_matches(s, '{v.HYPERBOLE}') THEN 0.75 END)::DOUBLE AS confidence FROM sw) WHERE confidence IS NOT NULL",
        f"SELECT * FROM (WITH {SENT} SELECT doc_id, sent, 'asyndeton' AS device, 0.8::DOUBLE AS confidence FROM sw WHERE len(regexp_extract_all(s, ',')) >= 2 AND len(list_filter(w, lambda q: q IN ('and', 'or', 'nor', 'but'))) = 0 AND {three})",
        device("polysyndeton", "least(0.92, 0.68 + 0.06 * n)", out["rh_polysyndeton"]),
        device("litotes", "c", f"SELECT * FROM ({deny}) WHERE c IS NOT NULL"),
        device("antithesis", "CASE WHEN \"pivot\" IN ('but', 'yet', 'whereas') THEN 0.8 ELSE 0.65 END", out["rh_antithesis"]),
        device("oxymoron", "0.85", out["rh_oxymoron"]),
        device("alliteration", "confidence", out["rh_alliteration"]),
        device("assonance", "least(0.78, 0.52 + 0.08 * n)", out["rh_assonance"]),
        f"SELECT doc_id, sent, 'personification' AS device, 0.82::DOUBLE AS confidence FROM (WITH {SENT} SELECT doc_id, sent FROM sent WHERE regexp_matches(s, '{pattern}'))",
    ]))
    order = "CASE cluster " + " ".join(f"WHEN '{c}' THEN {k}" for k, c in enumerate(v.LETTER_CLUSTERS)) + " END"
    sql["lar_posturing"] = f"WITH r AS (SELECT doc_id, cluster AS dominant FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY percent DESC, {order}) AS k FROM ({out['lar_radar']})) WHERE k = 1), b AS (SELECT doc_id, pole_name AS pole FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, pole_name) AS k FROM ({sql['macro_seed_hits']})) WHERE k = 1) SELECT doc_id, dominant, pole, coalesce(pole = 'kinetic_aggression' AND dominant = 'structural', false) AS is_posturing FROM r LEFT JOIN b USING (doc_id)"

    letters = f"e AS (SELECT 'd' || doc_id AS doc, letter AS feature, CAST(n AS DOUBLE) AS w FROM ({out['letter_freq_latin']})), c AS (SELECT DISTINCT 'd' || doc_id AS doc, coalesce(source, 'none') AS corpus FROM documents)"

    def matrix(name: str, where: str) -> str:
        own = f"SELECT e.* FROM e WHERE {where}"
        return f"{name} AS (SELECT a.feature AS i, b.feature AS j, sum(a.w * b.w) AS value FROM ({own}) a JOIN ({own}) b USING (doc) GROUP BY ALL)"

    def jaccard(name: str, of: str) -> str:
        return f"{name} AS (SELECT m.i, m.j, CASE WHEN coalesce(x.value, 0) + coalesce(y.value, 0) > 0 THEN 2 * m.value / (coalesce(x.value, 0) + coalesce(y.value, 0)) ELSE 0 END AS value FROM {of} m LEFT JOIN {of} x ON x.i = m.i AND x.j = m.i LEFT JOIN {of} y ON y.i = m.j AND y.j = m.j)"

    wire, opinion = (f"doc IN (SELECT doc FROM c WHERE corpus = '{x}')" for x in ("wire_dispatch", "op_ed"))
    either = "doc IN (SELECT doc FROM c WHERE corpus IN ('wire_dispatch', 'op_ed'))"
    sql["g_cooc_all"] = f"WITH {letters}, {matrix('m', either)} SELECT i, j, value FROM m"
    sql["g_laplacian_all"] = f"WITH {letters}, {matrix('m', either)}, o AS (SELECT i, j, -value AS value FROM m WHERE i <> j) SELECT i, j, value FROM o UNION ALL SELECT i, i AS j, -sum(value) AS value FROM o GROUP BY i"
    sql["g_jaccard_all"] = f"WITH {letters}, {matrix('m', either)}, {jaccard('jj', 'm')} SELECT i, j, round(value + 1e-9, 6) AS value FROM jj"
    both = f"WITH {letters}, {matrix('m', wire)}, {matrix('k', opinion)}, {jaccard('x', 'm')}, {jaccard('y', 'k')}, dv AS (SELECT coalesce(x.i, y.i) AS i, coalesce(x.j, y.j) AS j, coalesce(x.value, 0) - coalesce(y.value, 0) AS value FROM x FULL JOIN y ON x.i = y.i AND x.j = y.j)"
    sql["g_divergence_all"] = f"{both} SELECT i, j, round(value + 1e-9, 6) AS value FROM dv"
    sql["g_frobenius"] = f"{both} SELECT round(coalesce(sqrt(sum(value * value)), 0.0) + 1e-9, 6) AS norm FROM dv"
    first = "(SELECT 'd' || min(doc_id) FROM documents)"
    one = "doc = (SELECT 'd' || min(doc_id) FROM documents WHERE lang = 'en')"
    sql["g_doc_matrix"] = f"WITH {letters}, {matrix('m', one)} SELECT i, j, value FROM m"
    sql["g_corpora"] = "SELECT coalesce(source, 'none') AS corpus, count(DISTINCT doc_id) AS documents FROM documents GROUP BY ALL"
    sql["g_corpus_docs"] = "SELECT 'd' || doc_id AS id, title, lang FROM documents WHERE source = 'wire_dispatch'"
    sql["g_ephemeral"] = f"WITH {WIN}, lt AS (SELECT doc_id, win_idx, letter AS feature, CAST(count(*) AS DOUBLE) AS w FROM (SELECT doc_id, win_idx, unnest(string_split(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^A-Z]+', '', 'g'), '')) AS letter FROM win WHERE doc_id IN (SELECT doc_id FROM documents WHERE source = 'wire_dispatch')) WHERE letter <> '' GROUP BY ALL) SELECT a.feature AS i, b.feature AS j, sum(a.w * b.w) AS value FROM lt a JOIN lt b USING (doc_id, win_idx) GROUP BY ALL"
    sql["g_related"] = f"SELECT relation, count(DISTINCT dst) AS features FROM (SELECT 'd' || doc_id AS src, letter AS dst, 'CO_OCCURS_WITH' AS relation FROM ({out['letter_freq_latin']}) UNION ALL SELECT 'd' || doc_id, coalesce(source, 'none'), 'BELONGS_TO' FROM documents) WHERE src = {first} GROUP BY relation"
    edges = f"(SELECT 'd' || doc_id AS src, letter AS dst, 'CO_OCCURS_WITH' AS relation FROM ({out['letter_freq_latin']}) UNION ALL SELECT 'd' || doc_id, coalesce(source, 'none'), 'BELONGS_TO' FROM documents)"
    sql["g_remove_corpus"] = f"SELECT relation, count(*) AS edges FROM {edges} WHERE NOT (relation = 'BELONGS_TO' AND dst = 'wire_dispatch') GROUP BY relation UNION ALL SELECT 'any node', count(DISTINCT id) FROM (SELECT src AS id FROM {edges} UNION ALL SELECT dst FROM {edges}) WHERE id <> 'wire_dispatch'"
    axes_of = out["cmp_delta"].split(" SELECT count(*) AS windows")[0]
    sql["analyze_windows"] = f"{axes_of} SELECT w.* EXCLUDE (digest), total_words, total_chars, avg_word_length, anxiety, attention, emotion, agitation, round(total_words / (end_line - start_line + 1), 2) AS words_per_line FROM ({out['win_slide']}) w JOIN ({out['tel_words']}) t USING (doc_id, win_idx) LEFT JOIN ax USING (doc_id, win_idx)"
    sql["g_trace"] = f"SELECT round(sum(value), 3)::DOUBLE AS trace FROM ({out['g_laplacian']}) WHERE i = j"
    sql["cmp_events"] = "WITH o AS (SELECT DISTINCT request_id, entity_id FROM analysis_requests), e AS (SELECT DISTINCT event_id, request_id, trigger_type FROM dissonance_events) SELECT trigger_type, count(*) FILTER (WHERE entity_id IS NOT NULL) AS events_a, count(*) FILTER (WHERE entity_id IS NULL) AS events_b, count(*) FILTER (WHERE entity_id IS NULL) - count(*) FILTER (WHERE entity_id IS NOT NULL) AS difference FROM e JOIN o USING (request_id) GROUP BY trigger_type"
    sql["ent_baseline"] = f"WITH a AS (UNPIVOT (SELECT * FROM ({out['micro_axes']})) ON COLUMNS(* EXCLUDE (doc_id)) INTO NAME variable VALUE value) SELECT entity_id, variable, count(*) AS n, round(round(avg(value) + 1e-9, 6) + 1e-9, 4) AS mu, round(round(CASE WHEN count(*) < 2 THEN 1.0 ELSE sqrt(greatest(var_samp(value), 1e-9)) END + 1e-9, 6) + 1e-9, 4) AS sigma FROM a JOIN (SELECT doc_id, entity_id FROM documents WHERE entity_id IS NOT NULL) USING (doc_id) GROUP BY ALL"
    weights = {"first": [7, 9, 5, 7, 9, 6, 6, 7, 9, 8, 9, 5, 7, 9, 8, 8, 8, 8, 6], "vowel": [7, 6, 6, 5, 6, 5, 5, 5, 7, 6, 5, 6, 5, 7, 6, 5, 6, 5, 5, 5, 7], "final": [7, 9, 7, 5, 5, 5, 7, 6, 6, 6, 6, 6, 6, 6, 6, 6, 7, 7, 8, 9, 5, 7, 8, 8, 8, 8, 6]}
    weigh = dict(zip(single, [x for of in weights.values() for x in of], strict=True))
    case = "CASE {} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in weigh.items()) + " ELSE 0 END"
    doubles = {"ㄱ": 1.5, "ㄴ": 1.4, "ㄷ": 1.5, "ㄹ": 1.4, "ㅁ": 1.4, "ㅂ": 1.5, "ㅅ": 1.8, "ㅇ": 1.2, "ㅈ": 1.6, "ㅊ": 1.6, "ㅋ": 1.5, "ㅌ": 1.5, "ㅍ": 1.5, "ㅎ": 1.2}
    twice = "CASE {} " + " ".join(f"WHEN '{k}' THEN {x}" for k, x in doubles.items()) + " ELSE 1.3 END"
    act = {"ㄱㄹ": 1.7, "ㅅㄴ": 0.8, "ㄷㅇ": 0.7, "ㅁㅏ": 1.5, "ㄹㅡ": 1.4, "ㅈㅣ": 1.6, "ㅎㄱ": 1.9}

    def acts(other: str) -> str:
        return "CASE " + " ".join(f"WHEN q || {other} IN ('{x}', '{x[::-1]}') THEN {y}" for x, y in act.items()) + " END"

    halves = ", ".join(f"({case.format('c')} + {case.format(c)}) * {acts(q)} * {reach} / 2" for c, q, reach in (("c1", "q1", 0.5), ("c2", "q2", 1.0), ("c3", "q3", 1.0), ("c4", "q4", 0.5)))
    at = ", ".join(f"substring('  ' || word || '  ', k + {d}, 1) AS {c}, substring('  ' || kinds || '  ', k + {d}, 1) AS {q}" for d, c, q in ((0, "c1", "q1"), (1, "c2", "q2"), (2, "c", "q"), (3, "c3", "q3"), (4, "c4", "q4")))
    share = ", ".join(f"round(100.0 * sum(CASE WHEN kind IN ({quoted(tuple(of))}) THEN w ELSE 0 END) / sum(w) + 1e-9, 6) AS {name}" for name, of in (("anxiety", "ㅅㄴ"), ("attention", "ㄱㅇ"), ("emotion", "ㅁㅏ"), ("agitation", "ㄹㅈ")))
    sql["micro_ko"] = f"""WITH u AS (SELECT doc_id, unnest(regexp_extract_all(jamo, '[{single}]+')) AS word FROM ({sql['hangul_decompose']})), dw AS (SELECT DISTINCT word, translate(word, '{single}', '{counted}') AS kinds FROM u),
lk AS (SELECT word, kinds, regexp_replace(kinds, '{"|".join(x * 2 for x in "ㄱㄴㄷㄹㅁㅂㅅㅇㅈㅊㅋㅌㅍㅎㅏㅑㅓㅕㅗㅛㅜㅠㅡㅣ")}', '12', 'g') AS d, unnest(range(1, length(word) + 1)) AS k FROM dw), lt AS (SELECT word, kinds, k, substring(d, k, 1) AS f, {at} FROM lk),
sc AS (SELECT word, sum(CASE f WHEN '1' THEN {case.format('c')} * {twice.format('q')} / 2 WHEN '2' THEN {case.format('c2')} * {twice.format('q')} / 2 ELSE coalesce({halves}, {case.format('c')} * CASE WHEN k = 1 THEN 1.5 WHEN k = length(word) THEN 0.75 ELSE 1.0 END) END) * CASE WHEN regexp_matches(any_value(kinds), '[ㄹㅊㅌㅍㅎㅠ]') THEN 1.2 ELSE 1.0 END AS score, CASE WHEN regexp_matches(any_value(kinds), '[ㄹㅊㅌㅍㅎㅠ]') THEN 1 ELSE 0 END AS visual FROM lt GROUP BY word),
ws AS (SELECT doc_id, round(sum(score) + 1e-9, 4) AS raw, sum(length(word)) AS chars, sum(visual)::DOUBLE AS complexity FROM u JOIN sc USING (word) GROUP BY doc_id), sy AS (SELECT doc_id, len(regexp_extract_all(text, '[가-힣]')) AS n FROM documents),
ll AS (SELECT doc_id, unnest(string_split(word, '')) AS l FROM u), lw AS (SELECT doc_id, translate(l, '{single}', '{counted}') AS kind, {case.format('l')} AS w FROM ll), sh AS (SELECT doc_id, {share} FROM lw GROUP BY doc_id)
SELECT doc_id, round(raw / greatest(1, CASE WHEN n > 0 THEN n ELSE chars END) + 1e-9, 4) AS intensity, anxiety, attention, emotion, agitation, complexity FROM ws JOIN sy USING (doc_id) JOIN sh USING (doc_id)"""
    return sql | literary(out, "DE") | literary(out, "FR")
