"""Queries over the test tables for the core operators. Integers come out as bigint, for the SQL's sake."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from textloom import oracle, parameters
from textloom.functions import text as fx
from textloom.operators import affect, baseline, compare, entity, entropy, graph, lexicons, literary, macro, micro, rejects, telemetry, wave, windows
from textloom.plans import analyze
from textloom.sources import table

KEY = ["doc_id"]
Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}


def wide(df: DataFrame) -> DataFrame:
    """Whole numbers as bigint."""
    return df.select(*[F.col(f"`{f.name}`").cast("bigint").alias(f.name) if isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)) else F.col(f"`{f.name}`") for f in df.schema])


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = lambda spark, folder: wide(f(spark, folder))
    return f


def docs(spark: SparkSession, folder: str, *more: str) -> DataFrame:
    return table(spark, folder, "documents", "doc_id", "text", *more)


def rounded(df: DataFrame, digits: int, *columns: str) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c) + 1e-9, digits) for c in columns})


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.failures(table(spark, folder, "lexicon_raw"))


@query
def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return rejects.loaded(table(spark, folder, "lexicon_raw"))


# windows and places


@query
def win_boundaries(spark: SparkSession, folder: str) -> DataFrame:
    return windows.segments(docs(spark, folder)).select("doc_id", "seg", "offset", F.length("seg_text").alias("length"), "eof")


@query
def win_slide(spark: SparkSession, folder: str) -> DataFrame:
    return windows.windows(docs(spark, folder)).withColumn("digest", F.md5("text")).drop("text")


@query
def win_counts_per_doc(spark: SparkSession, folder: str) -> DataFrame:
    return windows.plain_windows(docs(spark, folder)).groupBy("doc_id").agg(F.count("*").alias("n_windows"))


@query
def line_index(spark: SparkSession, folder: str) -> DataFrame:
    return windows.line_index(docs(spark, folder))


@query
def snippets(spark: SparkSession, folder: str) -> DataFrame:
    return windows.snippets(docs(spark, folder).filter("text IS NOT NULL")).drop("text")


@query
def sent_split(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).select("doc_id", F.posexplode(fx.sentences(F.col("text"))).alias("sent", "s"))


@query
def sanitize_prose(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", fx.prose(F.col("text")).alias("prose"))


@query
def german_fold(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", fx.german_fold(F.col("text")).alias("folded"))


# telemetry


@query
def tel_words(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.word_counts(windows.plain_windows(docs(spark, folder))).drop("text")


@query
def tel_top5(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.top_letters(telemetry.latin_letters(docs(spark, folder), KEY), KEY)


@query
def tel_doubles(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.doubles(docs(spark, folder), KEY)


@query
def letter_freq_latin(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.latin_letters(docs(spark, folder), KEY)


@query
def letter_freq_ru(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.cyrillic_letters(docs(spark, folder), KEY)


@query
def letter_freq_ar(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.arabic_letters(docs(spark, folder), KEY)


@query
def letter_freq_fa(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.arabic_letters(docs(spark, folder), KEY, farsi=True)


@query
def letter_freq_ko(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.hangul_letters(docs(spark, folder), KEY)


@query
def stego_flag(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.hidden(docs(spark, folder).filter("text IS NOT NULL")).drop("text")


@query
def punct_wave(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.pause_wave(docs(spark, folder), KEY)


@query
def ja_scripts(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.scripts_ja(docs(spark, folder).filter("text IS NOT NULL")).drop("text")


# letter weights


@query
def micro_axes(spark: SparkSession, folder: str) -> DataFrame:
    return micro.axes(docs(spark, folder), KEY)


@query
def bpv_words(spark: SparkSession, folder: str) -> DataFrame:
    return micro.score_words(micro.vocabulary(docs(spark, folder)))


@query
def bpv_window(spark: SparkSession, folder: str) -> DataFrame:
    return micro.window_scores(windows.plain_windows(docs(spark, folder)), ["doc_id", "win_idx"])


@query
def bpv_pairs(spark: SparkSession, folder: str) -> DataFrame:
    return micro.pair_events(docs(spark, folder), KEY)


@query
def bpv_doubles(spark: SparkSession, folder: str) -> DataFrame:
    return micro.double_events(docs(spark, folder), KEY)


@query
def bpv_letters(spark: SparkSession, folder: str) -> DataFrame:
    return micro.letter_totals(docs(spark, folder), KEY)


@query
def letter_freq_latin26(spark: SparkSession, folder: str) -> DataFrame:
    return telemetry.all_letters(docs(spark, folder), KEY)


@query
def micro_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return micro.vectors(windows.plain_windows(docs(spark, folder)), ["doc_id", "win_idx"])


@query
def micro_es(spark: SparkSession, folder: str) -> DataFrame:
    return micro.vectors(docs(spark, folder, "lang").filter("lower(lang) = 'es'"), KEY, language="ES")


@query
def micro_fr(spark: SparkSession, folder: str) -> DataFrame:
    return micro.vectors(docs(spark, folder, "lang").filter("lower(lang) = 'fr'"), KEY, language="FR")


@query
def micro_de(spark: SparkSession, folder: str) -> DataFrame:
    d = docs(spark, folder, "lang").filter("lower(lang) = 'de'").withColumn("text", fx.german_fold(F.col("text")))
    return micro.vectors(d, KEY)


def _vectors(language: str) -> Query:
    return lambda spark, folder: micro.vectors(docs(spark, folder, "lang").filter(F.lower("lang") == language), KEY, language=language.upper())


def _letter_axes(language: str) -> Query:
    def f(spark: SparkSession, folder: str) -> DataFrame:
        return micro.axes(docs(spark, folder), KEY, language=language.upper())

    return f


for _language in ("ru", "ar", "fa"):
    _f = _vectors(_language)
    _f.__name__ = f"micro_{_language}"
    query(_f)
    _f = _letter_axes(_language)
    _f.__name__ = f"micro_axes_{_language}"
    query(_f)


@query
def micro_ja(spark: SparkSession, folder: str) -> DataFrame:
    return micro.script_axes(docs(spark, folder), KEY)


@query
def micro_ja_all(spark: SparkSession, folder: str) -> DataFrame:
    """Shares of all characters but blanks and punctuation, and the mean of strokes."""
    return micro.japanese(docs(spark, folder), spark.createDataFrame(parameters.STROKES, "ch string, n int"), KEY)


@query
def micro_zh(spark: SparkSession, folder: str) -> DataFrame:
    return micro.stroke_axes(docs(spark, folder), spark.createDataFrame(parameters.STROKES, "ch string, n int"), KEY)


@query
def sanitize_ru(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", fx.prose_of_script(F.col("text")).alias("prose"))


@query
def sanitize_abjad(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", fx.prose_of_script(F.col("text"), fx.HARAKAT, ".!?،؟").alias("prose"))


@query
def macro_keigo(spark: SparkSession, folder: str) -> DataFrame:
    return macro.politeness(docs(spark, folder), KEY)


# entropy and wave


@query
def ent_burstiness(spark: SparkSession, folder: str) -> DataFrame:
    return entropy.entropy(docs(spark, folder), KEY)


@query
def som_word(spark: SparkSession, folder: str) -> DataFrame:
    return wave.words(docs(spark, folder))


@query
def som_window(spark: SparkSession, folder: str) -> DataFrame:
    return wave.summary(docs(spark, folder), KEY).select("doc_id", "mean_sigma", "root", "tier", "label")


@query
def som_envelope(spark: SparkSession, folder: str) -> DataFrame:
    return wave.envelope(docs(spark, folder), KEY)


@query
def som_categories(spark: SparkSession, folder: str) -> DataFrame:
    return wave.categories(docs(spark, folder), KEY)


@query
def som_fft(spark: SparkSession, folder: str) -> DataFrame:
    return wave.spectrum(docs(spark, folder), KEY)


# baselines


@query
def base_welford(spark: SparkSession, folder: str) -> DataFrame:
    out = baseline.running(table(spark, folder, "events"), ["event_type"], ["event_id"]).select("event_id", "event_type", "n", "mu", "sigma", "z")
    return rounded(rounded(out, 5, "mu", "sigma"), 4, "z")


@query
def base_ema(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(baseline.moving_average(table(spark, folder, "events"), ["event_type"], ["event_id"]).select("event_id", "event_type", "ema"), 5, "ema")


@query
def base_snapshot(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(baseline.snapshot(table(spark, folder, "events"), ["event_type"]), 5, "mu", "sigma")


@query
def base_seed(spark: SparkSession, folder: str) -> DataFrame:
    """The events of the first half of the time are the control, the others are scored."""
    e = table(spark, folder, "events", "event_id", "event_type", "ts", "value")
    first, last = e.agg(F.unix_micros(F.min("ts").cast("timestamp")), F.unix_micros(F.max("ts").cast("timestamp"))).first()
    e = e.withColumn("early", F.unix_micros(F.col("ts").cast("timestamp")) < ((first or 0) + (last or 0)) // 2)
    out = baseline.seeded(e.filter("early"), e.filter("NOT early"), ["event_type"], ["event_id"]).select("event_id", "event_type", "n", "mu", "sigma", "z")
    return rounded(rounded(out, 5, "mu", "sigma"), 4, "z")


@query
def base_state(spark: SparkSession, folder: str) -> DataFrame:
    """The state of each variable after its last value, moving average included."""
    return rounded(baseline.states(table(spark, folder, "events"), ["event_type"], ["event_id"]), 5, "mu", "sigma", "ema")


def _z_scores(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Micro axes and, standing in for a seed table, word measures as the other side; z over all documents."""
    d = docs(spark, folder)
    a = micro.axes(d, KEY).unpivot(KEY, ["anxiety", "attention", "emotion", "agitation"], "variable", "value")
    b = literary.word_lengths(d, KEY).select("doc_id", F.col("short_share").alias("power_control"), F.col("middle_share").alias("power_submission"), F.col("long_share").alias("visibility_exposure"), F.col("mean_length").alias("kinetic_aggression"))
    b = b.unpivot(KEY, ["power_control", "power_submission", "visibility_exposure", "kinetic_aggression"], "variable", "value")
    return baseline.running(a, ["variable"], KEY), baseline.running(b, ["variable"], KEY)


@query
def dis_bridge(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(baseline.bridge_events(*_z_scores(spark, folder), KEY), 4, "delta")


@query
def dis_fallback(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _z_scores(spark, folder)
    return rounded(baseline.ranked_events(a, b, baseline.bridge_events(a, b, KEY), KEY), 4, "delta")


# clusters and affect


@query
def macro_centroids(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(macro.centroids(table(spark, folder, "embeddings")), 5, "value")


@query
def macro_cosine(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "embeddings")
    return rounded(macro.similar(v, macro.centroids(v), least=0.1), 4, "sim")


def _tokens(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder, "lang").select("doc_id", F.lower("lang").alias("lang"), F.explode(literary.tokens(F.col("text"))).alias("word"))


@query
def macro_exact(spark: SparkSession, folder: str) -> DataFrame:
    """The lexicon's words as seeds: emotion as cluster, strong or weak as pole."""
    lex = affect.intensity(rejects.loaded(table(spark, folder, "lexicon_raw")))
    seeds = lex.select("lang", F.col("emotion").alias("cluster"), F.when(F.col("score") >= 0.5, "strong").otherwise("weak").alias("pole"), "word", F.concat("emotion", F.col("score").cast("string")).alias("ord"))
    return macro.pole_scores(_tokens(spark, folder), seeds, KEY)


@query
def lex_intensity(spark: SparkSession, folder: str) -> DataFrame:
    return affect.intensity(rejects.loaded(table(spark, folder, "lexicon_raw")))


@query
def pds_affect(spark: SparkSession, folder: str) -> DataFrame:
    return affect.profile(_tokens(spark, folder), affect.intensity(rejects.loaded(table(spark, folder, "lexicon_raw"))), KEY)


@query
def pds_rotate(spark: SparkSession, folder: str) -> DataFrame:
    lex = affect.intensity(rejects.loaded(table(spark, folder, "lexicon_raw"))).groupBy("lang", "word")
    s = {e: F.coalesce(F.max(F.when(F.col("emotion") == e, F.col("score"))), F.lit(0.0)) for e in rejects.EMOTIONS}
    return affect.rotate(lex.agg(F.greatest(s["joy"], s["trust"]).alias("v"), F.greatest(s["anger"], s["surprise"]).alias("a"), F.greatest(s["disgust"], s["anticipation"]).alias("d")))


def _vad_lexicon(spark: SparkSession, folder: str) -> DataFrame:
    return pds_rotate(spark, folder).select("lang", "word", "v", "a", "d")


@query
def vad_agg(spark: SparkSession, folder: str) -> DataFrame:
    return affect.valence(_tokens(spark, folder), _vad_lexicon(spark, folder), KEY)


@query
def pds_triggers(spark: SparkSession, folder: str) -> DataFrame:
    return affect.triggers(vad_agg(spark, folder), pds_affect(spark, folder), KEY)


@query
def lex_fallback(spark: SparkSession, folder: str) -> DataFrame:
    lex = affect.intensity(rejects.loaded(table(spark, folder, "lexicon_raw")))
    return affect.with_fallback(lex, ["de", "es", "en"]).groupBy("lang", "emotion").agg(F.count("*").alias("words"))


# literary


@query
def lar_radar(spark: SparkSession, folder: str) -> DataFrame:
    return literary.letter_radar(docs(spark, folder), KEY)


@query
def lex_trend(spark: SparkSession, folder: str) -> DataFrame:
    return literary.progression(literary.curve(docs(spark, folder), KEY), KEY)


@query
def lex_label(spark: SparkSession, folder: str) -> DataFrame:
    return literary.moving_ttr(docs(spark, folder), KEY).select("doc_id", literary.richness_label(F.col("mattr")).alias("label"))


@query
def sty_ttr(spark: SparkSession, folder: str) -> DataFrame:
    return literary.variety(docs(spark, folder), KEY)


@query
def sty_funcwords(spark: SparkSession, folder: str) -> DataFrame:
    return literary.function_words(docs(spark, folder), KEY)


@query
def sty_sentlen(spark: SparkSession, folder: str) -> DataFrame:
    return literary.sentence_lengths(docs(spark, folder), KEY)


@query
def sty_wordlen(spark: SparkSession, folder: str) -> DataFrame:
    return literary.word_lengths(docs(spark, folder), KEY)


@query
def sty_punct(spark: SparkSession, folder: str) -> DataFrame:
    return literary.punctuation(docs(spark, folder), KEY)


@query
def nar_voice(spark: SparkSession, folder: str) -> DataFrame:
    return literary.voice(docs(spark, folder), KEY)


@query
def nar_speech(spark: SparkSession, folder: str) -> DataFrame:
    return literary.direct_speech(docs(spark, folder), KEY)


@query
def nar_mattr(spark: SparkSession, folder: str) -> DataFrame:
    return literary.moving_ttr(docs(spark, folder), KEY)


@query
def lex_curve(spark: SparkSession, folder: str) -> DataFrame:
    return literary.curve(docs(spark, folder), KEY)


def _read(language: str) -> Query:
    return lambda spark, folder: literary.readability(docs(spark, folder, "lang").filter(F.lower("lang") == language), KEY, language)


for _language in ("en", "de", "fr"):
    _f = _read(_language)
    _f.__name__ = f"read_{_language}"
    query(_f)


@query
def rh_alliteration(spark: SparkSession, folder: str) -> DataFrame:
    return literary.alliteration(docs(spark, folder), KEY)


@query
def rh_anaphora(spark: SparkSession, folder: str) -> DataFrame:
    return literary.repetition(docs(spark, folder), KEY)


@query
def rh_epistrophe(spark: SparkSession, folder: str) -> DataFrame:
    return literary.repetition(docs(spark, folder), KEY, end=True)


@query
def rh_polysyndeton(spark: SparkSession, folder: str) -> DataFrame:
    return literary.polysyndeton(docs(spark, folder), KEY)


@query
def rh_asyndeton(spark: SparkSession, folder: str) -> DataFrame:
    return literary.asyndeton(docs(spark, folder), KEY)


@query
def rh_question(spark: SparkSession, folder: str) -> DataFrame:
    return literary.questions(docs(spark, folder), KEY)


@query
def arg_score(spark: SparkSession, folder: str) -> DataFrame:
    return literary.arguments(docs(spark, folder), KEY)


@query
def arg_ratios(spark: SparkSession, folder: str) -> DataFrame:
    return literary.argument_ratios(literary.arguments(docs(spark, folder), KEY), KEY)


@query
def rh_assonance(spark: SparkSession, folder: str) -> DataFrame:
    return literary.assonance(docs(spark, folder), KEY)


@query
def rh_simile(spark: SparkSession, folder: str) -> DataFrame:
    return literary.by_pattern(docs(spark, folder), KEY, literary.SIMILE)


@query
def rh_hyperbole(spark: SparkSession, folder: str) -> DataFrame:
    return literary.by_pattern(docs(spark, folder), KEY, literary.HYPERBOLE)


@query
def rh_oxymoron(spark: SparkSession, folder: str) -> DataFrame:
    return literary.oxymora(docs(spark, folder), KEY)


@query
def rh_antithesis(spark: SparkSession, folder: str) -> DataFrame:
    return literary.antithesis(docs(spark, folder), KEY)


@query
def rh_litotes(spark: SparkSession, folder: str) -> DataFrame:
    return literary.litotes(docs(spark, folder), KEY)


def _literary(f: Callable[[DataFrame, str], DataFrame], language: str) -> Query:
    return lambda spark, folder: f(docs(spark, folder, "lang").filter(F.lower("lang") == language), language.upper())


# the English lists run on all documents; the other languages' on their own
_LITERARY = {
    "sty_funcwords": lambda d, la: literary.function_words(d, KEY, language=la),
    "cmp_burrows": lambda d, la: compare.burrows(literary.function_words(d, KEY, language=la), "doc_id"),
    "arg_score": lambda d, la: literary.arguments(d, KEY, language=la),
    "arg_ratios": lambda d, la: literary.argument_ratios(literary.arguments(d, KEY, language=la), KEY),
    "rh_alliteration": lambda d, la: literary.alliteration(d, KEY, language=la),
    "rh_assonance": lambda d, la: literary.assonance(d, KEY, language=la),
    "rh_anaphora": lambda d, la: literary.repetition(d, KEY, language=la),
    "rh_epistrophe": lambda d, la: literary.repetition(d, KEY, end=True, language=la),
    "rh_polysyndeton": lambda d, la: literary.polysyndeton(d, KEY, language=la),
    "rh_asyndeton": lambda d, la: literary.asyndeton(d, KEY, language=la),
    "rh_question": lambda d, la: literary.questions(d, KEY, language=la),
    "rh_antithesis": lambda d, la: literary.antithesis(d, KEY, language=la),
    "rh_simile": lambda d, la: literary.by_pattern(d, KEY, literary.LISTS[la]["simile"]),
}
for _language in ("de", "fr"):
    for _name, _measure in _LITERARY.items():
        _f = _literary(_measure, _language)
        _f.__name__ = f"{_name}_{_language}"
        query(_f)


# graph


def _edges(spark: SparkSession, folder: str, only: str | None = "BKMQWXZ") -> DataFrame:
    """Documents with letters (some, or all) as features and their sources as corpora."""
    d = docs(spark, folder, "source")
    letters = telemetry.latin_letters(d, KEY)
    letters = letters.filter(F.col("letter").isin(*only)) if only else letters
    features = letters.select(F.concat(F.lit("d"), "doc_id").alias("src"), F.col("letter").alias("dst"), F.lit("CO_OCCURS_WITH").alias("relation"), F.col("n").cast("double").alias("weight"))
    member = d.select(F.concat(F.lit("d"), "doc_id").alias("src"), F.coalesce("source", F.lit("none")).alias("dst"), F.lit("BELONGS_TO").alias("relation"), F.lit(1.0).alias("weight"))
    return features.unionAll(member)


@query
def g_cooc(spark: SparkSession, folder: str) -> DataFrame:
    return graph.corpus_matrix(_edges(spark, folder), ["op_ed"])


@query
def g_laplacian(spark: SparkSession, folder: str) -> DataFrame:
    return graph.laplacian(graph.corpus_matrix(_edges(spark, folder), ["op_ed"]))


@query
def g_spectrum(spark: SparkSession, folder: str) -> DataFrame:
    return graph.spectrum(graph.laplacian(graph.corpus_matrix(_edges(spark, folder), ["op_ed"])))


@query
def g_jaccard(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.jaccard(graph.corpus_matrix(_edges(spark, folder), ["op_ed"])), 6, "value")


@query
def g_divergence(spark: SparkSession, folder: str) -> DataFrame:
    e = _edges(spark, folder)
    return rounded(graph.divergence(graph.corpus_matrix(e, ["op_ed"]), graph.corpus_matrix(e, ["letters"])), 6, "value")


#: All letters, and the largest source among the corpora; the five queries above have the SQL's seven letters.
CORPORA = ["wire_dispatch", "op_ed"]


def _whole(spark: SparkSession, folder: str, corpora: list[str] = CORPORA) -> DataFrame:
    return graph.corpus_matrix(_edges(spark, folder, None), corpora)


@query
def g_cooc_all(spark: SparkSession, folder: str) -> DataFrame:
    return _whole(spark, folder)


@query
def g_laplacian_all(spark: SparkSession, folder: str) -> DataFrame:
    return graph.laplacian(_whole(spark, folder))


@query
def g_spectrum_all(spark: SparkSession, folder: str) -> DataFrame:
    return graph.spectrum(graph.laplacian(_whole(spark, folder)))


@query
def g_jaccard_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.jaccard(_whole(spark, folder)), 6, "value")


@query
def g_divergence_all(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(graph.divergence(_whole(spark, folder, CORPORA[:1]), _whole(spark, folder, CORPORA[1:])), 6, "value")


@query
def g_bfs(spark: SparkSession, folder: str) -> DataFrame:
    """From the first entity to its sources, and from these to their entities."""
    d = table(spark, folder, "documents", "entity_id", "source").filter("entity_id IS NOT NULL")
    a = d.select(F.col("entity_id").alias("src"), F.coalesce("source", F.lit("none")).alias("dst")).distinct()
    edges = a.unionAll(a.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).select("src", "dst", F.lit("r").alias("relation"), F.lit(1.0).alias("weight"))
    start = d.agg(F.min("entity_id")).first()[0]
    nodes = edges.select(F.col("src").alias("id")).distinct()
    return graph.reach(nodes, edges, [start] if start else [], 2).select("src", "dst") if start else edges.select("src", "dst").limit(0)


def _features(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    d = docs(spark, folder, "source").select(F.concat(F.lit("d"), "doc_id").alias("doc"), F.col("source").alias("corpus"))
    device = F.concat(F.lit("d"), "doc_id").alias("doc")
    found = literary.alliteration(docs(spark, folder), KEY).select(device, F.lit("device_alliteration").alias("node")).distinct().unionAll(literary.repetition(docs(spark, folder), KEY).select(device, F.lit("device_anaphora")).distinct())
    feelings = pds_affect(spark, folder).select(device, F.concat(F.lit("affect_"), "emotion").alias("node"), F.lit("AffectNode").alias("kind"), F.lit("HAS_AFFECT").alias("relation"), F.col("mean_score").alias("weight"))
    return d, found.select("doc", "node", F.lit("StylisticDevice").alias("kind"), F.lit("EXHIBITS_DEVICE").alias("relation"), F.lit(1.0).alias("weight")).unionAll(feelings)


@query
def g_index_doc(spark: SparkSession, folder: str) -> DataFrame:
    return graph.index(*_features(spark, folder))[1]


@query
def g_correlations(spark: SparkSession, folder: str) -> DataFrame:
    return graph.degrees(graph.index(*_features(spark, folder))[1])


@query
def g_counts(spark: SparkSession, folder: str) -> DataFrame:
    return graph.index(*_features(spark, folder))[0].groupBy("type").agg(F.count("*").alias("nodes"))


@query
def ent_records(spark: SparkSession, folder: str) -> DataFrame:
    return entity.records(table(spark, folder, "documents", "doc_id", "entity_id"))


@query
def ent_ledger(spark: SparkSession, folder: str) -> DataFrame:
    return entity.ledger(table(spark, folder, "dissonance_events"), table(spark, folder, "analysis_requests", "request_id", "entity_id"))


# comparison


def _spans(spark: SparkSession, folder: str) -> DataFrame:
    w = table(spark, folder, "window_results", "request_id", "win_idx", "start_char", "end_char").distinct()
    return w.withColumn("length", F.max("end_char").over(W.partitionBy("request_id")))


@query
def cmp_align(spark: SparkSession, folder: str) -> DataFrame:
    w = _spans(spark, folder)
    other = w.withColumn("request_id", F.col("request_id") - 1)
    return compare.position_scores(w, other, ["request_id", "win_idx"])


@query
def cmp_delta(spark: SparkSession, folder: str) -> DataFrame:
    w = windows.plain_windows(docs(spark, folder))
    v = micro.axes(w, ["doc_id", "win_idx"])
    return compare.delta(v, v.withColumn("doc_id", F.col("doc_id") - 1), ["doc_id", "win_idx"], ["anxiety", "attention", "emotion", "agitation"])


@query
def cmp_burrows(spark: SparkSession, folder: str) -> DataFrame:
    return compare.burrows(literary.function_words(docs(spark, folder), KEY), "doc_id")


# lexicons of lines, seeds, poles


def _vad_lines(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(parameters.VAD_LINES, "file_name string, line_no long, raw_line string")


@query
def src_vad_tsv(spark: SparkSession, folder: str) -> DataFrame:
    return lexicons.vad(_vad_lines(spark))


@query
def src_lex_vad(spark: SparkSession, folder: str) -> DataFrame:
    return lexicons.vad(_vad_lines(spark), "first")


def _intensity(spark: SparkSession, folder: str) -> DataFrame:
    return affect.intensity(rejects.loaded(table(spark, folder, "lexicon_raw")))


@query
def lex_axis(spark: SparkSession, folder: str) -> DataFrame:
    return lexicons.axis(_intensity(spark, folder), "fear")


@query
def lex_installed(spark: SparkSession, folder: str) -> DataFrame:
    return lexicons.installed(_intensity(spark, folder))


def _seeds(spark: SparkSession, of: dict = parameters.SEEDS) -> DataFrame:
    return spark.createDataFrame(parameters.rows(of), "lang string, cluster string, pole string, word string, ord int")


def _content(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, sent, pos, lang, word of the content words, looked up as English ones."""
    s = docs(spark, folder).filter("text IS NOT NULL").select("doc_id", F.posexplode(fx.sentences(F.col("text"))).alias("sent", "s"))
    w = s.select("doc_id", "sent", F.posexplode(literary.tokens(F.col("s"))).alias("k", "word"))
    w = w.filter(~F.col("word").isin(*literary.FUNCTION_WORDS))
    return w.select("doc_id", "sent", (F.col("sent") * 100000 + F.col("k")).alias("pos"), F.lit("en").alias("lang"), "word")


@query
def macro_seed_hits(spark: SparkSession, folder: str) -> DataFrame:
    return macro.pole_scores(_content(spark, folder), _seeds(spark), KEY)


@query
def macro_normalise(spark: SparkSession, folder: str) -> DataFrame:
    t = macro.pole_table(_content(spark, folder), _seeds(spark), KEY)
    return t.unpivot(["doc_id"], [c for c in t.columns if c not in ("doc_id", "total")], "pole_name", "score")


@query
def macro_pos_fallback(spark: SparkSession, folder: str) -> DataFrame:
    return macro.fallback(_content(spark, folder), _seeds(spark), KEY)


@query
def macro_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Two capitalised words in a row stand in for named entities."""
    s = docs(spark, folder).filter("text IS NOT NULL").select("doc_id", F.posexplode(fx.sentences(F.col("text"))).alias("sent", "s"))
    named = s.select("doc_id", "sent", F.explode(F.regexp_extract_all("s", F.lit("[A-Z][a-z]+ [A-Z][a-z]+"), F.lit(0))).alias("entity"))
    return macro.entities(named, _content(spark, folder), _seeds(spark), KEY)


@query
def tel_drivers(spark: SparkSession, folder: str) -> DataFrame:
    return macro.drivers(_content(spark, folder), _seeds(spark), KEY)


@query
def macro_multi(spark: SparkSession, folder: str) -> DataFrame:
    """Arabic words, with the particles that are written together with them."""
    w = docs(spark, folder).filter("text IS NOT NULL").select("doc_id", F.lit("ar").alias("lang"), F.explode(F.regexp_extract_all(F.regexp_replace("text", macro.AR_MARKS, ""), F.lit(r"\p{IsArabic}+"), F.lit(0))).alias("word"))
    return macro.pole_scores(w, macro.variants(_seeds(spark, parameters.OTHER_SEEDS)), KEY)


@query
def macro_ko(spark: SparkSession, folder: str) -> DataFrame:
    """Korean words between blanks, stop words included."""
    w = docs(spark, folder).filter("text IS NOT NULL").select("doc_id", F.lit("ko").alias("lang"), F.explode(F.regexp_extract_all("text", F.lit("[가-힣]+"), F.lit(0))).alias("word"))
    return macro.pole_scores(w, _seeds(spark, parameters.OTHER_SEEDS), KEY)


@query
def macro_zh(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of ideographs: each takes the first seed that it contains."""
    w = docs(spark, folder).filter("text IS NOT NULL").select("doc_id", F.lit("zh").alias("lang"), F.explode(F.regexp_extract_all("text", F.lit(r"[\x{4E00}-\x{9FFF}]+"), F.lit(0))).alias("word"))
    return macro.first_contained(w, _seeds(spark, parameters.OTHER_SEEDS), KEY).groupBy("doc_id", "cluster", "pole").agg(F.count("*").alias("hits"))


@query
def wf_score(spark: SparkSession, folder: str) -> DataFrame:
    fields = spark.createDataFrame([(f, w) for f, ws in parameters.FIELDS.items() for w in ws.split()], "field string, word string")
    return macro.densities(_content(spark, folder), fields, KEY)


def _poles_z(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """z over all documents of the six letter axes, and of all poles with the politeness of the text."""
    d = docs(spark, folder)
    a = micro.vectors(d, KEY).unpivot(KEY, ["intensity", "anxiety", "attention", "emotion", "agitation", "complexity"], "variable", "value")
    t = macro.pole_table(_content(spark, folder), _seeds(spark), KEY).drop("total")
    polite = macro.politeness(d, KEY).select("doc_id", F.col("formal").alias("keigo_formal"), F.col("casual").alias("keigo_casual"))
    t = t.join(polite, KEY)
    b = t.unpivot(KEY, [c for c in t.columns if c != "doc_id"], "variable", "value")
    return baseline.running(a, ["variable"], KEY), baseline.running(b, ["variable"], KEY)


@query
def dis_bridge_poles(spark: SparkSession, folder: str) -> DataFrame:
    return rounded(baseline.bridge_events(*_poles_z(spark, folder), KEY), 4, "delta")


@query
def dis_fallback_poles(spark: SparkSession, folder: str) -> DataFrame:
    a, b = _poles_z(spark, folder)
    return rounded(baseline.ranked_events(a, b, baseline.bridge_events(a, b, KEY), KEY), 4, "delta")


@query
def vad_all(spark: SparkSession, folder: str) -> DataFrame:
    return affect.valence_of_all(docs(spark, folder), affect.valence(_content(spark, folder), lexicons.vad(_vad_lines(spark), "first"), KEY), KEY)


@query
def pds_agg(spark: SparkSession, folder: str) -> DataFrame:
    return affect.pds(_content(spark, folder), lexicons.vad(_vad_lines(spark), "first"), _intensity(spark, folder), KEY)


@query
def pds_top60(spark: SparkSession, folder: str) -> DataFrame:
    return affect.extremes(_content(spark, folder), lexicons.vad(_vad_lines(spark), "first"), KEY)


# Korean, excerpts, waves


@query
def sanitize_ko(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", fx.prose_ko(F.col("text")).alias("prose"))


@query
def hangul_decompose(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", micro.jamo(F.col("text")).alias("jamo"))


@query
def letter_freq_ko24(spark: SparkSession, folder: str) -> DataFrame:
    return micro.hangul_letters(docs(spark, folder), KEY)


@query
def bpv_archetype(spark: SparkSession, folder: str) -> DataFrame:
    return micro.archetypes(docs(spark, folder), KEY)


@query
def micro_ko(spark: SparkSession, folder: str) -> DataFrame:
    return micro.vectors(docs(spark, folder), KEY, language="KO")


@query
def truncate140(spark: SparkSession, folder: str) -> DataFrame:
    return docs(spark, folder).filter("text IS NOT NULL").select("doc_id", windows.excerpt(F.col("text")).alias("excerpt"))


@query
def som_wave(spark: SparkSession, folder: str) -> DataFrame:
    return wave.pattern(docs(spark, folder), KEY)


@query
def som_envelope20(spark: SparkSession, folder: str) -> DataFrame:
    return wave.envelope(docs(spark, folder), KEY, buckets=20, empty=True)


@query
def som_shares(spark: SparkSession, folder: str) -> DataFrame:
    return wave.summary(docs(spark, folder), KEY).drop("mean_sigma", "root", "tier", "label")


# narrative, argument, devices on made texts


@query
def nar_tense(spark: SparkSession, folder: str) -> DataFrame:
    return literary.tense(docs(spark, folder), KEY)


@query
def nar_subord(spark: SparkSession, folder: str) -> DataFrame:
    return literary.subordination(docs(spark, folder), KEY)


@query
def rh_places(spark: SparkSession, folder: str) -> DataFrame:
    return literary.sentence_places(docs(spark, folder), KEY)


@query
def arg_function(spark: SparkSession, folder: str) -> DataFrame:
    return literary.argument_findings(docs(spark, folder).unionAll(_devices(spark)), KEY)


@query
def lar_posturing(spark: SparkSession, folder: str) -> DataFrame:
    return literary.posturing(lar_radar(spark, folder), macro_seed_hits(spark, folder), KEY)


def _devices(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(parameters.DEVICES, "doc_id long, text string")


for _name, _measure in {
    "rh_simile": lambda d: literary.by_pattern(d, KEY, literary.SIMILE),
    "rh_hyperbole": lambda d: literary.by_pattern(d, KEY, literary.HYPERBOLE),
    "rh_litotes": lambda d: literary.litotes(d, KEY),
    "rh_polysyndeton": lambda d: literary.polysyndeton(d, KEY),
    "rh_oxymoron": lambda d: literary.oxymora(d, KEY),
    "rh_personification": lambda d: literary.personification(d, KEY),
}.items():
    _f = (lambda measure: lambda spark, folder: measure(docs(spark, folder).unionAll(_devices(spark))))(_measure)
    _f.__name__ = f"{_name}_made"
    query(_f)


@query
def rh_findings(spark: SparkSession, folder: str) -> DataFrame:
    return literary.findings(docs(spark, folder).unionAll(_devices(spark)), KEY)


# more of the graph, of comparison and of entities


@query
def g_corpora(spark: SparkSession, folder: str) -> DataFrame:
    return graph.corpora(_edges(spark, folder, None))


@query
def g_corpus_docs(spark: SparkSession, folder: str) -> DataFrame:
    nodes = table(spark, folder, "documents", "doc_id", "title", "lang").select(F.concat(F.lit("d"), "doc_id").alias("id"), "title", "lang")
    return graph.corpus_documents(nodes, _edges(spark, folder, None), "wire_dispatch")


@query
def g_doc_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """Of the first English document."""
    first = table(spark, folder, "documents", "doc_id", "lang").filter("lang = 'en'").agg(F.min("doc_id")).first()[0]
    return graph.document_matrix(_edges(spark, folder, None), f"d{first}")


@query
def g_ephemeral(spark: SparkSession, folder: str) -> DataFrame:
    """Letters of the windows of the largest source's documents."""
    d = docs(spark, folder, "source").filter("source = 'wire_dispatch'")
    w = telemetry.latin_letters(windows.plain_windows(d), ["doc_id", "win_idx"])
    return graph.window_matrices(w.select("doc_id", "win_idx", F.col("letter").alias("node"), F.col("n").cast("double").alias("weight")), ["doc_id", "win_idx"])


@query
def g_frobenius(spark: SparkSession, folder: str) -> DataFrame:
    return graph.frobenius(graph.divergence(_whole(spark, folder, CORPORA[:1]), _whole(spark, folder, CORPORA[1:])))


@query
def g_trace(spark: SparkSession, folder: str) -> DataFrame:
    """The eigenvalues of a matrix of fewer than ten nodes add up to its trace."""
    return g_spectrum(spark, folder).agg(F.round(F.sum("eigenvalue"), 3).alias("trace"))


@query
def g_fiedler(spark: SparkSession, folder: str) -> DataFrame:
    return graph.fiedler(g_spectrum_all(spark, folder))


@query
def g_related(spark: SparkSession, folder: str) -> DataFrame:
    """From the first document, two steps."""
    e = _edges(spark, folder, None)
    first = table(spark, folder, "documents", "doc_id").agg(F.min("doc_id")).first()[0]
    return graph.related(e.select(F.col("src").alias("id")).distinct(), e, f"d{first}")


@query
def g_remove_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """What is left without the largest source."""
    e = _edges(spark, folder, None)
    nodes = e.select(F.col("src").alias("id")).unionAll(e.select("dst")).distinct()
    nodes, e = graph.remove_corpus(nodes, e, "wire_dispatch")
    return e.groupBy("relation").agg(F.count("*").alias("edges")).unionAll(nodes.select(F.lit("any node").alias("relation"), "id").groupBy("relation").agg(F.count("*")))


@query
def cmp_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events of entities' requests against those of requests without one."""
    own = table(spark, folder, "analysis_requests", "request_id", "entity_id").distinct()
    e = table(spark, folder, "dissonance_events", "event_id", "request_id", "trigger_type").distinct().join(own, "request_id")
    return compare.event_counts(e.filter("entity_id IS NOT NULL"), e.filter("entity_id IS NULL"), ["trigger_type"])


@query
def ent_baseline(spark: SparkSession, folder: str) -> DataFrame:
    d = table(spark, folder, "documents", "doc_id", "entity_id")
    a = micro.axes(docs(spark, folder), KEY).unpivot(KEY, ["anxiety", "attention", "emotion", "agitation"], "variable", "value")
    return rounded(entity.baselines(a.join(d, KEY)), 4, "mu", "sigma")


@query
def analyze_windows(spark: SparkSession, folder: str) -> DataFrame:
    return analyze.flagship(docs(spark, folder))


def flagship(spark: SparkSession, folder: str) -> DataFrame:
    return analyze_windows(spark, folder)


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return oracle.sql()
