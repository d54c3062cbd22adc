"""Hand-made cases: nulls, empty and long texts, ties, repeated rows, empty tables, clashing columns."""

import math

import pytest
from pyspark.sql import functions as F

from textloom.functions import text as fx
from textloom.operators import affect, baseline, compare, entropy, graph, literary, macro, micro, rejects, telemetry, wave, windows
from textloom.streaming import baselines

TEXTS = "doc_id long, text string"


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), TEXTS)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("aa\n\nbb", [(0, "structural_boundary"), (4, "stride")]),
        ("Chapter 1\nx", [(0, "stride")]),
        ("intro\nChapter 2 y", [(0, "structural_boundary"), (6, "stride")]),
        ("a\n\n\n\nPart b", [(0, "structural_boundary"), (5, "stride")]),
        ("  \n\nz", [(4, "stride")]),
        ("", []),
        (None, []),
    ],
)
def test_segments(spark, text, want):
    got = windows.windows(docs(spark, text)).orderBy("win_idx").collect()
    assert [(r.start_char, r.reset_reason) for r in got] == want


@pytest.mark.parametrize(("n", "want"), [(1, 1), (999, 1), (1000, 1), (1001, 2), (1500, 2), (1501, 3)])
def test_windows_tile_the_text(spark, n, want):
    got = windows.windows(docs(spark, "x" * n)).orderBy("win_idx").collect()
    assert len(got) == want
    assert got[0].start_char == 0 and got[-1].end_char == n
    assert all(b.start_char == a.start_char + 500 for a, b in zip(got, got[1:], strict=False))


def test_stride_must_be_smaller_than_window(spark):
    with pytest.raises(ValueError):
        windows.windows(docs(spark, "x"), 100, 100)


@pytest.mark.parametrize(("word", "want"), [("A", 12.0), ("MOON", 28.5), ("WM", 38.4), ("MESS", 32.16), ("HOB", 15.5)])
def test_word_scores(spark, word, want):
    assert micro.score_words(spark.createDataFrame([(word,)], "word string")).first().score == pytest.approx(want)


def test_doubles(spark):
    got = {(r.doc_id, r.pair): r.n for r in telemetry.doubles(docs(spark, "AAAA", "AAA", "letter"), ["doc_id"]).collect()}
    assert got == {(0, "AA"): 2, (1, "AA"): 1, (2, "TT"): 1}


def test_hidden_characters(spark):
    d = telemetry.hidden(docs(spark, "a​b", "x \t\ny", "end ", "﻿ok", "", None))
    assert [r.hidden_unicode_count for r in d.orderBy("doc_id").collect()] == [1, 2, 1, 1, 0, None]


def test_pauses(spark):
    rows = telemetry.pause_wave(docs(spark, "a, b; c! – d— e؟"), ["doc_id"]).orderBy("pos").collect()
    assert [r.value for r in rows] == [1, 3, 4, 2, 3, 4]


def test_entropy(spark):
    r = entropy.entropy(docs(spark, "One two. Three four five six."), ["doc_id"]).first()
    assert (r.n_sentences, r.burstiness, r.lexical, r.ai_score) == (2, 1.4142, 1.0, 0.9081)
    empty = entropy.entropy(docs(spark, ""), ["doc_id"]).first()
    assert (empty.n_sentences, empty.burstiness, empty.lexical) == (1, 0.0, 0.0)


def test_baselines_batch_equals_stream(spark):
    xs = [1.0, 4.0, 2.0]
    df = spark.createDataFrame([("v", k, x) for k, x in enumerate([*xs, None])], "variable string, seq long, value double")
    rows = baseline.running(df, ["variable"], ["seq"]).orderBy("seq").collect()
    assert [round(r.z, 4) for r in rows] == [1.0, 0.7071, -0.2182]
    ema = baseline.moving_average(df, ["variable"], ["seq"]).orderBy("seq").collect()
    assert [round(r.ema, 4) for r in ema] == [0.1, 0.49, 0.641]
    state = (0, 0.0, 0.0, 0.0)
    for x, r, e in zip(xs, rows, ema, strict=True):
        state, sigma, z = baselines.absorb(state, x)
        assert math.isclose(z, r.z) and math.isclose(sigma, r.sigma) and math.isclose(state[3], e.ema)


def test_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame([("v", k, float(x)) for k, x in enumerate([1, 4, 2])], "variable string, seq long, value double").coalesce(1).write.parquet(src)
    stream = baselines.running(spark.readStream.schema("variable string, seq long, value double").parquet(src))
    q = stream.writeStream.format("memory").queryName("zs").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert [round(r.z, 4) for r in spark.table("zs").orderBy("seq").collect()] == [1.0, 0.7071, -0.2182]


def test_events(spark):
    z = "doc_id long, variable string, z double"
    micro_z = spark.createDataFrame([(1, "anxiety", 0.0), (2, "anxiety", 5.0), (3, "complexity", 3.0)], z)
    macro_z = spark.createDataFrame([(1, "power_submission", 3.0), (2, "power_submission", 0.0), (3, "power_control", 0.0)], z)
    b = baseline.bridge_events(micro_z, macro_z, ["doc_id"])
    assert {(r.doc_id, r.conclusion) for r in b.collect()} == {(1, "posturing"), (2, "fracture")}
    f = baseline.ranked_events(micro_z, macro_z, b, ["doc_id"]).collect()
    assert [(r.doc_id, r.conclusion) for r in f] == [(3, "suppressed")]


@pytest.mark.parametrize(("word", "want"), [("  Hello ", "hello"), ("work tool", None), ("---", None), ("don't", "don't"), ("___", None), ("abc-def", "abc-def"), ("", None), (None, None)])
def test_cleanse(spark, word, want):
    d = spark.createDataFrame([(word,)], "w string")
    assert d.select(affect.cleanse(F.col("w"))).first()[0] == want


def test_rotate(spark):
    rows = affect.rotate(spark.createDataFrame([(0.054, 0.948, 0.25), (0.1, 0.9, 0.15)], "v double, a double, d double")).collect()
    assert [(r.power, r.danger, r.structure) for r in rows] == [(-0.5, 0.8932, -0.896), (-0.7, 0.8, -0.8)]
    assert rows[0].quadrant == "Desperate Panic"


@pytest.mark.parametrize(("language", "word", "want"), [("en", "fire", 1), ("en", "flower", 2), ("en", "eternal", 3), ("en", "through", 1), ("de", "liebe", 2), ("de", "lesen", 1), ("de", "mutter", 1), ("fr", "forte", 1), ("fr", "armée", 2), ("fr", "courageux", 3), ("fr", "fleuve", 1)])
def test_syllables(spark, language, word, want):
    d = spark.createDataFrame([(word,)], "w string")
    assert d.select(literary._syllables(F.col("w"), language)).first()[0] == want


def test_repetition_and_ties(spark):
    d = docs(spark, "We came. We saw. We won. They left. They sang.", None, "")
    got = {(r.word, r.n, r.confidence) for r in literary.repetition(d, ["doc_id"]).collect()}
    assert got == {("we", 3, 0.9), ("they", 2, 0.72)}


def test_spectrum_of_a_pure_tone(spark):
    text = "".join("AZ"[k % 2] for k in range(256))
    top = wave.spectrum(docs(spark, text), ["doc_id"]).orderBy(F.desc("magnitude")).first()
    assert top.magnitude < 1e-3  # bin 128, the tone itself, lies beyond the bins asked for
    env = wave.envelope(docs(spark, "AB" * 100), ["doc_id"])
    assert env.count() == 100 and env.agg(F.avg("value")).first()[0] == 1.5


def test_graph(spark):
    e = spark.createDataFrame([("d1", "a", "HAS_AFFECT", 1.0), ("d1", "a", "HAS_AFFECT", 1.0), ("d1", "b", "HAS_AFFECT", 3.0), ("d2", "b", "HAS_AFFECT", 1.0), ("d1", "c1", "BELONGS_TO", 1.0), ("d1", "c2", "BELONGS_TO", 1.0), ("d2", "c2", "BELONGS_TO", 1.0)], "src string, dst string, relation string, weight double")
    m = {(r.i, r.j): r.value for r in graph.corpus_matrix(e, ["c1", "c2"]).collect()}
    assert m == {("a", "a"): 4.0, ("a", "b"): 6.0, ("b", "a"): 6.0, ("b", "b"): 10.0}
    lap = graph.laplacian(graph.corpus_matrix(e, ["c1", "c2"]))
    assert all(abs(r.s) < 1e-9 for r in lap.groupBy("i").agg(F.sum("value").alias("s")).collect())
    values = [r.eigenvalue for r in graph.spectrum(lap).orderBy("rank").collect()]
    assert values == [pytest.approx(0.0, abs=1e-6), pytest.approx(12.0)]
    assert {r.value for r in graph.jaccard(graph.corpus_matrix(e, ["c1"])).filter("i = j").collect()} == {1.0}
    none = graph.divergence(graph.corpus_matrix(e, ["c1"]), graph.corpus_matrix(e, ["nowhere"]))
    assert none.count() == 4
    nodes = spark.createDataFrame([("d1",), ("a",), ("c1",)], "id string")
    assert graph.reach(nodes, e, ["d1"], 2).count() == 5


def test_compare(spark):
    a = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 9.0)], "win_idx int, x double")
    b = spark.createDataFrame([(0, 2.0), (1, 4.0)], "win_idx int, x double")
    r = compare.delta(a, b, ["win_idx"], ["x"]).first()
    assert (r.windows, r.x) == (2, 1.5)


def test_clusters(spark):
    seeds = spark.createDataFrame([("en", "a", "x", "War", 1), ("en", "b", "y", "war", 2)], "lang string, cluster string, pole string, word string, ord int")
    t = spark.createDataFrame([(1, "en", "war"), (1, "en", "peace")], "doc_id long, lang string, word string")
    assert [(r.pole_name, r.score) for r in macro.pole_scores(t, seeds, ["doc_id"]).collect()] == [("b_y", 0.5)]


def test_rejects(spark):
    de, en = "affect_intensity_de_1.tsv", "affect_intensity_en_1.tsv"
    rows = [
        (de, 1, "English_Word\tEmotion\tScore\tTranslated_Word"), (de, 2, "a\tjoy\t0.5\tx"), (de, 2, "a\tjoy\t0.5\tx"), (de, 3, '"""q"""\tJoy\t1.\t'), (de, 4, '"a\tb\nc" \tjoy\t.5\t"y"\r'), (de, 5, 'a"b\tjoy\t0.5\tx'),
        (de, 6, "a\tjoy\t0.5"), (de, 7, "a\tglee\tx\t12"), (de, 8, "a\tjoy\t0,5\tx"), (de, 9, "a\tjoy\t2\t12"), (en, 2, "a\tjoy\t-3"), (en, 3, "  "), (en, 4, None), (en, 5, "x" + "\t" * 20000), (None, 6, "a\tjoy\t0.5\tb"),
        (en, 7, '"' + '""' * 2000 + '"\tjoy\t0.1'), (en, 8, "a\tjoy\tNaN"),
    ]
    raw = spark.createDataFrame([(*r, 0) for r in rows], "file_name string, line_no int, raw_line string, score int")
    got = {(r.file_name, r.line_no): r.fail_reason for r in rejects.parse(raw).collect()}
    assert got[de, 2] is None and got[de, 3] is None and got[de, 4] is None and got[en, 2] is None and got[None, 6] is None and got[en, 7] is None
    assert [got[de, k] for k in range(5, 10)] == ["quoting", "column_count", "emotion", "score", "translated_word"]
    assert got[en, 5] == "column_count" and got[en, 8] == "score"
    assert (de, 1) not in got and (en, 3) not in got and (en, 4) not in got and len(got) == 13
    good = {(r.file_name, r.line_no): r for r in rejects.loaded(raw).collect()}
    assert good[en, 2].score == 0.0 and good[de, 3].english_word == '"q"' and good[de, 3].translated_word is None
    assert rejects.failures(raw.limit(0)).count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], TEXTS)
    k = ["doc_id"]
    for df in (windows.windows(none), telemetry.latin_letters(none, k), micro.vectors(none, k), entropy.entropy(none, k), wave.summary(none, k), wave.spectrum(none, k), literary.variety(none, k), literary.moving_ttr(none, k), literary.readability(none, k, "en"), literary.arguments(none, k)):
        assert df.count() == 0


def test_long_text_and_clashing_columns(spark):
    text = "word " * 100_000
    d = spark.createDataFrame([(1, text, "x", 5)], "doc_id long, text string, letter string, n int")
    assert telemetry.word_counts(d).first().total_words == 100_000
    assert windows.plain_windows(d).count() == 999
    assert {r.letter for r in telemetry.latin_letters(d, ["doc_id"]).collect()} == set("WORD")


def test_prose(spark):
    d = docs(spark, "# Head\n\n```code```\n* item one\nsome `x` **bold** text")
    assert d.select(fx.prose(F.col("text"))).first()[0] == "Head. item one. some bold text."


def test_entities_and_triggers(spark):
    from textloom.operators import entity

    d = spark.createDataFrame([(k, "e1") for k in range(12)] + [(50, "e2"), (50, "e2"), (60, None)], "doc_id long, entity_id string")
    assert {(r.entity_id, r.documents, r.confidence) for r in entity.records(d).collect()} == {("e1", 12, 1.0), ("e2", 1, 0.1)}
    vad = spark.createDataFrame([(1, 1, 0.1, 0.9, 0.9), (2, 1, 0.1, 0.9, 0.1)], "doc_id long, matched long, v_mean double, a_mean double, d_mean double")
    e = spark.createDataFrame([(1, "anger", 0.8, 0.0), (1, "disgust", 0.6, 0.0), (2, "fear", 0.7, 0.0), (2, "anticipation", 0.7, 0.0)], "doc_id long, emotion string, mean_score double, sd_score double")
    assert {tuple(r) for r in affect.triggers(vad, e, ["doc_id"]).collect()} == {(1, True, True, False), (2, False, False, True)}


def test_fallback_lexicon(spark):
    lex = spark.createDataFrame([("en", "a"), ("de", "b")], "lang string, word string")
    assert {tuple(r) for r in affect.with_fallback(lex, ["de", "fr"]).collect()} == {("de", "b"), ("fr", "a")}


def test_sinks_and_udtf(spark, tmp_path):
    from textloom.functions import udtf
    from textloom.sources import sinks

    path = str(tmp_path / "t")
    for n in (1, 2):
        sinks.replace_table(spark.range(n), path)
    assert sinks.read_table(spark, path).count() == 2
    sinks.export(spark.range(3), str(tmp_path / "c"), "csv")
    assert spark.read.csv(str(tmp_path / "c"), header=True).count() == 3
    udtf.register(spark)
    rows = spark.sql("SELECT start_char FROM text_windows(repeat('x', 1501), 1000, 500)").collect()
    assert [r.start_char for r in rows] == [0, 500, 1000]


def test_alphabets(spark):
    def score(word, language):
        return micro.score_words(spark.createDataFrame([(word,)], "word string"), language).first().score

    assert score("Я", "RU") == 12.0
    assert score("ЖЖ", "RU") == pytest.approx(8 * 1.8 * 1.2)
    assert score("جع", "AR") == pytest.approx(((8 + 9) * 2.0) * 1.2)
    assert score("AS", "FR") == score("AS", "EN")  # the pair counts before it could be silent
    assert score("BT", "FR") == 7 * 1.5


def test_stroke_table(spark):
    from textloom.parameters import STROKES

    strokes = dict(STROKES)
    assert len(strokes) == len(STROKES) == 309  # the reference's ideographs, each once
    assert (strokes["露"], strokes["藏"], strokes["现"], strokes["力"]) == (21, 17, 8, 2)
    got = micro.stroke_axes(docs(spark, "力力!", "藏龘"), spark.createDataFrame(STROKES, "ch string, n int"), ["doc_id"]).collect()
    assert {r.doc_id: r.intensity for r in got} == {0: 16.0, 1: 100.0}


def test_literary_lists_by_language(spark):
    k = ["doc_id"]
    de = docs(spark, "Laut Studien belegt die Analyse den Nachweis. Warum schweigt man? Er kam und sah und ging und blieb.", "Er ist so schnell wie ein Pfeil.")
    fr = docs(spark, "Selon les études, la preuve est donc là. Pourquoi faut-il attendre ?", "Il est aussi rapide que le vent.")
    en = docs(spark, "Research shows this. The survey confirms and suggests it. It was utterly devastating.")
    score = {r.sent: (r.logos, r.ethos, r.pathos) for r in literary.arguments(en, k).collect()}
    assert score == {0: (4, 2, 0), 1: (3, 0, 0), 2: (0, 0, 2)}
    assert [r.dominant for r in literary.arguments(de, k, language="DE").collect()] == ["logos"] and literary.arguments(de, k).count() == 0
    assert literary.arguments(fr, k, language="FR").count() == 1
    assert [r.sent for r in literary.questions(de, k, language="DE").collect()] == [1] and literary.questions(fr, k, language="FR").count() == 1
    assert [(r.conjunction, r.n) for r in literary.polysyndeton(de, k, language="DE").collect()] == [("und", 3)]
    assert [r.doc_id for r in literary.by_pattern(de, k, literary.LISTS["DE"]["simile"]).collect()] == [1]
    assert [r.doc_id for r in literary.by_pattern(fr, k, literary.LISTS["FR"]["simile"]).collect()] == [1]
    assert {"die", "den"} <= {r.word for r in literary.function_words(de, k, language="DE").collect()}


def test_graph_over_all_letters(spark):
    from textloom import queries

    folder = "/root/testdata/sf0.001"
    d = queries.docs(spark, folder, "source").filter(F.col("source").isin("wire_dispatch", "op_ed"))
    letters = {r.doc_id: {} for r in d.collect()}
    for r in telemetry.latin_letters(d, ["doc_id"]).groupBy("doc_id", "letter").agg(F.sum("n").alias("n")).collect():
        letters[r.doc_id][r.letter] = r.n
    want = {}
    for of in letters.values():
        for i, a in of.items():
            for j, b in of.items():
                want[i, j] = want.get((i, j), 0.0) + a * b
    got = {(r.i, r.j): r.value for r in queries.queries()["g_cooc_all"](spark, folder).collect()}
    assert got == want and len({i for i, _ in got}) > 7
    assert queries.queries()["g_divergence_all"](spark, folder).count() == len(got)


def test_plan(spark):
    from textloom.plans import analyze

    out = analyze.analyze(docs(spark, "The cat sat. It ran!", None, ""))
    assert {name: df.count() for name, df in out.items()} == {"windows": 1, "telemetry": 1, "micro": 1, "entropy": 1, "wave": 1, "baselines": 6}


def test_tables_are_replaced_whole(spark, tmp_path):
    from textloom.sources import sinks

    path = str(tmp_path / "t")
    first = sinks.replace_table(spark.range(3), path)
    old = sinks.read_table(spark, path)
    sinks.replace_table(spark.range(5), path)
    assert sinks.read_table(spark, path).count() == 5 and old.count() == 3 and sinks.current(spark, path) != first
    with pytest.raises(Exception, match="boom"):
        sinks.replace_table(spark.range(9).select(F.raise_error(F.lit("boom")).alias("x")), path)
    assert sinks.read_table(spark, path).count() == 5
    assert sinks.prune(spark, path) >= 1 and sinks.read_table(spark, path).count() == 5
    with pytest.raises(FileNotFoundError):
        sinks.read_table(spark, str(tmp_path / "none"))


def test_graphs_and_exports_come_back(spark, tmp_path):
    from textloom.sources import sinks, texts

    nodes = spark.createDataFrame([("a", "Document"), ("c", "Corpus")], "id string, type string")
    edges = spark.createDataFrame([("a", "c", "BELONGS_TO", 1.0)], "src string, dst string, relation string, weight double")
    sinks.save_graph(nodes, edges, str(tmp_path / "g"))
    n, e = sinks.load_graph(spark, str(tmp_path / "g"))
    assert sorted(n.collect()) == sorted(nodes.collect()) and e.collect() == edges.collect()
    for fmt in ("json", "csv"):
        sinks.export(edges, str(tmp_path / fmt), fmt)
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 1 and spark.read.json(str(tmp_path / "json")).count() == 1
    (tmp_path / "one.txt").write_text("A text.\nOf two lines.")
    assert texts(spark, str(tmp_path / "one.txt")).first().text == "A text.\nOf two lines."


@pytest.mark.parametrize("rows", [1, 7, 40, 10_000])
def test_ranges_compose(spark, rows):
    import random

    rng = random.Random(3)
    xs = [(rng.choice(["hot"] * 8 + ["cold", None]), k // 2, k, rng.choice([None, 1e6 + rng.random(), 1e6 - rng.random()])) for k in range(500)]
    df = spark.createDataFrame(xs, "variable string, at long, id long, value double")
    got = {r.id: r for r in baseline.running(df, ["variable"], ["at", "id"], rows=rows).collect()}
    ema = {r.id: r.ema for r in baseline.moving_average(df, ["variable"], ["at", "id"], rows=rows).collect()}
    state = {}
    for variable, _, k, x in xs:
        if x is None:
            assert k not in got and k not in ema
            continue
        state[variable], sigma, z = baselines.absorb(state.get(variable, (0, 0.0, 0.0, 0.0)), x)
        n, mu, _, e = state[variable]
        r = got[k]
        assert r.n == n and math.isclose(r.mu, mu, rel_tol=1e-12) and math.isclose(r.sigma, sigma, rel_tol=1e-6) and abs(r.z - z) < 1e-4 * max(1, abs(z)) and math.isclose(ema[k], e, rel_tol=1e-9)


def test_seeded_baselines_absorb_the_control_first(spark):
    schema = "variable string, seq long, value double"
    control = spark.createDataFrame([("v", 9, 1.0), ("v", 10, 4.0)], schema)
    r = baseline.seeded(control, spark.createDataFrame([("v", 1, 2.0)], schema), ["variable"], ["seq"]).collect()
    assert len(r) == 1 and r[0].n == 3 and round(r[0].z, 4) == -0.2182


def test_prefix_sums(spark):
    from textloom.functions.arrays import prefix_sums

    d = spark.createDataFrame([([],), (list(range(200)),), ([5],)], "x array<int>")
    assert [r[0] for r in d.select(prefix_sums(F.col("x"))).collect()] == [[], [k * (k - 1) // 2 for k in range(200)], [0]]


def test_windows_of_a_long_part_and_odd_strides(spark):
    text = "x\n" * 2500 + "😀" * 700
    got = windows.windows(docs(spark, text), 1000, 300).orderBy("win_idx").collect()
    for r in got:
        assert r.text == text[r.start_char : r.end_char] and r.start_line == text[: r.start_char].count("\n") + 1 and r.end_line == text[: r.end_char].count("\n") + 1
    assert got[-1].end_char == len(text)


def test_lexicon_files(spark, tmp_path):
    from textloom.operators import lexicons

    (tmp_path / "vad_de.tsv").write_text("Word\tV\tA\tD\tT\ncouncil\t0.6\t0.4\t1.8\tRat\nnight\t0.1\t0.2\t0.3\t\nnight\t0.4\t0.5\t0.6\n")
    raw = lexicons.lines(spark, str(tmp_path))
    assert {tuple(r) for r in lexicons.vad(raw).collect()} == {("de", "rat", 0.6, 0.4, 1.8), ("de", "night", 0.4, 0.5, 0.6)}
    assert {tuple(r) for r in lexicons.vad(raw, "first").collect()} == {("de", "rat", 0.6, 0.4, 1.0), ("de", "night", 0.1, 0.2, 0.3)}
    assert lexicons.vad(raw.limit(0)).count() == 0


def test_similar_beyond_the_bound(spark, monkeypatch):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [0.0, 2.0], 1), (3, [0.0, 0.0], 1), (4, [3.0, 3.0], 0)], "vec_id long, embedding array<float>, label int")
    c = macro.centroids(v)
    want = sorted((r.vec_id, r.pole, round(r.sim, 6)) for r in macro.similar(v, c, least=0.5).collect())
    monkeypatch.setattr(macro, "CENTROID_VALUES", 1)
    assert want and sorted((r.vec_id, r.pole, round(r.sim, 6)) for r in macro.similar(v, c, least=0.5).collect()) == want


def test_upserts_and_properties(spark):
    s = "id string, type string, props map<string,string>"
    nodes = spark.createDataFrame([("a", "Document", {"x": "1"}), ("b", "Corpus", None)], s)
    new = spark.createDataFrame([("a", "Document", {"x": "2"}), ("a", "Document", {"x": "3"})], s)
    got = {r.id: r.props for r in graph.upsert_nodes(nodes, new).collect()}
    assert got == {"a": {"x": "3"}, "b": None}
    assert {r.id: r.props for r in graph.set_property(nodes, "a", "y", "5").collect()} == {"a": {"x": "1", "y": "5"}, "b": {}} or {r.id: r.props for r in graph.set_property(nodes, "a", "y", "5").collect()}["a"] == {"x": "1", "y": "5"}


def test_ledgers(spark):
    from textloom.operators import entity

    s = "event_id string, delta double"
    old, new = spark.createDataFrame([("a", 1.0)], s), spark.createDataFrame([("a", 2.0), ("b", 3.0)], s)
    assert {tuple(r) for r in entity.append(old, new).collect()} == {("a", 1.0), ("b", 3.0)} and entity.cleared(old).count() == 0


@pytest.mark.parametrize("language", ["EN", "ES", "FR", "RU", "AR", "FA", "KO"])
def test_scores_of_words_met_one_by_one(spark, language):
    import random

    rng = random.Random(1)
    a = micro.ALPHABETS[language]
    words = ["".join(rng.choice(a.letters[:12]) for _ in range(rng.randint(1, 7))) for _ in range(300)]
    score = micro.scorer(language)
    for r in micro.score_words(spark.createDataFrame([(w,) for w in words], "word string"), language).collect():
        assert score(r.word) == pytest.approx(r.score), r.word


def test_spectrum_beyond_the_driver(spark, monkeypatch):
    import random

    rng = random.Random(2)
    m = spark.createDataFrame([(f"n{a:02d}", f"n{b:02d}", float(w)) for a in range(40) for b in range(40) for w in [rng.randint(0, 5)] if w and (a + b) % 3], "i string, j string, value double")
    lap = graph.laplacian(m)
    want = [r.eigenvalue for r in graph.spectrum(lap, 5).orderBy("rank").collect()]
    monkeypatch.setattr(graph, "SPECTRUM_NODES", 5)
    got = [r.eigenvalue for r in graph.spectrum(lap, 5).orderBy("rank").collect()]
    assert got == pytest.approx(want, abs=1e-4) and abs(got[0]) < 1e-4


def test_many_values_at_once_equal_one_by_one():
    import numpy as np

    rng = np.random.default_rng(4)
    xs = 1e5 + rng.standard_normal(300)
    one = many = (0, 0.0, 0.0, 0.0)
    rows = []
    for part in np.array_split(xs, [1, 7, 150]):
        many, out = baselines.absorb_all(many, part)
        rows.append(out)
    for x, row in zip(xs, np.concatenate(rows), strict=True):
        one, sigma, z = baselines.absorb(one, float(x))
        assert row[0] == one[0] and row[1] == pytest.approx(one[1]) and row[2] == pytest.approx(sigma, rel=1e-6) and row[3] == pytest.approx(one[3]) and row[4] == pytest.approx(z, abs=1e-5 * max(1, abs(z)))
