"""Steps whose memory, tasks and passes do not grow faster than the input."""

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from voxframe.functions.core import range_join
from voxframe.operators import analyze as AN
from voxframe.operators import infer as INF
from voxframe.operators import vocab as VC
from voxframe.plans import q_quality
from voxframe.plans.q_quality import TONE, _tone, stub_synthesizer
from voxframe.sources.manifest import parse_lines
from voxframe.sources.sinks import write_audio_by_lang


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_range_join_broadcasts_no_exploded_side(spark):
    p = spark.createDataFrame([("k", 100)], "k string, n long").select("k", F.explode(F.sequence(F.lit(0).cast("long"), "n")).alias("x"))
    r = spark.createDataFrame([("k", 10, 20)], "k string, lo long, hi long")
    j = range_join(p, r, "x", "lo", "hi", keys=["k"])
    assert j.count() == 11
    assert "BroadcastHashJoin" not in _plan(j) and "SortMergeJoin" in _plan(j)


def test_lines_of_one_file_do_not_meet_in_one_task(spark):
    names, rows = "audio_file|text|speaker_name|language|ref_file", [(1, "a.wav|hi|s|en|r"), (2, "b.wav|ho|s|en|r")]
    lines = spark.createDataFrame([(n, t, f) for f in ("/x.csv", None) for n, t in [(0, names), *rows]], "line_no long, line string, file_path string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for lines of any size
    try:
        x = parse_lines(lines, "coqui", "/d")
        assert sorted((r.text, r.audio_file) for r in x.collect()) == [("hi", "/d/a.wav")] * 2 + [("ho", "/d/b.wav")] * 2
        assert "SortMergeJoin" not in _plan(x) and "BroadcastHashJoin" in _plan(x)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_encoder_and_decoder_give_ids_back_piece_by_piece(spark, monkeypatch):
    made = []
    vocab = spark.createDataFrame([("a", 7), ("b", 8)], "token string, id long")
    table = VC.code_point_table(vocab)
    monkeypatch.setattr(VC.F, "arrow_udf", lambda kind: lambda f: made.append(f) or (lambda c: c))
    VC.encode_chars_arrow(F.lit(""), table, 4)
    VC.decode_arrow(F.lit(""), vocab, 4)
    texts = ["ab", "b?", None, "abab", "", "a"]
    ids = list(made[0](iter([pa.array(texts, pa.string()), pa.array([], pa.string())])))
    assert max(len(p.flatten()) for p in ids) < 4 + 4 and len([p for p in ids if len(p)]) > 1
    whole = [x for p in ids for x in p.to_pylist()]
    assert whole == [[7, 8], [8], None, [7, 8, 7, 8], [], [7]]
    back = list(made[1](iter([pa.array(whole, pa.list_(pa.int64()))])))
    assert len(back) > 1 and [x for p in back for x in p.to_pylist()] == ["ab", "b", None, "abab", "", "a"]


def test_routed_words_are_counted_before_they_meet_the_lexicon(spark):
    words = spark.createDataFrame([("en", "a")] * 5 + [("en", "b"), (None, "a"), ("en", None)], "l string, w string")
    lexicon = spark.createDataFrame([("en", "A"), (None, "B")], "lx string, u string")
    x = VC.route_words(words, "l", "w", lexicon, "lx", "u")
    assert {r.l: (r.n_words, r.n_matched) for r in x.collect()} == {"en": (7, 5), None: (1, 0)}
    assert "InMemoryTableScan" in _plan(x)


def test_model_calls_are_spread_over_all_cores(spark):
    df = spark.range(4000).select("id", F.lit("en").alias("lang"))
    n = [r["count"] for r in INF.group_by_language(df, "lang").groupBy(F.spark_partition_id()).count().collect()]
    assert len(n) >= INF.TASKS_PER_CORE * spark.sparkContext.defaultParallelism * 0.9 and max(n) < 4 * 4000 / len(n)


def test_the_kept_tone_is_the_tone():
    for n in (0, 1, 777, TONE // 60 + 3):
        assert (stub_synthesizer("x" * n, "en") == _tone(0, 60 * n)).all()


def test_analysis_reads_its_texts_once(spark, tmp_path, monkeypatch):
    from voxframe.plans.q_sinks import _snk_analysis
    rows = [(i, "a few words " * (i % 5 + 1), "en" if i % 2 else "fr", 10 * i + 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    seen, totals = [], AN.totals
    monkeypatch.setattr(AN, "totals", lambda df, *a: seen.extend(df.inputFiles()) or totals(df, *a))
    got = {r.metric: r.value for r in _snk_analysis(spark, str(tmp_path)).collect()}
    assert float(got["total_words"]) == sum(3 * (i % 5 + 1) for i in range(40))
    assert seen and not any("documents.parquet" in f for f in seen)


def _generated(df):
    """Rows that each explode of the plan makes, by the expression it explodes."""
    qe = df._jdf.queryExecution()
    qe.toRdd().count()
    out, todo = [], [qe.executedPlan()]
    while todo:
        node = todo.pop()
        todo += [node.children().apply(i) for i in range(node.children().size())]
        if node.nodeName() == "Generate":
            out.append((node.generator().toString(), node.metrics().apply("numOutputRows").value()))
    return out


def test_many_ranges_are_not_cut_into_many_rows(spark):
    n = 1 << 17
    few, many = ([(10 ** 9, 10 ** 9 + 12345)], spark.range(n).selectExpr("id * 36 AS lo", "id * 36 + 30 AS hi"))
    p = spark.range(1000).selectExpr("id * 50 AS x")
    r = many.union(spark.createDataFrame(few, "lo long, hi long"))
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = range_join(p, r, "x", "lo", "hi")
        made = {("cells" if "sequence" in g else "points"): k for g, k in _generated(j)}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert n < made["cells"] < 2 * n and made["points"] == 2 * 1000
    assert j.count() == sum(50 * i % 36 <= 30 for i in range(1000))


def test_a_range_that_holds_all_points_is_cut(spark):
    j = range_join(spark.range(1 << 12).withColumnRenamed("id", "x"), spark.createDataFrame([(0, (1 << 12) - 1)], "lo long, hi long"), "x", "lo", "hi")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert [k for g, k in _generated(j) if "sequence" in g] == [64]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert j.count() == 1 << 12


def test_words_meet_samples_without_being_cut(spark, tmp_path):
    from voxframe.plans.q_assemble import _asm_label_time_join
    text = ["a bc  defghij", "klmnopqrstuvwxyzklmnopqrstuvwxyz x", " ", None, "one two three"]
    rows = [(c, t, text[((c or 0) + t) % 5]) for c in (1, 2, None) for t in range(9)]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    want, n_words = [], 0
    for c in (1, 2):
        at, words = 0, []
        for t in range(9):
            for k, w in enumerate((text[(c + t) % 5] or "").split()):
                words.append((at * 0.06 * 100, (at + len(w)) * 0.06 * 100, t, k, w))
                at += len(w) + 1
        n_words += len(words)
        want += [(c, i, t, k, w) for i in range(0, int(max(x[1] for x in words)) + 1, 50) for lo, hi, t, k, w in words if lo <= i <= hi]
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        j = _asm_label_time_join(spark, str(tmp_path))
        made = [k for g, k in _generated(j) if "shiftright" in g]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    assert sorted(tuple(r) for r in j.collect()) == sorted(want)
    assert len(made) == 1 and made[0] <= 2 * n_words


def _wave(wav):
    """Rate and samples of a WAV file of 32-bit floats."""
    kind, channels, rate = struct.unpack("<HHI", wav[20:28])
    assert (wav[:4], wav[8:16], kind, channels, wav[50:54]) == (b"RIFF", b"WAVEfmt ", 3, 1, b"data")
    assert struct.unpack("<I", wav[4:8])[0] == len(wav) - 8 and struct.unpack("<I", wav[54:58])[0] == len(wav) - 58
    return rate, np.frombuffer(wav[58:], "<f4")


def test_the_model_gives_whole_waves_back(spark, tmp_path):
    def model(text, language):
        if text == "bad":
            raise ValueError("x" * 2000)
        return None if text == "none" else np.ones((2, 3)) if text == "two" else np.arange(len(text) * 1000)

    texts = ["a" * n for n in (1, 0, 7, 3000)] + ["bad", "none", "two"]
    rows = [(i if i else None, "l" + str(i % 2), t) for i, t in enumerate(texts)] + [(2 ** 60 + 1, "l0", "abc")]
    df = spark.createDataFrame(rows, "k long, l string, t string").coalesce(1)
    x = INF.apply_model(df, model, "k", "l", "t", rate=8000)
    got = {r.id: r for r in x.collect()}
    assert len(got) == len(rows) and set(got) == {k for k, _, _ in rows}
    for k, lang, t in rows:
        r = got[k]
        assert r.language == lang and r.proc_s >= 0
        if t in ("bad", "none", "two"):
            assert (r.status, r.n_samples, r.wav) == ("failed", 0, None)
        else:
            rate, wave = _wave(r.wav)
            assert (r.status, r.error, r.n_samples, rate) == ("ok", None, 1000 * len(t), 8000)
            assert (wave == np.arange(1000 * len(t), dtype=np.float32)).all()
    assert got[4].error == "ValueError: " + "x" * 2000 and got[5].error.startswith("ValueError")
    write_audio_by_lang(x.where("status = 'ok'").select("id", "language", "wav"), f"{tmp_path}/audio")
    back = spark.read.parquet(f"{tmp_path}/audio")
    assert {(r.id, r.language, bytes(r.wav)) for r in back.collect()} == {(r.id, r.language, bytes(r.wav)) for r in got.values() if r.wav is not None}


def test_every_call_of_the_stand_in_computes_its_tone(monkeypatch):
    made = []
    monkeypatch.setattr(q_quality, "_tone", lambda a, b: made.append((a, b)) or _tone(a, b))
    want = np.sin(2 * np.pi * 220 * np.arange(60 * 300) / 16000)
    for _ in range(2):
        assert abs(stub_synthesizer("x" * 300, "en") - want).max() < 1e-6
    assert made == [(0, 60 * 300)] * 2
