"""Hand-computed fixtures for ties, defaults and edges, and brute force for the dynamic programs."""

import itertools
import random
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from metrum.functions import hashing, intervals, stats, text
from metrum.operators import alignment, gates, lexicon, regions, sampling, signal
from metrum.sources import files


def one(spark, *cols):
    return spark.range(1).select(*(c.alias(f"c{i}") for i, c in enumerate(cols))).first()


def test_ratio_and_percentile(spark):
    assert tuple(one(spark, intervals.ratio(F.lit(0), F.lit(0)), intervals.ratio(F.lit(0), F.lit(0), 0.0), intervals.ratio(F.lit(1), F.lit(4)))) == (1.0, 0.0, 0.25)
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (10.0,)], "x double")
    assert df.agg(stats.percentile(F.col("x"), 0.9)).first()[0] == 8.200000000000001
    assert df.where("x > 99").agg(stats.percentile(F.col("x"), 0.9), stats.rms(F.col("x")), stats.mean(F.col("x"))).first()[:] == (0.0, 0.0, 0.0)


def test_ties(spark):
    df = spark.createDataFrame([(3, 1, 0), (1, 2, 1)], "k int, n int, at int").withColumn("n", F.lit(2))
    assert df.agg(stats.mode_smallest(F.col("k"), F.col("n")), stats.most_common_first(F.col("k"), F.col("n"), F.col("at"))).first()[:] == (1, 3)


NUMBERS = {"0": "zero", "19": "nineteen", "20": "twenty", "105": "one hundred five", "1000": "one thousand", "21999": "twenty one thousand nine hundred ninety nine", "1000000": "1000000", "1,234": "one thousand two hundred thirty four", "1980s": "nineteen eighties", "2005s": "2005s", "2000s": "twenty", "word": "word"}


def test_number_words(spark):
    df = spark.createDataFrame(list(NUMBERS.items()), "t string, w string")
    assert [r for r in df.select("t", "w", text.expand_number(F.col("t")).alias("g")).collect() if r.w != r.g] == []


def test_tokens_and_marks(spark):
    got = one(spark, text.tokens_and_tails(F.lit("Well, it's 1,234.5 - a re-run... Yes!")))[0]
    assert [r.word for r in got] == ["Well", "it's", "1,234.5", "a", "re", "run", "Yes"]
    df = spark.createDataFrame([(r.tail,) for r in got], "tail string")
    assert [r[0] for r in df.select(text.mark_of(F.col("tail"))).collect()] == [",", "", "-", "", "", ".", "!"]
    assert one(spark, text.mark_of(F.lit("!\n?")), text.mark_of(F.lit(",\n , ")))[:] == ("?", ",")
    assert one(spark, text.text_key(F.lit("Ça VA, it's 5!")), text.vowel_runs(F.lit("rhythms"))).asDict() == {"c0": "a va it's 5", "c1": 1}


def test_hashes(spark):
    assert one(spark, hashing.fnv1a32(F.lit("AH")), hashing.fold(F.lit("case_0001")), hashing.fnv1a32(F.lit("")))[:] == (584389068, 3, 2166136261)


def test_overlap_join_ties_and_misses(spark):
    spans = spark.createDataFrame([(1, 0, 0, 2), (1, 1, 5, 6)], "case_id long, idx int, start long, end long")
    found = spark.createDataFrame([(1, 0, 0, 1), (1, 1, 1, 2), (1, 2, 8, 9)], "case_id long, r_idx int, r_start long, r_end long")
    get = lambda near: {r.idx: r.match for r in regions.best_overlap(spans, found, 3, near).collect()}
    assert get(False) == {0: 0, 1: -1} and get(True) == {0: 0, 1: 2}


def test_point_owner(spark):
    r = spark.createDataFrame([(1, 0, 0, 1000), (1, 1, 1000, 2000)], "case_id long, r_idx int, r_start long, r_end long")
    p = spark.createDataFrame([(1, 0, 1000), (1, 1, 2001), (1, 2, -1), (1, 3, 1500)], "case_id long, idx int, at long")
    assert {x.idx: x.owner for x in regions.owner_of_point(p, r, 700, 1).collect()} == {0: -1, 1: 1, 2: -1, 3: 1}


def test_range_join_equals_theta_join(spark):
    rng = random.Random(5)
    rows = lambda n: [(rng.randrange(3), i, s := rng.randrange(-500, 500), s + rng.randrange(1, 300)) for i in range(n)]
    a, b = rows(60), rows(60)
    left = spark.createDataFrame(a, "case_id long, idx int, start long, end long")
    right = spark.createDataFrame(b, "case_id long, r_idx int, r_start long, r_end long")
    want = sorted((x[1], y[1]) for x in a for y in b if x[0] == y[0] and x[2] < y[3] and y[2] < x[3])
    assert sorted((r.idx, r.r_idx) for r in regions.range_join(left, right, 97).collect()) == want


def test_split_rule(spark):
    df = spark.createDataFrame([("hard", 90, True), ("hard", 89, False), ("comma", 120, True), ("comma", 119, False), ("", 240, True), ("", 239, False), (None, 239, False)], "m string, g long, want boolean")
    assert df.where(regions.split_rule(F.col("m"), F.col("g"), 90, 120, 240) != F.col("want")).count() == 0
    assert one(spark, regions.split_rule(F.lit(""), F.lit(350), 90, 200, 240), regions.split_rule(F.lit(""), F.lit(299), 90, 200, 240))[:] == (True, False)


def test_grid_and_interpolation(spark):
    spans = spark.createDataFrame([(0, 100)], "start long, end long")
    assert sampling.grid(spans, 10).count() == 11
    rows = spark.createDataFrame([(1, i, v) for i, v in enumerate([None, 1.0, None, None, 1.6, None])], "case_id int, i int, centre double")
    got = [r.filled for r in regions.interpolate_centres(rows, 0.03, ["case_id"], "i").orderBy("i").collect()]
    assert got == pytest.approx([0.97, 1.0, 1.2, 1.4, 1.6, 1.63])
    none = spark.createDataFrame([(1, i, None) for i in range(3)], "case_id int, i int, centre double")
    assert [r.filled for r in regions.interpolate_centres(none, 0.03, ["case_id"], "i").orderBy("i").collect()] == pytest.approx([0, 0.03, 0.06])


def test_lexicon(spark):
    words = spark.createDataFrame([("cat",), ("cat's",), ("cats",), ("catdog",), ("zzz",)], "word string")
    known = spark.createDataFrame([("cat",), ("dog",)], "entry string")
    assert {r.word: r.source for r in lexicon.resolve(words, known).collect()} == {"cat": "exact", "cat's": "possessive", "cats": "plural", "catdog": "compound", "zzz": "unresolved"}
    flags = F.array(*map(F.lit, [False, True, False, False, True]))
    assert one(spark, lexicon.syllable_bounds(flags))[0] == [0, 3]


def test_gates(spark):
    m = spark.createDataFrame([("a", 0.9), ("b", 5.0)], "metric string, value double")
    got = {r.metric: r.passed for r in gates.check(m, [("a", "min", 1.0, 0.05), ("b", "max", 5.0, 0.0), ("c", "abs_min", 0.0, 0.0)]).collect()}
    assert got == {"a": False, "b": True, "c": False}


def test_lcs():
    assert alignment.lcs(["T", "AH"], ["T", "UW"]) == [(0, 0)]
    rng = random.Random(1)
    for _ in range(60):
        a, b = ([rng.choice("xyz") for _ in range(rng.randrange(6))] for _ in range(2))
        subs = {tuple(a[i] for i in c) for k in range(len(a) + 1) for c in itertools.combinations(range(len(a)), k)}
        longest = max(len(s) for s in subs if s in {tuple(b[i] for i in c) for k in range(len(b) + 1) for c in itertools.combinations(range(len(b)), k)})
        assert len(alignment.lcs(a, b)) == longest


def test_event_match_is_optimal():
    rng = random.Random(2)
    for _ in range(60):
        a, b = ([(t, rng.choice("pq"), rng.choice("uv")) for t in sorted(rng.sample(range(40), rng.randrange(5)))] for _ in range(2))
        best = (0, 0, 0.0)
        for k in range(min(len(a), len(b)) + 1):
            for i in itertools.combinations(range(len(a)), k):
                for j in itertools.combinations(range(len(b)), k):
                    if all(a[x][1] == b[y][1] and abs(a[x][0] - b[y][0]) <= 10 for x, y in zip(i, j, strict=True)):
                        best = max(best, (k, sum(a[x][2] == b[y][2] for x, y in zip(i, j, strict=True)), -float(sum(abs(a[x][0] - b[y][0]) for x, y in zip(i, j, strict=True)))))
        got = alignment.match_events(a, b, 10)
        assert (len(got), sum(a[i][2] == b[j][2] for i, j in got), -float(sum(abs(a[i][0] - b[j][0]) for i, j in got))) == best


def test_spans_and_viterbi():
    assert alignment.align_spans([(0, 1), (2, 3)], [(0, 1), (5, 6)]) == [(0, 0, 1.0), (1, -1, 0.0), (-1, 1, 0.0)]
    rng = np.random.default_rng(3)
    for _ in range(30):
        s, stay = rng.normal(size=(6, 3)), np.full(3, np.log(0.8))
        paths = [p for p in itertools.product(range(3), repeat=6) if p[0] == 0 and all(0 <= y - x <= 1 for x, y in zip(p, p[1:], strict=False))]
        cost = lambda p: sum(s[t, q] for t, q in enumerate(p)) + sum(np.log(0.8) if x == y else np.log(0.2) for x, y in zip(p, p[1:], strict=False))
        assert cost(alignment.viterbi(s, stay)) == pytest.approx(max(map(cost, paths)))
        held = alignment.fixed_lag(s, stay, 2)
        assert len(held) == 6 and all(0 <= y - x <= 1 for x, y in zip(held, held[1:], strict=False))
        assert alignment.fixed_lag(s, stay, 99) == alignment.viterbi(s, stay)


def test_signal():
    t = np.arange(64)
    e = signal.goertzel(np.cos(2 * np.pi * 8 * t / 64)[None, :], [1.0, 8.0, 16.0])
    assert e[0].argmax() == 1 and signal.periodicity(np.cos(2 * np.pi * 8 * t / 64)[None, :], 2, 16)[0] > 0.99


def test_files(spark, tmp_path):
    pcm = np.array([[0, 0], [16384, 16384], [-32768, 0]], "<i2").tobytes()
    fmt = struct.pack("<HHIIHH", 1, 2, 8000, 32000, 4, 16)
    body = b"WAVE" + b"junk" + struct.pack("<I", 3) + b"abc\0" + b"fmt " + struct.pack("<I", 16) + fmt + b"data" + struct.pack("<I", len(pcm)) + pcm
    (tmp_path / "case_1.wav").write_bytes(b"RIFF" + struct.pack("<I", len(body)) + body)
    (tmp_path / "case_2.wav").write_bytes(b"no sound")
    got = {r.case_id: r for r in files.read_wav(spark, str(tmp_path / "*.wav")).collect()}
    assert (got["case_1"].rate, got["case_1"].channels, got["case_1"].frames, got["case_1"].samples) == (8000, 2, 3, [0.0, 0.5, -0.5]) and got["case_2"].rate is None
    (tmp_path / "a.TextGrid").write_text('item []:\n item [1]:\n  name = "words"\n  intervals: size = 1\n  intervals [1]:\n   xmin = 0\n   xmax = 0.5\n   text = "say ""hi"""\n item [2]:\n  name = "phones"\n')
    assert [tuple(r) for r in files.read_textgrid(spark, str(tmp_path / "*.TextGrid")).collect()] == [("a", "words", 0, 0.0, 0.5, 'say "hi"')]
    (tmp_path / "m.meta").write_text("k=1=2\r\nbad\nz = x\nk=3\n")
    assert files.read_key_values(spark, str(tmp_path / "m.meta")).first().pairs == {"k": "3", "z": "x"}
    (tmp_path / "d.dict").write_text(";;; note\nRED 0.9 R EH D\nred(2) R IY D\nred R EH D\n")
    assert [(r.word, r.variant, r.phones) for r in files.read_dictionary(spark, str(tmp_path / "d.dict")).orderBy("variant").collect()] == [("red", 0, "R EH D"), ("red", 1, "R IY D")]
    (tmp_path / "p.csv").write_text('word_phone_index,word\n4,"a ""b"", c"\n,x\n')
    assert [tuple(r) for r in files.read_csv(spark, str(tmp_path / "p.csv"), "phone_index int, word string, start double").collect()] == [("p", 4, 'a "b", c', None), ("p", None, "x", None)]
    files.write_csv(spark.createDataFrame([(None, "x,y")], "n int, s string").coalesce(1), str(tmp_path / "out"))
    assert next((tmp_path / "out").glob("*.csv")).read_text() == 'n,s\n-1,"x,y"\n'


def test_hysteresis():
    from metrum.operators.frames import hysteresis

    assert hysteresis([True], 2, 12) == [] and hysteresis([True, True], 2, 12) == [(0, 1, 0, False)]
    assert hysteresis([True] * 2 + [False] * 11 + [True], 2, 12) == [(0, 13, 1, False)]
    assert hysteresis([True] * 2 + [False] * 12 + [True], 2, 12) == [(0, 1, 0, True)]


def test_greedy_gaps():
    from metrum.operators.curation import greedy_matches

    assert greedy_matches([(0, 1), (0.2, 1)], [(0, 1), (5, 6)], 0.18) == [(0, 0)]
    assert greedy_matches([(0, 1), (2, 3)], [(2.1, 3), (0, 0.9)], 0.18) == [(0, 1), (1, 0)]


def test_phones(spark):
    from metrum.operators import phones

    want = {"ngo": "NG OW1", "city": "S IH1 T IY0", "tough": "T AO1", "psst": "P IY1 EH1 S EH1 S T IY1", "gem": "JH EH1 M", "nge": "NG EH1", "back": "B AH0 K", "ex": "EH1 K S", "rhythms": "R HH IY0 TH M S", "a": None}
    df = spark.createDataFrame([(w,) for w in want], "w string")
    got = {r.w: r.p and " ".join(r.p) for r in df.select("w", phones.spell_out(F.col("w")).alias("p")).collect()}
    assert got == want
    assert one(spark, phones.stress(F.lit("EY1")), phones.stress(F.lit("T")), phones.syllables(F.array(F.lit("T"), F.lit("S"))), phones.plan_units(F.lit(1), F.lit(9)))[:] == (1, 0, 1, 4)
    to = spark.createDataFrame([("to", "AH0"), ("on", "AH0"), ("x", "??")], "word string, phone string")
    assert [(r.word, r.pose) for r in phones.poses(to).collect()] == [("to", "11_Oo"), ("on", "18_Uh"), ("x", None)]


def test_silences(spark):
    from metrum.operators.curation import with_silences

    t = spark.createDataFrame([(1, 0, "a", 1.0, 0.2), (1, 1, "b", 2.0, 0.2), (1, 2, "b", 2.1, 0.2), (1, 3, "c", 2.105, 0.2)], "case_id int, idx int, word string, centre double, duration double")
    got = [(r.idx, r.silence, round(r.centre, 6), round(r.duration, 6)) for r in with_silences(t).orderBy("idx", "silence").collect()]
    assert got == [(0, False, 1.0, 0.2), (0, True, 1.5, 0.8), (1, False, 2.0, 0.2), (2, False, 2.1, 0.2), (2, True, 2.1025, 0.01), (3, False, 2.105, 0.2)]


def test_scores(spark):
    from metrum.operators import frames

    x = F.array(F.lit(0.0), F.lit(1.0))
    got = one(spark, frames.sigmoid(F.lit(-800.0)), frames.sigmoid(F.lit(0.0)), frames.log_softmax(x), frames.mix(x, F.array(F.lit(1.0), F.lit(3.0)), 0.5), frames.widen(x, 1, 2))
    assert got[0] == 0.0 and got[1] == 0.5 and got[2] == pytest.approx([-1.313262, -0.313262], abs=1e-5) and got[3] == [0.5, 2.0] and got[4] == [0.0, 0.0, 0.0, 1.0, 0.0, 0.0]


def test_pause_classes(spark):
    from metrum.operators import pauses

    def run(said):
        t = spark.createDataFrame([(1, said)], "k int, s string").select("k", F.posexplode(text.tokens_and_tails(F.col("s"))).alias("i", "t"))
        marked = t.select("k", "i", F.lower("t.word").alias("word"), text.mark_of(F.col("t.tail")).alias("mark"))
        return [(r.pause, r.scored, r.seconds) for r in pauses.classify(marked, ["k"]).orderBy("i").collect()]

    assert run("a, b, and c.") == [("soft_list", "list_comma", 0.04), ("soft_list", "standard_comma", 0.04), ("none", "none", 0.0), ("hard_break", "hard_stop", 0.2)]
    assert run("well, I think so.")[0] == ("hard_break", "standard_comma", 0.2)
    assert run("x, y. p; q") == [("hard_break", "other_comma", 0.2), ("hard_break", "hard_stop", 0.2), ("hard_break", "semicolon", 0.2), ("none", "none", 0.0)]


def test_csv_files_have_their_own_headers(spark, tmp_path):
    (tmp_path / "a.csv").write_text("phone_index,word,start\n3,x,0.5\n")
    (tmp_path / "b.csv").write_text('﻿word,word_phone_index,start\n"a, b",1,0.25\ny,,1e-3\n')
    (tmp_path / "c.csv").write_text("word\nz\nw\n")
    got = [tuple(r) for r in files.read_csv(spark, str(tmp_path / "*.csv"), "phone_index int, word string, start double").collect()]
    assert sorted(got, key=repr) == sorted([("a", 3, "x", 0.5), ("b", 1, "a, b", 0.25), ("b", None, "y", 0.001), ("c", None, "z", None), ("c", None, "w", None)], key=repr)
    assert [(r.word, r.phone_index) for r in files.read_phones(spark, str(tmp_path / "c.csv")).orderBy("phone_index").collect()] == [("z", 0), ("w", 1)]


def test_textgrid_exponents_and_mangled_metadata(spark, tmp_path):
    (tmp_path / "a.TextGrid").write_text('item [1]:\n  name = "w"\n  intervals [1]:\n   xmin = 1e-05\n   xmax = 2.5E+1\n   text = "x"\n')
    assert tuple(files.read_textgrid(spark, str(tmp_path / "a.TextGrid")).first())[3:5] == (1e-05, 25.0)
    (tmp_path / "u.meta").write_bytes("k=vé\r\nz=1\r\n".encode("utf-16"))
    (tmp_path / "m.meta").write_bytes(("k=it" + "’".encode().decode("cp1252") + "s").encode())
    assert files.read_key_values(spark, str(tmp_path / "u.meta")).first().pairs == {"k": "vé", "z": "1"}
    assert files.read_key_values(spark, str(tmp_path / "m.meta")).first().pairs == {"k": "it’s"}


def test_decaying_maximum(spark):
    rng = random.Random(3)
    v = [rng.choice([0.0, rng.random() * 10]) for _ in range(300)]
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(v)], "case_id int, i int, value double")
    peak, want = 1e-4, []
    for x in v:
        peak = max(0.995 * peak, x)
        want.append(peak)
    got = sampling.decaying_max(rows, "value", 0.995, 1e-4, ["case_id"], ["i"]).orderBy("i").collect()
    assert [r.peak for r in got] == pytest.approx(want, rel=1e-12) and all(r.peak_value is None or r.peak_value == v[r.i - r.peak_age] for r in got)


def test_sinks_and_json(spark, tmp_path):
    rows = spark.createDataFrame([("c1", 1, "b, c", True), ("c1", 0, None, False), ("c2", 0, 'say "x"', None)], "case_id string, word_index int, word string, split_applied boolean")
    files.write_sink(rows, "boundaries", str(tmp_path / "b"))
    lines = next((tmp_path / "b" / "case_id=c1").glob("*.csv")).read_text().splitlines()
    assert lines[0] == ",".join(x.split()[0] for x in files.SINKS["boundaries"].split(", ")) and lines[1].startswith("0,,-1,") and lines[2].startswith('1,"b, c",-1,,,,,1,')
    back = files.read_csv(spark, str(tmp_path / "b" / "case_id=c2"), "word string, split_applied int").first()
    assert (back.word, back.split_applied) == ('say "x"', -1)
    files.write_json(rows, str(tmp_path / "j"))
    assert files.read_json(spark, str(tmp_path / "j"), "word_index int, word string").where("word IS NULL").count() == 1
    (tmp_path / "one.json").write_text('{\n  "a": {"b": 2},\n  "c": [1, 2]\n}\n')
    assert files.read_json(spark, str(tmp_path / "one.json"), "a struct<b:int>, c array<int>, d string").first() == ((2,), [1, 2], None)


def test_fnv64(spark):
    def fnv(b):
        h = 14695981039346656037
        for x in b:
            h = (h ^ x) * 1099511628211 % 2**64
        return h

    for t in ("", "a", "foobar", "é" * 50):
        r = one(spark, hashing.fnv1a64(F.lit(t)))[0]
        assert r.high * 2**32 + r.low == fnv(t.encode())
    assert one(spark, text.truth(F.lit(" Yes")), text.truth(F.lit("2")), text.number(F.lit("x"), "int", 7), text.sanitise(F.lit("a - b!")))[:] == (True, False, 7, "a_b_")


def test_drafting_edges(spark):
    from metrum.operators import drafting

    spans = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 20, 20), (1, 2, 50, 60)], "case_id long, idx long, start long, end long")
    found = spark.createDataFrame([(1, 0, 5, 20), (1, 1, 20, 30)], "case_id long, r_idx int, r_start long, r_end long")
    assert {r.idx: r.match for r in drafting.region_of_span(spans, found, 7).collect()} == {0: 0, 1: 1, 2: -1}
    w = spark.createDataFrame([(1, i, c == "x", 12) for i, c in enumerate("x..x....x...")], "case_id long, i long, active boolean, n long")
    # Gaps of two and four quiet windows: four end a region; the last region's three quiet ones do not.
    got = [(r.start, r.end) for r in drafting.active_regions(w, 10, 4, 2, 0, 0, 0).orderBy("region").collect()]
    assert got == [(0, 40), (80, 120)] and [(r.start, r.end) for r in drafting.quiet_spans(w, 10, 3).orderBy("start").collect()] == [(40, 80), (90, 120)]
    g = spark.createDataFrame([(".", 90), (",", 119), (",", 120), ("", 239), ("", 240), (",", 20), (".", 20), (".", 19)], "mark string, acoustic long")
    told = [(r.reason, r.pause_class) for r in drafting.split_reasons(g, (".",), 90, 120, 240, 20).collect()]
    assert told == [("hard_punctuation_with_lull", "region_break"), ("none", "soft_pause"), ("comma_with_lull", "region_break"), ("none", "none"), ("strong_acoustic_gap", "region_break"), ("none", "soft_pause"), ("none", "hard_pause"), ("none", "none")]
    planned = spark.createDataFrame([(1, 0, "AH", 0), (1, 0, "T", 1), (1, 0, "T", 9), (1, 0, "", -1), (1, 0, "Z", 9), (2, 0, "T", 0), (1, 0, "", 1)], "case_id long, word_index long, source_phone string, source_index int")
    owned = spark.createDataFrame([(1, 0, 0, "AH1"), (1, 0, 1, "S"), (1, 0, 2, "T")], "case_id long, owner long, index_in_word long, label string")
    got = [(r.source_phone, r.source_index, r.reason, r.located) for r in drafting.locate_phones(planned, owned).collect()]
    assert sorted(got) == sorted([
        ("AH", 0, "mfa_exact_source_phone_index", 0), ("T", 1, "mfa_source_phone_index_label_mismatch", 1), ("T", 9, "mfa_source_phone_label_fallback", 2), ("", -1, "synthetic_word_fallback", 0),
        ("Z", 9, "no_phone_evidence", -1), ("T", 0, "no_phone_evidence", -1), ("", 1, "mfa_exact_source_phone_index", 1),
    ])
