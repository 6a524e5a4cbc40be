"""The tensor in its two forms, places without a sort of phones, looks ahead without a look at each later word."""

import random

from metrum.functions import hashing
from metrum.operators import pauses, textplan
from metrum.plans import catalogue

from tests.test_textplan import PLANNED, _fnv

SF = "/root/testdata/sf0.001"


def test_text_says_what_lists_say(spark):
    r, rows = random.Random(5), []
    for t in ("t", "u", "v"):
        word, sentence = 0, 0
        for place in range({"t": 40, "u": 1, "v": 7}[t]):
            if r.random() < 0.5:
                word, sentence = word + 1, sentence + (r.random() < 0.3)
            phone, pose = r.choice([("T", "01_TDS-Ah-"), ("UW1", "11_Oo"), ("QQ", "99_None"), ("HH", "08_Ah")])
            rows.append((t, place, word, place, sentence, phone, pose, r.random() < 0.5, r.choice(textplan.ROLES), place / 50, place / 50 + 0.1, r.choice([0.0, 0.5]), r.choice([None, 0.06]), r.choice([None, "none", "soft_list", "hard_break"]), r.choice([None, "none", *textplan.MARKS])))
    events = spark.createDataFrame(rows, PLANNED)
    lists, said = (sorted(map(tuple, f(events, ["t"]).collect()), key=lambda x: x[:2]) for f in (textplan.tensor, textplan.tensor_text))
    assert [(*x[:-2], " ".join(f"{a}:{int(v * 1e6 + 0.5)}" for a, v in zip(x[-2], x[-1], strict=True))) for x in lists] == said
    assert all(list(x[-2]) == sorted(x[-2]) for x in lists) and {x[-2][0] for x in lists if not x[2]} == {_fnv(n) % 64 for n in ("T", "UW", "QQ", "HH")}
    assert [hashing.fnv1a32_of(x) for x in ("", "SIL", "é")] == [_fnv(x) for x in ("", "SIL", "é")]


def test_places_are_those_of_starts(spark):
    r = random.Random(9)
    names = ["X", "T", "UW1", "M", "AE1", "HH", None]
    rows = [("t", i, "w", False, False, r.choice([None, [], [r.choice(names) for _ in range(r.choice([1, 2, 3, 5, 80]))]])) for i in range(300)]
    p = textplan.plan(spark.createDataFrame(rows, "case string, word_index long, word string, breaks boolean, ends boolean, phones array<string>"), ["case"]).collect()
    want = {(i, k): q for _, i, _, _, _, ph in rows for k, q in enumerate(ph or ["UNK"])}
    assert {(x.word_index, x.word_phone): x.phone for x in p} == want and len(p) == len(want)
    shown = sorted((x for x in p if x.pose is not None), key=lambda x: (x.word_index, x.word_phone))
    assert [x.event_index for x in shown] == list(range(len(shown)))
    assert [x.place for x in sorted(shown, key=lambda x: (x.start_norm, x.event_index))] == list(range(len(shown)))
    assert all(x.place is None and x.event_index is None and x.start_norm is None for x in p if x.pose is None)


def test_sorts_and_windows(spark):
    plan = catalogue.QUERIES["transcript_tensor"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # Three sorts of words and one of events.
    assert plan.count("- Sort [") <= 4 and "Join" in plan and "SortMergeJoin" not in plan


def test_conjunctions_later(spark):
    words = [("t", i, w, m) for i, (w, m) in enumerate([("a", ","), ("b", ""), ("and", ""), ("c", "."), ("and", ","), ("d", ""), ("e", ","), ("what", ","), ("f", ".")])]
    d = spark.createDataFrame(words, "t string, i int, word string, mark string")
    found = pauses.classify(d, ["t"])
    assert [x.pause for x in found.orderBy("i").collect()] == ["soft_list", "none", "none", "hard_break", "soft_list", "none", "hard_break", "soft_list", "hard_break"]
    windows = found.select("pause")._jdf.queryExecution().optimizedPlan().toString()
    assert "1, unboundedfollowing" not in windows and "unboundedpreceding" in windows
