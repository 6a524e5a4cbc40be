"""The plan of a text, by hand."""

from metrum.operators import textplan


def test_plan(spark):
    rows = [("t", 0, "to", False, False, ["T", "UW1"]), ("t", 1, "hm", True, True, ["HH", "M"]), ("t", 2, "1980", False, False, []), ("t", 3, "aeio", False, False, None), ("u", 0, "on", False, False, ["AA1", "N"])]
    p = textplan.plan(spark.createDataFrame(rows, "case string, word_index long, word string, breaks boolean, ends boolean, phones array<string>"), ["case"]).where("case = 't'").orderBy("phone_index").collect()
    assert [r.phone for r in p] == ["T", "UW1", "HH", "M", "UNK", "UNK"] and [r.phone_index for r in p] == list(range(6)) and [r.word_phone for r in p] == [0, 1, 0, 1, 0, 0]
    assert [(r.units, r.unit_start, r.total_units) for r in p[::2]] == [(2, 0, 8), (2, 2, 8), (2, 4, 8)]
    assert [(r.region, r.sentence) for r in p] == [(0, 0)] * 4 + [(1, 1)] * 2
    assert [r.role for r in p] == ["supporting", "primary", "coarticulated", "primary", "primary", "primary"] and [r.pose for r in p[4:]] == ["06_Eh"] * 2
    assert [r.event_index for r in p] == list(range(6)) == [r.place for r in p] and [r.stress for r in p] == [0, 1, 0, 0, 0, 0] and [r.vowel for r in p[:2]] == [False, True]
    assert abs(p[0].start_norm - (0.25 * 2 - 0.42) / 8) < 1e-12 and abs(p[4].end_norm - (4 + 0.5 * 2 + 0.42) / 8) < 1e-12


PLANNED = "t string, place long, word_index long, phone_index long, sentence long, phone string, pose string, vowel boolean, role string, start_norm double, end_norm double, strength double, prior double, pause string, mark string"


def _fnv(name):
    h = 2166136261
    for b in name.encode():
        h = (h ^ b) * 16777619 % 2**32
    return h


def test_tensor(spark):
    rows = [
        ("t", 0, 0, 0, 0, "T", "01_TDS-Ah-", False, "supporting", 0.0, 0.2, 0.4, 0.05, "soft_list", "comma"), ("t", 1, 0, 1, 0, "UW1", "11_Oo", True, "primary", 0.2, 0.4, 0.78, None, "soft_list", "comma"),
        ("t", 2, 1, 2, 0, "M", "22_MBP", False, "primary", 0.5, 0.7, 1.0, 0.06, "hard_break", "period"), ("t", 3, 2, 4, 1, "HH", "08_Ah", False, "coarticulated", 0.8, 1.0, 0.52, 0.06, None, None), ("u", 0, 7, 0, 0, "AA1", "07_Aa", True, "primary", 0.1, 0.3, 0.78, 0.1, "hard_break", "question"),
    ]
    found = textplan.tensor(spark.createDataFrame(rows, PLANNED), ["t"]).orderBy("t", "token").collect()
    t, u = [r for r in found if r.t == "t"], [r for r in found if r.t == "u"]
    assert [r.silent for r in t] == [True, False, False, True, False, True, False, True] and [r.token for r in t] == list(range(8)) and [r.place for r in t] == [None, 0, 1, None, 2, None, 3, None]
    assert [(r.sentence_end, r.pause, r.hard_pause, r.mark) for r in t if r.silent] == [(False, False, False, "none"), (False, True, False, "comma"), (True, True, True, "period"), (False, False, False, "none")]
    assert [(r.silent, r.pause, r.mark) for r in u] == [(True, False, "none"), (False, False, "none"), (True, False, "question")]
    dense = lambda r: {a: round(x, 9) for a, x in zip(r["at"], r["value"], strict=True)}
    assert dense(t[0]) == {_fnv("SIL") % 64: 1.0, 64 + _fnv("__SILENCE__") % 32: 1.0, 96: 0.04, 101: 1.0, 103: 1.0}
    assert dense(t[2]) == {_fnv("UW") % 64: 1.0, 64 + _fnv("11_Oo") % 32: 1.0, 96: 0.075, 97: 1.0, 98: 1.0, 99: 0.3, 100: 0.78, 105: 1.0}
    assert dense(t[5]) == {_fnv("SIL") % 64: 1.0, 64 + _fnv("__SILENCE__") % 32: 1.0, 96: 0.12, 99: 0.75, 103: 1.0, 106: 1.0, 107: 1.0, 109: 1.0}
    assert dense(u[2]) == {_fnv("SIL") % 64: 1.0, 64 + _fnv("__SILENCE__") % 32: 1.0, 96: 0.04, 99: 1.0, 102: 1.0, 103: 1.0, 107: 1.0, 110: 1.0}
    assert textplan.tensor(spark.createDataFrame([], PLANNED), ["t"]).count() == 0
