"""Pronunciations by rules, against plain loops and by hand."""

import random

import pytest
from pyspark.sql import functions as F

from metrum.operators import pronunciations as p

ENTRIES = {"cat": ["K AE1 T", "K AH0 T"], "fish": ["F IH1 SH"], "box": ["B AA1 K S"], "walk": ["W AO1 K"], "don": ["D AA1 N"], "t": ["T IY1"], "catf": ["X"], "ish": ["IH SH"], "walks": ["W AO1 K S"]}


def _by_loops(word, rules):
    for rule in rules:
        if rule == "exact" and word in ENTRIES:
            return rule, 0, ENTRIES[word]
        if rule == "parts":
            parts = [x for x in word.replace("-", "'").split("'") if x]
            if len(parts) > 1 and all(x in ENTRIES for x in parts):
                return rule, 0, [" ".join(ENTRIES[x][0] for x in parts)]
        if rule == "compound":
            for c in range(3, len(word) - 2):
                if word[:c] in ENTRIES and word[c:] in ENTRIES:
                    return rule, c, [ENTRIES[word[:c]][0] + " " + ENTRIES[word[c:]][0]]
        if rule in p.ENDINGS:
            end, more, tail = p.ENDINGS[rule]
            if word.endswith(end) and len(word) > more and word[: -len(end)] in ENTRIES:
                return rule, 0, [ENTRIES[word[: -len(end)]][0] + " " + tail]
    return "unresolved", 0, []


@pytest.mark.parametrize("rules", [p.PLANNER, p.BUILDER])
def test_against_loops(spark, rules):
    r = random.Random(5)
    bits = [*ENTRIES, "'s", "s", "es", "ed", "ing", "-", "'", "zz"]
    words = sorted({"".join(r.choices(bits, k=r.randint(1, 3))) for _ in range(400)} | {"cats", "boxes", "walked", "walking", "catfish", "don't", "cat's", "s", "'s", ""})
    d = spark.createDataFrame(list(ENTRIES.items()), "entry string, said array<string>")
    asked = spark.createDataFrame([(w,) for w in [*words, *words, None]], "word string")
    got = {x.word: (x.source, x.cut, list(x.said)) for x in p.pronounce(asked, d, rules).collect()}
    assert got == {w: _by_loops(w, rules) for w in words}


def test_fallback_reviewed_union_report(spark):
    d = spark.createDataFrame(list(ENTRIES.items()), "entry string, said array<string>")
    more = spark.createDataFrame([("cat", ["K AH0 T", "K EH1 T"]), ("dog", ["D AO1 G"])], "entry string, said array<string>")
    both = p.entries([d, more])
    assert {x.entry: x.said for x in both.where("entry IN ('cat', 'dog')").collect()} == {"cat": ["K AE1 T", "K AH0 T", "K EH1 T"], "dog": ["D AO1 G"]}
    reviewed = spark.createDataFrame([("cat", ["K AH0 T", "C"]), ("zzz", ["Z"]), ("not asked", ["N"])], "word string, said array<string>")
    told = p.pronounce(spark.createDataFrame([("cat",), ("zzz",), ("yy",), ("dogs",)], "word string"), both, p.BUILDER, F.when(F.col("word") == "yy", "Y Y"), reviewed)
    assert {x.word: (x.source, x.said) for x in told.collect()} == {"cat": ("exact", ["K AE1 T", "K AH0 T", "K EH1 T", "C"]), "zzz": ("unresolved", ["Z"]), "yy": ("fallback", ["Y Y"]), "dogs": ("plural", ["D AO1 G Z"])}
    assert {x.source: (x.words, x.said, x.first_word) for x in p.report(told).collect()} == {"exact": (1, 4, "cat"), "unresolved": (1, 1, "zzz"), "fallback": (1, 1, "yy"), "plural": (1, 1, "dogs")}


def test_empty(spark):
    none = spark.createDataFrame([], "entry string, said array<string>")
    assert [x.source for x in p.pronounce(spark.createDataFrame([("cat",)], "word string"), none).collect()] == ["unresolved"]
    assert p.pronounce(spark.createDataFrame([], "word string"), none).count() == 0


def test_cuts_are_those_of_known_lengths(spark):
    from metrum.operators.lexicon import known_cuts, resolve

    cuts = lambda n, lengths: spark.range(1).select(known_cuts(F.lit(n), 3, F.array(*map(F.lit, lengths)).cast("array<int>"))).first()[0]
    assert cuts(9, [2, 3, 4, 6]) == [3, 6] and cuts(8, [2, 3, 4, 5]) == [3, 4, 5] and cuts(5, [2, 3]) == cuts(20_000, [3, 9]) == cuts(9, []) == []
    words = spark.createDataFrame([("catfish",), ("fishcats",), ("x" * 20_000,), ("cat's",), ("fishs",), ("catcat",), ("cat",)], "word string")
    told = {x.word[:9]: (x.source, x.cut) for x in resolve(words, spark.createDataFrame([("cat",), ("fish",), ("cats",)], "entry string")).collect()}
    assert told == {"catfish": ("compound", 3), "fishcats": ("compound", 4), "x" * 9: ("unresolved", 0), "cat's": ("possessive", 0), "fishs": ("plural", 0), "catcat": ("compound", 3), "cat": ("exact", 0)}
