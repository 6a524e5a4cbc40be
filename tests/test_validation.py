"""Targets, weights, losses and decoded metrics of frames, by hand and against plain loops."""

import math
import random

import pytest
from metrum.operators import validation as v

TOKENS = "case_id string, token long, centre double, duration double, silent boolean, vowel boolean, word_start boolean, word_end boolean, region_start boolean, region_end boolean, sentence_end boolean, confidence double, role int"
FRAMES = "case_id string, frame long, target long, decoded long, scores array<struct<token:long,score:double>>, speech double"


def _token(case, i, centre, *flags, duration=2.0, confidence=1.0, role=2):
    return (case, i, float(centre), duration, *(f in flags for f in ("silent", "vowel", "word_start", "word_end", "region_start", "region_end", "sentence_end")), confidence, role)


def _utterance(case="a"):
    return [
        _token(case, 0, 0, "silent", "region_start"), _token(case, 1, 4, "word_start", "region_start"), _token(case, 2, 7, "vowel", "word_end"), _token(case, 3, 9, "silent", "sentence_end"),
        _token(case, 4, 12, "word_start", "word_end", confidence=0.5), _token(case, 5, 15, "silent", "region_end"),
    ]


def test_targets(spark):
    # Ends: 3 (the word begins), 5.5 (halfway), 8 (before a silence), 11 (the word begins), 13; a frame at an end is before it.
    frames = spark.createDataFrame([("a", float(t)) for t in range(16)] + [("b", 1.0), ("a", None)], "case_id string, time double")
    got = v.targets(spark.createDataFrame(_utterance(), TOKENS), frames, ["case_id"]).collect()
    assert [r.target for r in sorted((r for r in got if r.case_id == "a" and r.time is not None), key=lambda r: r.time)] == [0] * 4 + [1] * 2 + [2] * 3 + [3] * 3 + [4] * 2 + [5] * 2
    assert sorted((r.case_id, r.target) for r in got if r.case_id == "b" or r.time is None) == [("a", None), ("b", None)]
    # An end that lies before an earlier one waits for it.
    back = [_token("a", 0, 10), _token("a", 1, 2), _token("a", 2, 30)]
    got = v.targets(spark.createDataFrame(back, TOKENS), spark.createDataFrame([("a", t) for t in (6.0, 6.5, 15.0, 16.0, 17.0)], "case_id string, time double"), ["case_id"])
    assert [r.target for r in got.orderBy("time").collect()] == [0, 1, 1, 1, 2]


def _random_frames(seed, n, tokens=6):
    r = random.Random(seed)
    target = sorted(r.randrange(tokens) for _ in range(n))
    decoded = sorted(r.randrange(tokens) for _ in range(n))
    return [("a", i, target[i], decoded[i], [(t, r.uniform(-2, 2)) for t in range(tokens) if r.random() < 0.8], r.uniform(-3, 3)) for i in range(n)]


def _chance(scores, first, last):
    total = sum(math.exp(s) for _, s in scores)
    inside = sum(math.exp(s) for t, s in scores if first <= t <= last)
    return min(max(inside / total if total else 0.0, 1e-6), 1 - 1e-6)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_losses_by_loops(spark, seed):
    tokens, frames = _utterance(), _random_frames(seed, 40)
    t, f = spark.createDataFrame(tokens, TOKENS), spark.createDataFrame(frames, FRAMES)

    def loss(first, last, share):
        near = [-math.log(_chance(s, first, last)) for _, _, y, _, s, _ in frames if first <= y <= last]
        far = [-math.log(1 - _chance(s, first, last)) for _, _, y, _, s, _ in frames if y in (first - 1, last + 1)]
        return (sum(near) / len(near) if near else 0) + share * (sum(far) / len(far) if far else 0)

    words = {r.first: r for r in v.word_losses(t, f, ["case_id"]).collect()}
    assert [(r.first, r.last, r.weight) for r in sorted(words.values())] == [(1, 2, 2.0), (4, 4, 2.0)]
    assert all(abs(r.loss - loss(r.first, r.last, 0.5)) < 1e-9 for r in words.values())
    phones = {r.token: r for r in v.phone_losses(t, f, ["case_id"]).collect()}
    assert {k: round(r.weight, 6) for k, r in phones.items()} == {1: 1.875, 2: 2.25, 4: round(1.5 * 0.5 * 1.25 * 1.5, 6)}
    assert all(abs(r.loss - loss(r.token, r.token, 0.25)) < 1e-9 for r in phones.values())
    w = {r.frame: r for r in v.weights(t, f, ["case_id"]).collect()}
    own = [7.0, 7.0, 4.0, 8.0, 4.0, 7.0]
    change = {(0, 1): 14.0, (1, 2): 4.0, (2, 3): 14.0, (3, 4): 14.0, (4, 5): 10.0}
    target = [x[2] for x in frames]
    for i, y in enumerate(target):
        near = [change.get((target[j - 1], target[j])) for j in range(max(1, i - 4), min(len(target), i + 5)) if target[j] != target[j - 1]]
        if None not in near:
            assert abs(w[i].weight - max([own[y], *near]) * (0.5 if y == 4 else 1.0)) < 1e-9
        assert w[i].speech_target == (0.0 if y in (0, 5) else 1.0)
        turned = any((target[j] in (0, 5)) != (target[j - 1] in (0, 5)) for j in range(max(1, i - 10), min(len(target), i + 11)))
        assert w[i].speech_weight == (6.0 if turned else 2.0 if y in (0, 5) else 1.0)
    total = v.losses(t, f, ["case_id"]).collect()[0]
    by_frame = sum(-math.log(_chance(s, y, y)) * w[i].weight for _, i, y, _, s, _ in frames) / sum(r.weight for r in w.values())
    heard = sum((max(x, 0) - x * w[i].speech_target + math.log1p(math.exp(-abs(x)))) * w[i].speech_weight for _, i, _, _, _, x in frames) / sum(r.speech_weight for r in w.values())
    mean = lambda rows: sum(r.loss * r.weight for r in rows) / sum(r.weight for r in rows)
    assert abs(total.loss - (by_frame + 0.45 * heard + 0.35 * mean(words.values()) + 0.25 * mean(phones.values()))) < 1e-9


def test_decoded_by_hand(spark):
    target, decoded = [0, 1, 1, 2, 2, 2, 3, 4, 5], [0, 0, 1, 1, 1, 2, 3, 5, 5]
    frames = [("a", i, target[i], decoded[i], [], 0.0) for i in range(9)]
    items = v.decoded_items(spark.createDataFrame(_utterance(), TOKENS), spark.createDataFrame(frames, FRAMES), ["case_id"])
    # Token 4 is never decoded, so neither its word nor its phone counts.
    assert sorted((r["item"], r["first"], r["last"], r["onset_error"], r["exit_error"], r["overlap"], r["length"]) for r in items.collect()) == [("phone", 1, 1, 1, 2, 1, 2), ("phone", 2, 2, 2, 0, 1, 3), ("word", 1, 2, 1, 0, 4, 5)]
    m = v.decoded_metrics(items).collect()[0]
    assert (m.words, m.short_words, m.phones, m.key_phones, m.phone_zero, m.phone_few) == (1, 1, 2, 2, 0, 2) and (m.word_onset_ms, m.phone_onset_ms, m.phone_exit_ms) == (10.0, 15.0, 10.0)
    seen = (0.5 + 0.333333) / 2
    want = (10 + 0 + 200 * 0.2) + (0.5 * 10 + 100 * 0.2) + (0.35 * 25 + 80 * (1 - seen) + 200) + (0.5 * 25 + 120 * (1 - seen) + 300)
    assert abs(m.selection - want) < 1e-6


def test_empty(spark):
    t, f = spark.createDataFrame([], TOKENS), spark.createDataFrame([], FRAMES)
    assert v.losses(t, f, ["case_id"]).count() == 0 == v.weights(t, f, ["case_id"]).count() == v.decoded_items(t, f, ["case_id"]).count()
    m = v.decoded_metrics(v.decoded_items(t, f, ["case_id"])).collect()[0]
    assert (m.words, m.phones, m.selection, m.word_coverage) == (0, 0, 0.0, 0.0)
    one = spark.createDataFrame([("a", 0, 1, 1, [], 0.0), ("a", 1, None, None, None, None)], FRAMES)
    assert v.losses(spark.createDataFrame(_utterance(), TOKENS), one, ["case_id"]).count() == 1


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_runs_show_what_targets_show(spark, seed):
    r = random.Random(seed)
    tokens, step = [], 2
    for case in ("a", "b", "c"):
        at = 0
        for i in range({"a": 40, "b": 1, "c": 25}[case]):
            at += r.choice([0, 1, 1, 3, 60])
            flags = [f for f in ("silent", "vowel", "word_start", "word_end", "region_start", "region_end", "sentence_end") if r.random() < 0.3]
            tokens.append((*_token(case, i, at, *flags, duration=float(r.choice([1, 2, 8])), confidence=r.choice([0.0, 0.5, 1.0])), float(at + r.randint(-9, 9))))
    t = spark.createDataFrame(tokens, TOKENS + ", late double")
    grid = [(case, k, float(min(c) + step * k)) for case in ("a", "b", "c") for c in [[x[2] for x in tokens if x[0] == case]] for k in range(int((max(c) - min(c)) // step) + 1)]
    frames = spark.createDataFrame(grid, "case_id string, frame long, time double")
    want = v.targets(t.withColumn("centre", t["late"]), v.targets(t, frames, ["case_id"]), ["case_id"], "decoded")
    found = v.runs(t, ["case_id"], step)
    shown = ["case_id", "frame", "time", "target", "decoded"]
    rows = lambda d: sorted(map(tuple, d.collect()))
    assert rows(v.frames_of(found, step).select(*shown)) == rows(want.select(*shown)) and found.count() < len(grid)
    weighed = v.weights(t, want, ["case_id"])
    assert rows(v.weights_of_runs(found, ["case_id"]).select(*weighed.columns)) == rows(weighed)
    by_run, by_frame = v.decoded_items(t, found, ["case_id"]), v.decoded_items(t, want, ["case_id"])
    assert rows(by_run) == rows(by_frame)
