"""Training-data operators that do the whole job, against brute force and SQL."""

import os
import random
import re
import subprocess
import sys
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrum.llm import chat, packing, phrases, pieces, queries, secrets, sharding, simhash, toxicity, urlrules, vptree
from tests.oracle import differences

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert differences(queries.QUERIES[name](spark, SF), queries.ORACLES[name], SF) == ""


def test_local_search_ends_without_an_exchange():
    rng = random.Random(7)
    small = [({rng.randrange(1, 60): rng.randrange(1, 9) for _ in range(12)}, 100) for _ in range(100)]
    # More than 200 underfull groups.
    many = ({rng.randrange(500, 1500): rng.randrange(1, 6) for _ in range(700)}, 2048)
    for h, capacity in [*small, many]:
        plan = packing.pack_histogram(h, capacity)
        used = Counter()
        for b, n in plan.items():
            for s, m in b:
                used[s] += m * n
        assert used == Counter(h)
        under = [b for b in plan if packing.fill(b) < capacity]
        assert not any(packing.exchange(a, b, capacity) for a in under for b in under if packing.fill(a) >= packing.fill(b) and (a != b or plan[a] > 1))


def test_url_tokens_have_the_files_ending(spark):
    urls = {"https://a.b/x/setup.EXE?q=1.zip#f.pdf": ["e=exe"], "http://a.b/v1.2/": [], "http://a.b": [], "http://a.b/.env": [], "http://a.b/x.tar.gz": ["e=gz"], "http://a.b/x.": [], "http://a.b/v1.2/get": [], "no url.exe": [], "http://a.b/song.mp3": ["e=mp3"]}
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = df.select("u", urlrules.tokens(urlrules.host_of(F.col("u")), urlrules.path_of(F.col("u")), F.col("u")).alias("t")).collect()
    assert {r.u: [t for t in r.t if t.startswith("e=")] for r in got} == urls
    # Pages that share nothing but their ending are blocked by it.
    labels = spark.createDataFrame([(f"http://h{i}x{i}/p{chr(97 + i % 26)}{chr(97 + i // 26)}.{'exe' if i % 2 else 'txt'}", "block" if i % 2 else "allow") for i in range(200)], "url string, verdict string")
    pages = spark.createDataFrame([(1, "http://new/other.exe"), (2, "http://new/other.txt"), (3, "http://new/other")], "page_id long, url string")
    assert {r.page_id: (r.verdict, r.by) for r in urlrules.judge(pages, [], labels).collect()} == {1: ("block", "mined"), 2: ("allow", "mined"), 3: ("allow", "default")}


def test_tokens_of_the_same_rows_are_one(spark):
    # A path of 24 segments that all blocked rows share: as single tokens these would make 2^24 combinations.
    shared = [f"p={i}" for i in range(24)]
    rows = [([*shared, f"x{i}"], "block") for i in range(60)] + [(["y", f"x{i}"], "allow") for i in range(60)]
    rules = urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9).collect()
    assert {(tuple(r.antecedent), tuple(map(tuple, r.alternatives)), r.verdict) for r in rules} == {(("p=0",), (tuple(sorted(shared)),), "block"), (("y",), (("y",),), "allow")}
    pages = spark.createDataFrame([(1, ["p=7"]), (2, ["y"]), (3, ["p=7", "p=9"]), (4, ["z"])], "row long, tokens array<string>")
    told = urlrules.match(pages, urlrules.mine(spark.createDataFrame(rows, "tokens array<string>, verdict string"), 0.05, 0.9))
    assert {r.row: r.mined for r in told.collect()} == {1: "block", 2: "allow", 3: "block"}


def test_rules_must_hold_on_the_fold_kept_back(spark):
    fold = lambda t: spark.range(1).select(F.pmod(F.xxhash64(F.lit(t)), F.lit(5))).first()[0]
    back = next(f"b\nk{i}" for i in range(99) if fold(f"b\nk{i}") == 0).split("\n")
    fit = next(f"b\nm{i}" for i in range(99) if fold(f"b\nm{i}") != 0).split("\n")
    rows = [(fit, "block")] * 50 + [(back, "allow")] * 5
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    assert urlrules.mine(df, 0.05, 0.9).count() == 0 and urlrules.mine(df.where("verdict = 'block'"), 0.05, 0.9, folds=0).count() == 1


@pytest.fixture(scope="module")
def model():
    return queries.tokenizer("piece_bpe_32k.model")


def test_draws_do_not_depend_on_what_a_worker_has_kept(model):
    texts = ["The quick brown fox, Привет мир! 你好世界 naïve 😀x", "x" * 300 + " \n\n  end"] * 3
    keys = [str(i) for i in range(6)]
    fresh = [pieces.Sampler(model, 0.5, 1).sample([t], [k])[0].tolist() for t, k in zip(texts, keys, strict=True)]
    full = pieces.Sampler(model, 0.5, 1)
    rng = random.Random(2)
    for _ in range(40):
        full.sample(["".join(rng.choice("abcdefghij klmnop") for _ in range(3000))], ["z"])
    ids, many = full.sample(texts, keys)
    at = np.concatenate([[0], np.cumsum(many)])
    assert [ids[i:j].tolist() for i, j in zip(at, at[1:], strict=False)] == fresh


@pytest.mark.parametrize("script", ["chinese", "cyrillic", "one letter", "emoji"])
def test_a_text_of_a_million_characters(model, script):
    rng = random.Random(3)
    text = {"chinese": lambda: "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(1_000_000)), "cyrillic": lambda: "".join(rng.choice("абвгдежзийклмноп ") for _ in range(1_000_000)), "one letter": lambda: "x" * 100_000, "emoji": lambda: "😀🚀" * 500_000}[script]()
    s, began = pieces.Sampler(model, 0.5, 1), time.time()
    ids, _ = s.sample([text], ["k"])
    assert pieces.decode_bytes(ids, s.pieces).tobytes() == text.encode() and time.time() - began < 20


def test_chunks_have_no_piece_across(model):
    p = pieces.Pieces(model, 0.5)
    rng = random.Random(4)
    for _ in range(50):
        text = "".join(rng.choice("ab th é你好пр \n▁😀==") for _ in range(40))
        chunks, many = p.cut([text, "", text])
        assert "".join(chunks) == text * 2 and many.tolist() == [len(chunks) // 2, 0, len(chunks) // 2]
        at, where = 0, set()
        for c in chunks[: len(chunks) // 2]:
            at += len(c)
            where.add(at)
        crossing = {i + k for i in range(len(text)) for j in range(i + 2, len(text) + 1) if text[i:j] in p.text for k in range(1, j - i)}
        assert not where & crossing


def test_plan_of_many_ranges(spark, monkeypatch):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    heads = [(-20_000 + 4 * i, 0) for i in range(5000)]
    monkeypatch.setattr(phrases, "first_keys", lambda *_: heads)
    began = time.time()
    phrases.compare_with_next(docs)._jdf.queryExecution().executedPlan().toString()
    assert time.time() - began < 5


def test_ranges_part_rows_of_one_id(spark):
    # All null ids and one long boilerplate head: ranges are cut by the whole texts.
    docs = spark.createDataFrame([(None, f"{'licence ' * 9}{i:05d}") for i in range(400)], "doc_id long, text string")
    assert len(phrases.first_keys(docs.select(F.lit(0).cast("long").alias("i"), F.xxhash64("text").alias("h")), 50)) > 4
    got = [r.near_edited for r in phrases.compare_with_next(docs, rows_a_range=50).collect()]
    assert len(got) == 400


def test_heads_of_ranges_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(phrases, "MOST_RANGES", 10)
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"))
    assert len(phrases.first_keys(docs.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")), 1)) <= 10
    assert phrases.compare_with_next(docs, rows_a_range=1).count() == 3000


@pytest.mark.parametrize("kind", ["equal", "null", "stride"])
def test_ids_do_not_make_a_range_larger(spark, kind):
    key = {"equal": F.lit(5), "null": F.lit(None), "stride": F.col("id") * 4096}[kind].cast("long")
    docs = spark.range(20_000).select(key.alias("doc_id"), F.concat(F.lit("t"), F.col("id") % 7000).alias("text"))
    plan = sharding.assign(docs)
    got = plan.groupBy("shard").agg(F.sum("size").alias("b"), F.count("*").alias("n"), F.countDistinct("slot").alias("d"), F.max("slot").alias("m")).collect()
    assert len(got) == 8 and max(r.b for r in got) - min(r.b for r in got) <= 12 and all(r.n == r.d == r.m + 1 for r in got)


def _planted(spark):
    """Documents of 12 owners with copied and owner-specific tokens, and what only looks like them."""
    r = random.Random(6)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    drawn = lambda: "".join(r.choice(letters) for _ in range(32))
    copied, own, rows = [drawn() for _ in range(6)], [(drawn(), f"o{i % 12}") for i in range(400)], []
    decoys = ["src/main/resources/Version2Templates/default", "build-2024-11-05-release-candidate-7", "InternationalizationHelper2Factory", "0A1B2C3D4E5F60718293A4B5", "the_quick_brown_fox_1_jumps_over", "AAAAAAAAAAaaaaaaaaaa1111111111"]
    for i in range(4000):
        owner, words = f"o{i % 12}", [f"w{r.randrange(900)}" for _ in range(30)]
        words.insert(3, copied[i % 6])
        words.insert(9, f"{decoys[i % 6]}")
        if i % 10 == 0:
            words.insert(20, own[i // 10][0])
            owner = own[i // 10][1]
        rows.append((i, " ".join(words), "en", owner, 0))
    return spark.createDataFrame(rows, DOCS), {v for v, _ in own}, set(copied)


@pytest.mark.parametrize("most", [1_000_000, 0])
def test_planted_tokens(spark, most):
    docs, own, copied = _planted(spark)
    spans = secrets.scan_secrets(docs, broadcast_rows=most).withColumnRenamed("doc_id", "k")
    found = spans.join(docs, F.col("k") == F.col("doc_id")).select("text", F.explode("spans").alias("s")).where("s.kind = 3").collect()
    marked = [r.text[r.s.start : r.s.end] for r in found]
    assert len(marked) > 390 and not copied & set(marked)
    precision, recall = sum(m in own for m in marked) / len(marked), len(own & set(marked)) / len(own)
    assert precision == 1 and recall >= 0.97
    kept = secrets.redact(docs, broadcast_rows=most).where(F.col("text").contains("[SECRET]")).count()
    assert kept == len(marked)


def test_one_value_in_every_document(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("token=Zq8Lm2Xv5Tb9Rw4Yk7Pd w"), "id").alias("text"), F.lit("en").alias("lang"), F.concat(F.lit("o"), F.col("id") % 5).alias("source"), F.lit(0).alias("n_chars"))
    for most in (1_000_000, 0):
        got = secrets.scan_secrets(docs, broadcast_rows=most).select(F.explode("spans").alias("s")).select("s.*").distinct().collect()
        assert [(r.live, r.owners, r.repositories) for r in got] == [(False, 5, 6000)]


def test_secrets_of_a_long_text_take_linear_time():
    part = "token=abcdef0123456789abcdef " + "Zq8Lm2Xv5Tb9Rw4Yk7Pd" + " AKIA" + "Z9" * 8 + " "
    began = time.time()
    found = secrets.scan(part * 12_000)
    assert time.time() - began < 5 and Counter(k for k, *_ in found) == {0: 12_000, 1: 12_000, 2: 12_000, 3: 12_000}


def test_packing_empties_bins_where_best_fit_does_not():
    first = packing.best_fit({17: 3, 60: 1, 21: 1, 65: 1}, 100)
    assert sum(first.values()) == 3 and sum(packing.local_search(first, 100).values()) == 2
    rng = random.Random(0)
    for low, high in ((400, 500), (300, 601)):
        h = {n: rng.randrange(1, 400) for n in range(low, high)}
        began, first = time.time(), packing.best_fit(h, 2048)
        last = packing.local_search(first, 2048)
        used = Counter()
        for b, n in last.items():
            for s, m in b:
                used[s] += m * n
        assert used == Counter(h) and sum(last.values()) < sum(first.values()) and time.time() - began < 60


def test_repeated_rows_are_parted_into_shards(spark):
    rows = [(None, "same text")] * 1500 + [(7, "other")] * 1500
    got = sharding.assign(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    by = defaultdict(list)
    for r in got:
        by[r.shard].append((r.slot, r.size))
    sizes = [sum(n for _, n in x) for x in by.values()]
    assert len(by) == 8 and max(sizes) - min(sizes) <= 20 and all(sorted(s for s, _ in x) == list(range(len(x))) for x in by.values())


A, B, C = "one two three four five six", "wholly other words stand in this line here", "and a third one that nothing else is like at all"


def test_repeated_ids_lose_no_text(spark):
    rows = [(1, A), (3, A), (3, B), (1, C), (4, C), (None, B), (None, "lone words that no other row has"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS).withColumn("fingerprint", F.lit("x")).withColumn("n", F.lit(1))
    want = Counter([(1, A), (3, B), (1, C), (None, "lone words that no other row has"), (5, "twice")])
    for most in (1_000_000, 0):
        kept = simhash.keep_one(docs, broadcast_rows=most)
        assert kept.columns == docs.columns and Counter((r.doc_id, r.text) for r in kept.collect()) == want
    got = {(r.doc_id, r.component_id) for r in simhash.components(docs).collect()}
    assert got == {(1, 1), (3, 1), (3, 3), (4, 1), (None, 3), (None, None), (5, 5)}


def test_redaction_is_the_same_by_either_join(spark):
    docs = spark.createDataFrame([(i, f"key {i} secret=abcdefghijkl{i:04d} end", "en", "s", 0) for i in range(50)], DOCS)
    a, b = (sorted(map(tuple, secrets.redact(docs, broadcast_rows=k).collect())) for k in (1_000_000, 0))
    assert a == b and all("[SECRET]" in r[1] for r in a)


def test_neighbours_across_cells(spark):
    rng = np.random.default_rng(8)
    centres = rng.normal(size=(40, 6)) * 20
    rows = [(i, (centres[i % 40] + rng.normal(size=6)).tolist()) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    x = np.array([v for _, v in rows])
    for scale in (1.0, 1e140):
        scaled = df.select("vec_id", F.transform("embedding", lambda v: v * scale).alias("embedding"))
        got = defaultdict(list)
        for r in vptree.nearest(scaled, scaled.where("vec_id % 20 = 0"), k=5).orderBy("query_id", "rank").collect():
            got[r.query_id].append(r.vec_id)
        for q, found in got.items():
            s = x @ x[q]
            s[q] = -np.inf
            assert found == np.lexsort((np.arange(len(x)), -s))[:5].tolist()
        assert len(got) == 150


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_loss_texts_are_read_from_the_string(spark):

    made = chat.format_chats(spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a### b")], "conv_id long, turn long, role string, text string"))
    # With other texts in the segments the digest stays, as only their flags are used.
    other = made.withColumn("segments", F.transform("segments", lambda s: F.struct(F.lit("?").alias("text"), s["loss"].alias("loss"))))
    assert chat.digest(made).first() == chat.digest(other).first() and re.search("a", made.first().formatted)


def test_fit_does_not_depend_on_the_process():
    code = "from metrum.llm import toxicity as t; m = t.fit([f'w{i % 7} w{i % 11} x{i % 5}' + ' bad' * (i % 2) for i in range(200)], [i % 2 for i in range(200)]); print(m.bias, sorted(m.weights.items()))"
    runs = {subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONHASHSEED": str(k)}, capture_output=True, text=True, timeout=120, check=True).stdout for k in (1, 2, 3)}
    assert len(runs) == 1 and len(next(iter(runs))) > 100


def test_score_is_the_softmax_of_the_mean_embedding():
    """Brute force of a score: embeddings of a text's subwords, taken anew, are summed and divided by their number and the
    neutral ones; the model of several starts gives the mean logit of models of one start each."""
    rng = random.Random(5)
    clean, bad = ["garden", "window", "letters", "planet", "measure"], ["worthless", "disgusting"]
    texts = [" ".join(rng.choices(clean, k=40) + (rng.choices(bad, k=3) if i % 3 == 0 else [])) + f" {i}" for i in range(240)]
    model = toxicity.fit(texts, [int(i % 3 == 0) for i in range(240)], toxicity.Options(starts=3))
    row = {g: i for i, g in enumerate(model.weights)}
    for text in [*texts[:9], "Worthlesss gardens, WINDOW window!", "", None]:
        grams = []
        for chunk in dict.fromkeys((text or "").split()):
            for word in re.findall(r"\w+", chunk.lower()):
                marked = f"<{word}>"
                grams += [marked] + [marked[i : i + n] for n in (4, 5) if n < len(marked) for i in range(len(marked) - n + 1)]
        mean = sum((model.embeddings[row[g]] for g in grams if g in row), np.zeros(model.softmax.size)) / (len(grams) + model.options.pad)
        assert abs(toxicity.Scorer(model).score(text) - 1 / (1 + np.exp(-(mean @ model.softmax + model.bias)))) < 1e-9
    assert model.embeddings.shape == (len(row), 3 * model.options.dim)
