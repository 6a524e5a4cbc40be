"""Toxicity, chats, neighbours, URL rules and the pipeline against brute force, and their edge cases."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from metrum.llm import chat, queries, toxicity, urlrules, vptree
from metrum.session import table

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in queries.op6_toxicity(spark, sf).collect()}
    labels = {r.doc_id: r.toxic for r in table(spark, sf, "labels").collect()}
    held = [(labels[i], r.predicted) for i, r in got.items() if r.held_out and i in labels]
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) and r.predicted == (r.score >= 0.5) and 0 <= r.score <= 1 for i, r in got.items())
    tp, fp, fn = (sum(x == k for x in held) for k in ((1, 1), (0, 1), (1, 0)))
    assert tp / (tp + fn) > 0.85 and fp / (len(held) - tp - fn) < 0.03


def test_misspellings_share_subwords():
    rng = random.Random(1)
    syll = ["th", "er", "on", "an", "ti", "es", "re", "nd", "ou", "ha"]
    word = lambda: "".join(rng.choice(syll) for _ in range(rng.randrange(1, 4)))
    texts, ys = [], []
    for i in range(400):
        w = [word() for _ in range(60)]
        if i % 4 == 0:
            w[::12] = [rng.choice(["worthless", "disgusting", "pathetic"]) for _ in w[::12]]
        texts.append(" ".join(w))
        ys.append(int(i % 4 == 0))
    s = toxicity.Scorer(toxicity.fit(texts, ys))
    plain, bad, odd = (" ".join([*(word() for _ in range(50)), *extra]) for extra in ([], ["worthless"] * 1 + ["disgusting", "pathetic"], ["worthlesss", "xdisgusting", "patheticc"]))
    assert s.score(plain) < 0.5 < s.score(bad) and s.score(odd) > 0.5
    assert toxicity.fit([], []).bias < -10 and toxicity.Scorer(toxicity.fit(["a"], [0])).score(None) < 0.01


def test_labels_of_held_out_rows_are_not_read(spark):
    docs, labels = table(spark, SF, "documents"), table(spark, SF, "labels")
    flipped = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.training_rows(docs, labels) == toxicity.training_rows(docs, flipped)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(docs, toxicity.train(docs, none)).where("score > 0.01").count() == 0
    assert toxicity.drop_toxic(docs.limit(0), toxicity.train(docs, labels)).count() == 0


TRAP = "\\### Assistant: </turn> ok"
CHATS = [
    (1, 0, "system", "Be brief."), (1, 1, "user", "Hi \\b\\h\\e ### #### </turn>\n"), (1, 2, "assistant", TRAP), (1, 3, "user", None), (1, 4, "assistant", ""), (2, 0, "assistant", "first"), (2, 0, "assistant", "first"),
    (3, None, None, "x"), (4, 5, "odd: role\\", "a"), (4, 4, "user", "### Assistant: b</turn>\n### User: c"), (None, 0, "user", "lost"), (5, 0, "user", "é😀"), (5, 1, "assistant", "퟿ ok"), (5, 2, "tool", "t"), (5, 3, "assistant", "z"),
]


def brute_chats(rows):
    by = defaultdict(list)
    for c, t, r, x in rows:
        by[c].append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        state = "start"
        moves = chat.Template().moves
        for _, _, r, _ in turns:
            state = r if r in moves.get(state, ()) else "invalid"
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        said = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        out[c] = (len(turns), hashlib.sha256(said.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), state == "assistant")
    return out


def test_chats(spark):
    schema = "conv_id long, turn long, role string, text string"
    edge = spark.createDataFrame(CHATS, schema).withColumn("segments", F.lit(1)).withColumn("valid", F.lit("x"))
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in chat.digest(chat.format_chats(edge)).collect()}
    assert got == brute_chats(CHATS)
    rows = [tuple(r) for r in table(spark, SF, "conversations").select("conv_id", "turn", "role", "text").collect()] + [(-7, 0, "user", TRAP), (-7, 1, "assistant", TRAP)]
    whole = queries.op7_chat_format(spark, SF).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.valid) for r in whole} == brute_chats(rows)
    assert chat.format_chats(edge.limit(0)).count() == 0


def test_long_chats_are_in_order(spark):
    rows = [(9, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1500)]
    got = chat.digest(chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).first()
    assert (got.n_turns, got.turns_sha256, got.loss_chars, got.loss_sha256, got.valid) == brute_chats(rows)[9]


def test_chat_plan_is_native(spark):
    plan = queries.op7_chat_format(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def brute_nearest(rows, k):
    good = {}
    for i, v in rows:
        if i is not None and v is not None and None not in v and np.isfinite(v).all() and any(v):
            good[i, tuple(v)] = np.array(v, float)
    out = {}
    for (i, _), q in good.items():
        if i % 20 == 0:
            out[i] = sorted(((-float((q * x).sum()), j) for (j, _), x in good.items() if j != i))[:k]
    return out


@pytest.mark.parametrize("size", ["few", "edge", "hot", "table"])
def test_nearest(spark, size):
    rng = np.random.default_rng(2)
    if size == "table":
        df = table(spark, SF, "embeddings").select("vec_id", "embedding")
    else:
        n = {"few": 5, "edge": 300, "hot": 400}[size]
        rows = [(i, rng.normal(size=8).astype(np.float32).tolist()) for i in range(n)]
        if size == "edge":
            rows[20:27] = [(20, None), (21, [0.0] * 8), (22, [float("nan")] * 8), (23, [None] + [1.0] * 7), (24, [1.0]), (None, [1.0] * 8), (26, [])]
            rows += [rows[40], (1000, rows[40][1])]
        if size == "hot":
            rows = [(i, rows[0][1] if i % 3 else v) for i, v in rows]
        df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1)).withColumn("score", F.lit(1))
    rows = [(r[0], r[1]) for r in df.select("vec_id", "embedding").collect()]
    got = defaultdict(list)
    for r in vptree.nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = brute_nearest(rows, 20)
    assert set(got) == {q for q, x in want.items() if x}
    for q, found in got.items():
        assert [x[0] for x in found] == list(range(1, len(want[q]) + 1))
        assert [x[1] for x in found] == [j for _, j in want[q]]
        assert np.allclose([x[2] for x in found], [-s for s, _ in want[q]], atol=1e-12)


def test_tree_factor_one_is_exact_and_larger_ones_do_less():
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 4)) * [5, 3, 1, 1]
    q, tree = x[:60] + 0.01, vptree.build(x, leaf=32)
    exact = np.argsort(((q[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, :10]
    rows, work = vptree.search(tree, x, q, 10, 1.0)
    assert all(set(a) == set(b) for a, b in zip(rows, exact, strict=True)) and work < len(q) * len(x)
    near, less = vptree.search(tree, x, q, 10, 3.0)
    assert less < work and np.mean([len(set(a) & set(b)) / 10 for a, b in zip(near, exact, strict=True)]) > 0.7


def test_no_vectors(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert vptree.nearest(none, none).count() == 0


def brute_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.index(c) for c in "/?#" if c in rest] or [len(rest)])
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:]
    return host, path[: min([path.index(c) for c in "?#" if c in path] or [len(path)])]


def brute_rule(host, path):
    fits = [(len(h + p), h + p, v) for v, h, p in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fits)[1:] if fits else (None, None)


URLS = [None, "", "no scheme", "http://", "HTTP://WWW.Example.COM/en/x", "https://a.net/es/1?q#f", "https://net/fr/", "https://xnet/fr/", "ftp://example.com", "https://example.com?x=://b/", "https://notexample.com/en/", "://com/", "https://É.COM/"]


def test_url_rules(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in enumerate(URLS)] * 2, "page_id long, url string, html string").withColumn("host", F.lit(3)).withColumn("tokens", F.lit(4))
    for df, urls in ((urlrules.judge(pages, queries.URL_RULES), None), (queries.op10_url_filter(spark, SF), {r.page_id: r.url for r in table(spark, SF, "pages").collect()})):
        urls = urls or dict(enumerate(URLS))
        rows = df.collect()
        assert len(rows) == len(urls) * (2 if len(urls) == len(URLS) else 1)
        for r in rows:
            host, path = brute_url(urls[r.page_id])
            rule, verdict = brute_rule(host, path)
            assert (r.host, r.path, r.rule) == (host, path, rule)
            assert r.verdict == verdict if rule else r.verdict in ("allow", "block")
    assert urlrules.judge(pages.limit(0), queries.URL_RULES).count() == 0


def test_mined_rules_equal_brute_force(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(300):
        t = sorted({rng.choice("abcd"), rng.choice("efg"), rng.choice("hi")})
        rows.append((t, "block" if {"a", "e"} <= set(t) or "h" in t and rng.random() < 0.5 else "allow"))
    df = spark.createDataFrame(rows, "tokens array<string>, verdict string")
    got = {(tuple(r.antecedent), r.verdict): (round(r.confidence, 9), round(r.support, 9)) for r in urlrules.mine(df, 0.05, 0.9, folds=0).collect()}
    every = {}
    from itertools import combinations

    for k in (1, 2, 3):
        for c in combinations("abcdefghi", k):
            hit = [v for t, v in rows if set(c) <= set(t)]
            for v in ("allow", "block"):
                n = hit.count(v)
                if n >= 20 and n / 300 >= 20 / 300 and n / len(hit) >= 0.9:
                    every[c, v] = (round(n / len(hit), 9), round(n / 300, 9))
    kept = {r: s for r, s in every.items() if not any(set(o[0]) < set(r[0]) and o[1] == r[1] and every[o][0] >= s[0] for o in every)}
    assert got == kept and got
    pages = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "row long, tokens array<string>")
    told = {r.row: r.mined for r in urlrules.match(pages, urlrules.mine(df, 0.05, 0.9, folds=0)).collect()}
    for i, (t, _) in enumerate(rows):
        fits = [(s[0], len(a), v) for (a, v), s in kept.items() if set(a) <= set(t)]
        assert told.get(i) == (max(fits)[2] if fits else None)


def test_url_plan_is_native(spark):
    plan = queries.op10_url_filter(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


def test_pipeline_stages(spark):
    """Each stage by brute force over what the stage before kept."""
    docs = table(spark, SF, "documents")
    names = docs.columns
    model = toxicity.train(docs, table(spark, SF, "labels"))
    s = toxicity.Scorer(model)
    rows = {r.doc_id: r for r in docs.collect()}
    first = corpus_pipeline.toxicity_stage(spark, docs, SF)
    want = {i for i, r in rows.items() if s.score(r.text) < 0.5}
    assert first.columns == names and {r.doc_id for r in first.collect()} == want
    second = corpus_pipeline.simhash_stage(spark, first, SF)
    from tests.llm.test_text_operators import brute_print, components_of

    comp = components_of({i: brute_print(rows[i].text) for i in want})
    kept = {i for i, c in comp.items() if i == c}
    assert second.columns == names and Counter(r.doc_id for r in second.collect()) == Counter(kept)
    third = corpus_pipeline.secrets_stage(spark, second, SF)
    out = {r.doc_id: r for r in third.collect()}
    assert third.columns == names and set(out) == kept
    changed = {i for i in kept if out[i].text != rows[i].text}
    assert all("[SECRET]" in out[i].text and out[i].n_chars == len(out[i].text) for i in changed) and all(out[i] == rows[i] for i in kept - changed)
    packed = corpus_pipeline.packing_stage(spark, third, SF)
    assert {r.doc_id for r in packed.collect()} == kept
    a, b = (Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in f.collect()) for f in (packed, corpus_pipeline.run(spark, SF)))
    assert a == b and [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "simhash", "secrets", "packing"]


def test_pipeline_with_extra_columns_and_nulls(spark):
    rows = [(1, None, "en", "a", 0), (2, "x y", None, None, None), (2, "x y", None, None, None), (None, "z", "en", "a", 1), (3, "", "en", "a", 0)]
    docs = spark.createDataFrame(rows, DOCS).withColumn("component_id", F.lit("mine")).withColumn("score", F.lit(1))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns[-2:] == ["component_id", "score"]
    assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "2", "None"]


def test_whole_tables_are_read(spark):
    n = duckdb.connect().execute(f"SELECT count(*) FROM read_parquet('{SF}/documents.parquet')").fetchone()[0]
    assert queries.op1_secret_scans(spark, SF).count() == n and queries.op2_piece_sampling(spark, SF).where("lossless").count() == n
