"""Queries over texts: tokens, number words, splits, priors and preferences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import hashing, stats, text
from metrum.operators import lexicon, pauses, phones, pronunciations, textplan
from metrum.session import dealt, table, written

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


WORDS = "w AS (SELECT doc_id, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM documents WHERE len(regexp_extract_all(lower(text), '[a-z0-9'']+')) > 0))"


def words(spark: SparkSession, sf: str, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """columns, i (from 1), word."""
    return table(spark, sf, "documents").select(*columns, F.posexplode(text.words(F.col("text"))).alias("p", "word")).select(*columns, (F.col("p") + 1).alias("i"), "word")


@query(f"WITH {WORDS} SELECT word, count(*) AS n, count(DISTINCT doc_id) AS docs FROM w GROUP BY 1")
def token_frequency(spark: SparkSession, sf: str) -> DataFrame:
    """One exchange: counts by word and document are partial sums of both results."""
    each = words(spark, sf).groupBy("word", "doc_id").agg(F.count("*").alias("k"))
    return each.groupBy("word").agg(F.sum("k").alias("n"), F.count("*").alias("docs"))


# A token and what follows it up to the next; and of that the place of the last hard mark, a hyphen only between white space.
TOKEN_SQL = "([A-Za-z0-9'']*[0-9](?:[,.][0-9](?:[A-Za-z0-9'']*[0-9])?)*[A-Za-z0-9'']*|[A-Za-z0-9'']+)([^A-Za-z0-9'']*)"
MARKED_SQL = f"""tk AS (SELECT conv_id, turn, role, row_number() OVER () AS row_, coalesce(text, '') AS body FROM conversations),
    tl AS (SELECT conv_id, turn, role, row_, generate_subscripts(ws, 1) AS i, lower(unnest(ws)) AS word, string_split(unnest(ts), '') AS c FROM (SELECT *, regexp_extract_all(body, '{TOKEN_SQL}', 1) AS ws, regexp_extract_all(body, '{TOKEN_SQL}', 2) AS ts FROM tk) WHERE len(ws) > 0),
    at_ AS (SELECT *, list_filter(range(1, len(c) + 1), lambda k: c[k] IN ('.', '!', '?', ':', ';', '–', '—') OR c[k] = '-' AND k > 1 AND k < len(c) AND regexp_matches(c[k - 1], '^\\s$') AND regexp_matches(c[k + 1], '^\\s$')) AS hard, list_filter(range(1, len(c) + 1), lambda k: c[k] = ',') AS commas FROM tl),
    mk AS (SELECT *, CASE WHEN len(hard) > 0 THEN c[hard[len(hard)]] WHEN len(commas) > 0 THEN ',' ELSE '' END AS mark FROM at_)"""


@query(f"""WITH {MARKED_SQL} SELECT role, CASE mark WHEN '' THEN 'none' WHEN ',' THEN 'comma' WHEN '.' THEN 'period' WHEN '!' THEN 'exclamation' WHEN '?' THEN 'question' WHEN ':' THEN 'colon' WHEN ';' THEN 'semicolon' ELSE 'dash' END AS class, count(*) AS n FROM mk GROUP BY ALL""")
def token_boundary_class(spark: SparkSession, sf: str) -> DataFrame:
    """Tokens of conversations by the class of the mark that follows them."""
    t = table(spark, sf, "conversations").select("role", F.explode(text.tokens_and_tails(F.coalesce("text", F.lit("")))).alias("t"))
    return t.select("role", text.mark_class(text.mark_of(F.col("t.tail"))).alias("class")).groupBy("role", "class").agg(F.count("*").alias("n"))


STARTERS_SQL = ", ".join(f"'{w}'" for w in text.CLAUSE_STARTERS)


@query(f"""WITH {MARKED_SQL}, st AS (SELECT *, mark IN ('.', '!', '?', ':', ';', '-', '–', '—') AS is_hard, lead(word) OVER w AS nw FROM mk WINDOW w AS (PARTITION BY row_ ORDER BY i)),
    se AS (SELECT *, coalesce(sum(CASE WHEN is_hard THEN 1 ELSE 0 END) OVER (PARTITION BY row_ ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS sentence FROM st),
    co AS (SELECT *, count(*) FILTER (mark = ',') OVER (PARTITION BY row_, sentence) AS commas_, coalesce(bool_or(word IN ('and', 'or')) OVER (PARTITION BY row_, sentence ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS joined,
      min(CASE WHEN mark <> '' THEN i END) OVER (PARTITION BY row_ ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later FROM se),
    cl AS (SELECT co.*, n.mark AS later_mark, (commas_ >= 2 OR joined) AND NOT coalesce(nw IN ({STARTERS_SQL}), false) AS soft FROM co LEFT JOIN mk n ON n.row_ = co.row_ AND n.i = co.later),
    pc AS (SELECT role, CASE WHEN is_hard OR mark = ',' AND NOT soft THEN 'hard_break' WHEN mark = ',' THEN 'soft_list' ELSE 'none' END AS pause,
      CASE WHEN mark = ',' THEN CASE WHEN later IS NULL OR later > i + 1 THEN 'standard_comma' WHEN later_mark = ',' THEN 'list_comma' ELSE 'other_comma' END WHEN mark IN ('.', '!', '?') THEN 'hard_stop' WHEN mark = ';' THEN 'semicolon' WHEN mark = ':' THEN 'colon' WHEN mark = '' THEN 'none' ELSE 'other' END AS scored FROM cl)
    SELECT role, pause, scored, count(*) AS n, round(sum(CASE pause WHEN 'hard_break' THEN 0.2 WHEN 'soft_list' THEN 0.04 ELSE 0.0 END), 3) AS seconds FROM pc GROUP BY ALL""")
def pause_classes(spark: SparkSession, sf: str) -> DataFrame:
    """How turns pause: the planner's class, the scorecard's class and the expected seconds, by role."""
    c = dealt(table(spark, sf, "conversations").select("conv_id", "turn", "role", "text"), "conv_id", "turn")
    t = c.select("conv_id", "turn", "role", F.posexplode(text.tokens_and_tails(F.coalesce("text", F.lit("")))).alias("i", "t"))
    marked = t.select("conv_id", "turn", "role", "i", F.lower("t.word").alias("word"), text.mark_of(F.col("t.tail")).alias("mark"))
    c = pauses.classify(marked, ["conv_id", "turn"])
    return c.groupBy("role", "pause", "scored").agg(F.count("*").alias("n"), F.round(F.sum("seconds"), 3).alias("seconds"))


# A token: letters, digits and apostrophes, with commas and full stops between digits.
NUMBER_TOKEN = "[A-Za-z0-9'']*[0-9](?:[,.][0-9](?:[A-Za-z0-9'']*[0-9])?)*[A-Za-z0-9'']*"


def _spoken(n: str) -> str:
    """Words of 1 to 999 in SQL; empty for 0."""
    return f"""concat_ws(' ', CASE WHEN {n} >= 100 THEN a[{n} // 100 + 1] || ' hundred' END, CASE WHEN {n} % 100 BETWEEN 1 AND 19 THEN a[{n} % 100 + 1] WHEN {n} % 100 >= 20 THEN b[{n} % 100 // 10 + 1] || CASE WHEN {n} % 10 > 0 THEN ' ' || a[{n} % 10 + 1] ELSE '' END END)"""


@query(f"""WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(text, '{NUMBER_TOKEN}')) AS token FROM documents),
    u AS (SELECT ['zero','one','two','three','four','five','six','seven','eight','nine','ten','eleven','twelve','thirteen','fourteen','fifteen','sixteen','seventeen','eighteen','nineteen'] AS a, ['','','twenty','thirty','forty','fifty','sixty','seventy','eighty','ninety'] AS b,
      ['','tens','twenties','thirties','forties','fifties','sixties','seventies','eighties','nineties'] AS c),
    p AS (SELECT token, CASE WHEN regexp_full_match(replace(token, ',', ''), '[0-9]{{1,9}}') THEN CAST(replace(token, ',', '') AS BIGINT) END AS v, CASE WHEN regexp_full_match(replace(token, ',', ''), '[1-9][0-9][0-9]0[sS]') THEN CAST(substr(replace(token, ',', ''), 1, 3) AS BIGINT) END AS d FROM n)
    SELECT token, CASE WHEN v = 0 THEN 'zero' WHEN v < 1000000 THEN concat_ws(' ', CASE WHEN v >= 1000 THEN {_spoken("(v // 1000)")} || ' thousand' END, nullif({_spoken("(v % 1000)")}, ''))
      WHEN d IS NOT NULL THEN trim({_spoken("(d // 10)")} || ' ' || c[d % 10 + 1]) ELSE token END AS words FROM p, u""")
def number_expansion(spark: SparkSession, sf: str) -> DataFrame:
    """Whole tokens that have a digit, each as spoken; those that are no numbers or over 999 999 stay as they are."""
    each = table(spark, sf, "documents").select(F.explode(text.whole_tokens(F.col("text"))).alias("token"))
    n = each.where(F.col("token").rlike("[0-9]")).distinct()
    return n.select("token", text.expand_number(F.col("token")).alias("words"))


KEY_SQL = "k AS (SELECT doc_id, source, array_to_string(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9'']+'), ' ') AS key FROM documents)"


@query(f"WITH {KEY_SQL} SELECT sha256(key) AS group_sha256, count(*) AS copies, min(doc_id) AS first_doc FROM k GROUP BY key HAVING count(*) > 1")
def normalized_text_dedup(spark: SparkSession, sf: str) -> DataFrame:
    """Groups of equal normalised texts; only digests are exchanged."""
    k = table(spark, sf, "documents").select("doc_id", F.sha2(text.text_key(F.coalesce("text", F.lit(""))), 256).alias("group_sha256"))
    return k.groupBy("group_sha256").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_doc")).where("copies > 1")


@query(f"""WITH {KEY_SQL}, p AS (SELECT *, CAST('0x' || substr(sha256('timing' || chr(0) || key), 1, 8) AS BIGINT) % 100 AS p FROM k)
    SELECT CASE WHEN source = 'src0' AND p < 75 THEN 'holdout' WHEN p < 75 THEN 'train' WHEN p < 85 THEN 'validation' ELSE 'test' END AS split, count(*) AS n, count(DISTINCT key) AS texts FROM p GROUP BY 1""")
def text_group_split(spark: SparkSession, sf: str) -> DataFrame:
    """Equal texts share a split; one source is held out of training."""
    key = text.text_key(F.coalesce("text", F.lit("")))
    k = table(spark, sf, "documents").select("source", F.sha2(key, 256).alias("group"), hashing.split_75_10_15(key).alias("s"))
    split = F.when((F.col("source") == "src0") & (F.col("s") == "train"), "holdout").otherwise(F.col("s"))
    each = k.groupBy(split.alias("split"), "group").agg(F.count("*").alias("k"))
    return each.groupBy("split").agg(F.sum("k").alias("n"), F.count("*").alias("texts"))


@query("""SELECT c_custkey AS case_id, CAST('0x' || substr(sha1(c_name), 1, 8) AS BIGINT) % 5 AS fold FROM customer""")
def case_hash_split(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("case_id"), hashing.fold(F.col("c_name")).alias("fold"))


@query("""SELECT p_partkey AS id, 1 + CAST('0x' || substr(sha256(p_name || ':' || p_partkey), 1, 8) AS BIGINT) % 2147483646 AS seed, CAST('0x' || substr(sha256(p_name || ':' || p_partkey), 9, 8) AS BIGINT) % 7 AS voice FROM part""")
def seed_voice_assignment(spark: SparkSession, sf: str) -> DataFrame:
    key = F.concat_ws(":", "p_name", "p_partkey")
    return table(spark, sf, "part").select(F.col("p_partkey").alias("id"), hashing.seed_of(key).alias("seed"), hashing.choice_of(key, 7).alias("voice"))


@query("""WITH r AS (SELECT p_partkey AS id, p_name, p_brand, row_number() OVER (PARTITION BY p_name, p_brand ORDER BY p_partkey) - 1 AS retry FROM part), k AS (SELECT id, retry, 'corpus' || chr(0) || p_name || chr(0) || p_brand || CASE WHEN retry > 0 THEN chr(0) || 'retry=' || retry ELSE '' END AS key FROM r)
    SELECT id, retry, 1 + CAST('0x' || substr(sha256(key), 1, 8) AS BIGINT) % 2147483646 AS seed FROM k""")
def retry_seeds(spark: SparkSession, sf: str) -> DataFrame:
    """Seeds of names and brands; each further part of the same ones is a retry."""
    retry = (F.row_number().over(Window.partitionBy("p_name", "p_brand").orderBy("p_partkey")) - 1).cast("long")
    r = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), "p_name", "p_brand", retry.alias("retry"))
    return r.select("id", "retry", hashing.seed_of(hashing.salted_key([F.lit("corpus"), F.col("p_name"), F.col("p_brand")], F.col("retry"))).alias("seed"))


LETTERS = f"""{WORDS}, l AS (SELECT doc_id, i, word, unnest(generate_series(1, len(word))) AS j FROM w WHERE regexp_full_match(word, '[a-z]+')),
    o AS (SELECT upper(substr(word, j, 1)) AS phone, CASE WHEN len(word) = 1 THEN 'single' WHEN j = 1 THEN 'initial' WHEN j = len(word) THEN 'final' ELSE 'medial' END AS position, 0.02 + ((len(word) * 7 + j * 13) % 30) / 100.0 AS seconds, CAST('0x' || substr(sha1('doc' || doc_id), 1, 8) AS BIGINT) % 5 AS fold FROM l)"""


def _letters(spark: SparkSession, sf: str) -> DataFrame:
    """Letters as phones, with a made-up duration that depends on the place, so priors have something to fit; k: how often.
    Words are counted by fold before their letters are listed, and letters again after, so what is exchanged grows with
    the vocabulary."""
    fold = hashing.fold(F.concat(F.lit("doc"), F.col("doc_id").cast("string")))
    w = words(spark, sf).where(F.col("word").rlike("^[a-z]+$")).groupBy("word", fold.alias("fold")).agg(F.count("*").alias("k"))
    n = F.length("word")
    j = w.select("word", "fold", "k", F.explode(F.sequence(F.lit(1), n)).alias("j"))
    pos = F.when(n == 1, "single").when(F.col("j") == 1, "initial").when(F.col("j") == n, "final").otherwise("medial")
    return j.select(F.upper(F.substring("word", F.col("j"), F.lit(1))).alias("phone"), pos.alias("position"), (F.lit(0.02) + ((n * 7 + F.col("j") * 13) % 30) / 100.0).alias("seconds"), "fold", "k").groupBy("phone", "position", "seconds", "fold").agg(F.sum("k").alias("k"))


@query(f"""WITH {LETTERS} SELECT phone, NULL AS position, round(least(greatest(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 0.025), 0.25), 6) AS prior, count(*) AS n FROM o GROUP BY phone
    UNION ALL SELECT phone, position, round(least(greatest(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 0.025), 0.25), 6), count(*) FROM o GROUP BY phone, position HAVING count(*) >= 8""")
def word_position_priors(spark: SparkSession, sf: str) -> DataFrame:
    return lexicon.duration_priors(_letters(spark, sf)).withColumn("prior", F.round("prior", 6))


@query(f"""WITH {LETTERS}, t AS (SELECT * FROM o WHERE fold <> 0), h AS (SELECT * FROM o WHERE fold = 0),
    a AS (SELECT phone, least(greatest(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 0.025), 0.25) AS p FROM t GROUP BY 1), b AS (SELECT phone, position, least(greatest(quantile_cont(CAST(seconds AS DOUBLE), 0.5), 0.025), 0.25) AS p FROM t GROUP BY ALL HAVING count(*) >= 8)
    SELECT count(*) AS n, round(avg(abs(seconds - coalesce(a.p, 0.075))), 6) AS base_mae, round(avg(abs(seconds - coalesce(b.p, a.p, 0.075))), 6) AS position_mae FROM h LEFT JOIN a ON h.phone = a.phone LEFT JOIN b ON h.phone = b.phone AND h.position = b.position""")
def prior_heldout_mae(spark: SparkSession, sf: str) -> DataFrame:
    o = _letters(spark, sf)
    priors = lexicon.duration_priors(o.where("fold <> 0"))
    # Errors of equal observations are equal: they are counted before the join.
    held = o.where("fold = 0").groupBy("phone", "position", "seconds").agg(F.sum("k").alias("k"))
    plain = priors.where("position IS NULL").select("phone", F.col("prior").alias("base"))
    both = lexicon.with_prior(held, priors).join(plain, "phone", "left")
    err = lambda c: F.round(F.sum(F.abs(F.col("seconds") - F.coalesce(c, F.lit(0.075))) * F.col("k")) / F.sum("k"), 6)
    return both.agg(F.sum("k").alias("n"), err("base").alias("base_mae"), err("prior").alias("position_mae"))


TURN_WORDS = "c AS (SELECT conv_id, turn, role, generate_subscripts(ws, 1) AS i, unnest(ws) AS word FROM (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z0-9'']+') AS ws FROM conversations WHERE len(regexp_extract_all(lower(text), '[a-z0-9'']+')) > 0)), v AS (SELECT conv_id, turn, i, substr(word, 1, 2) AS base, word AS variant, {'c': conv_id, 't': turn, 'i': i} AS place FROM c)"


def _turn_words(spark: SparkSession, sf: str) -> DataFrame:
    c = dealt(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn").select("conv_id", "turn", F.posexplode(text.words(F.col("text"))).alias("p", "variant"))
    return c.select("conv_id", "turn", (F.col("p") + 1).alias("i"), "variant", F.substring("variant", 1, 2).alias("base"), F.struct("conv_id", "turn", "p").alias("place"))


@query(f"""WITH {TURN_WORDS}, k AS (SELECT base, variant, count(*) AS n, min(place) AS first_place FROM v GROUP BY ALL), t AS (SELECT base, sum(n) AS total FROM k GROUP BY 1),
    b AS (SELECT * FROM k QUALIFY row_number() OVER (PARTITION BY base ORDER BY n DESC, first_place) = 1)
    SELECT b.base, b.variant AS preferred, b.n, CAST(t.total AS BIGINT) AS total, round(b.n / CAST(t.total AS DOUBLE), 6) AS share FROM b JOIN t ON b.base = t.base WHERE t.total >= 5 AND b.n / CAST(t.total AS DOUBLE) >= 0.3""")
def preference_mining(spark: SparkSession, sf: str) -> DataFrame:
    """The most common variant of each base, the one seen first of several, where it is common enough."""
    k = _turn_words(spark, sf).groupBy("base", "variant").agg(F.count("*").alias("n"), F.min("place").alias("at"))
    b = k.groupBy("base").agg(F.min_by("variant", F.struct(-F.col("n"), "at")).alias("preferred"), F.max("n").alias("n"), F.sum("n").alias("total")).withColumn("share", F.col("n") / F.col("total"))
    return b.where("total >= 5 AND share >= 0.3").withColumn("share", F.round("share", 6))


@query(f"""WITH {TURN_WORDS}, x AS (SELECT *, lag(variant) OVER w AS prev, lead(variant) OVER w AS next FROM v WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
    y AS (SELECT base, 'prev:' || prev AS context, variant, place FROM x WHERE prev IS NOT NULL UNION ALL SELECT base, 'next:' || next, variant, place FROM x WHERE next IS NOT NULL),
    k AS (SELECT base, context, variant, count(*) AS n, min(place) AS first_place FROM y GROUP BY ALL), t AS (SELECT base, context, CAST(sum(n) AS BIGINT) AS total FROM k GROUP BY ALL)
    SELECT k.base, k.context, k.variant AS preferred, k.n, t.total FROM k JOIN t ON k.base = t.base AND k.context = t.context WHERE t.total >= 4 QUALIFY row_number() OVER (PARTITION BY k.base, k.context ORDER BY k.n DESC, k.first_place) = 1""")
def context_preference(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("conv_id", "turn").orderBy("i")
    x = _turn_words(spark, sf).withColumn("prev", F.lag("variant").over(w)).withColumn("next", F.lead("variant").over(w))
    kinds = F.array_compact(F.array(F.concat(F.lit("prev:"), F.col("prev")), F.concat(F.lit("next:"), F.col("next"))))
    k = x.select("base", "variant", "place", F.explode(kinds).alias("context")).groupBy("base", "context", "variant").agg(F.count("*").alias("n"), F.min("place").alias("at"))
    return k.groupBy("base", "context").agg(F.min_by("variant", F.struct(-F.col("n"), "at")).alias("preferred"), F.max("n").alias("n"), F.sum("n").alias("total")).where("total >= 4")


CHOICE_SQL = f"""WITH {TURN_WORDS}, x AS (SELECT *, coalesce(lag(variant) OVER w, '') AS prev, coalesce(lead(variant) OVER w, '') AS next, CAST('0x' || substr(sha1('conv' || conv_id), 1, 8) AS BIGINT) % 5 AS fold FROM v WINDOW w AS (PARTITION BY conv_id, turn ORDER BY i)),
    dv AS (SELECT base, list_sort(list(DISTINCT variant)) AS vs FROM v GROUP BY 1), tr AS (SELECT * FROM x WHERE fold <> 0), k AS (SELECT base, variant, count(*) AS n, min(place) AS p FROM tr GROUP BY ALL),
    top AS (SELECT *, sum(n) OVER (PARTITION BY base) AS total FROM k QUALIFY row_number() OVER (PARTITION BY base ORDER BY n DESC, p) = 1),
    pf AS (SELECT top.base, top.variant FROM top JOIN dv ON dv.base = top.base LEFT JOIN k d ON d.base = top.base AND d.variant = vs[1] WHERE top.variant <> vs[1] AND total >= 4 AND top.n / total::DOUBLE >= 0.45 AND top.n >= coalesce(d.n, 0) + 2),
    y AS (SELECT base, true AS before, prev AS nb, variant, place FROM tr UNION ALL SELECT base, false, next, variant, place FROM tr), kc AS (SELECT base, before, nb, variant, count(*) AS n, min(place) AS p FROM y GROUP BY ALL),
    tc AS (SELECT *, sum(n) OVER (PARTITION BY base, before, nb) AS total FROM kc QUALIFY row_number() OVER (PARTITION BY base, before, nb ORDER BY n DESC, p) = 1),
    cf AS (SELECT tc.base, before, nb, tc.variant, tc.n / total::DOUBLE AS share, total FROM tc JOIN dv ON dv.base = tc.base LEFT JOIN pf ON pf.base = tc.base WHERE tc.variant <> coalesce(pf.variant, vs[1]) AND total >= 2 AND tc.n / total::DOUBLE >= 0.67),
    ch AS (SELECT x.*, vs, coalesce(CASE WHEN a.share IS NULL THEN b.variant WHEN b.share IS NULL OR a.share > b.share OR a.share = b.share AND a.total >= b.total THEN a.variant ELSE b.variant END, pf.variant, vs[1]) AS chosen
      FROM x JOIN dv ON dv.base = x.base LEFT JOIN pf ON pf.base = x.base LEFT JOIN cf a ON a.base = x.base AND a.before AND a.nb = x.prev LEFT JOIN cf b ON b.base = x.base AND NOT b.before AND b.nb = x.next)"""


def _choices(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Occurrences with the variant chosen for them, and the preferences, learned from four folds of conversations. A word's
    first two letters stand for the word, the word for its pronunciation; equal occurrences are counted first."""
    w = Window.partitionBy("conv_id", "turn").orderBy("i")
    near = lambda f: F.coalesce(f("variant").over(w), F.lit(""))
    v = _turn_words(spark, sf).select(F.col("base").alias("word"), F.col("variant").alias("said"), near(F.lag).alias("previous"), near(F.lead).alias("next"), hashing.fold(F.concat(F.lit("conv"), F.col("conv_id").cast("string"))).alias("fold"), "place")
    x = written(v.groupBy("word", "said", "previous", "next", "fold").agg(F.count("*").alias("n"), F.min("place").alias("first")), "occurrences")
    variants = written(x.groupBy("word").agg(F.array_sort(F.collect_set("said")).alias("variants")), "variants")
    seen = x.where("fold <> 0").withColumnRenamed("said", "phones")
    preferences = written(lexicon.variant_preferences(seen.select("word", "phones", "n", "first"), variants), "preferences")
    contexts = written(lexicon.context_preferences(seen, variants, preferences), "contexts")
    return lexicon.choose_variants(x, variants, preferences, contexts).join(variants.select("word", F.get("variants", F.lit(0)).alias("default")), "word"), preferences, contexts


@query(f"""{CHOICE_SQL} SELECT base, chosen, list_position(vs, chosen) - 1 AS variant, count(*) AS n, count(*) FILTER (chosen = variant) AS hits FROM ch GROUP BY ALL""")
def variant_choice(spark: SparkSession, sf: str) -> DataFrame:
    """Which variants are chosen by preference and context, how often, and how often rightly."""
    c = _choices(spark, sf)[0]
    return c.groupBy(F.col("word").alias("base"), F.col("phones").alias("chosen"), "variant").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("phones") == F.col("said"), F.col("n")).otherwise(0)).alias("hits"))


@query(f"""{CHOICE_SQL}, r AS (SELECT fold = 0 AS held, vs[1] = variant AS a, chosen = variant AS b, substr(vs[1], 1, 3) = substr(variant, 1, 3) AS c, substr(chosen, 1, 3) = substr(variant, 1, 3) AS d FROM ch)
    SELECT count(*) FILTER (NOT held) AS train, count(*) FILTER (held) AS test, (SELECT count(*) FROM pf) AS preferences, (SELECT count(*) FROM cf) AS contexts, floor((count(*) FILTER (held AND a) / greatest(count(*) FILTER (held), 1)::DOUBLE) * 1e6 + 0.5) / 1e6 AS default_exact, floor((count(*) FILTER (held AND b) / greatest(count(*) FILTER (held), 1)::DOUBLE) * 1e6 + 0.5) / 1e6 AS chosen_exact,
      floor((count(*) FILTER (held AND c) / greatest(count(*) FILTER (held), 1)::DOUBLE) * 1e6 + 0.5) / 1e6 AS default_base, floor((count(*) FILTER (held AND d) / greatest(count(*) FILTER (held), 1)::DOUBLE) * 1e6 + 0.5) / 1e6 AS chosen_base FROM r""")
def preference_heldout(spark: SparkSession, sf: str) -> DataFrame:
    """Accuracy on the held-out fold with and without preferences, of whole pronunciations and of their first three letters."""
    c, preferences, contexts = _choices(spark, sf)
    total = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    held, short = F.col("fold") == 0, lambda x: F.substring(x, 1, 3)
    share = lambda cond: stats.half_up(total(held & cond) / F.greatest(total(held), F.lit(1)), 6)
    told = c.agg(total(~held).alias("train"), total(held).alias("test"), share(F.col("default") == F.col("said")).alias("default_exact"), share(F.col("phones") == F.col("said")).alias("chosen_exact"), share(short("default") == short("said")).alias("default_base"), share(short("phones") == short("said")).alias("chosen_base"))
    return told.crossJoin(preferences.agg(F.count("*").alias("preferences"))).crossJoin(contexts.agg(F.count("*").alias("contexts")))


@query(f"""WITH {WORDS}, d AS (SELECT word AS entry FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20 AND len(word) >= 2), u AS (SELECT DISTINCT word, CASE WHEN word LIKE '%''s' THEN substr(word, 1, len(word) - 2) END AS possessor, CASE WHEN word LIKE '%s' THEN substr(word, 1, len(word) - 1) END AS singular FROM w),
    halves AS (SELECT word, cut, substr(word, 1, cut) AS one, substr(word, cut + 1) AS two FROM (SELECT word, unnest(generate_series(3, len(word) - 3)) AS cut FROM u WHERE len(word) >= 6)),
    comp AS (SELECT word, min(cut) AS cut FROM halves JOIN d a ON a.entry = one JOIN d b ON b.entry = two GROUP BY 1),
    s AS (SELECT u.word, CASE WHEN e.entry IS NOT NULL THEN 'exact' WHEN p.entry IS NOT NULL THEN 'possessive' WHEN l.entry IS NOT NULL THEN 'plural' WHEN c.cut IS NOT NULL THEN 'compound' ELSE 'unresolved' END AS source, c.cut
      FROM u LEFT JOIN d e ON e.entry = u.word LEFT JOIN d p ON p.entry = u.possessor LEFT JOIN d l ON l.entry = u.singular LEFT JOIN comp c ON c.word = u.word)
    SELECT word, source, CAST(CASE WHEN source = 'compound' THEN cut ELSE 0 END AS INTEGER) AS cut FROM s""")
def pronunciation_fallback(spark: SparkSession, sf: str) -> DataFrame:
    """Words through the ordered fallbacks of a dictionary of those that 20 documents or more have."""
    each = written(words(spark, sf).select("word", "doc_id").distinct().groupBy("word").agg(F.count("*").alias("docs")), "words")
    return lexicon.resolve(each.select("word"), each.where((F.col("docs") >= 20) & (F.length("word") >= 2)).select(F.col("word").alias("entry"))).select("word", "source", "cut")


@query(f"""WITH {WORDS}, u AS (SELECT DISTINCT word FROM w), b AS (SELECT word, list_transform(range(1, len(word) + 1), lambda i: CAST(ord(substr(word, i, 1)) AS BIGINT)) AS bytes FROM u)
    SELECT word, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), bytes), lambda h, x: (xor(h, x) * 16777619) & 4294967295) % 64 AS bucket FROM b""")
def feature_hash_buckets(spark: SparkSession, sf: str) -> DataFrame:
    return words(spark, sf).select("word").distinct().select("word", (hashing.fnv1a32(F.col("word")) % 64).alias("bucket"))


@query("""WITH f AS (SELECT d.doc_id, d.source, (CASE WHEN l.toxic = 1 THEN 5 ELSE 0 END) + (CASE WHEN l.quality = 0 THEN 3 ELSE 0 END) + (CASE WHEN len(d.text) < 200 THEN 1 ELSE 0 END) AS risk FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)
    SELECT doc_id, source, risk FROM f ORDER BY risk DESC, doc_id LIMIT 25""")
def risk_ranking_topn(spark: SparkSession, sf: str) -> DataFrame:
    """The 25 riskiest documents, by weighted flags; the report is the feature."""
    d = table(spark, sf, "documents").select("doc_id", "source", (F.length("text") < 200).cast("int").alias("short"))
    f = d.join(table(spark, sf, "labels"), "doc_id", "left")
    one = lambda c: F.coalesce(c.cast("int"), F.lit(0))
    risk = 5 * one(F.col("toxic") == 1) + 3 * one(F.col("quality") == 0) + F.coalesce("short", F.lit(0))
    return f.select("doc_id", "source", risk.alias("risk")).orderBy(F.desc("risk"), "doc_id").limit(25)


@query("""WITH d AS (SELECT DISTINCT c_name AS name FROM customer UNION SELECT DISTINCT p_name FROM part), b AS (SELECT name, list_transform(range(1, strlen(name) + 1), lambda i: CAST(ord(substr(name, i, 1)) AS HUGEINT)) AS bytes FROM d),
    h AS (SELECT name, list_reduce(list_prepend(CAST('14695981039346656037' AS HUGEINT), bytes), lambda h, x: (xor(h, x) * 1099511628211) % CAST('18446744073709551616' AS HUGEINT)) AS h FROM b)
    SELECT name, CAST(h // 4294967296 AS BIGINT) AS high, CAST(h % 4294967296 AS BIGINT) AS low, regexp_replace(name, '[^A-Za-z0-9]+', '_', 'g') AS sanitised, regexp_replace(lower(name), '[^a-z0-9]', '', 'g') AS log_key FROM h""")
def name_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """FNV-1a of 64 bits in two halves, and names as file tokens and as keys of logs."""
    names = table(spark, sf, "customer").select(F.col("c_name").alias("name")).union(table(spark, sf, "part").select("p_name")).distinct()
    h = hashing.fnv1a64(F.col("name"))
    return names.select("name", h["high"].alias("high"), h["low"].alias("low"), text.sanitise(F.col("name")).alias("sanitised"), text.log_key(F.col("name")).alias("log_key"))


@query("""SELECT event_id, coalesce(TRY_CAST(json_extract_string(props, '$.k') AS BIGINT), -1) AS k, coalesce(json_extract_string(props, '$.a.b'), 'none') AS nested, lower(json_extract_string(props, '$.k')) IN ('1', 'true', 'yes') AS flag, coalesce(TRY_CAST(event_type AS DOUBLE), 0.5) AS number FROM events""")
def json_fields(spark: SparkSession, sf: str) -> DataFrame:
    """Fields of JSON by path, with defaults for what is missing or no number."""
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", text.number(k, "bigint", -1).alias("k"), F.coalesce(F.get_json_object("props", "$.a.b"), F.lit("none")).alias("nested"), text.truth(k).alias("flag"), text.number(F.col("event_type"), "double", 0.5).alias("number"))


# Phones by spelling, as no dictionary is at hand; digits have none.
SPELLED = {
    "a": "AE1", "b": "B", "c": "K", "d": "D", "e": "EH0", "f": "F", "g": "G", "h": "HH", "i": "IH2", "j": "JH", "k": "K", "l": "L", "m": "M",
    "n": "N", "o": "OW1", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "u": "UW0", "v": "V", "w": "W", "x": "X", "y": "Y", "z": "Z",
}
_RULES = {p: (pose, s if s is not None else phones.VOWEL_STRENGTH) for group, pose, s in phones.POSES for p in group.split()}
_RULES_SQL = "(VALUES " + ", ".join(f"('{p}', '{pose}', {s}e0)" for p, (pose, s) in _RULES.items()) + ") AS r(base, pose, strength)"
_SPELLED_SQL = "MAP {" + ", ".join(f"'{k}': '{v}'" for k, v in SPELLED.items()) + "}"
_VOWELS_SQL = "(" + ", ".join(f"'{v}'" for v in phones.VOWELS) + ")"


@query(f"""WITH t AS (SELECT conv_id, turn, role AS speaker, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS word_index FROM (SELECT conv_id, turn, role, regexp_extract_all(lower(text), '[a-z0-9'']+[.!?,;:]?') AS toks FROM conversations)),
    u AS (SELECT conv_id, turn, word_index, regexp_replace(tok, '[.!?,;:]$', '') AS word, regexp_matches(tok, '[.!?;:]$') AS breaks, regexp_matches(tok, '[.!?]$') AS ends, list_transform(list_filter(string_split(tok, ''), lambda c: c BETWEEN 'a' AND 'z'), lambda c: {_SPELLED_SQL}[c]) AS ph FROM t),
    v AS (SELECT *, len(ph) > 0 AS known, greatest(len(ph), 1) AS n, CASE WHEN len(ph) > 0 THEN greatest(len(list_filter(ph, lambda p: regexp_replace(p, '[0-9]', '') IN {_VOWELS_SQL})), 1) ELSE greatest(len(list_filter(string_split(regexp_replace(word, '[^aeiouy]+', ' ', 'g'), ' '), lambda x: x <> '')), 1) END AS syl FROM u),
    x AS (SELECT *, least(greatest(syl + least(greatest(n // 3, 1), 3), 2), 6) AS units FROM v),
    y AS (SELECT *, CAST(coalesce(sum(units) OVER b, 0) AS BIGINT) AS unit_start, CAST(sum(units) OVER (PARTITION BY conv_id, turn) AS BIGINT) AS total_units, CAST(coalesce(sum(n) OVER b, 0) AS BIGINT) AS first_, CAST(coalesce(sum(breaks::INT) OVER b, 0) AS BIGINT) AS region, CAST(coalesce(sum(ends::INT) OVER b, 0) AS BIGINT) AS sentence FROM x WINDOW b AS (PARTITION BY conv_id, turn ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    z AS (SELECT * EXCLUDE (ph), unnest(CASE WHEN known THEN ph ELSE ['UNK'] END) AS phone, unnest(range(n)) AS word_phone FROM y),
    p AS (SELECT z.*, CASE WHEN NOT known THEN '06_Eh' WHEN word = 'to' AND regexp_replace(phone, '[0-9]', '') IN ('AH', 'IH') THEN '11_Oo' ELSE r.pose END AS pose, CASE WHEN NOT known THEN 0.78e0 ELSE r.strength END AS strength FROM z LEFT JOIN {_RULES_SQL} ON r.base = regexp_replace(phone, '[0-9]', '')),
    q AS (SELECT *, CASE WHEN pose IS NOT NULL THEN count(pose) OVER (PARTITION BY conv_id, turn ORDER BY word_index, word_phone) - 1 END AS event_index, count(pose) OVER (PARTITION BY conv_id, turn, word_index) AS many, (unit_start + least(greatest((word_phone + 0.5e0) / n, 0.05e0), 0.95e0) * units) / total_units AS centre FROM p),
    s AS (SELECT *, CASE WHEN pose IS NOT NULL THEN least(greatest(centre - CASE WHEN many > 2 THEN 0.32e0 ELSE 0.42e0 END / total_units, 0e0), 1e0) END AS s0, CASE WHEN pose IS NOT NULL THEN least(greatest(centre + CASE WHEN many > 2 THEN 0.32e0 ELSE 0.42e0 END / total_units, 0e0), 1e0) END AS s1 FROM q)
    SELECT conv_id, turn, word_index, word, region, sentence, units, unit_start, total_units, first_ + word_phone AS phone_index, word_phone, phone, CAST(coalesce(TRY_CAST(regexp_extract(phone, '([12])$', 1) AS INTEGER), 0) AS INTEGER) AS stress, regexp_replace(phone, '[0-9]', '') IN {_VOWELS_SQL} AS vowel, pose, strength, coalesce(pose IN ('22_MBP', '12_Ww-Oo-', '11_Oo', '20_FV', '24_Tongue_Th'), false) AS strong,
      CASE WHEN pose IS NULL THEN 'timing' WHEN phone = 'HH' THEN 'coarticulated' WHEN pose IN ('21_FV-Ee-', '01_TDS-Ah-', '23_Tongue_LNTDS', '13_KGY_TDS', '02_TDS_KGY-Ee-') THEN 'supporting' ELSE 'primary' END AS role, event_index, floor(s0 * 1e6 + 0.5) / 1e6 AS start_norm, floor(s1 * 1e6 + 0.5) / 1e6 AS end_norm, CASE WHEN pose IS NOT NULL THEN row_number() OVER (PARTITION BY conv_id, turn ORDER BY s0 NULLS LAST, event_index) - 1 END AS place FROM s""")
def text_plan(spark: SparkSession, sf: str) -> DataFrame:
    """Words, phones and events of each turn, with units, normalised extents and places."""
    return _planned(_plan_words(spark, sf))


def _plan_words(spark: SparkSession, sf: str) -> DataFrame:
    """conv_id, turn, i, word_index, word, mark, breaks, ends, phones; texts are dealt, not words."""
    tok = F.col("tok")
    c = dealt(table(spark, sf, "conversations").select("conv_id", "turn", "text"), "conv_id", "turn")
    t = c.select("conv_id", "turn", F.posexplode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9']+[.!?,;:]?"), F.lit(0))).alias("i", "tok"))
    letters = F.filter(F.split("tok", ""), lambda c: c.between("a", "z"))
    spelled = F.transform(letters, lambda c: F.create_map(*(F.lit(x) for kv in SPELLED.items() for x in kv))[c])
    return t.select("conv_id", "turn", "i", F.col("i").cast("long").alias("word_index"), F.regexp_replace(tok, "[.!?,;:]$", "").alias("word"), F.regexp_extract(tok, "[.!?,;:]$", 0).alias("mark"), tok.rlike("[.!?;:]$").alias("breaks"), tok.rlike("[.!?]$").alias("ends"), spelled.alias("phones"))


def _planned(words: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    p = textplan.plan(words, ["conv_id", "turn"], keep)
    return p.withColumn("start_norm", stats.half_up(F.col("start_norm"), 6)).withColumn("end_norm", stats.half_up(F.col("end_norm"), 6))


# The class of a mark that ends a token, and the pause after it.
_MARKS = {",": "comma", ".": "period", "!": "exclamation", "?": "question", ":": "colon", ";": "semicolon"}
_FNV_SQL = "list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, len({0}) + 1), lambda i: CAST(ord(substr({0}, i, 1)) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295)"
_OTHER_SQL = ["prior", "vowel::INT", "role", "centre", "strength", "(token = 0)::INT", "(lead(part) OVER w IS NULL)::INT", "silent::INT", "starts::INT", "ends_::INT", "pause::INT", "(mark <> 'none')::INT", *(f"(mark = '{m}')::INT" for m in textplan.MARKS)]


@query(f"""WITH tp AS ({ORACLES["text_plan"]}), t AS (SELECT conv_id, turn, unnest(toks) AS tok, generate_subscripts(toks, 1) - 1 AS word_index FROM (SELECT conv_id, turn, regexp_extract_all(lower(text), '[a-z0-9'']+[.!?,;:]?') AS toks FROM conversations)),
    m0 AS (SELECT conv_id, turn, word_index, regexp_replace(tok, '[.!?,;:]$', '') AS word, regexp_extract(tok, '[.!?,;:]$') AS c FROM t), m1 AS (SELECT *, c IN ('.', '!', '?', ':', ';') AS hard, lead(word) OVER (PARTITION BY conv_id, turn ORDER BY word_index) AS nw FROM m0),
    m2 AS (SELECT *, coalesce(sum(hard::INT) OVER (PARTITION BY conv_id, turn ORDER BY word_index ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS s FROM m1),
    m3 AS (SELECT *, count(*) FILTER (c = ',') OVER (PARTITION BY conv_id, turn, s) >= 2 OR coalesce(bool_or(word IN ('and', 'or')) OVER (PARTITION BY conv_id, turn, s ORDER BY word_index ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), false) AS listed FROM m2),
    mk AS (SELECT conv_id, turn, word_index, CASE WHEN hard OR c = ',' AND NOT (listed AND NOT coalesce(nw IN ({STARTERS_SQL}), false)) THEN 'hard_break' WHEN c = ',' THEN 'soft_list' ELSE 'none' END AS pause, CASE c {" ".join(f"WHEN '{k}' THEN '{v}'" for k, v in _MARKS.items())} ELSE 'none' END AS mark FROM m3),
    ev AS (SELECT tp.*, regexp_replace(phone, '[0-9]', '') AS base, start_norm + 0.5e0 * (end_norm - start_norm) AS centre, CASE WHEN vowel THEN 0.12e0 ELSE 0.075e0 END AS prior, CASE role WHEN 'coarticulated' THEN 1 WHEN 'supporting' THEN 2 WHEN 'primary' THEN 3 ELSE 0 END / 3e0 AS rl, mk.pause, mk.mark FROM tp JOIN mk USING (conv_id, turn, word_index) WHERE place IS NOT NULL),
    e2 AS (SELECT *, lag(word_index) OVER w AS pw, lead(word_index) OVER w AS nw, lead(centre) OVER w AS nc, lead(sentence) OVER w AS ns FROM ev WINDOW w AS (PARTITION BY conv_id, turn ORDER BY place)),
    rw AS (SELECT conv_id, turn, place AS p, 1 AS part, false AS silent, place, word_index, phone_index, base AS phone, pose, prior, vowel, rl AS role, centre, strength, coalesce(pw <> word_index, true) AS starts, coalesce(nw <> word_index, true) AS ends_, false AS sentence_end, false AS pause, false AS hard_pause, 'none' AS mark FROM e2
      UNION ALL SELECT conv_id, turn, place, 0, true, NULL, NULL, NULL, 'SIL', '__SILENCE__', 0.04e0, false, 0e0, 0e0, 0e0, false, false, false, false, false, 'none' FROM e2 WHERE pw IS NULL
      UNION ALL SELECT conv_id, turn, place, 2, true, NULL, NULL, NULL, 'SIL', '__SILENCE__', CASE WHEN ns <> sentence THEN 0.12e0 ELSE 0.04e0 END, false, 0e0, coalesce(0.5e0 * (centre + nc), 1e0), 0e0, false, false, coalesce(ns <> sentence, false), nw IS NOT NULL AND pause <> 'none', nw IS NOT NULL AND pause = 'hard_break', mark FROM e2 WHERE coalesce(nw <> word_index, true)),
    tk AS (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY p, part) - 1 AS token FROM rw),
    ft AS (SELECT *, {_FNV_SQL.format("phone")} % 64 AS b0, 64 + {_FNV_SQL.format("pose")} % 32 AS b1, [{", ".join(f"CAST({c} AS DOUBLE)" for c in _OTHER_SQL)}] AS other FROM tk WINDOW w AS (PARTITION BY conv_id, turn ORDER BY p, part))
    SELECT conv_id, turn, token, silent, place, word_index, phone_index, sentence_end, pause, hard_pause, mark, b0 || ':1000000 ' || b1 || ':1000000 ' || array_to_string(list_transform(list_filter(range(20), lambda i: other[i + 1] <> 0), lambda i: (96 + i) || ':' || CAST(floor(other[i + 1] * 1e6 + 0.5e0) AS BIGINT)), ' ') AS features FROM ft""")
def transcript_tensor(spark: SparkSession, sf: str) -> DataFrame:
    """The tokens of each turn, silences between words among them, with their features (number:millionths; those of 0 left out)."""
    keys = ["conv_id", "turn"]
    # Pauses are told of the words before these become phones, so the two are not joined.
    words_ = pauses.classify(_plan_words(spark, sf), keys).withColumn("mark", text.mark_class(F.col("mark")))
    events = _planned(words_, ("pause", "mark")).where("place IS NOT NULL").withColumn("prior", F.when(F.col("vowel"), 0.12).otherwise(0.075))
    return textplan.tensor_text(events, keys)


# Entries are the words that 20 documents or more have, said by their letters; every third length has a second way, backwards.
# Words of five letters have a reviewed one; short words without digits have a fallback.
_LETTERS_SQL = "array_to_string(list_filter(string_split(upper({0}), ''), lambda c: c BETWEEN 'A' AND 'Z'), ' ')"


def _said_sql(rules: tuple[str, ...]) -> str:
    """The first rule that answers, as a chain of cases over left joins."""
    join, when, cut, said = [], [], [], []
    for k, r in enumerate(rules):
        if r == "compound":
            join.append("LEFT JOIN cp ON cp.word = u.word")
            found, text_ = "cp.cut IS NOT NULL", "[cp.one || ' ' || cp.two]"
        elif r == "parts":
            join.append("LEFT JOIN pa ON pa.word = u.word")
            found, text_ = "pa.said IS NOT NULL", "[pa.said]"
        else:
            ending, more, tail = pronunciations.ENDINGS.get(r, ("", 0, ""))
            e = ending.replace("'", "''")
            on = f"d{k}.entry = u.word" if r == "exact" else f"d{k}.entry = substr(u.word, 1, len(u.word) - {len(ending)}) AND u.word LIKE '%{e}' AND len(u.word) > {more}"
            join.append(f"LEFT JOIN d d{k} ON {on}")
            found, text_ = f"d{k}.entry IS NOT NULL", f"d{k}.said" if r == "exact" else f"[d{k}.said[1] || ' {tail}']"
        when.append(f"WHEN {found} THEN '{r}'")
        cut.append(f"WHEN {found} THEN {'cp.cut' if r == 'compound' else 0}")
        said.append(f"WHEN {found} THEN {text_}")
    back = "len(u.word) <= 5 AND NOT regexp_matches(u.word, '[0-9]') AND regexp_matches(u.word, '[a-z]')"
    return f"""WITH {WORDS}, d AS (SELECT word AS entry, CASE WHEN len(word) % 3 = 0 THEN [a, b] ELSE [a] END AS said FROM (SELECT word, {_LETTERS_SQL.format("word")} AS a, 'R ' || {_LETTERS_SQL.format("reverse(word)")} AS b FROM w GROUP BY 1 HAVING count(DISTINCT doc_id) >= 20 AND len(word) >= 2 AND regexp_matches(word, '^[a-z]+$'))),
    u AS (SELECT DISTINCT word FROM w), hv AS (SELECT word, unnest(generate_series(3, len(word) - 3)) AS cut FROM u WHERE len(word) >= 6), cp AS (SELECT hv.word, min(hv.cut) AS cut, min_by(a.said[1], hv.cut) AS one, min_by(b.said[1], hv.cut) AS two FROM hv JOIN d a ON a.entry = substr(hv.word, 1, hv.cut) JOIN d b ON b.entry = substr(hv.word, hv.cut + 1) GROUP BY 1),
    p0 AS (SELECT word, ps, unnest(ps) AS part, generate_subscripts(ps, 1) AS i FROM (SELECT word, list_filter(string_split_regex(word, '[-'']'), lambda x: x <> '') AS ps FROM u) WHERE len(ps) > 1), pa AS (SELECT p0.word, CASE WHEN count(d.entry) = count(*) THEN string_agg(d.said[1], ' ' ORDER BY i) END AS said FROM p0 LEFT JOIN d ON d.entry = part GROUP BY 1),
    sd AS (SELECT u.word, CASE {" ".join(when)} WHEN {back} THEN 'fallback' ELSE 'unresolved' END AS source, CAST(CASE {" ".join(cut)} ELSE 0 END AS INTEGER) AS cut, CASE {" ".join(said)} WHEN {back} THEN ['F ' || {_LETTERS_SQL.format("u.word")}] ELSE CAST([] AS VARCHAR[]) END || CASE WHEN len(u.word) = 5 THEN ['AH0 ' || upper(substr(u.word, 1, 1))] ELSE CAST([] AS VARCHAR[]) END AS said FROM u {" ".join(join)})"""


def _spelt(word: Column) -> Column:
    return F.array_join(F.filter(F.split(F.upper(word), ""), lambda c: c.between("A", "Z")), " ")


def _pronounced(spark: SparkSession, sf: str, rules: tuple[str, ...]) -> DataFrame:
    each = words(spark, sf).select("word", "doc_id").distinct().groupBy("word").agg(F.count("*").alias("docs"))
    each = written(each, "words")
    w = F.col("word")
    plain, back = _spelt(w), F.concat(F.lit("R "), _spelt(F.reverse(w)))
    dictionary = each.where((F.col("docs") >= 20) & (F.length("word") >= 2) & w.rlike("^[a-z]+$")).select(w.alias("entry"), F.when(F.length(w) % 3 == 0, F.array(plain, back)).otherwise(F.array(plain)).alias("said"))
    fallback = F.when((F.length(w) <= 5) & ~w.rlike("[0-9]") & w.rlike("[a-z]"), F.concat(F.lit("F "), plain))
    reviewed = each.where(F.length("word") == 5).select("word", F.array(F.concat(F.lit("AH0 "), F.upper(F.substring("word", 1, 1)))).alias("said"))
    return pronunciations.pronounce(each, dictionary, rules, fallback, reviewed)


@query(f"{_said_sql(pronunciations.PLANNER)} SELECT word, source, cut, array_to_string(said, '|') AS said FROM sd")
def planned_pronunciations(spark: SparkSession, sf: str) -> DataFrame:
    """How the planner says each word: endings add their sound, halves of compounds are joined."""
    return _pronounced(spark, sf, pronunciations.PLANNER).withColumn("said", F.array_join("said", "|"))


@query(f"{_said_sql(pronunciations.BUILDER)} SELECT word, source, cut, array_to_string(said, '|') AS said FROM sd")
def dictionary_pronunciations(spark: SparkSession, sf: str) -> DataFrame:
    """The same by the rules that build a dictionary, with reviewed pronunciations behind."""
    return _pronounced(spark, sf, pronunciations.BUILDER).withColumn("said", F.array_join("said", "|"))


@query(f"{_said_sql(pronunciations.BUILDER)} SELECT source, count(*) AS words, sum(len(said))::BIGINT AS said, min(word) AS first_word FROM sd GROUP BY 1")
def dictionary_report(spark: SparkSession, sf: str) -> DataFrame:
    """Words and pronunciations by source."""
    return pronunciations.report(_pronounced(spark, sf, pronunciations.BUILDER))
