"""Lookup of words through ordered fallbacks, syllables and duration priors.

The dictionary source of the reference is not available here, so entries are built from the spelling: each letter is a
phone of its own. The fallbacks, their order and the sources they report are what matters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

VOWELS = ("a", "e", "i", "o", "u", "y")


def spelled(word: Column) -> Column:
    """One phone a letter, upper case."""
    return F.filter(F.split(F.upper(F.regexp_replace(word, "[^a-z]", "")), ""), lambda x: x != "")


def known_cuts(n: Column, least: int, lengths: Column) -> Column:
    """The places that cut a word of n letters into two halves of `least` letters or more, both as long as a dictionary word;
    lengths: those of the dictionary's words, as a list."""
    longest = F.coalesce(F.array_max(lengths), F.lit(0))
    low, high = F.greatest(F.lit(least), n - longest), F.least(n - least, longest)
    return F.when(low <= high, F.filter(F.sequence(low, high), lambda c: F.array_contains(lengths, c) & F.array_contains(lengths, n - c))).otherwise(F.array().cast("array<int>"))


def resolve(words: DataFrame, dictionary: DataFrame) -> DataFrame:
    """words (word) with base, rest and source: `exact`, `possessive` (word without 's), `plural` (without s),
    `compound` (the first split into two known halves of 3 letters or more) or `unresolved`.

    dictionary: (entry), distinct. Candidates of all kinds go through one equi join, and what it leaves through a second for the
    other half; the best rank wins, so no fallback needs a join of its own."""
    w, n = F.col("word"), F.length("word")
    # Words of lengths that no dictionary word has are not asked for; its lengths are one short row.
    lengths = dictionary.agg(F.collect_set(F.length("entry")).alias("_lengths"))
    has = lambda x: F.array_contains("_lengths", x)
    cand = lambda rank, cut, text, rest: F.struct(F.lit(rank).alias("rank"), cut.alias("cut"), text.alias("entry"), rest.alias("rest"))
    none = F.lit(0)
    one = lambda rank, end: cand(rank, none, F.substring(w, F.lit(1), n - end), F.substring(w, F.lit(1), n - end))
    simple = F.array_compact(F.array(F.when(has(n), one(0, 0)), F.when(w.endswith("'s") & has(n - 2), one(1, 2)), F.when(w.endswith("s") & (n > 1) & has(n - 1), one(2, 1))))
    halves = F.transform(known_cuts(n, 3, F.col("_lengths")), lambda c: cand(3, c, F.substring(w, F.lit(1), c), F.substring(w, c + 1, n)))
    asked = words.select("word").distinct().crossJoin(F.broadcast(lengths)).select("word", F.explode(F.concat(simple, halves)).alias("c")).select("word", "c.*")
    # Few first halves are known, so second ones are looked for by what is left; others look for their entry once more.
    hits = asked.join(dictionary.select("entry"), "entry").join(dictionary.select(F.col("entry").alias("rest")), "rest")
    good = hits.groupBy("word").agg(F.min(F.struct("rank", "cut")).alias("best"))
    r = F.col("best.rank")
    source = F.when(r == 0, "exact").when(r == 1, "possessive").when(r == 2, "plural").when(r == 3, "compound").otherwise("unresolved")
    return words.join(good, "word", "left").select(*words.columns, source.alias("source"), F.coalesce("best.cut", F.lit(0)).alias("cut"))


def word_position(partition: list[str], order: str) -> Column:
    """single, initial, medial or final, by the place in the partition."""
    w = Window.partitionBy(*partition)
    i, n = F.row_number().over(w.orderBy(order)), F.count("*").over(w)
    return F.when(n == 1, "single").when(i == 1, "initial").when(i == n, "final").otherwise("medial")


def duration_priors(observed: DataFrame, least: int = 8, low: float = 0.025, high: float = 0.250) -> DataFrame:
    """(phone, position, prior, n): the median, then clamped; by phone alone (position null) and by phone and position
    where `least` observations or more exist. observed: (phone, position, seconds, k: how many such observations)."""
    clamp = lambda x: F.least(F.greatest(x, F.lit(low)), F.lit(high))
    prior = clamp(F.percentile("seconds", F.lit(0.5), F.col("k"))).alias("prior")
    by_phone = observed.groupBy("phone").agg(prior, F.sum("k").alias("n")).select("phone", F.lit(None).cast("string").alias("position"), "prior", "n")
    both = observed.groupBy("phone", "position").agg(prior, F.sum("k").alias("n")).where(F.col("n") >= least)
    return by_phone.unionByName(both)


def with_prior(rows: DataFrame, priors: DataFrame, default: float = 0.075) -> DataFrame:
    """rows with prior by (phone, position), else phone, else the default."""
    exact = priors.where("position IS NOT NULL").select("phone", "position", F.col("prior").alias("_p2"))
    plain = priors.where("position IS NULL").select("phone", F.col("prior").alias("_p1"))
    return rows.join(exact, ["phone", "position"], "left").join(plain, "phone", "left").withColumn("prior", F.coalesce("_p2", "_p1", F.lit(default))).drop("_p1", "_p2")


def syllable_bounds(vowel: Column) -> Column:
    """For an array of flags (is a vowel) the list of first indices of syllables: the halfway index between neighbouring
    nuclei, rounded up; the first syllable begins at 0."""
    at = F.filter(F.transform(vowel, lambda v, i: F.when(v, i)), lambda i: i.isNotNull())
    pairs = F.when(F.size(at) > 1, F.zip_with(F.slice(at, F.lit(1), F.size(at) - 1), F.slice(at, F.lit(2), F.size(at) - 1), lambda a, b: F.floor((a + b + 1) / 2).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.concat(F.array(F.lit(0)), pairs)


def coherent(phones: Column) -> Column:
    """Whether a pronunciation (phones by spaces) has no R right before ER, with or without stress digits."""
    return ~phones.rlike("(^| )R[0-9]* ER[0-9]*( |$)")


def _most_common(seen: DataFrame, keys: list[str], *more: Column) -> DataFrame:
    """keys, phones (the most common ones, those seen first of several), best (how often), n (of all) and more aggregates."""
    counted = seen.groupBy(*keys, "phones").agg(F.sum("n").alias("n"), F.min("first").alias("first"), *(F.any_value(c).alias(c) for c in seen.columns if c == "default"))
    return counted.groupBy(*keys).agg(F.min_by("phones", F.struct(-F.col("n"), "first")).alias("phones"), F.max("n").alias("best"), F.sum("n").alias("total"), *more)


def variant_preferences(seen: DataFrame, variants: DataFrame, least: int = 4, share: float = 0.45, win: int = 2) -> DataFrame:
    """word, phones, share, n of words whose most common pronunciation isn't their first variant: observed `least` times or
    more in all, with this share of them, and `win` times more than the first variant. seen: (word, phones, n: how often,
    first: where first); variants: (word, variants: the dictionary's pronunciations in order), one row a word."""
    known = seen.join(variants.select("word", F.get("variants", F.lit(0)).alias("default")), "word")
    ruled = F.coalesce(F.sum(F.when(F.col("phones") == F.col("default"), F.col("n"))), F.lit(0)).alias("ruled")
    top = _most_common(known, ["word"], ruled, F.any_value("default").alias("default")).withColumn("share", F.col("best") / F.col("total"))
    kept = top.where((F.col("phones") != F.col("default")) & (F.col("total") >= least) & (F.col("share") >= share) & (F.col("best") >= F.col("ruled") + win))
    return kept.select("word", "phones", "share", F.col("total").alias("n"))


def context_preferences(seen: DataFrame, variants: DataFrame, preferences: DataFrame, least: int = 2, share: float = 0.67) -> DataFrame:
    """word, before (whether the neighbour stands before it), neighbour, phones, share, n where the most common
    pronunciation next to that neighbour isn't what the word gets without it. seen: as in variant_preferences, with
    previous and next, empty at the ends."""
    side = lambda before, c: F.struct(F.lit(before).alias("before"), F.col(c).alias("neighbour"))
    each = seen.select("word", "phones", "n", "first", F.explode(F.array(side(True, "previous"), side(False, "next"))).alias("s")).select("word", "phones", "n", "first", "s.*")
    top = _most_common(each, ["word", "before", "neighbour"]).withColumn("share", F.col("best") / F.col("total"))
    usual = variants.join(preferences.select("word", F.col("phones").alias("_p")), "word", "left").select("word", F.coalesce("_p", F.get("variants", F.lit(0))).alias("_usual"))
    kept = top.join(usual, "word").where((F.col("phones") != F.col("_usual")) & (F.col("total") >= least) & (F.col("share") >= share))
    return kept.select("word", "before", "neighbour", "phones", "share", F.col("total").alias("n"))


def choose_variants(asked: DataFrame, variants: DataFrame, preferences: DataFrame, contexts: DataFrame) -> DataFrame:
    """asked (word, previous, next and more) with variant, the place of its pronunciation (from 0), and phones. The first
    variant unless the word has a preference; before that goes its neighbours' preference with the larger share, then the
    larger n, then the one before. Incoherent preferences and those that are no variant are passed over; words without
    variants are left out."""
    usual = preferences.where(coherent(F.col("phones"))).select("word", F.col("phones").alias("_p"))
    c = contexts.where(coherent(F.col("phones"))).select("word", "before", "neighbour", F.struct("share", "n").alias("w"), "phones")
    side = lambda before, key, name: c.where(F.col("before") == before).select("word", F.col("neighbour").alias(key), F.struct("w", "phones").alias(name))
    rows = asked.join(variants, "word").join(usual, "word", "left").join(side(True, "previous", "_a"), ["word", "previous"], "left").join(side(False, "next", "_b"), ["word", "next"], "left")
    a, b = F.col("_a"), F.col("_b")
    told = F.when(b.isNull() | (a["w"] >= b["w"]), a["phones"]).otherwise(b["phones"])
    place = lambda x: F.nullif(F.array_position("variants", x), F.lit(0)) - 1
    chosen = rows.withColumn("variant", F.coalesce(place(told), place(F.col("_p")), F.lit(0).cast("long")))
    return chosen.select(*asked.columns, "variant", F.get("variants", F.col("variant").cast("int")).alias("phones"))
