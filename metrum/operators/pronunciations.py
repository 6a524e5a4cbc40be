"""Pronunciations of words by ordered rules over a dictionary, with the sounds that endings add, reviewed ones and a report.

Every rule asks the dictionary for one or more entries of a word; all questions of all rules are one equi join, those left of it
are a second one for the other halves of compounds, and the first rule that has all its answers wins, its leftmost cut of several.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.operators.lexicon import known_cuts

# Endings, the letters a word must have more than, and what they add to the entry without them; the least half of
# a compound; the rules in the order of the planner, and in that of the builder of dictionaries.
ENDINGS = {
    "possessive": ("'s", 2, "Z"), "any_s": ("s", 1, "Z"), "plural": ("s", 3, "Z"), "plural_es": ("es", 4, "Z"), "past": ("ed", 4, "D"), "progressive": ("ing", 5, "IH0 NG"),
}
LEAST_HALF = 3
PLANNER = ("exact", "possessive", "any_s", "compound")
BUILDER = ("exact", "parts", "compound", "plural", "plural_es", "past", "progressive")


def _asked(word: Column, rule: str, rank: int, lengths: Column) -> Column:
    """The questions of a rule as a list of (rank, cut, parts, part, entry, rest): all `parts` of a cut must be answered, and
    of a compound its rest, too, which else is the entry. lengths: see known_cuts()."""
    n = F.length(word)
    one = lambda cut, parts, part, entry, rest=None: F.struct(F.lit(rank).alias("rank"), cut.cast("int").alias("cut"), parts.cast("int").alias("parts"), part.cast("int").alias("part"), entry.alias("entry"), (entry if rest is None else rest).alias("rest"))
    none, single = F.lit(0), F.lit(1)
    nothing = F.array().cast("array<struct<rank:int,cut:int,parts:int,part:int,entry:string,rest:string>>")
    if rule == "exact":
        return F.array(one(none, single, none, word))
    if rule == "parts":
        of = F.filter(F.split(word, "[-']"), lambda p: p != "")
        return F.when((word.contains("'") | word.contains("-")) & (F.size(of) > 1), F.transform(of, lambda p, i: one(none, F.size(of), i, p))).otherwise(nothing)
    if rule == "compound":
        return F.transform(known_cuts(n, LEAST_HALF, lengths), lambda c: one(c, single, none, F.substring(word, F.lit(1), c), F.substring(word, c + 1, n)))
    ending, more_than, _ = ENDINGS[rule]
    return F.when(word.endswith(ending) & (n > more_than), F.array(one(none, single, none, F.substring(word, F.lit(1), n - len(ending))))).otherwise(nothing)


def pronounce(words: DataFrame, dictionary: DataFrame, rules: tuple[str, ...] = BUILDER, fallback: Column | None = None, reviewed: DataFrame | None = None) -> DataFrame:
    """word (distinct), source (the rule; fallback, or unresolved), cut (of a compound, else 0), said: a list of pronunciations,
    phones separated by blanks; empty if unresolved.

    dictionary: entry, said (a list, in order, none of it empty); repeated entries are not allowed. An exact entry keeps all of
    its list, other rules join the first ones of their entries. fallback: a column over `word`, null where it has nothing.
    reviewed (word, said): added behind, without repeats; words that are not asked for are left out. Null words are left out."""
    asked = words.select("word").where("word IS NOT NULL").distinct()
    every = F.concat(*(_asked(F.col("word"), r, k, F.col("_lengths")) for k, r in enumerate(rules)))
    # Entries that no dictionary word is as long as go before the exchange; its lengths are one short row.
    lengths = dictionary.agg(F.collect_set(F.length("entry")).alias("_lengths"))
    questions = asked.crossJoin(F.broadcast(lengths)).select("word", "_lengths", F.inline(every)).where(F.array_contains("_lengths", F.length("entry"))).drop("_lengths")
    known = dictionary.select("entry", F.col("said").alias("_said"))
    hits = questions.join(known, "entry").join(known.select(F.col("entry").alias("rest"), F.col("_said").alias("_more")), "rest")
    both = F.array(F.concat_ws(" ", F.col("_said")[0], F.col("_more")[0]))
    hits = hits.withColumn("_said", F.when(F.col("cut") > 0, both).otherwise(F.col("_said")))
    cuts = hits.groupBy("word", "rank", "cut", "parts").agg(F.array_sort(F.collect_list(F.struct("part", "_said"))).alias("_found")).where(F.size("_found") == F.col("parts"))
    best = cuts.groupBy("word").agg(F.min_by(F.struct("rank", "cut", "_found"), F.struct("rank", "cut")).alias("_b"))
    tail = F.get(F.array(*(F.lit(ENDINGS[r][2] if r in ENDINGS else None).cast("string") for r in rules)), F.col("_b.rank"))
    joined = F.concat_ws(" ", F.transform("_b._found", lambda p: p["_said"][0]), tail)
    said = F.when(F.get(F.array(*map(F.lit, rules)), F.col("_b.rank")) == "exact", F.col("_b._found")[0]["_said"]).otherwise(F.array(joined))
    other = F.lit(None).cast("string") if fallback is None else fallback
    known = F.col("_b").isNotNull()
    source = F.when(known, F.get(F.array(*map(F.lit, rules)), F.col("_b.rank"))).when(other.isNotNull(), "fallback").otherwise("unresolved")
    spoken = F.when(known, said).when(other.isNotNull(), F.array(other)).otherwise(F.array().cast("array<string>"))
    told = asked.join(best, "word", "left").select("word", source.alias("source"), F.coalesce("_b.cut", F.lit(0)).alias("cut"), spoken.alias("said"))
    if reviewed is None:
        return told
    return told.join(reviewed.select("word", F.col("said").alias("_more")), "word", "left").withColumn("said", F.array_union("said", F.coalesce("_more", F.array().cast("array<string>")))).drop("_more")


def entries(dictionaries: list[DataFrame]) -> DataFrame:
    """entry, said: the union of dictionaries (entry, said), the earlier ones' pronunciations first, without repeats."""
    all_ = [d.select("entry", F.lit(k).alias("_k"), F.posexplode("said").alias("_i", "_s")) for k, d in enumerate(dictionaries)]
    union = all_[0]
    for d in all_[1:]:
        union = union.unionByName(d)
    first = union.groupBy("entry", "_s").agg(F.min(F.struct("_k", "_i")).alias("_at"))
    return first.groupBy("entry").agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", "_s"))), lambda x: x["_s"]).alias("said"))


def report(told: DataFrame) -> DataFrame:
    """source, words, said (how many pronunciations), first_word (the least): a row for each source of pronounce()."""
    return told.groupBy("source").agg(F.count("*").alias("words"), F.sum(F.size("said")).cast("long").alias("said"), F.min("word").alias("first_word"))
