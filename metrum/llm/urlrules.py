"""URL filters: listed rules, and association rules that FP-growth mines from labelled URLs.

Listed rules name a host and a path prefix; a rule fits its host and all subdomains, and the longest one decides. For
URLs that no listed rule fits, association rules decide: FP-growth finds frequent combinations of URL tokens together
with a label; rules below the least support or confidence go, as do rules whose antecedent contains that of a kept,
shorter rule at least as confident with the same verdict, and rules that don't hold on a fold that was kept back. Tokens
that the same labelled rows have count as one while mining, so long shared paths don't multiply. Rules match by an inverted index: each rule is listed under
its tokens, a page looks up its own tokens, and a rule matches once all its tokens were hit. The most confident match
decides, then the longest; without a match the verdict is `allow`.

All of it is DataFrame functions and the JVM's FP-growth. Mined rules are few by construction (their number is checked
before they are broadcast; above the bound they are joined by a shuffle).

Defined results: a null URL or one without `://` has an empty host and path, fits no rule and has no token, so it is
allowed; repeated rows are judged each; without labelled URLs nothing is mined; extra columns are ignored.
"""

from __future__ import annotations

import json

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from metrum.llm.shared import ascii_lower, materialize

LABEL = "label="
BROADCAST_RULES = 20_000

Rule = tuple[str, str, str]  # verdict, host, path


def host_of(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; empty without `://`."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(F.lit(""))


def path_of(url: Column) -> Column:
    """After the host up to `?`, `#` or the end."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    return F.when(F.coalesce(at, F.lit(0)) > 0, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise(F.lit(""))


def listed(rules: list[Rule]) -> tuple[Column, Column]:
    """(rule, verdict) for columns host and path: the longest rule that fits; null if none does."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, host, path in sorted(rules, key=lambda r: len(r[1]) + len(r[2])):
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(path))
        rule = F.when(fits, F.lit(host + path)).otherwise(rule)
        verdict = F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, url: Column) -> Column:
    """Distinct tokens of a URL: labels of the host with their place from the right, parts of labels with hyphens, segments of
    the path without digits, the file's ending (A-Z lower-cased), and the names of query parameters."""
    labels = F.reverse(F.split(host, r"\."))
    placed = F.transform(labels, lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit("="), x))
    parts = F.flatten(F.transform(F.filter(labels, lambda x: F.contains(x, F.lit("-"))), lambda x: F.transform(F.filter(F.split(x, "-"), lambda y: y != ""), lambda y: F.concat(F.lit("w="), y))))
    segs = F.transform(F.filter(F.split(F.regexp_replace(path, r"[0-9]+", "0"), "/"), lambda x: x != ""), lambda x: F.concat(F.lit("p="), x))
    ending = ascii_lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1))
    file = F.when(ending != "", F.array(F.concat(F.lit("e="), ending))).otherwise(F.array().cast("array<string>"))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    names = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q="), F.split(x, "=")[0]))
    return F.when(host == "", F.array().cast("array<string>")).otherwise(F.array_distinct(F.concat(placed, parts, segs, file, names)))


def classes(labelled: DataFrame, least: int) -> dict[str, list[str]]:
    """Tokens that `least` rows or more have, grouped where the same rows have them; each group under its smallest token.
    Tokens of one group, as the segments of a path that many URLs share, would make 2^n combinations of one meaning. Each
    of these tokens is in `least` rows, so they are no more than the rows' tokens over `least`, and with `least` a share
    of the rows their number has a bound that doesn't grow with the table."""
    row = F.array_join(F.array_sort("tokens"), "\n")
    each = labelled.select(F.xxhash64(row).alias("a"), F.pmod(F.xxhash64(F.lit(1), row), F.lit(1 << 31)).alias("b"), F.explode("tokens").alias("token"))
    seen = each.groupBy("token").agg(F.count("*").alias("n"), F.bit_xor("a").alias("a"), F.sum("b").alias("b")).where(F.col("n") >= least)
    groups = seen.groupBy("n", "a", "b").agg(F.array_sort(F.collect_list("token")).alias("members"))
    return {r["members"][0]: r["members"] for r in groups.select("members").collect()}


def mine(labelled: DataFrame, min_support: float = 0.01, min_confidence: float = 0.9, min_count: int = 20, folds: int = 5) -> DataFrame:
    """rule, antecedent, alternatives, verdict, confidence, support from columns tokens and verdict. A combination counts as
    frequent from min_support of all rows and min_count rows on, so few labels don't make every combination a rule. An
    antecedent names one token of each group of tokens that the same rows have; alternatives are these groups.
    One of `folds` folds of token sets is kept back: rules stay that are as confident there, too (0: none is kept back)."""
    spark = labelled.sparkSession
    labelled = labelled.select(F.array_sort("tokens").alias("tokens"), "verdict")
    back = F.pmod(F.xxhash64(F.array_join("tokens", "\n")), F.lit(folds)) == 0 if folds else F.lit(False)
    fitted = labelled.where(~back)
    n = fitted.count()
    least = max(-(-min_support * n // 1), min_count)
    members = classes(fitted, int(least))
    empty = spark.createDataFrame([], "rule string, antecedent array<string>, alternatives array<array<string>>, verdict string, confidence double, support double")
    if not members:
        return empty
    of_token = F.from_json(F.lit(json.dumps({t: c for c, own in members.items() for t in own})), "map<string,string>")
    of_class = F.from_json(F.lit(json.dumps(members)), "map<string,array<string>>")
    held = F.array_distinct(F.filter(F.transform("tokens", lambda t: of_token[t]), lambda c: c.isNotNull()))
    baskets = fitted.select(F.array_append(held, F.concat(F.lit(LABEL), F.col("verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, min_count / n)), minConfidence=min_confidence).fit(baskets)
    found = model.associationRules.where((F.size("consequent") == 1) & F.startswith(F.col("consequent")[0], F.lit(LABEL)) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit(LABEL))))
    rules = found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], len(LABEL) + 1, 1000).alias("verdict"), "confidence", "support")
    rules = rules.withColumn("rule", F.md5(F.concat_ws("\n", "verdict", "antecedent"))).withColumn("alternatives", F.transform("antecedent", lambda c: of_class[c]))
    kept = prune(materialize(rules, "rules"))
    if folds:
        kept = confirmed(kept, labelled.where(back), min_confidence)
    return kept.select(*empty.columns)


def prune(rules: DataFrame) -> DataFrame:
    """rules without those that a kept shorter one makes redundant. A rule's candidates are found through its tokens."""
    short = rules.select(F.col("rule").alias("by"), F.explode("antecedent").alias("token"), F.size("antecedent").alias("need"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    long_ = rules.select("rule", "verdict", "confidence", F.size("antecedent").alias("n"), F.explode("antecedent").alias("token"))
    hit = long_.join(short, "token").where((F.col("v") == F.col("verdict")) & (F.col("need") < F.col("n")) & (F.col("c") >= F.col("confidence")))
    redundant = hit.groupBy("rule", "by", "need").count().where("count = need").select("rule").distinct()
    return rules.join(redundant, "rule", "left_anti")


def confirmed(rules: DataFrame, held: DataFrame, min_confidence: float) -> DataFrame:
    """rules that match rows held back, of which min_confidence or more have the rule's verdict. Equal rows count once
    in the matching, with their number."""
    rules = materialize(rules, "pruned")
    sets = held.groupBy("tokens", F.col("verdict").alias("said")).agg(F.count("*").alias("k")).withColumn("row", F.md5(F.concat_ws("\n", "said", "tokens")))
    sets = materialize(sets, "held")
    hit = matches(sets.select("row", "tokens"), rules).join(sets.select("row", "said", "k"), "row")
    good = hit.groupBy("rule").agg(F.sum("k").alias("all"), F.sum(F.when(F.col("said") == F.col("verdict"), F.col("k")).otherwise(0)).alias("right"))
    return rules.join(good.where(F.col("right") >= F.col("all") * min_confidence).select("rule"), "rule", "left_semi")


def matches(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """row, rule, verdict, confidence, need: rules that match, for columns row and tokens of pages. A rule matches where the
    page has a token of each of its groups; the rules are listed under their tokens."""
    slots = rules.select("rule", "verdict", "confidence", F.size("antecedent").alias("need"), F.posexplode("alternatives").alias("slot", "members"))
    index = slots.select("rule", "verdict", "confidence", "need", "slot", F.explode("members").alias("token"))
    if rules.count() <= BROADCAST_RULES:
        index = F.broadcast(index)
    hits = pages.select("row", F.explode("tokens").alias("token")).join(index, "token").select("row", "rule", "verdict", "confidence", "need", "slot").distinct()
    return hits.groupBy("row", "rule", "verdict", "confidence", "need").count().where("count = need").drop("count")


def match(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """row, mined (verdict of the deciding rule) for columns row and tokens of pages that some rule matches."""
    best = F.max_by("verdict", F.struct("confidence", "need", "verdict"))
    return matches(pages, rules).groupBy("row").agg(best.alias("mined"))


def judge(pages: DataFrame, rules: list[Rule], labels: DataFrame | None = None, min_support: float = 0.01, min_confidence: float = 0.9, key: str = "page_id", url: str = "url", default: str = "allow") -> DataFrame:
    """One row for each row of pages: key, host, path, rule, verdict, by ('list', 'mined' or 'default'). labels: rows
    (url, verdict) to mine from; if not given, the pages that listed rules fit, with those rules' verdicts."""
    host, path = host_of(F.col("u")), path_of(F.col("u"))
    read = pages.select(F.col(key).alias("k"), F.col(url).alias("u")).withColumn("host", host).withColumn("path", path)
    rule, verdict = listed(rules)
    told = read.withColumn("rule", rule).withColumn("said", verdict).withColumn("tokens", tokens(F.col("host"), F.col("path"), F.col("u")))
    if labels is None:
        known = told.where("said is not null").select("tokens", F.col("said").alias("verdict"))
    else:
        known = labels.select(F.col("url").alias("u"), "verdict").where("verdict is not null").withColumn("host", host).withColumn("path", path).select(tokens(F.col("host"), F.col("path"), F.col("u")).alias("tokens"), "verdict")
    known = known.where(F.size("tokens") > 0)
    # Equal token sets are judged once; pages look up their own by a hash of the set.
    row = F.md5(F.array_join(F.array_sort("tokens"), "\n"))
    sets = told.where("said is null").select(F.array_sort("tokens").alias("tokens")).distinct().withColumn("row", row)
    # Written first, the join's two sides are plain exchanges, and a set that very many pages share is split.
    mined = materialize(match(sets, mine(known, min_support, min_confidence)), "mined") if not known.isEmpty() else None
    open_ = told.withColumn("row", row)
    open_ = open_.join(mined, "row", "left") if mined is not None else open_.withColumn("mined", F.lit(None).cast("string"))
    by = F.when(F.col("said").isNotNull(), "list").when(F.col("mined").isNotNull(), "mined").otherwise("default")
    return open_.select(F.col("k").alias(key), "host", "path", "rule", F.coalesce("said", "mined", F.lit(default)).alias("verdict"), by.alias("by"))
