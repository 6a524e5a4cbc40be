"""Queries over orders, customers and parts: completion, order, shares, gates, inventories and recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import hashing, intervals, stats
from metrum.operators import gates, regions, sampling
from metrum.plans.adapters import EVENTS_SQL, events
from metrum.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query("""SELECT o.o_orderstatus, count(DISTINCT o.o_orderkey) AS orders, count(l.l_orderkey) AS lines, count(DISTINCT CASE WHEN l.l_orderkey IS NULL THEN o.o_orderkey END) AS incomplete,
    round(count_if(l.l_linestatus = 'F') / CAST(greatest(count(l.l_orderkey), 1) AS DOUBLE), 6) AS finished FROM orders o LEFT JOIN lineitem l ON l.l_orderkey = o.o_orderkey GROUP BY 1""")
def delivery_completion(spark: SparkSession, sf: str) -> DataFrame:
    """Lines are counted by order before the join, so the join has one row an order."""
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("lines"), F.count_if(F.col("l_linestatus") == "F").alias("done"))
    o = table(spark, sf, "orders").select("o_orderkey", "o_orderstatus").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").na.fill(0, ["lines", "done"])
    g = o.groupBy("o_orderstatus").agg(F.count("*").alias("orders"), F.sum("lines").alias("lines"), F.count_if(F.col("lines") == 0).alias("incomplete"), F.sum("done").alias("done"))
    return g.select("o_orderstatus", "orders", "lines", "incomplete", F.round(F.col("done") / F.greatest("lines", F.lit(1)), 6).alias("finished"))


@query("""WITH x AS (SELECT l_orderkey, l_linenumber, l_shipdate < lag(l_shipdate) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS back FROM lineitem)
    SELECT l_orderkey AS case_id, count(*) AS lines, count_if(coalesce(back, false)) AS violations FROM x GROUP BY 1""")
def order_violations(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    x = table(spark, sf, "lineitem").select("l_orderkey", F.coalesce(F.col("l_shipdate") < F.lag("l_shipdate").over(w), F.lit(False)).alias("back"))
    return x.groupBy(F.col("l_orderkey").alias("case_id")).agg(F.count("*").alias("lines"), F.count_if("back").alias("violations"))


@query(f"""WITH {EVENTS_SQL}, x AS (SELECT case_id, t - lag(t) OVER w AS d, value FROM ev WINDOW w AS (PARTITION BY case_id ORDER BY event_id))
    SELECT case_id, count(*) AS n, count_if(d < 0) AS backwards, count_if(value <= 0) AS non_positive, count_if(d = 0) AS equal FROM x GROUP BY 1""")
def monotonic_validation(spark: SparkSession, sf: str) -> DataFrame:
    w = Window.partitionBy("case_id").orderBy("event_id")
    x = events(spark, sf).withColumn("d", F.col("t") - F.lag("t").over(w))
    return x.groupBy("case_id").agg(F.count("*").alias("n"), F.count_if(F.col("d") < 0).alias("backwards"), F.count_if(F.col("value") <= 0).alias("non_positive"), F.count_if(F.col("d") == 0).alias("equal"))


@query("""WITH q AS (SELECT p_type, l_returnflag, sum(l_quantity) AS q FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY ALL), s AS (SELECT p_type, l_returnflag, q / sum(q) OVER (PARTITION BY p_type) AS share FROM q),
    a AS (SELECT l_returnflag, sum(q) / (SELECT sum(q) FROM q) AS share FROM q GROUP BY 1), t AS (SELECT DISTINCT p_type FROM q),
    d AS (SELECT t.p_type, a.l_returnflag, coalesce(s.share, 0) - a.share AS d FROM t CROSS JOIN a LEFT JOIN s ON s.p_type = t.p_type AND s.l_returnflag = a.l_returnflag),
    c AS (SELECT *, sum(d) OVER (PARTITION BY p_type ORDER BY l_returnflag ROWS UNBOUNDED PRECEDING) AS cum FROM d)
    SELECT p_type, round(sum(abs(d)) / 2, 6) AS total_variation, round(max(abs(cum)), 6) AS boundary_error, sum(abs(d)) / 2 > 0.25 AS severe FROM c GROUP BY 1""")
def share_total_variation(spark: SparkSession, sf: str) -> DataFrame:
    """How far a type's shares of return flags are from those of all; flags are few, so the second table is tiny."""
    l = table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).groupBy("p_type", "l_returnflag").agg(F.sum("l_quantity").alias("q"))
    s = l.withColumn("share", F.col("q") / F.sum("q").over(Window.partitionBy("p_type"))).groupBy("p_type").agg(F.map_from_entries(F.collect_list(F.struct("l_returnflag", "share"))).alias("own"))
    a = l.groupBy("l_returnflag").agg(F.sum("q").alias("q"))
    everything = a.agg(F.sort_array(F.collect_list(F.struct("l_returnflag", "q"))).alias("flags"), F.sum("q").alias("total"))
    both = s.crossJoin(F.broadcast(everything))  # one row
    d = both.select("p_type", F.transform("flags", lambda f: F.coalesce(F.col("own")[f["l_returnflag"]], F.lit(0.0)) - f["q"] / F.col("total")).alias("d"))
    tv = F.aggregate("d", F.lit(0.0), lambda x, y: x + F.abs(y)) / 2
    cum = F.transform("d", lambda _, i: F.abs(F.aggregate(F.slice("d", F.lit(1), i + 1), F.lit(0.0), lambda x, y: x + y)))
    return d.select("p_type", F.round(tv, 6).alias("total_variation"), F.round(F.array_max(cum), 6).alias("boundary_error"), (tv > 0.25).alias("severe"))


@query("""SELECT l_orderkey AS case_id, l_returnflag AS pose, least(1.0, greatest(0.0, max(l_discount * 10))) AS weight FROM lineitem GROUP BY ALL""")
def pose_collapse_max(spark: SparkSession, sf: str) -> DataFrame:
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.col("l_returnflag").alias("pose"), (F.col("l_discount") * 10).alias("weight"))
    return sampling.collapse(x, ["case_id", "pose"])


@query("""WITH c AS (SELECT l_orderkey, l_returnflag, avg(l_extendedprice) AS m, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT l_returnflag, round(sum(m * n) / sum(n), 4) AS weighted, round(avg(m), 4) AS plain, CAST(sum(n) AS BIGINT) AS n FROM c GROUP BY 1""")
def weighted_mae(spark: SparkSession, sf: str) -> DataFrame:
    """Case means, weighted back to the corpus by their counts, beside their plain mean."""
    c = table(spark, sf, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(F.avg("l_extendedprice").alias("m"), F.count("*").alias("n"))
    return c.groupBy("l_returnflag").agg(F.round(stats.weighted_mean(F.col("m"), F.col("n")), 4).alias("weighted"), F.round(F.avg("m"), 4).alias("plain"), F.sum("n").alias("n"))


GATES = [("events.mean", "abs_min", -50.0, 0.0), ("events.errors", "max", 0.2, 0.05), ("events.cases", "abs_min", 10.0, 0.0), ("lines.late", "max", 0.4, 0.05), ("lines.discount", "min", 0.05, 0.01), ("lines.unknown", "abs_max", 1.0, 0.0)]
GATE_ROWS = ", ".join(f"('{m}', '{k}', CAST({b} AS DOUBLE), CAST({t} AS DOUBLE))" for m, k, b, t in GATES)


@query(f"""WITH {EVENTS_SQL}, a AS (SELECT avg(value) AS mean, count_if(event_type = 'error') / CAST(count(*) AS DOUBLE) AS errors, CAST(count(DISTINCT case_id) AS DOUBLE) AS cases FROM ev), b AS (SELECT count_if(l_returnflag = 'R') / CAST(count(*) AS DOUBLE) AS late, avg(l_discount) AS discount FROM lineitem),
    m AS (SELECT 'events.mean' AS metric, mean AS value FROM a UNION ALL SELECT 'events.errors', errors FROM a UNION ALL SELECT 'events.cases', cases FROM a UNION ALL SELECT 'lines.late', late FROM b UNION ALL SELECT 'lines.discount', discount FROM b),
    g AS (SELECT * FROM (VALUES {GATE_ROWS}) AS t(metric, kind, baseline, tolerance))
    SELECT g.metric, g.kind, round(m.value, 6) AS value, g.baseline, g.tolerance, coalesce(CASE g.kind WHEN 'min' THEN m.value >= g.baseline - g.tolerance WHEN 'max' THEN m.value <= g.baseline + g.tolerance WHEN 'abs_min' THEN m.value >= g.baseline ELSE m.value <= g.baseline END, false) AS passed FROM g LEFT JOIN m ON m.metric = g.metric""")
def gate_report(spark: SparkSession, sf: str) -> DataFrame:
    a = events(spark, sf).agg(F.avg("value").alias("mean"), intervals.ratio(F.count_if(F.col("event_type") == "error"), F.count("*"), 0.0).alias("errors"), F.countDistinct("case_id").alias("cases"))
    b = table(spark, sf, "lineitem").agg(intervals.ratio(F.count_if(F.col("l_returnflag") == "R"), F.count("*"), 0.0).alias("late"), F.avg("l_discount").alias("discount"))
    return gates.check(gates.long_form(a, "events").unionByName(gates.long_form(b, "lines")), GATES).withColumn("value", F.round("value", 6))


@query("""WITH e AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_acctbal > 0), o AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderpriority = '1-URGENT')
    SELECT coalesce(e.k, o.k) AS custkey, CASE WHEN o.k IS NULL THEN 'missing' ELSE 'unlisted' END AS status FROM e FULL JOIN o ON e.k = o.k WHERE e.k IS NULL OR o.k IS NULL""")
def inventory_reconcile(spark: SparkSession, sf: str) -> DataFrame:
    """Customers in credit, who are expected to have an urgent order, against those who have one: both may lack the other."""
    e = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("custkey"))
    return gates.reconcile(e, table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("custkey")), "custkey")


def _digest_sql(name: str, chars: str) -> str:
    text = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE length(CAST({c} AS VARCHAR)) || ':' || {c} END"
    lane = lambda at: f"CAST(sum(CAST('0x' || substr(h, {at}, 15) AS HUGEINT)) AS VARCHAR)"
    return f"{name} AS (SELECT lang, source, count(*) AS n, {lane(1)} AS low, {lane(16)} AS high FROM (SELECT lang, source, md5({text('doc_id')} || {text('text')} || {text(chars)}) AS h FROM documents) GROUP BY ALL)"


@query(f"WITH {_digest_sql('d', 'n_chars')} SELECT * FROM d")
def corpus_digests(spark: SparkSession, sf: str) -> DataFrame:
    """A manifest of the corpus by language and source."""
    return gates.digests(table(spark, sf, "documents"), ["lang", "source"], ["doc_id", "text", "n_chars"])


@query(f"WITH {_digest_sql('m', 'n_chars')}, {_digest_sql('c', 'length(text)')} SELECT coalesce(m.lang, c.lang) AS lang, coalesce(m.source, c.source) AS source, CASE WHEN m.n = c.n AND m.low = c.low AND m.high = c.high THEN 'same' ELSE 'changed' END AS status FROM m FULL JOIN c ON m.lang IS NOT DISTINCT FROM c.lang AND m.source IS NOT DISTINCT FROM c.source")
def corpus_staleness(spark: SparkSession, sf: str) -> DataFrame:
    """Which parts of the corpus differ from what they are when made anew: lengths are counted again from the texts."""
    docs, by = table(spark, sf, "documents"), ["lang", "source"]
    made = docs.withColumn("n_chars", F.length("text").cast("long"))
    return gates.stale(gates.digests(docs, by, ["doc_id", "text", "n_chars"]), gates.digests(made, by, ["doc_id", "text", "n_chars"]), by)


@query("""SELECT r_name || '_' || n_name || '_' || seed AS case_id, 1 + CAST('0x' || substr(sha256(r_name || ':' || n_name || ':' || seed), 1, 8) AS BIGINT) % 2147483646 AS seed_value FROM region CROSS JOIN nation CROSS JOIN (SELECT unnest([0, 1, 2, 3]) AS seed)""")
def recipe_cross_product(spark: SparkSession, sf: str) -> DataFrame:
    """Every line with every voice and seed: the product is the recipe itself, of two small lists."""
    both = table(spark, sf, "region").select("r_name").crossJoin(table(spark, sf, "nation").select("n_name")).withColumn("seed", F.explode(F.sequence(F.lit(0), F.lit(3))))
    return both.select(F.concat_ws("_", "r_name", "n_name", "seed").alias("case_id"), hashing.seed_of(F.concat_ws(":", "r_name", "n_name", "seed")).alias("seed_value"))


@query("""WITH x AS (SELECT l_orderkey AS case_id, row_number() OVER w - 1 AS i, CASE WHEN l_returnflag = 'R' THEN row_number() OVER w * 0.1 + l_discount END AS centre FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate)),
    k AS (SELECT *, max(CASE WHEN centre IS NOT NULL THEN i END) OVER (PARTITION BY case_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS li, min(CASE WHEN centre IS NOT NULL THEN i END) OVER (PARTITION BY case_id ORDER BY i ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ri FROM x),
    v AS (SELECT k.case_id, k.i, k.li, k.ri, CAST(l.centre AS DOUBLE) AS lv, CAST(r.centre AS DOUBLE) AS rv FROM k LEFT JOIN x l ON l.case_id = k.case_id AND l.i = k.li LEFT JOIN x r ON r.case_id = k.case_id AND r.i = k.ri)
    SELECT case_id, CAST(i AS INTEGER) AS i, round(CASE WHEN li IS NULL AND ri IS NULL THEN 0.03 * i WHEN li IS NULL THEN CASE WHEN ri = 0 THEN rv ELSE greatest(0, rv - 0.03 * ri) + (rv - greatest(0, rv - 0.03 * ri)) * i / ri END WHEN ri IS NULL THEN lv + 0.03 * (i - li) WHEN li = ri THEN lv ELSE lv + (rv - lv) * (i - li) / (ri - li) END, 6) AS filled FROM v""")
def centre_interpolation(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown centres filled from known neighbours in the order of lines."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate")
    n = F.row_number().over(w)
    x = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), (n - 1).alias("i"), F.when(F.col("l_returnflag") == "R", n * 0.1 + F.col("l_discount")).alias("centre"))
    return regions.interpolate_centres(x, 0.03, ["case_id"], "i").select("case_id", "i", F.round("filled", 6).alias("filled"))
