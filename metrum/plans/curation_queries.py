"""Queries over flags, phones, boundaries, frames and oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import hashing
from metrum.operators import curation, frames, gates, phones
from metrum.plans import adapters
from metrum.plans.adapters import EVENTS_SQL, GOLD_SQL, HOUR, PRED_SQL
from metrum.plans.text_queries import WORDS, words
from metrum.session import table

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


NUMBERED = "n AS (SELECT case_id, event_id, t, event_type, value, row_number() OVER (PARTITION BY case_id ORDER BY t, event_id) - 1 AS place FROM ev)"


def place() -> Column:
    return F.row_number().over(Window.partitionBy("case_id").orderBy("t", "event_id")) - 1


@query(f"""WITH {EVENTS_SQL}, c AS (SELECT case_id, event_id, t / CAST({HOUR} AS DOUBLE) AS centre, event_type, value, t / CAST({HOUR} AS DOUBLE) - lag(t / CAST({HOUR} AS DOUBLE)) OVER (PARTITION BY case_id ORDER BY t, event_id) AS d FROM ev),
    f AS (SELECT case_id, unnest(['no_observed_phone_evidence', 'final_drain_fallback', 'boundary_guard_adjustment', 'low_strength_viseme', 'large_inter_event_gap']) AS kind, unnest([event_type = 'view', event_type = 'signup', event_type = 'error', value < 10, coalesce(d > 12, false)]) AS hit FROM c)
    SELECT case_id, count(*) AS flags, CAST(sum(CASE kind WHEN 'no_observed_phone_evidence' THEN 5 WHEN 'large_inter_event_gap' THEN 3 ELSE 1 END) AS BIGINT) AS risk FROM f WHERE hit GROUP BY 1""")
def draft_flag_risk(spark: SparkSession, sf: str) -> DataFrame:
    """Five independent tests an event, and the weighted count of what they flag."""
    reason = F.when(F.col("event_type") == "signup", "final_duration_drain").when(F.col("event_type") == "error", "guard").otherwise("")
    e = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("idx"), (F.col("t") / float(HOUR)).alias("centre"), F.col("value").alias("strength"), (F.col("event_type") != "view").alias("mapped"), reason.alias("reason"))
    return curation.risk(curation.event_flags(e, gap=12.0, weak=10.0), {"no_observed_phone_evidence": 5, "large_inter_event_gap": 3})


@query(f"""WITH {EVENTS_SQL}, {NUMBERED}, b AS (SELECT case_id, place AS idx, place AS word_at, CASE WHEN event_type = 'error' THEN -1 ELSE place + 1 END AS next_at, t + {HOUR} AS e FROM n WHERE event_type IN ('error', 'click'))
    SELECT b.case_id, b.idx, least(b.e, coalesce(r.t, b.e)) AS start_us, greatest(least(b.e, coalesce(r.t, b.e)) + 1000, coalesce(r.t, b.e)) AS end_us FROM b LEFT JOIN n r ON r.case_id = b.case_id AND r.place = b.next_at""")
def boundary_hydration(spark: SparkSession, sf: str) -> DataFrame:
    n = adapters.events(spark, sf).withColumn("place", place())
    w = n.select("case_id", "place", F.col("t").alias("start"), (F.col("t") + HOUR).alias("end"))
    b = n.where(F.col("event_type").isin("error", "click")).select("case_id", F.col("place").alias("idx"), F.col("place").alias("word_at"), F.when(F.col("event_type") == "error", -1).otherwise(F.col("place") + 1).alias("next_at"))
    return curation.hydrate_boundaries(b, w, 1000).select("case_id", "idx", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"""WITH {EVENTS_SQL}, w AS (SELECT case_id, event_id AS idx, t, 1 + event_id % 4 AS n FROM ev), k AS (SELECT *, unnest(generate_series(0, n - 1)) AS phone_index FROM w)
    SELECT case_id, idx, CAST(phone_index AS INTEGER) AS phone_index, round(phone_index * (60.0 / n), 6) AS start_min, round((phone_index + 1) * (60.0 / n), 6) AS end_min FROM k""")
def pseudo_phone_spans(spark: SparkSession, sf: str) -> DataFrame:
    w = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("idx"), F.lit(0.0).alias("start"), F.lit(60.0).alias("end"), (1 + F.col("event_id") % 4).cast("int").alias("n"))
    return curation.pseudo_phones(w).select("case_id", "idx", "phone_index", F.round("start", 6).alias("start_min"), F.round("end", 6).alias("end_min"))


@query("""WITH l AS (SELECT l_orderkey AS case_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate) AS idx, l_returnflag AS word, l_discount FROM lineitem),
    t AS (SELECT case_id, idx, word, idx * 0.5 + l_discount AS centre, 0.1 + l_discount AS duration FROM l),
    x AS (SELECT *, lead(word) OVER w AS nw, lead(centre) OVER w AS nc, lead(duration) OVER w AS nd FROM t WINDOW w AS (PARTITION BY case_id ORDER BY idx))
    SELECT case_id, count(*) + count_if(coalesce(nw <> word, false)) AS tokens, count_if(coalesce(nw <> word, false)) AS silences,
      round(coalesce(sum(CASE WHEN nw <> word THEN CASE WHEN nc - 0.005 > centre + 0.005 THEN least(greatest((centre + duration / 2 + nc - nd / 2) / 2, centre + 0.005), nc - 0.005) ELSE (centre + nc) / 2 END END), 0), 4) AS centres,
      round(coalesce(sum(CASE WHEN nw <> word THEN greatest(nc - nd / 2 - centre - duration / 2, 0.010) END), 0), 4) AS durations FROM x GROUP BY 1""")
def silence_insertion(spark: SparkSession, sf: str) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_shipdate"))
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("case_id"), n.alias("idx"), F.col("l_returnflag").alias("word"), (n * 0.5 + F.col("l_discount")).alias("centre"), (0.1 + F.col("l_discount")).alias("duration"))
    s = curation.with_silences(t)
    only = lambda c: F.round(F.coalesce(F.sum(F.when(F.col("silence"), F.col(c))), F.lit(0.0)), 4)
    return s.groupBy("case_id").agg(F.count("*").alias("tokens"), F.count_if("silence").alias("silences"), only("centre").alias("centres"), only("duration").alias("durations"))


def _gap_rows(name: str) -> str:
    return f"""(SELECT case_id, region AS idx, e AS gs, nx AS ge, row_number() OVER (PARTITION BY case_id ORDER BY region) AS p FROM (SELECT case_id, region, e, lead(s) OVER (PARTITION BY case_id ORDER BY region) AS nx FROM {name}) WHERE nx > e)"""


@query(f"""WITH RECURSIVE {EVENTS_SQL}, {GOLD_SQL}, {PRED_SQL}, x AS {_gap_rows("gold")}, y AS {_gap_rows("pred")},
    near AS (SELECT x.case_id, x.p, list({{'d': abs((y.gs + y.ge) / 2e0 - (x.gs + x.ge) / 2e0), 'j': y.p}} ORDER BY abs((y.gs + y.ge) / 2e0 - (x.gs + x.ge) / 2e0), y.p) AS c FROM x JOIN y ON y.case_id = x.case_id AND (least(x.ge, y.ge) > greatest(x.gs, y.gs) OR abs((y.gs + y.ge) / 2e0 - (x.gs + x.ge) / 2e0) <= {HOUR}) GROUP BY ALL),
    m AS (SELECT case_id, 0::BIGINT AS p, []::BIGINT[] AS used, NULL::BIGINT AS j FROM (SELECT DISTINCT case_id FROM x)
      UNION ALL SELECT m.case_id, x.p, CASE WHEN list_filter(n.c, lambda k: NOT list_contains(m.used, k.j))[1] IS NULL THEN m.used ELSE list_append(m.used, list_filter(n.c, lambda k: NOT list_contains(m.used, k.j))[1].j) END, list_filter(n.c, lambda k: NOT list_contains(m.used, k.j))[1].j
        FROM m JOIN x ON x.case_id = m.case_id AND x.p = m.p + 1 LEFT JOIN near n ON n.case_id = x.case_id AND n.p = x.p)
    SELECT m.case_id, CAST(x.idx AS BIGINT) AS expected, CAST(y.idx AS BIGINT) AS found FROM m JOIN x ON x.case_id = m.case_id AND x.p = m.p JOIN y ON y.case_id = m.case_id AND y.p = m.j""")
def greedy_gap_match(spark: SparkSession, sf: str) -> DataFrame:
    """Gaps between gold regions against gaps between predicted ones."""

    def gaps(r: DataFrame) -> DataFrame:
        w = Window.partitionBy("case_id").orderBy("region")
        return r.select("case_id", F.col("region").cast("long").alias("idx"), F.col("end").alias("start"), F.lead("start").over(w).alias("e")).where("e > start").withColumnRenamed("e", "end")

    return curation.match_gaps(gaps(adapters.gold(spark, sf)), gaps(adapters.predicted(spark, sf)), float(HOUR))


@query(f"""WITH {EVENTS_SQL}, {NUMBERED}, x AS (SELECT *, t - lag(t) OVER (PARTITION BY case_id, event_type ORDER BY place) AS d FROM n)
    SELECT case_id, count(*) AS tails, count_if(coalesce(d < {2 * HOUR}, false)) AS compressed, count_if(value > 100) AS early, count_if(abs(value) >= 150) AS shifted FROM x WHERE event_type = 'signup' GROUP BY 1""")
def tail_recovery(spark: SparkSession, sf: str) -> DataFrame:
    """Tails are the rows of one reason; events have none, so their type stands for it: signups."""
    e = adapters.events(spark, sf).select("case_id", place().alias("idx"), F.col("event_type").alias("word"), (F.col("t") / float(HOUR)).alias("h"), "t", "value", (F.col("event_type") == "signup").alias("tail"))
    r = e.select("case_id", "idx", "word", F.col("t").alias("centre"), (F.col("t") + F.col("value")).alias("prior"), F.col("value").alias("lead"), "tail")
    # The prior is as far from the centre as the value, in whole microseconds, so times stay exact.
    return curation.tail_recovery(r.withColumn("prior", F.col("centre") + F.floor(F.abs("lead")).cast("long")), 2 * HOUR, 100.0, 150.0)


@query(f"""WITH {WORDS}, u AS (SELECT DISTINCT word FROM w WHERE regexp_full_match(word, '[bcdfghjklmnpqrstvwxyz]{{2,5}}')) SELECT word, len(word) AS letters FROM u""")
def spelled_words(spark: SparkSession, sf: str) -> DataFrame:
    """Words that are spelled by letter names, as they have no vowel letter."""
    u = words(spark, sf).select("word").distinct().where(F.col("word").rlike("^[a-z]{2,5}$") & ~F.col("word").rlike("[aeiou]"))
    named = phones.spell_out(F.col("word"))
    return u.where(F.size(named) >= F.length("word")).select("word", F.length("word").cast("long").alias("letters"))


@query(None)
def fallback_poses(spark: SparkSession, sf: str) -> DataFrame:
    """Unknown words' phones, their poses, and how often each comes: words are spelled once, weighted by their count."""
    u = words(spark, sf).groupBy("word").agg(F.count("*").alias("n"))
    each = u.select("word", "n", F.explode(phones.spell_out(F.col("word"))).alias("phone"))
    return phones.poses(each).groupBy("phone", "pose", "strength").agg(F.sum("n").alias("n"))


@query(f"""WITH {EVENTS_SQL}, m AS (SELECT avg(value) AS m, stddev_pop(value) AS s FROM ev), z AS (SELECT case_id, event_id, t, (value - m) / greatest(s, 0.00001) AS z FROM ev, m)
    SELECT case_id, event_id, round(z, 6) AS z, round(max(z) OVER (PARTITION BY case_id ORDER BY t, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS band, round(1 / (1 + exp(-z)), 6) AS p FROM z""")
def standardized_bands(spark: SparkSession, sf: str) -> DataFrame:
    z = frames.standardize(adapters.events(spark, sf), ["value"])
    return frames.band_max(z, "value", 4, ["case_id"], ["t", "event_id"]).select("case_id", "event_id", F.round("value", 6).alias("z"), F.round("band", 6).alias("band"), F.round(frames.sigmoid(F.col("value")), 6).alias("p"))


@query(f"""WITH RECURSIVE {EVENTS_SQL}, f AS (SELECT case_id, event_id AS frame, row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS i, 1 / (1 + exp(-value / 50.0)) >= 0.45 AS active FROM ev),
    d AS (SELECT case_id, frame, i, active, CASE WHEN active THEN 1 ELSE 0 END AS run, 0 AS quiet, false AS inside, -1 AS region, NULL::BIGINT AS opened, frame AS began FROM f WHERE i = 1
      UNION ALL SELECT f.case_id, f.frame, f.i, f.active,
        CASE WHEN d.inside THEN (CASE WHEN NOT f.active AND d.quiet + 1 >= 12 THEN 0 ELSE d.run END) WHEN f.active THEN d.run + 1 ELSE 0 END,
        CASE WHEN d.inside AND NOT f.active THEN d.quiet + 1 ELSE 0 END,
        CASE WHEN d.inside THEN f.active OR d.quiet + 1 < 12 ELSE f.active AND d.run + 1 >= 2 END,
        CASE WHEN NOT d.inside AND f.active AND d.run + 1 >= 2 THEN d.region + 1 ELSE d.region END,
        CASE WHEN NOT d.inside AND f.active AND d.run + 1 >= 2 THEN d.began ELSE d.opened END,
        CASE WHEN NOT d.inside AND f.active AND d.run = 0 THEN f.frame ELSE d.began END FROM d JOIN f ON f.case_id = d.case_id AND f.i = d.i + 1),
    p AS (SELECT *, lag(inside) OVER w AS was, lag(quiet) OVER w AS before FROM d WINDOW w AS (PARTITION BY case_id ORDER BY i))
    SELECT case_id, CAST(region AS INTEGER) AS region, max(opened) AS first, max(frame) FILTER (active) AS last, CAST(count(*) FILTER (active AND was AND before > 0) AS INTEGER) AS reopened, count(*) FILTER (NOT inside) > 0 AS ended
    FROM p WHERE region >= 0 AND (inside OR was) GROUP BY case_id, region""")
def hysteresis_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Regions of frames by hysteresis: open after two active frames, closed after twelve quiet ones."""
    f = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("frame"), (frames.sigmoid(F.col("value") / 50.0) >= 0.45).alias("active"))
    return frames.detect(f)


@query("""WITH p AS (SELECT a.vec_id, CAST(a.embedding AS DOUBLE[]) AS x, CAST(b.embedding AS DOUBLE[]) AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1),
    m AS (SELECT vec_id, list_transform(range(1, len(x) + 1), lambda i: x[i] + (y[i] - x[i]) * 0.25) AS z FROM p), s AS (SELECT vec_id, z, list_max(z) AS top FROM m)
    SELECT vec_id, len(z) + len(z) // 16 * 2 AS widened, round(list_sum(z), 5) AS total, round(z[1] - top - ln(list_sum(list_transform(z, lambda v: exp(v - top)))), 5) AS first_log FROM s""")
def checkpoint_mix(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbouring vectors mixed, widened by two zeros each 16, and the first entry's log-softmax."""
    v = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("x"))
    p = v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    z = p.select("vec_id", frames.mix(F.col("x"), F.col("y"), 0.25).alias("z"))
    return z.select("vec_id", F.size(frames.widen(F.col("z"), 16, 2)).cast("long").alias("widened"), F.round(F.aggregate("z", F.lit(0.0), lambda a, b: a + b), 5).alias("total"), F.round(frames.log_softmax(F.col("z"))[0], 5).alias("first_log"))


@query("""WITH b AS (SELECT c_custkey, c_mktsegment, c_nationkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(range(1, len(c_name) + 1), lambda i: CAST(ord(substr(c_name, i, 1)) AS BIGINT))), lambda h, x: (xor(h, x) * 16777619) & 4294967295) AS h FROM customer),
    o AS (SELECT * FROM b UNION ALL SELECT * FROM b WHERE c_nationkey < 5 UNION ALL SELECT * FROM b WHERE c_mktsegment = 'BUILDING')
    SELECT c_mktsegment, count(*) AS n, count_if((h + 3) % 16 = 0) AS due FROM o GROUP BY 1""")
def oversampled_cadence(spark: SparkSession, sf: str) -> DataFrame:
    """Rows repeated once for each of two traits, and how many are due in epoch 3 of a cadence of 16. One explode instead
    of a union of three scans."""
    c = table(spark, sf, "customer").select("c_mktsegment", "c_nationkey", hashing.fnv1a32(F.col("c_name")).alias("h"))
    times = F.lit(1) + (F.col("c_nationkey") < 5).cast("int") + (F.col("c_mktsegment") == "BUILDING").cast("int")
    o = c.select("c_mktsegment", "h", F.explode(F.array_repeat(F.lit(1), times)).alias("one"))
    return o.groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.count_if((F.col("h") + 3) % 16 == 0).alias("due"))


@query("""SELECT c_custkey AS custkey, need AS artefact FROM customer CROSS JOIN (SELECT unnest(['O', 'F', 'P']) AS need) WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = need)""")
def manifest_completeness(spark: SparkSession, sf: str) -> DataFrame:
    """What each case lacks of three required artefacts: one aggregation and one join, then a set difference in the row."""
    have = table(spark, sf, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderstatus").alias("have"))
    need = F.array(*map(F.lit, "OFP"))
    c = table(spark, sf, "customer").join(have, F.col("c_custkey") == F.col("o_custkey"), "left")
    return c.select(F.col("c_custkey").alias("custkey"), F.explode(F.array_except(need, F.coalesce("have", F.array().cast("array<string>")))).alias("artefact"))


@query("""WITH a AS (SELECT DISTINCT user_id AS k FROM events WHERE event_type = 'error'), b AS (SELECT DISTINCT user_id AS k FROM events WHERE value > 200)
    SELECT (SELECT count(*) FROM a) AS errors, (SELECT count(*) FROM b) AS high, (SELECT count(*) FROM a JOIN b ON a.k = b.k) AS both_""")
def affected_cases(spark: SparkSession, sf: str) -> DataFrame:
    """Distinct cases with either trait and with both: one pass, flags by case, no intersection of two scans."""
    f = adapters.events(spark, sf).groupBy("case_id").agg(F.max(F.col("event_type") == "error").alias("e"), F.max(F.col("value") > 200).alias("h"))
    return f.agg(F.count_if("e").alias("errors"), F.count_if("h").alias("high"), F.count_if(F.col("e") & F.col("h")).alias("both_"))


@query("SELECT text, n FROM (SELECT sha256(text) AS text, count(*) AS n FROM documents GROUP BY 1) WHERE n > 1")
def duplicate_entries(spark: SparkSession, sf: str) -> DataFrame:
    return gates.duplicates(table(spark, sf, "documents").select(F.sha2("text", 256).alias("text")), "text")
