"""Queries over drafted annotations: clean phones, flags, gaps, regions, owners and heads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.operators import drafting
from metrum.plans import adapters, cases
from metrum.plans.adapters import DAY, EVENTS_SQL, HOUR, PRED_SQL
from metrum.plans.cases import MINUTE, PHONES_SQL, RUNTIME_SQL, WORDS_SQL

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


CLEAN_SQL = f"WITH {WORDS_SQL}, {PHONES_SQL}, clean AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY ps, pe, event_id, k) - 1 AS phone_index FROM ph WHERE lower(trim(label)) NOT IN ('', 'sil', 'sp', '<eps>', 'silence', 'pau') AND pe > ps)"


@query(f"{CLEAN_SQL} SELECT case_id, phone_index, label, ps AS start_us, pe AS end_us FROM clean")
def clean_phones(spark: SparkSession, sf: str) -> DataFrame:
    return drafting.clean_phones(cases.phones(spark, sf)).select("case_id", "phone_index", "label", F.col("start").alias("start_us"), F.col("end").alias("end_us"))


@query(f"""WITH {WORDS_SQL}, {PHONES_SQL} SELECT case_id, CASE WHEN label IN ('', 'sil') THEN 'blank_phone' ELSE 'non_positive_phone' END AS kind, count(*) AS n FROM ph WHERE label IN ('', 'sil') OR pe <= ps GROUP BY ALL""")
def phone_flags(spark: SparkSession, sf: str) -> DataFrame:
    return drafting.phone_flags(cases.phones(spark, sf))


@query(f"""WITH {WORDS_SQL}, {RUNTIME_SQL}, planned AS (SELECT case_id, word_index, word, row_number() OVER (PARTITION BY case_id ORDER BY word_index) AS p FROM (SELECT case_id, word_index, min(word) AS word FROM rt WHERE renderable GROUP BY ALL)),
    found AS (SELECT case_id, word, s, e, row_number() OVER (PARTITION BY case_id ORDER BY word_index) AS p FROM gw),
    z AS (SELECT coalesce(f.case_id, l.case_id) AS case_id, f.p AS fp, l.p AS lp, f.word, coalesce(l.word, f.word) AS said, f.s, f.e FROM found f FULL JOIN planned l ON f.case_id = l.case_id AND f.p = l.p),
    norm AS (SELECT *, regexp_replace(lower(word), '[^a-z0-9'']', '', 'g') AS a, regexp_replace(lower(said), '[^a-z0-9'']', '', 'g') AS b FROM z),
    last AS (SELECT case_id, max_by(e, p) AS e FROM found GROUP BY 1),
    flags AS (SELECT case_id, 'word_count_mismatch' AS kind, max(CASE WHEN fp IS NULL OR lp IS NULL THEN 1 ELSE 0 END) AS n FROM norm GROUP BY 1
      UNION ALL SELECT case_id, 'word_text_mismatch', count_if(word IS NOT NULL AND a <> b) FROM norm GROUP BY 1
      UNION ALL SELECT case_id, 'implausibly_short_word', count(*) FILTER (word IS NOT NULL AND greatest(length(b), 1) >= 6 AND e - s < {30 * MINUTE}) FROM norm GROUP BY 1
      UNION ALL SELECT l.case_id, 'mfa_timeline_truncated_tail', CASE WHEN max(t) + {90 * MINUTE} - any_value(l.e) > {-15 * MINUTE} THEN 1 ELSE 0 END FROM last l JOIN ev ON ev.case_id = l.case_id GROUP BY 1)
    SELECT case_id, kind, CAST(n AS BIGINT) AS n FROM flags WHERE n > 0""")
def draft_word_flags(spark: SparkSession, sf: str) -> DataFrame:
    """The words found against the planned list, those with an event that can be rendered; the audio ends 90 minutes after the last event."""
    planned = drafting.first_rows(cases.runtime(spark, sf).where("renderable"), ["case_id", "word_index"], ["idx"])
    audio = adapters.events(spark, sf).groupBy("case_id").agg((F.max("t") + 90 * MINUTE).alias("until"))
    return drafting.word_flags(cases.words(spark, sf), planned, audio, -15 * MINUTE, 30 * MINUTE)


SILENCES_SQL = f"still AS (SELECT case_id, e + {30 * MINUTE} AS qs, nx - {10 * MINUTE} AS qe FROM (SELECT case_id, e, lead(s) OVER (PARTITION BY case_id ORDER BY word_index) AS nx FROM gw) WHERE nx - {10 * MINUTE} > e + {30 * MINUTE})"
GAPS_SQL = f"""{CLEAN_SQL}, {SILENCES_SQL},
    b AS (SELECT case_id, word_index, mark, e AS gs, lead(s) OVER (PARTITION BY case_id ORDER BY word_index) AS ge FROM gw),
    pairs AS (SELECT case_id, pe AS le, lead(ps) OVER (PARTITION BY case_id ORDER BY phone_index) AS rs FROM clean),
    g AS (SELECT case_id, word_index, mark, greatest(ge - gs, 0) AS direct,
        greatest(0, coalesce((SELECT max(rs - le) FROM pairs p WHERE p.case_id = b.case_id AND 2 * le - 2 <= gs + ge AND gs + ge <= 2 * rs + 2), 0)) AS phone_gap,
        coalesce((SELECT max(least(ge, qe) - greatest(gs, qs)) FROM still q WHERE q.case_id = b.case_id AND qs < ge AND gs < qe), 0) AS silence FROM b WHERE ge IS NOT NULL),
    a AS (SELECT *, greatest(direct, phone_gap, silence) AS acoustic FROM g),
    r AS (SELECT *, CASE WHEN mark IN ('.', ';', ':', '?', '!', '-') AND acoustic >= {4 * HOUR} THEN 'hard_punctuation_with_lull' WHEN mark = ',' AND acoustic >= {6 * HOUR} THEN 'comma_with_lull' WHEN acoustic >= greatest({8 * HOUR}, {9 * HOUR}) THEN 'strong_acoustic_gap' ELSE 'none' END AS reason FROM a)"""


def _gaps(spark: SparkSession, sf: str) -> DataFrame:
    words = cases.words(spark, sf)
    after = F.lead("start").over(Window.partitionBy("case_id").orderBy("word_index"))
    still = words.withColumn("_n", after).select("case_id", (F.col("end") + 30 * MINUTE).alias("start"), (F.col("_n") - 10 * MINUTE).alias("end")).where("end > start")
    gaps = drafting.boundary_gaps(words, drafting.clean_phones(cases.phones(spark, sf)), still, DAY)
    return drafting.split_reasons(gaps, (".", ";", ":", "?", "!", "-"), 4 * HOUR, 6 * HOUR, 8 * HOUR, HOUR)


@query(f"""{GAPS_SQL} SELECT case_id, word_index, mark, direct, phone_gap, silence, acoustic, reason, reason <> 'none' AS split,
    CASE WHEN reason <> 'none' THEN 'region_break' WHEN mark = ',' AND acoustic >= {HOUR} THEN 'soft_pause' WHEN mark IN ('.', ';', ':', '?', '!', '-') AND acoustic >= {HOUR} THEN 'hard_pause' ELSE 'none' END AS pause_class FROM r""")
def acoustic_boundaries(spark: SparkSession, sf: str) -> DataFrame:
    """Three measures of each gap between words, the rule that splits there, and the class of the pause."""
    return _gaps(spark, sf)


REGIONS_SQL = f"""{GAPS_SQL}, wr AS (SELECT gw.*, CAST(coalesce(sum(CASE WHEN x.reason <> 'none' THEN 1 ELSE 0 END) OVER (PARTITION BY gw.case_id ORDER BY gw.word_index ROWS UNBOUNDED PRECEDING), 0) AS INTEGER) AS region
      FROM gw LEFT JOIN r x ON x.case_id = gw.case_id AND x.word_index = gw.word_index - 1),
    sr AS (SELECT case_id, region, min_by(s, word_index) AS rs, max_by(e, word_index) AS re, min(word_index) AS word_start, max(word_index) AS word_end, count(*) AS words FROM wr GROUP BY ALL)"""


@query(f"{REGIONS_SQL} SELECT case_id, region, rs AS start_us, re AS end_us, word_start, word_end, words FROM sr")
def speech_regions(spark: SparkSession, sf: str) -> DataFrame:
    found = drafting.regions_of_splits(cases.words(spark, sf), _gaps(spark, sf).where("split"))
    return found.select("case_id", "region", F.col("start").alias("start_us"), F.col("end").alias("end_us"), "word_start", "word_end", "words")


@query(f"""WITH {WORDS_SQL}, {PRED_SQL}, o AS (SELECT g.case_id, g.word_index, p.region, greatest(0, least(g.e, p.e) - greatest(g.s, p.s)) AS shared, 2 * p.s - 2 <= g.s + g.e AND g.s + g.e <= 2 * p.e + 2 AS held FROM gw g JOIN pred p ON p.case_id = g.case_id),
    best AS (SELECT case_id, word_index, CASE WHEN max(shared) > 0 THEN min_by(region, (-shared, region)) ELSE coalesce(max(region) FILTER (held), -1) END AS region FROM o GROUP BY ALL),
    every AS (SELECT gw.case_id, gw.word_index, coalesce(b.region, -1) AS before_ FROM gw LEFT JOIN best b ON b.case_id = gw.case_id AND b.word_index = gw.word_index)
    SELECT case_id, word_index, CAST(before_ AS INTEGER) AS region_before, CAST(lead(before_) OVER (PARTITION BY case_id ORDER BY word_index) AS INTEGER) AS region_after FROM every
    QUALIFY lead(before_) OVER (PARTITION BY case_id ORDER BY word_index) IS NOT NULL""")
def boundary_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Each boundary with the regions that its two words belong to."""
    spans = cases.words(spark, sf).select("case_id", F.col("word_index").alias("idx"), "start", "end")
    own = drafting.region_of_span(spans, adapters.as_right(adapters.predicted(spark, sf)), DAY)
    after = F.lead("match").over(Window.partitionBy("case_id").orderBy("idx"))
    return own.select("case_id", F.col("idx").alias("word_index"), F.col("match").cast("int").alias("region_before"), after.cast("int").alias("region_after")).where("region_after IS NOT NULL")


OWNED_SQL = f"""{CLEAN_SQL}, shifted AS (SELECT case_id, phone_index, label, ps + {8 * MINUTE} AS ps, pe + {8 * MINUTE} AS pe FROM clean),
    own AS (SELECT p.case_id, p.phone_index, min(w.word_index) AS owner FROM shifted p JOIN gw w ON w.case_id = p.case_id AND 2 * w.s - 2 <= p.ps + p.pe AND p.ps + p.pe <= 2 * w.e + 2 GROUP BY ALL),
    owned AS (SELECT o.*, s.label, row_number() OVER (PARTITION BY o.case_id, o.owner ORDER BY o.phone_index) - 1 AS index_in_word FROM own o JOIN shifted s ON s.case_id = o.case_id AND s.phone_index = o.phone_index)"""


def _owned(spark: SparkSession, sf: str) -> DataFrame:
    shifted = drafting.clean_phones(cases.phones(spark, sf)).withColumn("start", F.col("start") + 8 * MINUTE).withColumn("end", F.col("end") + 8 * MINUTE)
    return drafting.owners_of_phones(shifted, cases.words(spark, sf), DAY)


@query(f"{OWNED_SQL} SELECT case_id, phone_index, owner, index_in_word FROM owned")
def phone_owners(spark: SparkSession, sf: str) -> DataFrame:
    """Phones, moved by eight minutes, to the words that hold their middles."""
    return _owned(spark, sf).select("case_id", "phone_index", "owner", "index_in_word")


@query(f"""{OWNED_SQL}, lists AS (SELECT case_id, owner, list({{'i': index_in_word, 'base': regexp_replace(label, '[0-9]$', '')}} ORDER BY index_in_word) AS l FROM owned GROUP BY ALL),
    plan AS (SELECT case_id, event_id, word_index, k, CASE WHEN event_id % 6 = 0 THEN '' ELSE 'P' || ((event_id + k + event_id % 2) % 4) END AS src, CASE WHEN event_id % 4 = 0 THEN -1 ELSE k + event_id // 5 % 2 END AS nth FROM gk),
    j AS (SELECT p.*, l, list_filter(l, lambda x: x.i = nth)[1] AS ix, list_filter(l, lambda x: x.base = src)[1] AS lx FROM plan p LEFT JOIN lists ON lists.case_id = p.case_id AND lists.owner = p.word_index),
    r AS (SELECT *, CASE WHEN l IS NOT NULL AND nth < 0 AND src = '' THEN 'synthetic_word_fallback' WHEN ix IS NOT NULL AND (ix.base = src OR src = '') THEN 'mfa_exact_source_phone_index' WHEN ix IS NOT NULL THEN 'mfa_source_phone_index_label_mismatch' WHEN lx IS NOT NULL THEN 'mfa_source_phone_label_fallback' ELSE 'no_phone_evidence' END AS reason FROM j)
    SELECT case_id, event_id, k, reason, CASE reason WHEN 'synthetic_word_fallback' THEN 0 WHEN 'mfa_source_phone_label_fallback' THEN lx.i WHEN 'no_phone_evidence' THEN -1 ELSE ix.i END AS located FROM r""")
def phone_locator(spark: SparkSession, sf: str) -> DataFrame:
    """Planned events to phones of their words: by index, by label, or the word's first."""
    e, k = F.col("event_id"), F.col("k")
    src = F.when(e % 6 == 0, "").otherwise(F.concat(F.lit("P"), ((e + k + e % 2) % 4).cast("string")))
    at = F.when(e % 4 == 0, -1).otherwise(k + F.floor(e / 5) % 2).cast("long")
    planned = cases.runtime(spark, sf).select("case_id", "event_id", "word_index", "k", src.alias("source_phone"), at.alias("source_index"))
    return drafting.locate_phones(planned, _owned(spark, sf)).select("case_id", "event_id", "k", "reason", "located")


WINDOWS_SQL = f"""WITH {EVENTS_SQL}, span AS (SELECT case_id, min(t) // {HOUR} AS b0, max(t) // {HOUR} - min(t) // {HOUR} + 1 AS n FROM ev GROUP BY 1),
    act AS (SELECT DISTINCT ev.case_id, t // {HOUR} - b0 AS i FROM ev JOIN span ON span.case_id = ev.case_id WHERE event_type <> 'view'),
    win AS (SELECT g.case_id, g.i, g.n, a.i IS NOT NULL AS active FROM (SELECT case_id, n, unnest(range(n)) AS i FROM span) g LEFT JOIN act a ON a.case_id = g.case_id AND a.i = g.i)"""


def _windows(spark: SparkSession, sf: str) -> DataFrame:
    """Hours of each case from its first event to its last; active with an event other than a view."""
    e = adapters.events(spark, sf).select("case_id", F.floor(F.col("t") / HOUR).alias("b"), (F.col("event_type") != "view").alias("on"))
    span = e.groupBy("case_id").agg(F.min("b").alias("b0"), (F.max("b") - F.min("b") + 1).alias("n"))
    act = e.where("on").join(span, "case_id").select("case_id", (F.col("b") - F.col("b0")).alias("i")).distinct().withColumn("active", F.lit(True))
    every = span.select("case_id", "n", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("i"))
    return every.join(act, ["case_id", "i"], "left").withColumn("active", F.coalesce("active", F.lit(False)))


@query(f"""{WINDOWS_SQL}, a AS (SELECT *, i - lag(i) OVER (PARTITION BY case_id ORDER BY i) AS d FROM win WHERE active), b AS (SELECT *, sum(CASE WHEN d IS NULL OR d > 10 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM a),
    raw AS (SELECT case_id, r, min(i) AS s, max(i) AS last, any_value(n) AS n FROM b GROUP BY ALL), e AS (SELECT case_id, n, s, CASE WHEN n - 1 - last >= 10 THEN greatest(s + 2, last + 1) ELSE n END AS e FROM raw),
    p AS (SELECT case_id, greatest(0, s * 2 - 1) AS s, least(n * 2, e * 2 + 3) AS e FROM e WHERE e - s >= 2), m AS (SELECT *, max(e) OVER (PARTITION BY case_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM p),
    g AS (SELECT *, sum(CASE WHEN reach IS NULL OR s > reach + 8 THEN 1 ELSE 0 END) OVER (PARTITION BY case_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) - 1 AS region FROM m)
    SELECT case_id, CAST(region AS INTEGER) AS region, CAST(min(s) AS BIGINT) AS start_half_hours, CAST(max(e) AS BIGINT) AS end_half_hours FROM g GROUP BY ALL""")
def wave_regions(spark: SparkSession, sf: str) -> DataFrame:
    """Active regions of hours: ten quiet ones end a region, two are the least, padded by half an hour and by one and a half,
    merged over four hours."""
    half = HOUR // 2
    found = drafting.active_regions(_windows(spark, sf), HOUR, 10, 2, half, 3 * half, 8 * half)
    return found.select("case_id", "region", F.floor(F.col("start") / half).alias("start_half_hours"), F.floor(F.col("end") / half).alias("end_half_hours"))


@query(f"""{WINDOWS_SQL}, q AS (SELECT case_id, i, i - row_number() OVER (PARTITION BY case_id ORDER BY i) AS g FROM win WHERE NOT active)
    SELECT case_id, min(i) AS start_hour, max(i) + 1 AS end_hour FROM q GROUP BY case_id, g HAVING count(*) >= 5""")
def silence_spans(spark: SparkSession, sf: str) -> DataFrame:
    return drafting.quiet_spans(_windows(spark, sf), 1, 5).select("case_id", F.col("start").alias("start_hour"), F.col("end").alias("end_hour"))


@query(f"""WITH {WORDS_SQL}, {RUNTIME_SQL} SELECT case_id, word_index, idx, pose, c - {5 * MINUTE} AS start_us FROM rt QUALIFY row_number() OVER (PARTITION BY case_id, word_index ORDER BY c, idx) = 1""")
def word_heads(spark: SparkSession, sf: str) -> DataFrame:
    """The earliest event of each word."""
    return drafting.first_rows(cases.runtime(spark, sf), ["case_id", "word_index"], ["centre", "idx"]).select("case_id", "word_index", "idx", "pose", (F.col("centre") - 5 * MINUTE).alias("start_us"))
