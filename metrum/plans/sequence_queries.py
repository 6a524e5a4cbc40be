"""Queries that need sequential state: alignments, decodings, frame features and the stream of regions."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import text
from metrum.operators import alignment, frames, framing, signal
from metrum.plans import adapters
from metrum.plans.adapters import EVENTS_SQL, GOLD_SQL, HOUR
from metrum.session import table
from metrum.streaming import commit, diagnostics
from metrum.streaming import regions as streaming

QUERIES, ORACLES = {}, {}


def query(sql: str | None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return keep


@query(None)
def lcs_alignment(spark: SparkSession, sf: str) -> DataFrame:
    """Words of each turn against those of the next turn of its conversation. Rows of the same turn are one sequence, in
    the order of role and text."""
    said = F.struct(F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    turns = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("case_id"), "turn").agg(F.sort_array(F.collect_list(said)).alias("said"))
    words = turns.select("case_id", "turn", F.flatten(F.transform("said", lambda r: text.words(r["text"]))).alias("planned"))
    w = Window.partitionBy("case_id").orderBy("turn")
    return alignment.align_tokens(words.select("case_id", "turn", F.lead("turn").over(w).alias("next_turn"), "planned", F.lead("planned").over(w).alias("gold")))


@query(None)
def monotonic_match(spark: SparkSession, sf: str) -> DataFrame:
    """Purchases and errors of a case against its clicks and views, two sequences of the same kind that hold all events."""
    # Each side reads the table itself: a cogroup of one plan with itself mixes up its columns.
    side = lambda k: adapters.events(spark, sf).where(F.coalesce("event_type", F.lit("")).isin("purchase", "error") == k).select("case_id", F.col("event_id").alias("id"), "t", F.lit("e").alias("kind"), (F.floor("value") % 3).cast("string").alias("word"))
    return alignment.align_events(side(True), side(False), 3.0 * HOUR)


@query(None)
def span_alignment(spark: SparkSession, sf: str) -> DataFrame:
    return alignment.align_regions(adapters.gold(spark, sf), adapters.predicted(spark, sf))


# The best scores of all states after each frame, and which of them came from the state before. A path is read back from its
# last state; a frame is committed from what is known LAG frames later, within one state of the frame before.
STATES, LAG = 6, 30
DECODE_SQL = f"""WITH RECURSIVE {EVENTS_SQL}, f AS (SELECT case_id, event_id AS frame, row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS i, value, min(value) OVER (PARTITION BY case_id) AS lo, max(value) OVER (PARTITION BY case_id) AS hi, count(*) OVER (PARTITION BY case_id) AS n FROM ev),
    raw AS (SELECT *, list_transform(range({STATES}), lambda j: -abs(value - (lo + (hi - lo) * j / {STATES - 1})) / (hi - lo + 1e-9)) AS x FROM f),
    sc AS (SELECT case_id, frame, i, n, list_transform(x, lambda a: a - list_max(x) - ln(greatest(list_sum(list_transform(x, lambda b: exp(b - list_max(x)))), 1e-12))) AS s FROM raw),
    d AS (SELECT case_id, i, list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN j = 1 THEN s[1] ELSE '-infinity'::DOUBLE END) AS best, list_transform(range({STATES}), lambda j: 0) AS back FROM sc WHERE i = 1
      UNION ALL SELECT sc.case_id, sc.i,
        list_transform(range(1, {STATES + 1}), lambda j: greatest(d.best[j] + ln(0.8), CASE WHEN j = 1 THEN '-infinity'::DOUBLE ELSE d.best[j - 1] + ln(0.2) END) + sc.s[j]),
        list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN j > 1 AND d.best[j - 1] + ln(0.2) > d.best[j] + ln(0.8) THEN 1 ELSE 0 END)
      FROM d JOIN sc ON sc.case_id = d.case_id AND sc.i = d.i + 1)"""


COMMIT_SQL = f"""{DECODE_SQL}, n AS (SELECT case_id, max(i) AS n FROM d GROUP BY 1), ends AS (SELECT d.case_id, d.i AS upto, n.n, list_position(best, list_max(best)) AS state FROM d JOIN n ON n.case_id = d.case_id),
    walk AS (SELECT case_id, upto, n, upto AS i, state FROM ends UNION ALL SELECT w.case_id, w.upto, w.n, w.i - 1, w.state - d.back[w.state] FROM walk w JOIN d ON d.case_id = w.case_id AND d.i = w.i WHERE w.i > 1 AND (w.upto - w.i < {LAG} OR w.upto = w.n)),
    off AS (SELECT case_id, i, state - 1 AS offline FROM walk WHERE upto = n),
    seen AS (SELECT case_id, i, state - 1 AS want FROM walk WHERE upto = least(i + {LAG}, n)),
    com AS (SELECT case_id, i, want AS committed FROM seen WHERE i = 1 UNION ALL SELECT s.case_id, s.i, least(greatest(s.want, c.committed), c.committed + 1) FROM com c JOIN seen s ON s.case_id = c.case_id AND s.i = c.i + 1)"""


@query(f"""{COMMIT_SQL}
    SELECT f.case_id, f.frame, CAST(off.offline AS INTEGER) AS offline, CAST(com.committed AS INTEGER) AS committed FROM f JOIN off ON off.case_id = f.case_id AND off.i = f.i JOIN com ON com.case_id = f.case_id AND com.i = f.i""")
def fixed_lag_viterbi(spark: SparkSession, sf: str) -> DataFrame:
    frames = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("frame"), "value")
    return alignment.decode_cases(frames, 6, 30)


@query(f"""{COMMIT_SQL}
    SELECT f.case_id, f.frame, CAST(com.committed AS INTEGER) AS committed, CASE WHEN f.i > f.n - {LAG} THEN 'end_of_stream' ELSE 'fixed_lag' END AS reason FROM f JOIN com ON com.case_id = f.case_id AND com.i = f.i""")
def stream_commit(spark: SparkSession, sf: str) -> DataFrame:
    """The same decisions from a stream: frame by frame, never revised, with the last ones at the end of the stream."""
    return commit.commits_of_events(spark, f"{sf}/events.parquet", [math.log(0.8)] * STATES, LAG, go=[math.log(0.2)] * STATES)


BANDS = [1.0, 2.0, 4.0, 8.0, 16.0, 24.0]


@query(f"""WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS x, len(embedding) AS n FROM embeddings WHERE len(embedding) > 1),
    h AS (SELECT *, list_transform(x, lambda a, i: a * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / (n - 1)))) AS w FROM v),
    e AS (SELECT *, list_transform({BANDS}::DOUBLE[], lambda b: (pow(list_sum(list_transform(w, lambda a, i: a * cos(2 * pi() * (i - 1) * b / n))), 2) + pow(list_sum(list_transform(w, lambda a, i: a * sin(2 * pi() * (i - 1) * b / n))), 2)) / n) AS energies FROM h),
    lags AS (SELECT vec_id, max(CASE WHEN aa * bb > 0 THEN greatest(ab / sqrt(aa * bb), 0) ELSE 0 END) AS periodicity FROM (SELECT vec_id, list_inner_product(x[:n-k], x[k+1:]) AS ab, list_inner_product(x[:n-k], x[:n-k]) AS aa, list_inner_product(x[k+1:], x[k+1:]) AS bb FROM (SELECT *, unnest(range(2, least(16, n - 1) + 1)) AS k FROM v)) GROUP BY 1)
    SELECT e.vec_id, round(sqrt(list_inner_product(x, x) / n), 6) AS rms, len(list_filter(range(1, n), lambda i: (x[i] < 0) <> (x[i + 1] < 0))) AS zero_crossings, round(list_sum(energies), 6) AS energy, round(list_inner_product(energies, {BANDS}::DOUBLE[]) / greatest(list_sum(energies), 1e-12), 6) AS centroid,
      round(exp(list_avg(list_transform(energies, lambda a: ln(greatest(a, 1e-12))))) / greatest(list_avg(energies), 1e-12), 6) AS flatness, len(list_filter(range(1, len(energies) + 1), lambda i: list_sum(energies[1:i]) < 0.85 * greatest(list_sum(energies), 1e-12))) AS rolloff, round(periodicity, 6) AS periodicity
    FROM e JOIN lags ON lags.vec_id = e.vec_id""")
def goertzel_features(spark: SparkSession, sf: str) -> DataFrame:
    f = signal.features(table(spark, sf, "embeddings"), "vec_id", "embedding", BANDS)
    r = lambda c: F.round(c, 6)
    return f.select("vec_id", r("rms").alias("rms"), "zero_crossings", r(F.aggregate("energies", F.lit(0.0), lambda a, x: a + x)).alias("energy"), r("centroid").alias("centroid"), r("flatness").alias("flatness"), "rolloff", r("periodicity").alias("periodicity"))


@query(f"WITH {EVENTS_SQL}, {GOLD_SQL} SELECT case_id, region, s AS start_us, e AS end_us, n AS n_events FROM gold")
def stream_regions(spark: SparkSession, sf: str) -> DataFrame:
    """The stream's regions over all events, read to the end; equal to the batch query's."""
    return streaming.regions_of_table(spark, f"{sf}/events.parquet", 8 * HOUR, HOUR)


# Six tokens: silence, two sounds, the end of a sentence, two sounds.
PRIOR, SILENT, SENTENCE = [0.02, 0.05, 0.08, 0.02, 0.04, 0.12], [True, False, False, True, False, False], [False, False, False, True, False, False]


@query(f"""WITH RECURSIVE {EVENTS_SQL}, f AS (SELECT case_id, event_id AS frame, row_number() OVER (PARTITION BY case_id ORDER BY event_id) AS i, value, min(value) OVER (PARTITION BY case_id) AS lo, max(value) OVER (PARTITION BY case_id) AS hi, count(*) OVER (PARTITION BY case_id) AS n FROM ev),
    raw AS (SELECT *, list_transform(range({STATES}), lambda j: -abs(value - (lo + (hi - lo) * j / {STATES - 1})) / (hi - lo + 1e-9)) AS x FROM f),
    sc AS (SELECT case_id, frame, i, n, least(greatest(1 / (1 + exp(-value / 50.0)), 0.02), 0.98) AS occ, list_transform(x, lambda a: a - list_max(x) - ln(greatest(list_sum(list_transform(x, lambda b: exp(b - list_max(x)))), 1e-12))) AS s FROM raw),
    tk AS (SELECT {PRIOR}::DOUBLE[] AS pr, {str(SILENT).lower()} AS si, {str(SENTENCE).lower()} AS se),
    tl AS (SELECT si, list_transform(pr, lambda p: least(greatest(0.010::DOUBLE / greatest(p, 0.020::DOUBLE), 0.02::DOUBLE), 0.80::DOUBLE)) AS ap, list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN se[j] THEN 8e0 WHEN si[j] THEN 1e0 ELSE least(greatest(ceil(pr[j] * 50e0), 2e0), 8e0) END) AS mn,
      list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN si[j] THEN 1e9 ELSE least(greatest(ceil(pr[j] * 300e0), 6e0), 30e0) END) AS mx, list_transform(se, lambda x: CASE WHEN x THEN 0.75e0 ELSE 0.5e0 END) AS cost FROM tk),
    d AS (SELECT case_id, i, list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN j = 1 THEN s[1] + 1.75e0 * ln(1 - occ) ELSE '-infinity'::DOUBLE END) AS best, list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN j = 1 THEN 1 ELSE 0 END) AS dwell, list_transform(range({STATES}), lambda j: false) AS came FROM sc WHERE i = 1
      UNION ALL SELECT case_id, i, list_transform(range(1, {STATES + 1}), lambda j: greatest(st[j].h, st[j].g) + s[j] + 1.75e0 * ln(CASE WHEN si[j] THEN 1 - occ ELSE occ END)), list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN st[j].g > st[j].h THEN 1 ELSE dwell[j] + 1 END), list_transform(st, lambda x: x.g > x.h)
        FROM (SELECT sc.case_id, sc.i, sc.s, sc.occ, si, dwell, list_transform(range(1, {STATES + 1}), lambda j: {{'h': CASE WHEN dwell[j] < mx[j] THEN best[j] + ln(1 - ap[j]) ELSE '-infinity'::DOUBLE END,
          'g': CASE WHEN j > 1 AND (si[j - 1] OR dwell[j - 1] >= 2) THEN best[j - 1] + ln(ap[j - 1]) - greatest(mn[j - 1] - dwell[j - 1], 0e0) * cost[j - 1] ELSE '-infinity'::DOUBLE END}}) AS st FROM d JOIN sc ON sc.case_id = d.case_id AND sc.i = d.i + 1 CROSS JOIN tl)),
    p AS (SELECT case_id, i, {STATES - 1} AS token FROM sc WHERE i = n
      UNION ALL SELECT d.case_id, d.i - 1, p.token - CASE WHEN d.came[p.token + 1] THEN 1 ELSE 0 END FROM p JOIN d ON d.case_id = p.case_id AND d.i = p.i WHERE d.i > 1)
    SELECT sc.case_id, sc.frame, CAST(p.token AS INTEGER) AS token FROM p JOIN sc ON sc.case_id = p.case_id AND sc.i = p.i""")
def dwell_lattice(spark: SparkSession, sf: str) -> DataFrame:
    """Paths through the six tokens with dwell limits, dwell costs and speech occupancy."""
    chance = frames.sigmoid(F.col("value") / 50.0)
    f = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("frame"), "value", chance.alias("speech"))
    return alignment.decode_dwell(f, PRIOR, SILENT, SENTENCE)


def _energy_sql(x: str, n: int, bands: tuple[float, ...], rate: int = 16000) -> str:
    wave = lambda f: f"list_sum(list_transform({x}, lambda a, i: a * (0.54 - 0.46 * cos(2 * pi() * (i - 1) / {n - 1})) * {f}(2 * pi() * q * (i - 1) / {n})))"
    return f"list_transform({[int(0.5 + n * b / rate) for b in bands]}, lambda q: pow({wave('cos')}, 2) + pow({wave('sin')}, 2))"


def _period_sql(x: str, n: int, longest: float, steps: int, rate: int = 16000) -> str:
    low, high = int(framing.PERIOD * rate + 0.5), min(int(longest * rate + 0.5), n - 2)
    part = lambda a, b: f"list_inner_product({a}, {b})"
    a, b = f"{x}[:{n} - g]", f"{x}[g + 1:]"
    return f"least(1e0, greatest(0e0, list_max(list_transform({list(range(low, high + 1, max((high - low) // steps, 1)))}, lambda g: {part(a, b)} / sqrt(greatest({part(a, a)} * {part(b, b)}, 1e-8))))))"


HOP, WIDTH, HZ, RICH_HZ = 160, 480, list(framing.BANDS), list(framing.RICH_BANDS)


@query(f"""WITH s AS (SELECT label AS case_id, flatten(list(CAST(embedding AS DOUBLE[]) ORDER BY vec_id)) AS x FROM embeddings GROUP BY label), f AS (SELECT case_id, k AS frame, x[k * {HOP} + 1:(k + 1) * {HOP}] AS h, CASE WHEN (k + 1) * {HOP} >= {WIDTH} THEN x[(k + 1) * {HOP} - {WIDTH - 1}:(k + 1) * {HOP}] END AS w FROM (SELECT *, unnest(range(len(x) // {HOP})) AS k FROM s)),
    e AS (SELECT *, sqrt(list_inner_product(h, h) / {HOP}) AS rms, {_energy_sql('h', HOP, framing.BANDS)} AS e, CASE WHEN list_inner_product(h, h) > 1e-7 THEN {_period_sql('h', HOP, framing.LONGEST, framing.PERIODS)} ELSE 0 END AS p, CASE WHEN w IS NOT NULL THEN {_energy_sql('w', WIDTH, framing.RICH_BANDS)} END AS r, CASE WHEN w IS NOT NULL THEN {_period_sql('w', WIDTH, framing.RICH_LONGEST, framing.RICH_PERIODS)} END AS rp FROM f),
    t AS (SELECT *, greatest(list_sum(e), 1e-6) AS t, greatest(list_sum(r), 1e-6) AS rt, lag(rms) OVER o AS before_, lag(r) OVER o AS r0 FROM e WINDOW o AS (PARTITION BY case_id ORDER BY frame)),
    pk AS (SELECT a.case_id, a.frame, greatest(max(b.rms * pow(0.995, a.frame - b.frame)), 1e-4 * pow(0.995, max(a.frame) + 1)) AS peak FROM t a JOIN t b ON b.case_id = a.case_id AND b.frame <= a.frame GROUP BY ALL),
    u AS (SELECT t.*, peak, least(list_inner_product(e, {HZ}::DOUBLE[]) / t / 8000, 1) AS c, CASE WHEN r IS NOT NULL THEN least(list_inner_product(r, {RICH_HZ}::DOUBLE[]) / rt / 8000, 1) END AS rc, list_transform(r, lambda a: a / rt) AS d, list_transform(r0, lambda a: a / greatest(list_sum(r0), 1e-6)) AS d0 FROM t JOIN pk ON pk.case_id = t.case_id AND pk.frame = t.frame)
    SELECT case_id, frame, round(ln(greatest(rms, 1e-6)), 6) AS log_rms, round(least(rms / greatest(peak, 1e-4), 1), 6) AS rms_norm, round(coalesce(rms - before_, 0), 6) AS delta_rms, round(greatest(coalesce(rms - before_, 0), 0) / greatest(peak, 1e-4), 6) AS flux, round(len(list_filter(range(1, {HOP}), lambda i: (h[i] < 0) <> (h[i + 1] < 0))) / {HOP}::DOUBLE, 6) AS zcr,
      round(list_sum(e[1:2]) / t, 6) AS low, round(list_sum(e[3:4]) / t, 6) AS mid, round(list_sum(e[5:6]) / t, 6) AS high, round(c, 6) AS centroid, round(p, 6) AS periodicity, round(CASE WHEN r IS NULL THEN list_sum(e[1:2]) / t ELSE list_sum(r[1:3]) / rt END, 6) AS rich_low, round(CASE WHEN r IS NULL THEN list_sum(e[3:4]) / t ELSE list_sum(r[4:7]) / rt END, 6) AS rich_mid,
      round(CASE WHEN r IS NULL THEN list_sum(e[5:6]) / t ELSE list_sum(r[8:12]) / rt END, 6) AS rich_high, round(coalesce(rc, c), 6) AS rich_centroid, round(CASE WHEN r IS NULL THEN c ELSE coalesce(({RICH_HZ}::DOUBLE[])[len(list_filter(range(1, 13), lambda i: list_sum(r[1:i]) < 0.85 * rt)) + 1] / 8000, rc) END, 6) AS rich_rolloff,
      round(CASE WHEN r IS NULL THEN 0 ELSE least(exp(list_avg(list_transform(r, lambda a: ln(a + 1e-9)))) / greatest(rt / 12, 1e-9), 1) END, 6) AS rich_flatness, round(CASE WHEN r IS NULL OR r0 IS NULL THEN 0 ELSE least(2 * list_sum(list_transform(d, lambda a, i: greatest(a - d0[i], 0))), 1) END, 6) AS rich_flux, round(coalesce(rp, p), 6) AS rich_periodicity FROM u""")
def audio_frames(spark: SparkSession, sf: str) -> DataFrame:
    """The 18 features of 10 ms frames and 30 ms windows, of the vectors of a label taken as one stream of samples."""
    blocks = table(spark, sf, "embeddings").select(F.col("label").alias("case_id"), F.col("vec_id").alias("block"), F.col("embedding").alias("samples"), F.lit(16000).alias("rate"))
    found = framing.frame_features(blocks)
    return found.select("case_id", "frame", *(F.round(c, 6).alias(c) for c in framing.FEATURES))


FORWARD_SQL = f"""{DECODE_SQL}, fw AS (SELECT case_id, i, list_transform(range(1, {STATES + 1}), lambda j: CASE WHEN j = 1 THEN s[1] ELSE '-infinity'::DOUBLE END) AS a FROM sc WHERE i = 1
      UNION ALL SELECT sc.case_id, sc.i, list_transform(range(1, {STATES + 1}), lambda j: sc.s[j] + greatest(st[j].h, st[j].g) + CASE WHEN greatest(st[j].h, st[j].g) = '-infinity'::DOUBLE THEN 0 ELSE ln(exp(st[j].h - greatest(st[j].h, st[j].g)) + exp(st[j].g - greatest(st[j].h, st[j].g))) END)
        FROM (SELECT sc.case_id, sc.i, sc.s, list_transform(range(1, {STATES + 1}), lambda j: {{'h': fw.a[j] + ln(0.8), 'g': CASE WHEN j = 1 THEN '-infinity'::DOUBLE ELSE fw.a[j - 1] + ln(0.2) END}}) AS st FROM fw JOIN sc ON sc.case_id = fw.case_id AND sc.i = fw.i + 1) sc)"""


@query(f"""{FORWARD_SQL} SELECT fw.case_id, sc.n AS frames, CASE WHEN fw.a[{STATES}] = '-infinity'::DOUBLE THEN NULL ELSE round(fw.a[{STATES}], 6) END AS log_likelihood FROM fw JOIN sc ON sc.case_id = fw.case_id AND sc.i = fw.i WHERE fw.i = sc.n""")
def forward_likelihood(spark: SparkSession, sf: str) -> DataFrame:
    """The log likelihood of each case's frames over all paths from the first state to the last."""
    f = adapters.events(spark, sf).select("case_id", F.col("event_id").alias("frame"), "value")
    return alignment.forward_cases(f, STATES).withColumn("log_likelihood", F.round("log_likelihood", 6))


@query(f"""WITH {EVENTS_SQL}, {GOLD_SQL}, g AS (SELECT case_id, count(*) AS regions, min(s) AS shown_from, sum(n)::BIGINT AS inside FROM gold GROUP BY 1), e AS (SELECT case_id, count(*) AS rows, min(t) AS first, max(t) AS last FROM ev GROUP BY 1)
    SELECT e.case_id, rows, first, last, coalesce(regions, 0) AS regions, shown_from, rows - coalesce(inside, 0) AS open_rows FROM e LEFT JOIN g ON g.case_id IS NOT DISTINCT FROM e.case_id""")
def stream_tail(spark: SparkSession, sf: str) -> DataFrame:
    """What two streams over the events, one counting rows by micro-batch, one telling regions, have seen of each case."""
    path = f"{sf}/events.parquet"
    return diagnostics.tail(diagnostics.received(spark, path), diagnostics.told_regions(spark, path, 8 * HOUR, HOUR)).drop("updates")
