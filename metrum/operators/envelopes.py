"""Envelopes of runtime events, their samples on a grid, and where they are visible, without a row a sample.

An event rises, holds and falls; its edges depend on the events before and after it, on its region, and on its own extent.
Times are whole numbers of one unit; `second` says how many of them a second has, for the fixed values, which are seconds.
An event's weight rises and falls once, so the samples at which it is visible are a range: only those of its edges, which are
short, are looked at. Only events with other curves (a nucleus beat, or a diphthong, which turns into a second pose) are
sampled one by one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions.intervals import min_jerk, smooth

# Fixed values, in seconds: margins of an event's extent and of its centre, how far envelopes go beyond the middle between
# neighbours, the distance of neighbours that are continuous, edges, half a nucleus beat, the window and length of a
# region's entry, the least length of an edge; and the least weight, shares of a diphthong's turn.
MARGIN, CENTRE_MARGIN, BEYOND, CONTINUOUS, EDGE, BEAT = 0.015, 0.045, 0.020, 0.180, 0.045, 0.035
ENTRY_WINDOW, ENTRY_LENGTH, LEAST_EDGE = 0.060, 0.120, 0.001
LEAST_WEIGHT, TURN_BEGINS, TURN_LASTS, TURN_KEEPS, TURN_POSE = 0.012, 0.35, 0.40, 0.78, "12_Ww-Oo-"


def continuous(prev: Column, this: Column, second: int) -> Column:
    """Whether the envelopes of two neighbours (structs of centre, region, nucleus, anchor) may meet: in one region, centres
    near, neither a nucleus beat, and the later one not anchored to a resume."""
    return prev.isNotNull() & this.isNotNull() & ~prev["nucleus"] & ~this["nucleus"] & ~this["anchor"] & (prev["region"] == this["region"]) & (this["centre"] - prev["centre"] <= round(CONTINUOUS * second))


def envelopes(events: DataFrame, second: int, case: str = "case_id", order: str = "idx") -> DataFrame:
    """Rendered events with attack, attack_end, release_start, release. events: case, idx, start, centre, end, region,
    region_start, region_end, nucleus, anchor. One window a case; no join."""
    u = lambda seconds: F.lit(round(seconds * second))
    w = Window.partitionBy(case).orderBy(order)
    me = F.struct("centre", "region", "nucleus", "anchor")
    seen = events.withColumn("_me", me).withColumn("_prev", F.lag("_me").over(w)).withColumn("_next", F.lead("_me").over(w))
    c, prev, this, following = F.col("centre"), F.col("_prev"), F.col("_me"), F.col("_next")
    attack = F.least(F.col("start") - u(MARGIN), c - u(CENTRE_MARGIN))
    attack = F.when(continuous(prev, this, second) & (c > prev["centre"]), F.least(attack, F.floor((prev["centre"] + c) / 2) - u(BEYOND))).otherwise(attack)
    release = F.greatest(F.col("end") + u(MARGIN), c + u(CENTRE_MARGIN))
    release = F.when(continuous(this, following, second) & (following["centre"] > c), F.greatest(release, F.floor((following["centre"] + c) / 2) + u(BEYOND))).otherwise(release)
    attack, release = F.greatest(attack, F.col("region_start")), F.least(release, F.col("region_end"))
    entry = F.greatest(release, F.least(F.col("region_start") + u(ENTRY_LENGTH), F.col("region_end")))
    release = F.when(c - F.col("region_start") <= u(ENTRY_WINDOW), entry).otherwise(release)
    attack = F.when(F.col("nucleus"), F.greatest(c - u(BEAT), F.col("region_start"))).otherwise(attack)
    release = F.when(F.col("nucleus"), F.least(c + u(BEAT), F.col("region_end"))).otherwise(release)
    shaped = seen.withColumn("attack", attack.cast("long")).withColumn("release", release.cast("long")).drop("_me", "_prev", "_next")
    return shaped.withColumn("attack_end", F.least(c, F.col("attack") + u(EDGE))).withColumn("release_start", F.greatest(c, F.col("release") - u(EDGE)))


def weight(t: Column, second: int) -> Column:
    """The weight of a row of envelopes() at t."""
    least = F.lit(round(LEAST_EDGE * second))
    part = lambda a, b: (t - a) / F.greatest(b - a, least)
    a, ae, rs, r, c = (F.col(x) for x in ("attack", "attack_end", "release_start", "release", "centre"))
    beat = F.when(t <= c, smooth(part(a, c))).otherwise(1.0 - smooth(part(c, r)))
    held = F.when(t < ae, min_jerk(part(a, ae))).when(t > rs, 1.0 - min_jerk(part(rs, r))).otherwise(F.lit(1.0))
    shape = F.when((t < a) | (t > r), F.lit(0.0)).otherwise(F.when(F.col("nucleus"), beat).otherwise(held))
    return shape * F.greatest(F.least(F.col("strength"), F.lit(1.0)), F.lit(0.0))


def _once(rows: DataFrame, **made: Column) -> DataFrame:
    """rows with the columns made. A generator keeps what it makes: columns of a projection would be computed anew in filters
    that are pushed below it, and nested curves would become code too long to be compiled."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(n) for n, c in made.items())))))


def _clamped(x: Column) -> Column:
    return F.greatest(F.least(x, F.lit(1.0)), F.lit(0.0))


def weighed(rows: DataFrame, t: Column, second: int, name: str = "_w", strongest: bool = False) -> DataFrame:
    """Rows of envelopes() with their weight at t, each part of the curve computed once: the same numbers as weight(). strongest: a
    diphthong's is the larger one of its two poses, and weights not above LEAST_WEIGHT are 0."""
    least = F.lit(round(LEAST_EDGE * second))
    a, ae, rs, r, c = (F.col(x) for x in ("attack", "attack_end", "release_start", "release", "centre"))
    beat, up, flat, x = F.col("nucleus"), F.col("_up"), F.col("_flat"), F.col("_x")
    sides = rows.withColumn("_t", t).withColumn("_up", F.when(beat, F.col("_t") <= c).otherwise(F.col("_t") < ae)).withColumn("_flat", ~beat & (F.col("_t") >= ae) & (F.col("_t") <= rs))
    sides = sides.withColumn("_from", F.when(up, a).when(beat, c).otherwise(rs)).withColumn("_to", F.when(~up, r).when(beat, c).otherwise(ae))
    at = sides.withColumn("_x", _clamped((F.col("_t") - F.col("_from")) / F.greatest(F.col("_to") - F.col("_from"), least)))
    curve = at.withColumn("_y", F.when(beat, x * x * (F.lit(3.0) - F.lit(2.0) * x)).otherwise(x * x * x * (F.lit(10.0) + x * (F.lit(6.0) * x - F.lit(15.0)))))
    shape = F.when((F.col("_t") < a) | (F.col("_t") > r), F.lit(0.0)).when(flat, F.lit(1.0)).when(up, F.col("_y")).otherwise(1.0 - F.col("_y"))
    made = curve.withColumn("_v", shape * _clamped(F.col("strength")))
    if strongest:
        w, turn, phase = F.col("_v"), F.col("_turn"), F.col("_phase")
        made = made.withColumn("_phase", _clamped((_clamped((F.col("_t") - F.col("start")) / F.greatest(F.col("end") - F.col("start"), least)) - TURN_BEGINS) / TURN_LASTS)).withColumn("_turn", phase * phase * (F.lit(3.0) - F.lit(2.0) * phase))
        both = F.when(F.col("turns"), F.greatest(w * (1.0 - TURN_KEEPS * turn), w * turn)).otherwise(w)
        return _once(made, **{name: F.when(w > LEAST_WEIGHT, both).otherwise(0.0)}).select(*rows.columns, name)
    return _once(made, **{name: F.col("_v")}).select(*rows.columns, name)


def samples(found: DataFrame, second: int, step: int) -> DataFrame:
    """Rows of envelopes() with step (a number; its time is that many steps), pose and weight: two poses while a diphthong
    (`turns`) goes over into the second one. Weights not above LEAST_WEIGHT are left out."""
    first, last = F.ceil(F.col("attack") / step), F.floor(F.col("release") / step)
    each = found.where(first <= last).withColumn("step", F.explode(F.sequence(first, last)))
    t = F.col("step") * step
    each = weighed(each, t, second).where(F.col("_w") > LEAST_WEIGHT)
    phase = F.greatest(F.least((t - F.col("start")) / F.greatest(F.col("end") - F.col("start"), F.lit(round(LEAST_EDGE * second))), F.lit(1.0)), F.lit(0.0))
    turn = smooth((phase - TURN_BEGINS) / TURN_LASTS)
    one = lambda pose, w: F.struct(pose.alias("pose"), w.alias("weight"))
    both = F.when(F.col("turns"), F.array(one(F.col("pose"), F.col("_w") * (1.0 - TURN_KEEPS * turn)), one(F.lit(TURN_POSE), F.col("_w") * turn))).otherwise(F.array(one(F.col("pose"), F.col("_w"))))
    return each.withColumn("_s", F.explode(both)).drop("pose", "_w").select("*", "_s.pose", "_s.weight").drop("_s").where(F.col("weight") > LEAST_WEIGHT)


def visible(found: DataFrame, second: int, step: int, least: float, strict: bool = False, keys: tuple[str, ...] = ("case_id", "idx"), offset: Column | None = None) -> DataFrame:
    """keys, first, last, n: the steps at which an event's weight (a diphthong's: of one of its poses) is `least` or more
    (strict: above), and how many samples those are, from step `from_step` up to `to_step` of the row where it has them.
    offset: the time of step 0. An event that holds is as strong all the while, so of that part only the first and the last
    step are looked at; edges are short."""
    near = F.lit(0) if offset is None else offset
    at = F.col("step") * step + near
    enough = (lambda w: w > least) if strict else (lambda w: w >= least)
    low = F.greatest(F.ceil((F.col("attack") - near) / step), F.col("from_step"))
    high = F.least(F.floor((F.col("release") - near) / step), F.col("to_step"))
    curved, lo, hi, a, b = F.col("nucleus") | F.col("turns"), F.col("_lo"), F.col("_hi"), F.col("_a"), F.col("_b")
    ranged = _once(found, _lo=low, _hi=high).where("_lo <= _hi").where(curved | (F.col("strength") >= least))
    held = _once(ranged, _a=F.greatest(lo, F.ceil((F.col("attack_end") - near) / step)), _b=F.least(hi, F.floor((F.col("release_start") - near) / step)))
    parted = ~curved & (b - a >= 2)
    steps = F.when(parted, F.concat(F.sequence(lo, a), F.sequence(b, hi))).otherwise(F.sequence(lo, hi))
    each = held.withColumn("_skipped", F.when(parted, b - a - 1).otherwise(0)).withColumn("step", F.explode(steps))
    each = weighed(each, at, second)
    edge = F.lit(round(LEAST_EDGE * second))
    each = each.where(~curved | (F.col("_w") > LEAST_WEIGHT)).withColumn("_p", _clamped((_clamped((at - F.col("start")) / F.greatest(F.col("end") - F.col("start"), edge)) - TURN_BEGINS) / TURN_LASTS))
    each = each.withColumn("_turn", F.col("_p") * F.col("_p") * (F.lit(3.0) - F.lit(2.0) * F.col("_p")))
    one = lambda w: enough(w).cast("long")
    counted = _once(each, _n=F.when(F.col("turns"), one(F.col("_w") * (1.0 - TURN_KEEPS * F.col("_turn"))) + one(F.col("_w") * F.col("_turn"))).otherwise(one(F.col("_w")))).where("_n > 0")
    return counted.groupBy(*keys).agg(F.min("step").alias("first"), F.max("step").alias("last"), (F.sum("_n") + F.max("_skipped")).alias("n"))


def union_length(ranges: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n: how many whole numbers the ranges (first, last, both included) of a key cover together, by one sweep."""
    w = Window.partitionBy(*keys).orderBy("first", "last")
    reached = F.coalesce(F.max("last").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.col("first") - 1)
    new = F.greatest(F.col("last") - F.greatest(F.col("first") - 1, reached), F.lit(0))
    return ranges.withColumn("_new", new).groupBy(*keys).agg(F.sum("_new").alias("n"))
