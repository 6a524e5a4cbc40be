"""The plan of a text as one table: words, their phones, and the events that show them.

Words fan out to phones by one explode; running units, numbers and cross-links are windows over a text, so nothing is joined
with itself. A text's plan is as long as the text and is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions import hashing
from metrum.operators import phones

# The event of a word without phones, poses that are strongly visible, bounds of an event's place in its word, and
# half an event's extent, in units, for words of few events and of more than two.
UNKNOWN, UNKNOWN_POSE, UNKNOWN_STRENGTH = "UNK", "06_Eh", 0.78
STRONG = ("22_MBP", "12_Ww-Oo-", "11_Oo", "20_FV", "24_Tongue_Th")
PLACES, FEW_HALF, MANY_HALF, MANY = (0.05, 0.95), 0.42, 0.32, 2
#: Poses that support others.
SUPPORTING = ("21_FV-Ee-", "01_TDS-Ah-", "23_Tongue_LNTDS", "13_KGY_TDS", "02_TDS_KGY-Ee-")


def plan(words: DataFrame, case: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """One row a phone: case, word_index, word, region (by hard breaks before), sentence (by ends before), units, unit_start,
    total_units, phone_index (in the text), word_phone, phone, stress, vowel, pose, strength, strong, role, event_index (in the
    order of words; null for phones without a pose), start_norm, end_norm, place (of the event by start_norm).

    words: case, word_index, word, breaks and ends (whether a region and a sentence end after it), phones (null or empty: one
    event stands for the word). No two words of a text may have the same word_index.
    keep: more columns of words that its phones keep."""
    w, text = Window.partitionBy(*case).orderBy("word_index"), Window.partitionBy(*case)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    so_far = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    known = F.coalesce(F.size("phones") > 0, F.lit(False))
    # A word without phones counts as one of as many syllables as it has runs of vowels.
    runs = F.greatest(F.size(F.filter(F.split(F.regexp_replace(F.lower("word"), "[^aeiouy]+", " "), " "), lambda x: x != "")), F.lit(1))
    n = F.when(known, F.size("phones")).otherwise(1)
    units = phones.plan_units(F.when(known, phones.syllables(F.col("phones"))).otherwise(runs), n)
    told = words.withColumn("_known", known).withColumn("_n", n.cast("long")).withColumn("units", units.cast("long"))
    told = told.withColumn("unit_start", so_far("units")).withColumn("total_units", F.sum("units").over(text)).withColumn("_first", so_far("_n"))
    told = told.withColumn("region", so_far(F.col("breaks").cast("long"))).withColumn("sentence", so_far(F.col("ends").cast("long")))
    # Events are counted by word, so phones, of which there are many more, are not sorted.
    told = told.withColumn("_many", F.when(F.col("_known"), F.size(F.filter("phones", phones.is_shown))).otherwise(1).cast("long")).withColumn("_e", so_far("_many"))
    each = told.select("*", F.inline(F.when(F.col("_known"), _numbered(F.col("phones"))).otherwise(F.array(_phone(F.lit(0), F.lit(UNKNOWN), F.lit(0)))))).drop("phones")
    shown = phones.poses(each)
    unknown = ~F.col("_known")
    shown = shown.withColumn("pose", F.when(unknown, UNKNOWN_POSE).otherwise(F.col("pose"))).withColumn("strength", F.when(unknown, UNKNOWN_STRENGTH).otherwise(F.col("strength")))
    shown = shown.withColumn("_v", F.col("pose").isNotNull().cast("long"))
    at = F.least(F.greatest((F.col("word_phone") + 0.5) / F.col("_n"), F.lit(PLACES[0])), F.lit(PLACES[1]))
    centre = (F.col("unit_start") + at * F.col("units")) / F.col("total_units")
    half = F.when(F.col("_many") > MANY, MANY_HALF).otherwise(FEW_HALF) / F.col("total_units")
    within = lambda c: F.when(F.col("_v") == 1, F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0)))
    shown = shown.withColumn("event_index", F.col("_e") + F.col("_event")).withColumn("start_norm", within(centre - half)).withColumn("end_norm", within(centre + half))
    base = phones.base(F.col("phone"))
    role = F.when(F.col("_v") == 0, "timing").when(base == "HH", "coarticulated").when(F.col("pose").isin(*SUPPORTING), "supporting").otherwise("primary")
    # By start_norm, events come in their own order: a word has 2 units or more and its events lie PLACES apart from its ends, so from
    # one word to the next a start grows by 0.2 units and more, of which half an extent takes back no more than 0.1; equal starts
    # are in order of events.
    return shown.withColumn("place", F.col("event_index")).select(
        *case, "word_index", "word", "region", "sentence", "units", "unit_start", "total_units", (F.col("_first") + F.col("word_phone")).alias("phone_index"), F.col("word_phone").cast("long").alias("word_phone"), "phone",
        phones.stress(F.col("phone")).alias("stress"), base.isin(*phones.VOWELS).alias("vowel"), "pose", "strength", F.coalesce(F.col("pose").isin(*STRONG), F.lit(False)).alias("strong"), role.alias("role"), "event_index", "start_norm", "end_norm", "place", *keep,
    )


def _phone(at: Column, phone: Column, event: Column) -> Column:
    return F.struct(at.cast("int").alias("word_phone"), phone.alias("phone"), event.cast("int").alias("_event"))


def _numbered(found: Column) -> Column:
    """Phones with their number in the word and, for those with a pose, among these; the others come last."""
    placed = F.transform(found, lambda p, i: F.struct(i.alias("at"), p.alias("phone"), phones.is_shown(p).alias("shown")))
    seen = F.transform(F.filter(placed, lambda x: x["shown"]), lambda x, i: _phone(x["at"], x["phone"], i))
    return F.concat(seen, F.transform(F.filter(placed, lambda x: ~x["shown"]), lambda x: _phone(x["at"], x["phone"], F.lit(None))))


# Buckets of phones and poses, numbers of other features and of kinds of marks in their order; how a silence is
# named and how long it is expected to last, at the end of a sentence too; roles in their order.
PHONE_BUCKETS, POSE_BUCKETS, OTHER_FEATURES = 64, 32, 20
MARKS = ("comma", "period", "question", "exclamation", "colon", "semicolon", "dash", "other")
SILENCE, SILENT_POSE, SILENT_SECONDS, SENTENCE_SECONDS = "SIL", "__SILENCE__", 0.040, 0.120
ROLES = ("timing", "coarticulated", "supporting", "primary")


def tensor(events: DataFrame, case: list[str]) -> DataFrame:
    """The tokens of a text and their features: its events in the order of `place`, a silence before the first one, between
    words, and after the last one.

    events: rows of plan() that have a place, with prior (seconds; null: 0.075), pause (hard_break, soft_list, none) and mark
    (a class of MARKS, or none) after the event's word; null is none. Returns case, token (from 0), silent, place, word_index,
    phone_index (null for silences), sentence_end, pause, hard_pause, mark, and the features that are not 0, as `at` (numbers,
    ascending) and `value`: one of 64 by the phone's hash, one of 32 by the pose's, then prior, vowel, role / 3, centre,
    strength, first, last, silent, starts a word, ends a word, pause, any mark, and one of eight by its class. Events of the
    same word that have another word's between them start and end it more than once.

    Neighbours come from one window, silences from one explode next to their event, so nothing is joined and events are sorted once."""
    each, numbers, flags = _tokens(events, case)
    features = sorted([*((k, at, c) for k, (at, c) in numbers.items()), *((k, at, F.when(c, 1.0).otherwise(0.0)) for k, (at, c) in flags.items())], key=lambda x: x[0])
    sparse = each.withColumn("_f", F.filter(F.array(*(F.struct(at.alias("at"), c.alias("value")) for _, at, c in features)), lambda x: x["value"] != 0))
    return sparse.select(*case, *TOKEN, F.col("_f.at").alias("at"), F.col("_f.value").alias("value"))


def tensor_text(events: DataFrame, case: list[str]) -> DataFrame:
    """tensor() with `features`, a text of number:millionths for each that is not 0, in place of at and value."""
    each, numbers, flags = _tokens(events, case)
    said = {k: F.when(c != 0, F.concat(at.cast("string"), F.lit(":"), F.floor(c * 1e6 + 0.5).cast("string"))) for k, (at, c) in numbers.items()}
    said |= {k: F.when(c, F.concat(at.cast("string"), F.lit(":1000000"))) for k, (at, c) in flags.items()}
    return each.select(*case, *TOKEN, F.concat_ws(" ", *(said[k] for k in sorted(said))).alias("features"))


TOKEN = ("token", "silent", "place", "word_index", "phone_index", "sentence_end", "pause", "hard_pause", "mark")
_PHONES = (SILENCE, UNKNOWN, *(p for group, _, _ in phones.POSES for p in group.split()))
_POSES = dict.fromkeys((SILENT_POSE, UNKNOWN_POSE, *(pose for _, pose, _ in phones.POSES)))


def _bucket(name: Column, n: int, known: tuple[str, ...] | dict[str, None]) -> Column:
    """The bucket of a name by its hash, which is computed beforehand for the known ones."""
    table = F.create_map(*(F.lit(x) for k in dict.fromkeys(known) for x in (k, hashing.fnv1a32_of(k) % n)))
    return F.coalesce(F.try_element_at(table, name), (hashing.fnv1a32(name) % n).cast("int"))


def _tokens(events: DataFrame, case: list[str]) -> tuple[DataFrame, dict[int, tuple[Column, Column]], dict[int, tuple[Column, Column]]]:
    """Tokens, and by their order the numbers and values of their features, numbers and flags."""
    w = Window.partitionBy(*case).orderBy("place")
    centre = F.col("start_norm") + 0.5 * (F.col("end_norm") - F.col("start_norm"))
    role = F.coalesce(F.array_position(F.array(*map(F.lit, ROLES)), F.col("role")) - 1, F.lit(0))
    told = events.select(
        *case, "place", "word_index", "phone_index", "sentence", _bucket(phones.base(F.col("phone")), PHONE_BUCKETS, _PHONES).alias("_p"), _bucket(F.col("pose"), POSE_BUCKETS, _POSES).alias("_q"), F.coalesce("prior", F.lit(0.075)).alias("prior"), "vowel",
        (role / 3.0).alias("role"), centre.alias("centre"), F.col("strength").cast("double").alias("strength"), F.coalesce("pause", F.lit("none")).alias("pause"), F.coalesce("mark", F.lit("none")).alias("mark"),
    )
    told = told.withColumn("_before", F.lag("word_index").over(w)).withColumn("_after", F.lead(F.struct("word_index", "centre", "sentence")).over(w))
    told = told.withColumn("_leads", F.col("_before").isNull()).withColumn("_trails", F.col("_after").isNull())
    told = told.withColumn("_ends", F.coalesce(F.col("_trails") | (F.col("_after.word_index") != F.col("word_index")), F.lit(False)))
    # Rows of earlier events, so tokens are numbered before silences stand between them.
    rows = 1 + F.col("_leads").cast("long") + F.col("_ends").cast("long")
    told = told.withColumn("_from", F.coalesce(F.sum(rows).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    # A silence before the text is part 0, the event part 1, a silence after it part 2.
    least = F.when(F.col("_leads"), 0).otherwise(1)
    told = told.select("*", F.explode(F.sequence(least, F.when(F.col("_ends"), 2).otherwise(1))).alias("_part"))
    own, leads, trails = F.col("_part") == 1, F.col("_leads"), F.col("_trails")
    after, no = F.col("_part") == 2, F.lit(False)
    between = after & ~trails
    closes = F.when(between, F.col("_after.sentence") != F.col("sentence")).otherwise(no)
    long_ = lambda c: F.when(own, F.col(c).cast("long")).alias(c)
    of = lambda c, other: F.when(own, F.col(c)).otherwise(other)
    each = told.select(
        *case, (F.col("_from") + F.col("_part") - least).cast("long").alias("token"), (~own).alias("silent"), long_("place"), long_("word_index"), long_("phone_index"), closes.alias("sentence_end"),
        (between & (F.col("pause") != "none")).alias("pause"), (between & (F.col("pause") == "hard_break")).alias("hard_pause"), F.when(after, F.col("mark")).otherwise("none").alias("mark"),
        of("_p", hashing.fnv1a32_of(SILENCE) % PHONE_BUCKETS).alias("_p"), of("_q", hashing.fnv1a32_of(SILENT_POSE) % POSE_BUCKETS).alias("_q"), of("prior", F.when(closes, SENTENCE_SECONDS).otherwise(SILENT_SECONDS)).alias("prior"), of("vowel", no).alias("vowel"), of("role", 0.0).alias("role"),
        F.when(own, F.col("centre")).when(~after, 0.0).when(trails, 1.0).otherwise(0.5 * (F.col("centre") + F.col("_after.centre"))).alias("centre"), of("strength", 0.0).alias("strength"),
        (own & (leads | (F.col("_before") != F.col("word_index")))).alias("_starts"), (own & F.col("_ends")).alias("_stops"), (after & trails).alias("_last"),
    )
    each = each.withColumn("_kind", F.array_position(F.array(*map(F.lit, MARKS)), F.col("mark")))
    base, kind = PHONE_BUCKETS + POSE_BUCKETS, F.col("_kind")
    at = lambda i: F.lit(base + i)
    numbers = {i: (at(i), F.col(c)) for i, c in ((0, "prior"), (2, "role"), (3, "centre"), (4, "strength"))}
    flags = {-2: (F.col("_p"), F.col("_p").isNotNull()), -1: (F.col("_q") + PHONE_BUCKETS, F.col("_q").isNotNull()), 1: (at(1), F.col("vowel")), 5: (at(5), F.col("token") == 0)}
    flags |= {i: (at(i), F.col(c)) for i, c in ((6, "_last"), (7, "silent"), (8, "_starts"), (9, "_stops"), (10, "pause"))}
    flags |= {11: (at(11), kind > 0), 12: ((kind + (base + 11)).cast("int"), kind > 0)}
    return each, numbers, flags
