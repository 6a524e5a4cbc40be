"""Drafts of annotations: clean intervals, flags, gaps between words, regions and owners. Times are whole microseconds.

Rows of a case meet by range joins in time buckets or by one window over the case; nothing compares all with all.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from metrum.functions.intervals import overlap
from metrum.functions.text import normalize_word
from metrum.operators import regions

# Labels of silence.
SILENCE = ("", "sil", "sp", "<eps>", "silence", "pau")


def is_silence(label: Column) -> Column:
    return F.lower(F.trim(F.coalesce(label, F.lit("")))).isin(*SILENCE)


def clean_phones(phones: DataFrame) -> DataFrame:
    """phones (case_id, start, end, label, tie: k) without silences and intervals that aren't positive, with phone_index,
    the place in the order of start, end and tie."""
    kept = phones.where(~is_silence(F.col("label")) & (F.col("end") > F.col("start")))
    return kept.withColumn("phone_index", (F.row_number().over(Window.partitionBy("case_id").orderBy("start", "end", "event_id", "k")) - 1).cast("long"))


def phone_flags(phones: DataFrame) -> DataFrame:
    """case_id, kind, n of what clean_phones leaves out: silences, and other labels whose interval isn't positive."""
    kind = F.when(is_silence(F.col("label")), "blank_phone").when(F.col("end") <= F.col("start"), "non_positive_phone")
    return phones.select("case_id", kind.alias("kind")).where("kind IS NOT NULL").groupBy("case_id", "kind").agg(F.count("*").alias("n"))


def first_rows(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key."""
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def word_flags(found: DataFrame, planned: DataFrame, audio: DataFrame, tail: int, short: int) -> DataFrame:
    """case_id, kind, n. found (case_id, word_index, word, start, end) and planned (case_id, word_index, word) meet by their
    places in their own order, and lists of unequal length are one flag; so is a difference of normalised words at a
    place, a last word that ends `tail` before its audio (case_id, until), and a word of six letters or more shorter than
    `short`."""
    place = F.row_number().over(Window.partitionBy("case_id").orderBy("word_index"))
    both = found.withColumn("_p", place).join(planned.select("case_id", place.alias("_p"), F.col("word").alias("_planned")), ["case_id", "_p"], "full")
    said = F.coalesce("_planned", "word")
    differs = F.col("word").isNotNull() & (normalize_word(said) != normalize_word(F.col("word")))
    brief = F.col("word").isNotNull() & (F.greatest(F.length(normalize_word(said)), F.lit(1)) >= 6) & (F.col("end") - F.col("start") < short)
    each = both.groupBy("case_id").agg(
        F.max((F.col("word").isNull() | F.col("_planned").isNull()).cast("long")).alias("word_count_mismatch"), F.count_if(differs).alias("word_text_mismatch"), F.count_if(brief).alias("implausibly_short_word"), F.max_by("end", F.when(F.col("word").isNotNull(), F.col("_p"))).alias("_last")
    )
    told = each.join(audio, "case_id", "left").withColumn("mfa_timeline_truncated_tail", F.coalesce((F.col("until") - F.col("_last") > tail).cast("long"), F.lit(0)))
    kinds = ["word_count_mismatch", "word_text_mismatch", "implausibly_short_word", "mfa_timeline_truncated_tail"]
    return told.select("case_id", F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), F.col(k).alias("n")) for k in kinds))).alias("f")).select("case_id", "f.kind", "f.n").where("n > 0")


def boundary_gaps(words: DataFrame, phones: DataFrame, silences: DataFrame, width: int) -> DataFrame:
    """One row for each word but a case's last: case_id, word_index, mark, direct, phone_gap, silence, acoustic. direct: to
    the next word; phone_gap: the largest gap of neighbouring phones around the middle of the word gap (within 1 us);
    silence: the largest overlap of the word gap with a silent span (case_id, start, end); acoustic: the largest of the
    three."""
    w = Window.partitionBy("case_id").orderBy("word_index")
    b = words.withColumn("next", F.lead("start").over(w)).where("next IS NOT NULL").select("case_id", "word_index", "mark", F.col("end").alias("start"), F.col("next").alias("end"))
    neighbours = phones.withColumn("r_end", F.lead("start").over(Window.partitionBy("case_id").orderBy("phone_index")))
    # Twice the time, so that the middle is whole.
    pairs = neighbours.where("r_end >= end - 1").select("case_id", (2 * F.col("end") - 2).alias("r_start"), (2 * F.col("r_end") + 2).alias("r_end"), (F.col("r_end") - F.col("end")).alias("gap")).where("r_start <= r_end")
    middle = b.select("case_id", "word_index", (F.col("start") + F.col("end")).alias("start")).withColumn("end", F.col("start"))
    by_phone = regions.range_join(middle, pairs, 2 * width, closed=True).groupBy("case_id", "word_index").agg(F.max("gap").alias("phone_gap"))
    still = silences.select("case_id", F.col("start").alias("r_start"), F.col("end").alias("r_end"))
    shared = overlap(F.col("start"), F.col("end"), F.col("r_start"), F.col("r_end"))
    by_silence = regions.range_join(b.where("end > start"), still, width).groupBy("case_id", "word_index").agg(F.max(shared).alias("silence"))
    told = b.join(by_phone, ["case_id", "word_index"], "left").join(by_silence, ["case_id", "word_index"], "left")
    none = F.lit(0).cast("long")
    told = told.select("case_id", "word_index", "mark", F.greatest(F.col("end") - F.col("start"), none).alias("direct"), F.greatest(F.coalesce("phone_gap", none), none).alias("phone_gap"), F.coalesce("silence", none).alias("silence"))
    return told.withColumn("acoustic", F.greatest("direct", "phone_gap", "silence"))


def split_reasons(gaps: DataFrame, hard_marks: tuple[str, ...], hard: int, comma: int, strong: int, audible: int) -> DataFrame:
    """gaps with reason (none, or which rule splits), split, and pause_class: a split is a region break; other marks with an
    audible gap are pauses, of a comma soft and else hard."""
    is_hard, is_comma, gap = F.col("mark").isin(*hard_marks), F.col("mark") == ",", F.col("acoustic")
    reason = F.when(is_hard & (gap >= hard), "hard_punctuation_with_lull").when(is_comma & (gap >= comma), "comma_with_lull").when(gap >= max(strong, 1.5 * comma), "strong_acoustic_gap").otherwise("none")
    told = gaps.withColumn("reason", reason).withColumn("split", F.col("reason") != "none")
    return told.withColumn("pause_class", F.when(F.col("split"), "region_break").when(is_comma & (gap >= audible), "soft_pause").when(is_hard & (gap >= audible), "hard_pause").otherwise("none"))


def regions_of_splits(words: DataFrame, splits: DataFrame) -> DataFrame:
    """case_id, region, start, end, word_start, word_end, words: runs of words between splits (case_id, word_index: the word
    before). A case without splits is one region."""
    before = splits.select("case_id", (F.col("word_index") + 1).alias("word_index"), F.lit(1).alias("_new"))
    w = Window.partitionBy("case_id").orderBy("word_index").rowsBetween(Window.unboundedPreceding, 0)
    told = words.join(before, ["case_id", "word_index"], "left").withColumn("region", F.sum(F.coalesce("_new", F.lit(0))).over(w).cast("int"))
    first, last = F.min_by("start", "word_index"), F.max_by("end", "word_index")
    return told.groupBy("case_id", "region").agg(first.alias("start"), last.alias("end"), F.min("word_index").alias("word_start"), F.max("word_index").alias("word_end"), F.count("*").alias("words"))


def region_of_span(spans: DataFrame, found: DataFrame, width: int) -> DataFrame:
    """case_id, idx, match: the region (r_idx, r_start, r_end) of the largest overlap, the first of several; without overlap
    the last one that holds the span's middle (within 1 us); else -1."""
    own = regions.best_overlap(spans, found, width)
    doubled = found.select("case_id", "r_idx", (2 * F.col("r_start") - 2).alias("r_start"), (2 * F.col("r_end") + 2).alias("r_end"))
    middle = spans.select("case_id", "idx", (F.col("start") + F.col("end")).alias("start")).withColumn("end", F.col("start"))
    lone = middle.join(own.where("match < 0").select("case_id", "idx"), ["case_id", "idx"], "left_semi")
    held = regions.range_join(lone, doubled, 2 * width, closed=True).groupBy("case_id", "idx").agg(F.max("r_idx").alias("_held"))
    return own.join(held, ["case_id", "idx"], "left").select("case_id", "idx", F.when(F.col("match") >= 0, F.col("match")).otherwise(F.coalesce("_held", F.lit(-1))).alias("match"))


def owners_of_phones(phones: DataFrame, words: DataFrame, width: int) -> DataFrame:
    """phones (case_id, phone_index, start, end, ...) that some word holds the middle of (within 1 us), with owner, the
    first such word_index, and index_in_word. Words of a case are in order and don't overlap."""
    middle = phones.select("case_id", "phone_index", (F.col("start") + F.col("end")).alias("start")).withColumn("end", F.col("start"))
    held = words.select("case_id", "word_index", (2 * F.col("start") - 2).alias("r_start"), (2 * F.col("end") + 2).alias("r_end"))
    own = regions.range_join(middle, held, 2 * width, closed=True).groupBy("case_id", "phone_index").agg(F.min("word_index").alias("owner"))
    within = F.row_number().over(Window.partitionBy("case_id", "owner").orderBy("phone_index")) - 1
    return phones.join(own, ["case_id", "phone_index"]).withColumn("index_in_word", within.cast("long"))


def locate_phones(planned: DataFrame, owned: DataFrame) -> DataFrame:
    """planned (case_id, word_index, source_phone, source_index, ...) with located (index in word, -1: none) and reason. The
    phone of that index, exact or with another label; else the first of the label; for rows that name neither the word's
    first. A word's phones are one short list, so one join does for all steps."""
    base = F.regexp_replace("label", "[0-9]$", "")
    lists = owned.groupBy("case_id", F.col("owner").alias("word_index")).agg(F.array_sort(F.collect_list(F.struct(F.col("index_in_word").alias("i"), base.alias("base")))).alias("_own"))
    rows = planned.join(lists, ["case_id", "word_index"], "left")
    source, at = F.coalesce("source_phone", F.lit("")), F.coalesce("source_index", F.lit(-1))
    one = lambda test: F.get(F.filter("_own", test), F.lit(0))
    indexed, labelled = one(lambda p: p["i"] == at), one(lambda p: p["base"] == source)
    reason = (
        F.when(F.col("_own").isNotNull() & (at < 0) & (source == ""), "synthetic_word_fallback").when(indexed.isNotNull() & ((indexed["base"] == source) | (source == "")), "mfa_exact_source_phone_index")
        .when(indexed.isNotNull(), "mfa_source_phone_index_label_mismatch").when(labelled.isNotNull(), "mfa_source_phone_label_fallback").otherwise("no_phone_evidence")
    )
    located = F.when(F.col("reason") == "synthetic_word_fallback", F.lit(0)).when(F.col("reason") == "mfa_source_phone_label_fallback", labelled["i"]).when(F.col("reason") != "no_phone_evidence", indexed["i"]).otherwise(F.lit(-1))
    return rows.withColumn("reason", reason).withColumn("located", located.cast("long")).drop("_own")


def active_regions(windows: DataFrame, size: int, hold: int, least: int, lead: int, trail: int, merge: int) -> DataFrame:
    """case_id, region, start, end from windows (case_id, i from 0, active, n: the case's number of them) of one size. A
    region ends at the first of `hold` quiet windows in a row, or with the case; those shorter than `least` windows go,
    the rest are padded within the case, and merged where `merge` or less lies between."""
    w = Window.partitionBy("case_id").orderBy("i")
    before = F.lag("i").over(w)
    on = windows.where("active").withColumn("_b", before)
    on = on.withColumn("_r", F.sum((F.col("_b").isNull() | (F.col("i") - F.col("_b") > hold)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    raw = on.groupBy("case_id", "_r").agg((F.min("i") * size).alias("s"), F.max("i").alias("last"), F.first("n").alias("n"))
    until = F.when(F.col("n") - 1 - F.col("last") >= hold, F.greatest(F.col("s") + least * size, (F.col("last") + 1) * size)).otherwise(F.col("n") * size)
    long_ = raw.withColumn("e", until).where(F.col("e") - F.col("s") >= least * size)
    padded = long_.select("case_id", F.greatest(F.col("s") - lead, F.lit(0)).alias("s"), F.least(F.col("e") + trail, F.col("n") * size).alias("e"))
    v = Window.partitionBy("case_id").orderBy("s", "e")
    reach = F.max("e").over(v.rowsBetween(Window.unboundedPreceding, -1))
    fresh = padded.withColumn("_m", reach).withColumn("region", F.sum((F.col("_m").isNull() | (F.col("s") > F.col("_m") + merge)).cast("int")).over(v.rowsBetween(Window.unboundedPreceding, 0)) - 1)
    return fresh.groupBy("case_id", F.col("region").cast("int").alias("region")).agg(F.min("s").alias("start"), F.max("e").alias("end"))


def quiet_spans(windows: DataFrame, size: int, least: int) -> DataFrame:
    """case_id, start, end: runs of `least` quiet windows or more."""
    w = Window.partitionBy("case_id").orderBy("i")
    off = windows.where("NOT active").withColumn("_g", F.col("i") - F.row_number().over(w))
    return off.groupBy("case_id", "_g").agg((F.min("i") * size).alias("start"), ((F.max("i") + 1) * size).alias("end"), F.count("*").alias("_n")).where(F.col("_n") >= least).select("case_id", "start", "end")
