"""Readers and writers of the file formats that corpora of recordings use.

Every reader lists a folder or pattern and works on all files in parallel; the case id is the file's stem. Missing
numbers are null here; the sentinels -1 and '' are put back by the writers.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Names a column may have in files of different age.
ALIASES = {"phone_index": ("phone_index", "word_phone_index"), "sentence_index": ("sentence_index", "text_sentence_index"), "region": ("speech_region_index", "region")}


def stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1)


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Quoted CSV with doubled quotes; columns by the names in each file's own first line, with the names they had before;
    absent ones are null. case_id is the file's stem."""
    return numbered_csv(spark, path, schema).drop("row")


def numbered_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """read_csv() with row, the place of a row in its file (from 0)."""
    first = spark.read.text(path).where("_metadata.file_block_start = 0").select(F.input_file_name().alias("_file"), "value", F.monotonically_increasing_id().alias("_at"))
    headers = first.groupBy("_file").agg(F.min_by("value", "_at").alias("line"))
    names = F.transform(F.split(F.regexp_replace("line", '^\ufeff|\r$|"', ""), ","), F.trim)
    headers = headers.select("_file", names.alias("_names")).cache()
    width = headers.agg(F.max(F.size("_names"))).first()[0] or 1
    cells = [f"_c{i}" for i in range(width)]
    raw = spark.read.csv(path, header=False, quote='"', escape='"', schema=", ".join(f"{c} string" for c in cells))
    raw = raw.select(F.array(*cells).alias("_cells"), F.input_file_name().alias("_file"), F.monotonically_increasing_id().alias("_at")).join(headers, "_file")
    # Data rows follow their file's first row.
    rows = raw.withColumn("row", F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 2).where("row >= 0")

    def pick(name: str, kind: str) -> Column:
        cell = lambda n: F.get("_cells", F.array_position("_names", n).cast("int") - 1)
        return F.coalesce(*map(cell, ALIASES.get(name, (name,)))).try_cast(kind).alias(name)

    return rows.select(stem(F.col("_file")).alias("case_id"), "row", *(pick(n, k) for n, k in (x.split() for x in schema.split(","))))


#: Gold tables; a column that a file lacks is null.
PHONES = "start double, end double, phone string, word string, confidence double, word_index int, region int, phone_index int, sentence_index int, alignment_reason string"
WORDS = "word_index int, word string, start double, end double, region int, sentence_index int"
REGIONS = "index int, start double, end double, word_start_index int, word_end_index int, source string"


def read_phones(spark: SparkSession, path: str) -> DataFrame:
    """Gold phones; where phone_index is missing it is the row's place in its file."""
    return numbered_csv(spark, path, PHONES).withColumn("phone_index", F.coalesce("phone_index", "row")).drop("row")


def read_words(spark: SparkSession, path: str) -> DataFrame:
    return numbered_csv(spark, path, WORDS).withColumn("word_index", F.coalesce("word_index", "row")).drop("row")


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return numbered_csv(spark, path, REGIONS).withColumn("index", F.coalesce("index", "row")).drop("row")


def write_csv(df: DataFrame, path: str, sentinels: bool = True) -> None:
    """CSV with a header; null numbers as -1 and null strings as '' where sentinels are wanted."""
    if sentinels:
        df = df.select(*(F.coalesce(F.col(c), F.lit(-1).cast(t) if t in ("int", "bigint", "float", "double") else F.lit("").cast(t)).alias(c) if t in ("int", "bigint", "float", "double", "string") else F.col(c) for c, t in df.dtypes))
    df.write.csv(path, header=True, quote='"', escape='"', mode="overwrite", emptyValue="")


# The columns of the tables that are exported, in order.
SINKS = {
    "visemes": "start double, end double, pose string, phone string, word string, confidence double, word_index int, speech_region_index int, sentence_index int, source_phone string, source_phone_index int, alignment_reason string",
    "phones": "start double, end double, phone string, word string, confidence double, word_index int, speech_region_index int, phone_index int, sentence_index int, alignment_reason string",
    "words": "word_index int, word string, start double, end double, speech_region_index int, sentence_index int",
    "speech": "index int, start double, end double, word_start_index int, word_end_index int, source string",
    "boundaries": "word_index int, word string, next_word_index int, next_word string, mark string, mark_sequence string, pause_class string, split_applied int, split_reason string, direct_word_gap_seconds double, phone_gap_seconds double, wave_silence_seconds double, acoustic_gap_seconds double, speech_region_index_before int, speech_region_index_after int",
    "planned": "index int, pose string, word string, word_index int, text_sentence_index int, text_center_norm double, strength double, source_phone string, lexical_stress int, source_phone_index int, visual_role string, renderable int, generator string",
    "regions": "index int, start double, end double, last_speech double, started int, ended int, provisional_end double, end_decision string, reopen_count int, end_reason string",
    "word_onsets": "word_index int, word string, gold_word_start double, gold_word_end double, first_gold_pose string, first_gold_start double, first_event_pose string, first_event_start double, detected_word_start double, detected_word_start_mapped double, error_ms double, missing_event int",
}


def write_sink(df: DataFrame, kind: str, path: str) -> None:
    """One of the exported tables as CSV, a folder for each case_id: its columns in order and of its types, absent ones as
    sentinels, flags as 0 and 1, rows in the order of their first column."""
    columns = [x.split() for x in SINKS[kind].split(", ")]
    kinds = dict(df.dtypes)
    pick = lambda n, t: (F.col(n).cast("int").cast(t) if kinds.get(n) == "boolean" else F.col(n).cast(t)) if n in kinds else F.lit(None).cast(t)
    blank = lambda t: F.lit("" if t == "string" else -1).cast(t)
    rows = df.select("case_id", *(F.coalesce(pick(n, t), blank(t)).alias(n) for n, t in columns))
    rows.repartition("case_id").sortWithinPartitions("case_id", columns[0][0]).write.partitionBy("case_id").csv(path, header=True, quote='"', escape='"', mode="overwrite", emptyValue="")


def write_json(df: DataFrame, path: str) -> None:
    """Rows as JSON lines; nulls are left out."""
    df.write.json(path, mode="overwrite")


def read_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON documents, one a line or over many lines; fields that a document lacks are null."""
    return spark.read.json(path, schema=schema, multiLine=True) if path.endswith(".json") else spark.read.json(path, schema=schema)


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, text): whole files, without a byte order mark, trimmed."""
    return spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("case_id"), F.trim(F.regexp_replace("value", "^﻿", "")).alias("text"))


def manifest(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A manifest of string columns with `ok`: no column empty, and the transcript's stem equal to case_id."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"`{c}` string" for c in columns), enforceSchema=False)
    full = F.lit(True)
    for c in columns:
        full = full & F.col(c).isNotNull() & (F.col(c) != "")
    return rows.withColumn("ok", full & (stem(F.col("transcript")) == F.col("case_id")))


def parse_wav(content: bytes) -> tuple[int, int, np.ndarray] | None:
    """(rate, channels, samples by frame and channel) of PCM16; chunks of odd size are padded; None for anything else."""
    if content[:4] != b"RIFF" or content[8:12] != b"WAVE":
        return None
    at, head, data = 12, None, None
    while at + 8 <= len(content):
        name, size = content[at : at + 4], struct.unpack("<I", content[at + 4 : at + 8])[0]
        body = content[at + 8 : at + 8 + size]
        if name == b"fmt " and len(body) >= 16:
            head = struct.unpack("<HHIIHH", body[:16])
        elif name == b"data":
            data = body
        at += 8 + size + size % 2
    if head is None or data is None or head[0] != 1 or head[5] != 16 or not head[1]:
        return None
    x = np.frombuffer(data[: len(data) // (2 * head[1]) * 2 * head[1]], "<i2").reshape(-1, head[1])
    return head[2], head[1], x


def read_wav(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, sha256, rate, channels, frames, seconds, samples: mono floats in [-1, 1)); nulls if it is not PCM16."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [parse_wav(c) for c in b.column("content").to_pylist()]
            pick = lambda f: [None if g is None else f(g) for g in got]
            yield pa.RecordBatch.from_arrays(
                [
                    b.column("case_id"), b.column("sha256"), pa.array(pick(lambda g: g[0]), pa.int32()), pa.array(pick(lambda g: g[1]), pa.int32()), pa.array(pick(lambda g: len(g[2])), pa.int64()),
                    pa.array(pick(lambda g: len(g[2]) / g[0] if g[0] else 0.0), pa.float64()), pa.array(pick(lambda g: (g[2].mean(axis=1) / 32768.0).astype(np.float32)), pa.list_(pa.float32())),
                ],
                names=["case_id", "sha256", "rate", "channels", "frames", "seconds", "samples"],
            )

    files = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("case_id"), F.sha2("content", 256).alias("sha256"), "content")
    return files.mapInArrow(run, "case_id string, sha256 string, rate int, channels int, frames long, seconds double, samples array<float>")


def read_textgrid(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, tier, place, start, end, text) of long TextGrid files, by built-in functions: the file is cut at tiers
    and then at intervals."""
    t = spark.read.text(path, wholetext=True).select(stem(F.input_file_name()).alias("case_id"), F.regexp_replace("value", "^﻿", "").alias("v"))
    tiers = t.select("case_id", F.split("v", r"item \[[0-9]+\]:").alias("items"))
    tiers = tiers.select("case_id", F.explode(F.slice("items", F.lit(2), F.size("items"))).alias("tier"))
    named = tiers.select("case_id", F.regexp_extract("tier", r'name = "([^"]*)"', 1).alias("tier"), F.split("tier", r"intervals \[[0-9]+\]:?").alias("parts"))
    rows = named.select("case_id", "tier", F.posexplode(F.slice(F.col("parts"), F.lit(2), F.greatest(F.size("parts"), F.lit(1)))).alias("place", "i"))
    number = lambda n: F.regexp_extract("i", rf"{n} = (-?[0-9.]+(?:[eE][-+]?[0-9]+)?)", 1).try_cast("double")
    return rows.select("case_id", "tier", "place", number("xmin").alias("start"), number("xmax").alias("end"), F.replace(F.regexp_extract("i", r'text = "((?:[^"]|"")*)"', 1), F.lit('""'), F.lit('"')).alias("text"))


def read_key_values(spark: SparkSession, path: str) -> DataFrame:
    """(case_id, pairs): lines `key=value`; the first `=` parts them, the last line of a key wins. Files are UTF-16 where a
    byte order mark says so, else UTF-8; text that was UTF-8 read as Windows-1252 is put right."""
    raw = spark.read.format("binaryFile").load(path).select(stem(F.col("path")).alias("case_id"), "content")
    head = F.hex(F.substring("content", 1, 2))
    text = F.when(head.isin("FFFE", "FEFF"), F.decode("content", "UTF-16")).otherwise(F.decode("content", "UTF-8"))
    t = raw.select("case_id", F.regexp_replace(text, "^\ufeff", "").alias("v"))
    mended = F.col("v")
    for right in MANGLED:
        mended = F.replace(mended, F.lit(right.encode().decode("cp1252", "replace")), F.lit(right))
    lines = F.filter(F.split(mended, r"\r?\n"), lambda x: F.instr(x, "=") > 1)
    entry = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, "=", 1)).alias("k"), F.trim(F.substring(x, F.instr(x, "=") + 1, F.length(x))).alias("v")))
    last = F.filter(entry, lambda e, i: ~F.exists(F.slice(entry, i + 2, F.size(entry)), lambda later: later["k"] == e["k"]))
    return t.select("case_id", F.map_from_entries(last).alias("pairs"))


#: Characters that come mangled when UTF-8 is read as Windows-1252.
MANGLED = "’‘“–—…é"


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(word, variant, phones): comments `;;;` and `#` go, `(n)` marks are dropped, leading probabilities are dropped,
    equal phones of a word come once, in the order of the file."""
    lines = spark.read.text(path).withColumn("at", F.monotonically_increasing_id()).where(~F.col("value").rlike(r"^\s*(;;;|#)") & (F.trim("value") != ""))
    parts = F.split(F.trim("value"), r"\s+")
    word = F.regexp_replace(F.lower(F.get(parts, F.lit(0))), r"\([0-9]+\)$", "")
    rest = F.slice(parts, F.lit(2), F.size(parts))
    phones = F.filter(rest, lambda p, i: ~(p.rlike(r"^[0-9]*\.?[0-9]+$") & F.forall(F.slice(rest, F.lit(1), i + 1), lambda q: q.rlike(r"^[0-9]*\.?[0-9]+$"))))
    each = lines.select(word.alias("word"), F.array_join(phones, " ").alias("phones"), "at").groupBy("word", "phones").agg(F.min("at").alias("at"))
    return each.select("word", (F.row_number().over(Window.partitionBy("word").orderBy("at")) - 1).alias("variant"), "phones")


def preferred_file(files: DataFrame) -> DataFrame:
    """(folder, path): of each folder's files the first `tts_line_*`, else the first, by name without case."""
    name = F.lower(F.regexp_extract("path", r"([^/]+)$", 1))
    return files.groupBy(F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("folder")).agg(F.min_by("path", F.struct(~name.startswith("tts_line_"), name)).alias("path"))


def numbered_cases(rows: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """rows with case_id `case_0001` and so on in the given order. The list of new cases is a report of bounded size."""
    return rows.withColumn("case_id", F.format_string("case_%04d", F.row_number().over(Window.orderBy(*order)) + (first - 1)))


def metadata_manifest(spark: SparkSession, root: str) -> DataFrame:
    """The manifest made anew from root/*/metadata.json: case_id (the folder's name where it is missing), approval,
    review_layers and summary as JSON (`{}` where missing), reviewer ('' where missing) and path, the folder. A file that is
    no JSON object has all defaults."""
    files = spark.read.format("binaryFile").load(f"{root.rstrip('/')}/*/metadata.json").select(F.regexp_replace(F.decode("content", "UTF-8"), "^\ufeff", "").alias("v"), F.regexp_extract("path", r"^(.*)/[^/]*$", 1).alias("path"))
    field = lambda name: F.get_json_object("v", f"$.{name}")
    name = F.regexp_extract("path", r"([^/]+)$", 1)
    return files.select(F.coalesce(field("case_id"), name).alias("case_id"), *(F.coalesce(field(c), F.lit(d)).alias(c) for c, d in (("approval", "{}"), ("review_layers", "{}"), ("reviewer", ""), ("summary", "{}"))), "path")


def import_plan(wanted: DataFrame, found: DataFrame, kept: DataFrame) -> DataFrame:
    """wanted (case_id, transcript, and more) with action: `missing` where found (case_id, kind) has not all of wav, grid and
    transcript for the case, else `differs` where kept (case_id, text: transcripts that are here already) has another text,
    `keep` where it has the same one, and `copy` where it has none. Texts are compared without white space at their ends;
    of several transcripts of a case all must be the same."""
    has = found.where(F.col("kind").isin("wav", "grid", "transcript")).groupBy("case_id").agg(F.count_distinct("kind").alias("_kinds"))
    plain = lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")
    texts = kept.groupBy("case_id").agg(F.min(plain(F.col("text"))).alias("_low"), F.max(plain(F.col("text"))).alias("_high"))
    rows = wanted.join(has, "case_id", "left").join(texts, "case_id", "left")
    same = (F.col("_low") == plain(F.col("transcript"))) & (F.col("_high") == plain(F.col("transcript")))
    action = F.when(F.coalesce("_kinds", F.lit(0)) < 3, "missing").when(F.col("_low").isNull(), "copy").when(same, "keep").otherwise("differs")
    return rows.select(*wanted.columns, action.alias("action"))
