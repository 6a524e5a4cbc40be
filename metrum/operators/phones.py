"""Phones of words that no dictionary has, and what phones look and count like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Letter names, grapheme phones (longer ones first), single letters, poses and strengths by phone.
LETTER_NAMES = {
    "a": "EY1", "b": "B IY1", "c": "S IY1", "d": "D IY1", "e": "IY1", "f": "EH1 F", "g": "JH IY1", "h": "EY1 CH", "i": "AY1", "j": "JH EY1", "k": "K EY1", "l": "EH1 L", "m": "EH1 M",
    "n": "EH1 N", "o": "OW1", "p": "P IY1", "q": "K Y UW1", "r": "AA1 R", "s": "EH1 S", "t": "T IY1", "u": "Y UW1", "v": "V IY1", "w": "D AH1 B AH0 L Y UW0", "x": "EH1 K S", "y": "W AY1", "z": "Z IY1",
}
GRAPHEMES = {
    "ough": "AO1", "eigh": "EY1", "tion": "SH AH0 N", "sion": "ZH AH0 N", "ch": "CH", "sh": "SH", "th": "TH", "ph": "F", "wh": "W", "ng": "NG", "qu": "K W", "ck": "K", "ee": "IY1", "ea": "IY1",
    "ai": "EY1", "ay": "EY1", "oa": "OW1", "ow": "AW1", "oo": "UW1", "ou": "AW1", "oi": "OY1", "oy": "OY1", "er": "ER0", "ar": "AA1 R", "or": "AO1 R", "ir": "ER1", "ur": "ER1",
}
SINGLE = {
    "a": "AH0", "b": "B", "c": "K", "d": "D", "e": "EH1", "f": "F", "g": "G", "h": "HH", "i": "IH1", "j": "JH", "k": "K", "l": "L", "m": "M",
    "n": "N", "o": "OW1", "p": "P", "q": "K", "r": "R", "s": "S", "t": "T", "u": "AH0", "v": "V", "w": "W", "x": "K S", "y": "IY0", "z": "Z",
}
SOFT = {"c": "S", "g": "JH"}
VOWELS = ("AA", "AE", "AH", "AO", "AW", "AY", "EH", "ER", "EY", "IH", "IY", "OW", "OY", "UH", "UW")
POSES = [
    ("M B P", "22_MBP", 1.00), ("F V", "20_FV", 0.96), ("W", "12_Ww-Oo-", 0.88), ("R", "17_Rr", 0.78), ("S Z", "21_FV-Ee-", 0.42), ("TH DH", "24_Tongue_Th", 0.82), ("T D", "01_TDS-Ah-", 0.40), ("L N", "23_Tongue_LNTDS", 0.46),
    ("K G", "13_KGY_TDS", 0.34), ("Y", "02_TDS_KGY-Ee-", 0.40), ("CH JH SH ZH", "14_ChJjSh", 0.42), ("HH", "08_Ah", 0.52), ("AY", "05_Ay", None), ("AW AA", "07_Aa", None), ("AE", "08_Ah", None), ("AH UH", "18_Uh", None),
    ("ER", "10_Or", None), ("EH EY", "06_Eh", None), ("IH", "04_Ih", None), ("IY", "03_Ee", None), ("AO OW OY", "09_Oh", None), ("UW", "11_Oo", None),
]
VOWEL_STRENGTH = 0.78


def _table(values: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for kv in values.items() for x in kv))


def spell_out(word: Column) -> Column:
    """Phones of an unknown word as a list; null below two letters. Words of up to five letters without a, e, i, o, u are
    spelled by letter names. Others go left to right by graphemes, of which the listed ones come before single letters;
    c and g are soft before e, i and y; a word without a vowel phone gets AH0 at its end."""
    letters = F.regexp_replace(F.lower(word), "[^a-z]", "")
    cut = F.regexp_replace(letters, "(" + "|".join(GRAPHEMES) + "|[a-z])", "$1 ")
    soft = F.regexp_replace(F.regexp_replace(cut, r"(?<![a-z])c (?=[eiy])", "C "), r"(?<![a-z])g (?=[eiy])", "G ")
    parts = F.split(F.rtrim(soft), " ")
    known = _table(GRAPHEMES | SINGLE | {k.upper(): v for k, v in SOFT.items()})
    by_part = F.flatten(F.transform(parts, lambda p: F.split(known[p], " ")))
    voiced = F.exists(by_part, lambda p: base(p).isin(*VOWELS))
    named = F.flatten(F.transform(F.filter(F.split(letters, ""), lambda x: x != ""), lambda x: F.split(_table(LETTER_NAMES)[x], " ")))
    n = F.length(letters)
    return F.when(n < 2, F.lit(None).cast("array<string>")).when((n <= 5) & ~letters.rlike("[aeiou]"), named).otherwise(F.when(voiced, by_part).otherwise(F.array_append(by_part, F.lit("AH0"))))


def base(phone: Column) -> Column:
    return F.translate(phone, "0123456789", "")


def is_shown(phone: Column) -> Column:
    """Whether poses() has a rule for it."""
    return F.coalesce(base(phone).isin(*(p for group, _, _ in POSES for p in group.split())), F.lit(False))


def stress(phone: Column) -> Column:
    """1 or 2 from the last digit, else 0."""
    return F.coalesce(F.regexp_extract(phone, "([12])$", 1).try_cast("int"), F.lit(0))


def syllables(phones: Column) -> Column:
    """Vowel phones, at least 1."""
    return F.greatest(F.size(F.filter(phones, lambda p: base(p).isin(*VOWELS))), F.lit(1))


def poses(rows: DataFrame) -> DataFrame:
    """rows (word, phone) with pose and strength; the word `to` rounds its AH and IH. Phones without a rule have nulls."""
    table = [(p, pose, float(s if s is not None else VOWEL_STRENGTH)) for group, pose, s in POSES for p in group.split()]
    rules = rows.sparkSession.createDataFrame(table, "_base string, pose string, strength double")
    joined = rows.withColumn("_base", base(F.col("phone"))).join(F.broadcast(rules), "_base", "left")
    to = (F.col("word") == "to") & F.col("_base").isin("AH", "IH")
    return joined.withColumn("pose", F.when(to, "11_Oo").otherwise(F.col("pose"))).drop("_base")


def plan_units(n_syllables: Column, n_phones: Column) -> Column:
    """Units of a word in the text's plan: syllables and a third of the phones (1 to 3), between 2 and 6."""
    third = F.least(F.greatest(F.floor(n_phones / 3), F.lit(1)), F.lit(3))
    return F.least(F.greatest(n_syllables + third, F.lit(2)), F.lit(6))
