"""Tokens, marks and number words, in built-in functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Marks and word lists.
HARD_MARKS = ".!?:;-–—"
CLAUSE_STARTERS = (
    "what when where why how who whom whose which can could would will did do does is are was were have has had i you we they he she it though because but so then well"
).split()
LIST_CONJUNCTIONS = ("and", "or")
UNITS = ("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen").split()
TENS = ("", "", "twenty", "thirty", "forty", "fifty", "sixty", "seventy", "eighty", "ninety")
DECADES = ("", "tens", "twenties", "thirties", "forties", "fifties", "sixties", "seventies", "eighties", "nineties")

TOKEN = r"[A-Za-z0-9'](?:[A-Za-z0-9']|(?<=[0-9])[,.](?=[0-9]))*"
TOKEN_AND_TAIL = "(" + TOKEN + ")([^A-Za-z0-9']*)"


def normalize_word(w: Column) -> Column:
    """Lower case; letters, digits and apostrophes of ASCII only."""
    return F.regexp_replace(F.lower(w), "[^a-z0-9']", "")


def text_key(text: Column) -> Column:
    """The runs of [a-z0-9'] of the lower-cased text, joined by spaces."""
    return F.array_join(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0)), " ")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9']+"), F.lit(0))


def whole_tokens(text: Column) -> Column:
    """The matches of TOKEN, however long: that pattern takes stack for each character, runs and their split do not."""
    runs = F.regexp_extract_all(text, F.lit("[A-Za-z0-9',.]+"), F.lit(0))
    return F.filter(F.flatten(F.transform(runs, lambda r: F.split(r, "[,.](?![0-9])|(?<![0-9])[,.]"))), lambda t: t != "")


def tokens_and_tails(text: Column) -> Column:
    """List of (word, tail): tokens in order, each with the separators up to the next."""
    w, t = (F.regexp_extract_all(text, F.lit(TOKEN_AND_TAIL), F.lit(i)) for i in (1, 2))
    return F.zip_with(w, t, lambda a, b: F.struct(a.alias("word"), b.alias("tail")))


def mark_of(tail: Column) -> Column:
    """The boundary mark in a tail: the last hard one, else the first comma, else empty. A hyphen counts only between
    white space."""
    clean = F.regexp_replace(tail, r"(?<!\s)-|-(?!\s)", "")
    hard = F.regexp_extract(clean, r"(?s)[.!?:;\-–—](?!.*[.!?:;\-–—])", 0)
    return F.when(hard != "", hard).otherwise(F.regexp_extract(clean, ",", 0))


def mark_class(mark: Column) -> Column:
    return (
        F.when(mark == "", "none").when(mark == ",", "comma").when(mark == ".", "period").when(mark == "!", "exclamation").when(mark == "?", "question")
        .when(mark == ":", "colon").when(mark == ";", "semicolon").when(mark.isin("-", "–", "—"), "dash").otherwise("other")
    )


def vowel_runs(w: Column) -> Column:
    """Estimated syllables: runs of vowels, at least 1."""
    return F.greatest(F.regexp_count(w, F.lit("[aeiouy]+")), F.lit(1))


def _word(table: tuple | list, n: Column) -> Column:
    return F.get(F.array(*map(F.lit, table)), n.cast("int"))


def _below_1000(n: Column) -> Column:
    hundred, rest = F.floor(n / 100), n % 100
    low = F.when(rest < 20, _word(UNITS, rest)).otherwise(F.concat_ws(" ", _word(TENS, F.floor(rest / 10)), F.when(rest % 10 > 0, _word(UNITS, rest % 10))))
    return F.concat_ws(" ", F.when(hundred > 0, F.concat(_word(UNITS, hundred), F.lit(" hundred"))), F.when((rest > 0) | (hundred == 0), low))


def cardinal(n: Column) -> Column:
    """Words of a number from 0 to 999 999; null beyond."""
    thousands, rest = F.floor(n / 1000), n % 1000
    return F.when((n >= 0) & (n < 1_000_000), F.concat_ws(" ", F.when(thousands > 0, F.concat(_below_1000(thousands), F.lit(" thousand"))), F.when((rest > 0) | (thousands == 0), _below_1000(rest))))


def expand_number(token: Column) -> Column:
    """Number tokens as words: grouping commas are dropped; `1980s` is a century and a decade (a decade without a name
    leaves the century's word alone); other tokens stay."""
    plain = F.replace(token, F.lit(","), F.lit(""))
    decade = F.regexp_extract(plain, "^([1-9][0-9]{2})0[sS]$", 1)
    named = F.trim(F.concat_ws(" ", _below_1000(F.floor(decade.cast("int") / 10)), _word(DECADES, decade.cast("int") % 10)))
    number = F.when(F.length(plain) <= 9, plain.cast("long"))
    return F.when(plain.rlike("^[0-9]{1,9}$") & (number < 1_000_000), cardinal(number)).when(decade != "", named).otherwise(token)


def sanitise(c: Column) -> Column:
    """Runs of anything but ASCII letters and digits as one underscore."""
    return F.regexp_replace(c, "[^A-Za-z0-9]+", "_")


def log_key(c: Column) -> Column:
    """Lower case, letters and digits alone."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def truth(c: Column) -> Column:
    """Whether a string says 1, true or yes, in either case; null for null."""
    return F.lower(F.trim(c)).isin("1", "true", "yes")


def number(c: Column, kind: str, default: float) -> Column:
    """A string as a number; the default where it is none."""
    return F.coalesce(F.trim(c).try_cast(kind), F.lit(default).cast(kind))
