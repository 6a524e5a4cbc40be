"""Queries that take the whole table, against brute force or SQL without any subset."""

import re
from collections import defaultdict

from metrum.plans import catalogue
from metrum.session import table
from metrum.sources import files
from tests.oracle import differences

SF = "/root/testdata/sf0.001"


def test_manifest_of_every_customer(spark):
    df = catalogue.QUERIES["manifest_completeness"](spark, SF)
    assert differences(df, catalogue.ORACLES["manifest_completeness"], SF) == "" and any(r.custkey % 3 == 0 for r in df.collect())


def lcs_length(a: list[str], b: list[str]) -> int:
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


def test_every_turn_is_aligned_with_the_next(spark, tmp_path):
    # Turn 3 is missing, turn 2 has two rows, one text is null.
    rows = [(1, 0, "user", "a b c d"), (1, 1, "bot", "b d a"), (1, 2, "user", "x a"), (1, 2, "bot", "d a x"), (1, 4, "bot", "a x"), (2, 0, "user", "a"), (3, 0, "user", None), (3, 1, "bot", "a b")]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    for sf in (str(tmp_path), SF):
        said = defaultdict(list)
        for r in sorted(table(spark, sf, "conversations").collect(), key=lambda r: (r.conv_id, r.turn, r.role or "", r.text or "")):
            said[r.conv_id, r.turn] += re.findall("[a-z0-9']+", (r.text or "").lower())
        keys = sorted(said)
        want = {(*p, q[1]): lcs_length(said[p], said[q]) for p, q in zip(keys, keys[1:], strict=False) if p[0] == q[0]}
        got = defaultdict(list)
        for r in catalogue.QUERIES["lcs_alignment"](spark, sf).collect():
            got[r.case_id, r.turn, r.next_turn].append((r.planned, r.gold))
        assert {k: len(v) for k, v in got.items()} == {k: n for k, n in want.items() if n}
        for (conv, turn, after), pairs in got.items():
            pairs.sort()
            assert all(said[conv, turn][i] == said[conv, after][j] for i, j in pairs)
            assert all(i < k and j < m for (i, j), (k, m) in zip(pairs, pairs[1:], strict=False))
    assert any(turn > 0 for _, turn, _ in got)


UNITS = "zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen".split()
TENS = ". . twenty thirty forty fifty sixty seventy eighty ninety".split()


def spoken(n: int) -> str:
    if n < 20:
        return UNITS[n]
    if n < 100:
        return TENS[n // 10] + (" " + UNITS[n % 10] if n % 10 else "")
    step, name = (100, "hundred") if n < 1000 else (1000, "thousand")
    return f"{spoken(n // step)} {name}" + (" " + spoken(n % step) if n % step else "")


def test_numbers_are_whole_tokens(spark, tmp_path):
    text = "In the 1980s, 12,345 of 1234567 (4111111111111111) rose by 3.14; 0980s, 1985s, 1990S, 007, mail2 and 999,999 or 1,000,000. No number here."
    spark.createDataFrame([(1, text), (2, None), (3, "8" * 50_000 + " 5")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.token: r.words for r in catalogue.QUERIES["number_expansion"](spark, str(tmp_path)).collect()}
    assert got == {
        "1980s": "nineteen eighties", "12,345": "twelve thousand three hundred forty five", "1234567": "1234567", "4111111111111111": "4111111111111111", "3.14": "3.14", "0980s": "0980s", "1985s": "1985s", "1990S": "nineteen nineties",
        "007": "seven", "mail2": "mail2", "999,999": "nine hundred ninety nine thousand nine hundred ninety nine", "1,000,000": "1,000,000", "8" * 50_000: "8" * 50_000, "5": "five",
    }
    tokens = {t for r in table(spark, SF, "documents").collect() for t in re.findall(r"[A-Za-z0-9'](?:[A-Za-z0-9']|(?<=[0-9])[,.](?=[0-9]))*", r.text or "") if re.search("[0-9]", t)}
    rows = catalogue.QUERIES["number_expansion"](spark, SF).collect()
    assert len(rows) == len(tokens)
    plain = lambda t: t.replace(",", "")
    assert {r.token: r.words for r in rows} == {t: spoken(int(plain(t))) if re.fullmatch("[0-9]{1,9}", plain(t)) and int(plain(t)) < 1_000_000 else t for t in tokens}


def test_textgrid_of_many_tiers(spark, tmp_path):
    tiers = "".join(f' item [{i}]:\n  name = "t{i}"\n  intervals [1]:\n   xmin = 0\n   xmax = 1\n   text = "x"\n' for i in range(1, 1203))
    (tmp_path / "a.TextGrid").write_text("item []:\n" + tiers)
    (tmp_path / "b.TextGrid").write_text("no tiers")
    assert {r.tier for r in files.read_textgrid(spark, str(tmp_path / "*.TextGrid")).collect()} == {f"t{i}" for i in range(1, 1203)}
