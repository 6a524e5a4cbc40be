"""One query for each operator, over its whole table with production parameters, and SQL where SQL can express it."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from metrum.llm import chat, collocations, divergence, minhash, packing, phrases, pieces, secrets, sharding, simhash, toxicity, urlrules, vptree
from metrum.session import table

URL_RULES: list[urlrules.Rule] = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def tokenizer(name: str) -> str:
    """The file of a public tokenizer, in METRUM_TOKENIZERS or else where the package public_tokenizers has it."""
    if os.environ.get("METRUM_TOKENIZERS"):
        return os.path.join(os.environ["METRUM_TOKENIZERS"], name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan_secrets(table(spark, sf_dir, "documents")))


def op2_piece_sampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sampled ids, and whether decoding them gives the text back."""
    docs, model = table(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model")
    return pieces.encode_checked(docs, model)


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.components(table(spark, sf_dir, "documents")).select("doc_id", simhash.fingerprint_hex(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sharding.assign(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op7_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    trap = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit("\\### Assistant: </turn> ok").alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(trap)
    return chat.digest(chat.format_chats(rows))


def op8_phrase_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.compare_with_next(table(spark, sf_dir, "documents"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return vptree.nearest(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(table(spark, sf_dir, "pages"), URL_RULES)


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.components(table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(table(spark, sf_dir, "documents"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_secret_scans, op2_piece_sampling, op3_best_fit_packing, op4_simhash, op5_sharding, op6_toxicity, op7_chat_format, op8_phrase_fingerprints, op9_nearest, op10_url_filter, op11_minhash, op12_source_divergence, op13_collocations)
}

KIND_PATTERNS = [
    r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "AKIA[A-Z0-9]+",
    "[0-9a-f]{16,}",  # runs are whole, so those of 16 or more are these
    "[A-Za-z0-9+/_=-]{20,}",
]


def _matches_sql(kind: int) -> str:
    """Every match of a kind with its place: the texts between matches and the matches before it sum up to its start."""
    p = KIND_PATTERNS[kind]
    return f"""
        SELECT row_, {kind} AS kind, k, list_sum(list_transform(gaps[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(hits[1:k-1], lambda x: length(x))), 0) AS start_, hits[k] AS hit
        FROM (SELECT row_, regexp_extract_all(body, '{p}') AS hits, string_split_regex(body, '{p}') AS gaps, unnest(range(1, len(regexp_extract_all(body, '{p}')) + 1)) AS k FROM d)"""


SECRETS_SQL = f"""
    WITH d AS (SELECT row_number() OVER () AS row_, doc_id, coalesce(text, '') AS body, coalesce(source, '') AS owner FROM documents),
    every AS ({" UNION ALL ".join(map(_matches_sql, range(4)))}),
    valued AS (SELECT row_, kind, CAST(start_ AS BIGINT) AS start_, CAST(start_ + length(hit) AS BIGINT) AS end_, CASE kind WHEN 0 THEN regexp_extract(hit, '{KIND_PATTERNS[0]}', 2) ELSE hit END AS value FROM every),
    base AS (SELECT * FROM valued WHERE kind < 3 AND length(value) >= CASE kind WHEN 0 THEN 12 WHEN 1 THEN 18 ELSE 16 END),
    mixed AS (SELECT * FROM valued t WHERE kind = 3 AND regexp_matches(value, '[0-9]') AND regexp_matches(value, '[A-Z]') AND regexp_matches(value, '[a-z]') AND NOT regexp_matches(value, '[a-z]{{9}}')
              AND NOT EXISTS (SELECT 1 FROM base b WHERE b.row_ = t.row_ AND b.start_ < t.end_ AND t.start_ < b.end_)),
    letters AS (SELECT value, n, count(*) / CAST(n AS DOUBLE) AS p FROM (SELECT DISTINCT value, length(value) AS n, generate_subscripts(string_split(value, ''), 1) AS i, unnest(string_split(value, '')) AS c FROM (SELECT DISTINCT value FROM mixed)) GROUP BY value, n, c),
    random_ AS (SELECT value FROM letters GROUP BY value HAVING -sum(p * log2(p)) >= 3.5),
    found AS (SELECT * FROM base UNION ALL SELECT m.* FROM mixed m JOIN random_ r ON m.value = r.value),
    counted AS (SELECT value, count(DISTINCT body) AS repositories, count(DISTINCT owner) AS owners FROM found JOIN d ON d.row_ = found.row_ GROUP BY value),
    told AS (SELECT f.*, c.owners, NOT (c.owners >= 3 OR c.owners >= 2 AND c.repositories >= 25) AS live FROM found f JOIN counted c ON c.value = f.value WHERE f.kind < 3 OR NOT (c.owners >= 3 OR c.owners >= 2 AND c.repositories >= 25)),
    named AS (SELECT *, ['assign', 'access', 'hex', 'live'][kind + 1] || ':' || start_ || ':' || end_ AS span FROM told)
    SELECT d.doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
           sha256(coalesce(string_agg(CASE WHEN kind < 3 THEN span END, ',' ORDER BY start_, kind), '')) AS base_sha256,
           coalesce(string_agg(span, ',' ORDER BY start_, kind), '') AS spans,
           count(*) FILTER (live) AS n_live_looking, count(*) FILTER (NOT live) AS n_example, coalesce(max(owners), 0) AS most_owners
    FROM d LEFT JOIN named n ON n.row_ = d.row_ GROUP BY d.row_, d.doc_id
"""

# CRC-32 by its definition: a table of 256 remainders, and one step a byte.
SHARDS_SQL = """
    WITH remainders AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(CAST(n AS BIGINT), CAST(range(8) AS BIGINT[])), lambda c, b: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS r),
    sized AS (
        SELECT doc_id, coalesce(text, '') AS body, strlen(coalesce(text, '')) + 1 AS size,
               CAST('0x' || substr(md5(coalesce(text, '')), 1, 15) AS BIGINT) AS major,
               coalesce(doc_id, -9223372036854775808) AS minor
        FROM documents),
    sums AS (
        SELECT body, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(regexp_extract_all(hex(encode(body)), '..'), lambda x: CAST(CAST('0x' || x AS INTEGER) AS BIGINT))),
                                     lambda c, b: xor(c >> 8, r[(xor(c, b) & 255) + 1])), 4294967295) AS crc
        FROM (SELECT DISTINCT body FROM sized), remainders),
    totals AS (SELECT sum(size) AS total FROM sized),
    placed AS (
        SELECT doc_id, s.body, size, crc, major, minor,
               CAST(((sum(size) OVER (ORDER BY major, minor RANGE UNBOUNDED PRECEDING)
                      - sum(size) OVER (PARTITION BY major, minor)) * 8) // total AS INTEGER) AS shard
        FROM sized s JOIN sums ON sums.body = s.body, totals)
    SELECT doc_id, size, crc AS text_crc32, 'bytes' AS law, shard,
           row_number() OVER (PARTITION BY shard ORDER BY major, minor, size) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
    FROM placed
"""

NEAREST_SQL = """
    WITH good AS (
        SELECT DISTINCT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
        WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
    width AS (SELECT len(v) AS n FROM good GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
    used AS (SELECT vec_id, v FROM good, width WHERE len(v) = n),
    scored AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v) AS score FROM used q JOIN used c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)
    SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
    QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) <= 20
"""

# All pairs that share a shingle; components by reachability.
MINHASH_SQL = r"""
    WITH RECURSIVE d AS (SELECT row_number() OVER () AS row_, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    sh AS (SELECT DISTINCT row_, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT row_, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM d WHERE len(w) > 0)),
    n AS (SELECT row_, count(*) AS n FROM sh GROUP BY row_),
    met AS (SELECT a.row_ AS u, b.row_ AS v, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.row_ < b.row_ GROUP BY 1, 2),
    e AS (SELECT u, v FROM met JOIN n nu ON nu.row_ = u JOIN n nv ON nv.row_ = v WHERE 100 * c >= 85 * (nu.n + nv.n - c)),
    both_ AS (SELECT u, v FROM e UNION ALL SELECT v, u FROM e),
    reach AS (SELECT row_ AS a, row_ AS b FROM d UNION SELECT a, v FROM reach JOIN both_ ON u = b),
    least_ AS (SELECT a, min(doc_id) AS component_id FROM reach JOIN d ON d.row_ = b GROUP BY a)
    SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, component_id, d.doc_id IS NOT DISTINCT FROM component_id AS kept FROM d JOIN least_ ON a = d.row_ LEFT JOIN n ON n.row_ = d.row_
"""

DIVERGENCE_SQL = r"""
    WITH d AS (SELECT row_number() OVER () AS row_, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                      regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ts FROM documents),
    t AS (SELECT row_, lang, source, unnest(ts) AS term FROM d),
    kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row_) >= 30),
    langs AS (SELECT lang, sum(n) AS n, count(*) AS v FROM kept GROUP BY lang),
    c AS (SELECT t.lang, t.source, t.term, count(*) AS n FROM t JOIN kept k ON k.lang = t.lang AND k.term = t.term GROUP BY ALL),
    g AS (SELECT d.lang, d.source, coalesce(any_value(s.n), 0) AS n FROM (SELECT DISTINCT lang, source FROM d) d LEFT JOIN (SELECT lang, source, sum(n) AS n FROM c GROUP BY ALL) s ON s.lang = d.lang AND s.source = d.source GROUP BY ALL),
    p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.n + 5 * l.v)::HUGEINT AS p, 1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n + 5 * l.v)::HUGEINT AS q
          FROM g JOIN kept k ON k.lang = g.lang JOIN langs l ON l.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
    sums AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM p a JOIN p b ON b.lang = a.lang AND b.term = a.term AND b.source <> a.source GROUP BY ALL),
    pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON b.lang = a.lang AND b.source <> a.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source),
    every AS (SELECT * FROM pairs UNION ALL SELECT lang, source, 'term', term, CAST(p - q AS BIGINT) FROM p WHERE n > 0 AND p > q)
    SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM every
    QUALIFY part = 'pair' OR rank <= 50
"""

COLLOCATIONS_SQL = r"""
    WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
    g AS (SELECT lang, m, array_to_string(w[k:k + m - 1], ' ') AS phrase FROM (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS k FROM w, (SELECT unnest(range(1, 6)) AS m) WHERE len(w) >= m)),
    n AS (SELECT lang, count(*) AS n FROM g WHERE m = 1 GROUP BY lang),
    f AS (SELECT lang, m, phrase, count(*) AS a FROM g GROUP BY ALL HAVING count(*) >= 100),
    cut AS (SELECT lang, m, phrase, a, k, array_to_string(string_split(phrase, ' ')[1:k], ' ') AS first_, array_to_string(string_split(phrase, ' ')[k + 1:], ' ') AS rest_ FROM (SELECT *, unnest(range(1, m)) AS k FROM f WHERE m > 1)),
    scored AS (SELECT c.lang, c.m, c.phrase, c.a, c.k, l.a AS l, r.a AS r, n.n, CAST((1000::HUGEINT * c.a * n.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score
               FROM cut c JOIN n ON n.lang = c.lang JOIN f l ON l.lang = c.lang AND l.phrase = c.first_ JOIN f r ON r.lang = c.lang AND r.phrase = c.rest_),
    best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
    left_ AS (SELECT * FROM best b WHERE NOT EXISTS (SELECT 1 FROM f WHERE f.lang = b.lang AND f.m > b.m AND 100 * f.a >= 100 * b.a AND contains(' ' || f.phrase || ' ', ' ' || b.phrase || ' ')))
    SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM left_ QUALIFY rank <= 2000
"""

# XXH64, tokenizers, trained scores, mined rules and phrase sets are beyond DuckDB's SQL, so the other six queries are held
# against brute force in tests/llm.
ORACLES: dict[str, str] = {
    "op1_secret_scans": SECRETS_SQL,
    "op5_sharding": SHARDS_SQL,
    "op9_nearest": NEAREST_SQL,
    "op11_minhash": MINHASH_SQL,
    "op12_source_divergence": DIVERGENCE_SQL,
    "op13_collocations": COLLOCATIONS_SQL,
    "op7_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
        shown AS (
            SELECT *, CASE role WHEN 'system' THEN 6 WHEN 'user' THEN 4 WHEN 'assistant' THEN 9 WHEN 'tool' THEN 4
                        ELSE 5 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) END
                   + 4 + 2 + length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) + 8 AS chars
            FROM said)
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
               sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn NULLS FIRST, role, text)) AS loss_sha256,
               CAST(sum(chars) AS BIGINT) AS formatted_chars,
               regexp_full_match(string_agg(role, ',' ORDER BY turn NULLS FIRST, role, text), '(system,)?user,assistant(,(user|tool),assistant)*') AS valid
        FROM shown GROUP BY conv_id
    """,
}
