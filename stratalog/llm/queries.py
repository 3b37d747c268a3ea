"""Registered corpus queries and their SQL: one thin opN_ query for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, ledger, licenses, neardup, reputation, rulefit, suffixtree, toolcalls, wordpiece
from .common import fold_of, table

#: Files of the public tokenizers' package, found on the executor that reads them (bpe.file_of).
WORD_BPE = "word_bpe_49k.json"
BYTE_BPE = "byte_bpe_50k.json"


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.search(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), digest.alias("items_sha256"), "contaminated")


def op5_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixtree.score(table(spark, sf_dir, "documents"), fold_of("doc_id", 10) == 0, deep=True)


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = ledger.ledger(table(spark, sf_dir, "documents"))
    return led.select(
        "doc_id",
        *("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"),
        (~ledger.passes(ledger.BASE)).alias("base_failed"),
        ledger.passes(ledger.CURRENT).alias("kept"),
        "fail_bits",
    )


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = rulefit.train(docs, table(spark, sf_dir, "labels"))
    scored = rulefit.score(docs, model)
    return scored.select("doc_id", (fold_of("doc_id", 3) == 1).alias("held_out"), "score", "predicted")


def op3_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = toolcalls.from_turns(table(spark, sf_dir, "conversations"))
    return toolcalls.link(calls, results, toolcalls.TURN_SCHEMAS)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.groups(table(spark, sf_dir, "documents"))


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labels(table(spark, sf_dir, "documents"))


def op8_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reputation.judge(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels")).drop("bound")


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wordpiece.token_counts(table(spark, sf_dir, "documents"), BYTE_BPE)


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(table(spark, sf_dir, "documents"), WORD_BPE, digest=True)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_tool_calls": op3_tool_calls,
    "op4_near_duplicates": op4_near_duplicates,
    "op5_suffix_tree": op5_suffix_tree,
    "op6_quality_rules": op6_quality_rules,
    "op7_license_scan": op7_license_scan,
    "op8_url_filter": op8_url_filter,
    "op9_token_counts": op9_token_counts,
    "op10_bpe": op10_bpe,
}

#: DuckDB: lower-cases A-Z only.
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
#: DuckDB: words without ASCII punctuation and white space.
_ALNUM_WORDS = r"list_filter(regexp_split_to_array(" + _LOWER.format("coalesce(text, '')") + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
_TEMPLATES = ", ".join(f"({i}, '{t.label}', {t.base}, string_split('{t.text}', ' '))" for i, t in enumerate(licenses.TEMPLATES))

ORACLE: dict[str, str] = {
    "op1_decontamination": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_ALNUM_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_ALNUM_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
bw AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT item_id, w, least(len(w), 13) AS k, unnest(generate_series(1, greatest(len(w) - 12, 1))) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM bw),
dw AS (SELECT row, i, k, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT row, w, k, unnest(generate_series(1, len(w) - k + 1)) AS i FROM d, ks WHERE len(w) >= k)),
h AS (SELECT row, i, k, item_id FROM dw JOIN bw USING (k, g)),
hit AS (SELECT row, count(DISTINCT p) AS n_hit FROM (SELECT row, unnest(generate_series(i, i + k - 1)) AS p FROM h) GROUP BY row),
it AS (SELECT row, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit > 0 AND 20 * n_hit >= len(w), false) AS contaminated
FROM d LEFT JOIN hit USING (row) LEFT JOIN it USING (row)""",
    "op3_tool_calls": """
WITH RECURSIVE t AS (SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id FROM conversations),
b AS (SELECT conv_id, turn + 1 AS turn, max(role) AS before FROM conversations GROUP BY ALL),
c AS (SELECT t.conv_id, t.turn, id, text, CASE role WHEN 'user' THEN 'reply' WHEN 'system' THEN 'configure' ELSE role END AS name,
             CASE WHEN before = 'assistant' THEN t.conv_id || ':' || (t.turn - 2) WHEN before IS NOT NULL THEN t.conv_id || ':' || (t.turn - 1) END AS after
      FROM t LEFT JOIN b ON b.conv_id = t.conv_id AND b.turn = t.turn WHERE coalesce(role, '') <> 'assistant'),
r AS (SELECT conv_id, turn, conv_id || ':' || (turn - 1) AS id, text FROM t WHERE role = 'assistant'),
n AS (SELECT id, count(*) AS n, max(after) AS after FROM c WHERE id IS NOT NULL GROUP BY id),
u AS (SELECT id, after FROM n WHERE n = 1),
d(id, depth) AS (SELECT id, 0 FROM u WHERE after IS NULL OR after NOT IN (SELECT id FROM u)
                 UNION ALL SELECT u.id, d.depth + 1 FROM d JOIN u ON u.after = d.id),
a AS (SELECT id, count(*) AS answers FROM r GROUP BY id)
SELECT conv_id, turn, 'call' AS kind, c.id AS call_id, name,
       CASE WHEN n IS NULL THEN 'no_id' WHEN n > 1 THEN 'duplicate_id' WHEN name IS NULL OR name NOT IN ('reply', 'configure') THEN 'unknown_tool'
            WHEN text IS NULL OR turn IS NULL THEN 'bad_arguments' WHEN depth IS NULL THEN 'cycle' WHEN answers IS NULL THEN 'unanswered' ELSE 'ok' END AS status,
       depth, 2 * depth AS topo,
       '{' || CASE WHEN c.after IS NOT NULL THEN '"after":' || to_json(c.after) || ',' ELSE '' END || '"arguments":' || to_json({'text': text, 'turn': turn})
           || ',"id":' || to_json(c.id) || ',"name":' || to_json(name) || '}' AS json
FROM c LEFT JOIN n USING (id) LEFT JOIN d USING (id) LEFT JOIN a USING (id)
UNION ALL
SELECT conv_id, turn, 'result', r.id, NULL, CASE WHEN n IS NULL THEN 'orphan' WHEN n > 1 THEN 'ambiguous' ELSE 'ok' END, depth, 2 * depth + 1,
       to_json({'content': text, 'id': r.id}) FROM r LEFT JOIN n USING (id) LEFT JOIN d USING (id)""",
    "op4_near_duplicates": f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS row, doc_id,
      list_filter(regexp_split_to_array({_LOWER.format("coalesce(text, '')")}, '[ \\t-\\r]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT row, array_to_string(w[i:i + 3], ' ') AS g
      FROM (SELECT row, w, unnest(generate_series(1, greatest(len(w) - 3, 1))) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT row, count(*) AS n FROM s GROUP BY row),
p AS (SELECT a.row AS u, b.row AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.row <> b.row GROUP BY ALL),
e AS (SELECT u, v FROM p JOIN n x ON x.row = u JOIN n y ON y.row = v WHERE 100 * c >= 80 * (x.n + y.n - c)),
r(row, near) AS (SELECT row, row FROM d UNION SELECT r.row, e.v FROM r JOIN e ON e.u = r.near),
c AS (SELECT r.row, min(o.doc_id) AS component_id FROM r JOIN d o ON o.row = r.near GROUP BY r.row)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, coalesce(doc_id = component_id, false) AS kept
FROM d JOIN c USING (row) LEFT JOIN n USING (row)""",
    "op7_license_scan": f"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, {_ALNUM_WORDS} AS w FROM documents),
t(tpl, label, base, w) AS (VALUES {_TEMPLATES}),
tg AS (SELECT tpl, label, base, len(w) - 2 AS size, i - 1 AS o, array_to_string(w[i:i + 2], ' ') AS g
       FROM (SELECT *, unnest(generate_series(1, len(w) - 2)) AS i FROM t)),
dg AS (SELECT row, i - 1 AS p, array_to_string(w[i:i + 2], ' ') AS g FROM (SELECT row, w, unnest(generate_series(1, len(w) - 2)) AS i FROM d WHERE len(w) >= 3)),
v AS (SELECT row, tpl, label, base, size, p - o AS diagonal, min(p) AS lo, max(p) AS hi, bit_or(1::BIGINT << o) AS bits
      FROM dg JOIN tg USING (g) GROUP BY ALL),
a AS (SELECT *, CASE WHEN base OR diagonal - lag(diagonal) OVER (PARTITION BY row, tpl ORDER BY diagonal) <= {licenses.SHIFT} IS NOT TRUE THEN 1
                     WHEN base THEN 1 ELSE 0 END AS apart FROM v),
s AS (SELECT *, sum(apart) OVER (PARTITION BY row, tpl ORDER BY diagonal) AS span FROM a),
m AS (SELECT row, label, base, size, min(lo) AS first, bit_count(bit_or(bits)) AS held, bit_or(bits) AS bits FROM s GROUP BY row, tpl, label, base, size, span),
k AS (SELECT *, held / size AS share FROM m WHERE CASE WHEN base THEN held = size ELSE held / size >= {licenses.SHARE} AND bits & 1 = 1 AND (bits >> (size - 1)) & 1 = 1 END),
f AS (SELECT row, count(*) FILTER (base) AS n_base, min(first) FILTER (base) AS first_word, max(first) FILTER (base) AS last_word,
             string_agg(DISTINCT label, ',' ORDER BY label) FILTER (base) AS base_labels, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score
      FROM k GROUP BY row)
SELECT doc_id, len(w) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels,
       coalesce(labels, '') AS labels, coalesce(score, 0.0)::DOUBLE AS score
FROM d LEFT JOIN f USING (row)""",
    "op8_url_filter": f"""
WITH p AS (SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')")} AS host,
                  coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
r(name, h, pa, v) AS (VALUES {", ".join(f"('{h + p}', '{h}', '{p}', '{v}')" for v, h, p in reputation.RULES)}),
u AS (SELECT host, path, arg_max(name, length(name)) AS rule, arg_max(v, length(name)) AS v
      FROM (SELECT DISTINCT host, path FROM p), r WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, pa) GROUP BY host, path),
o AS (SELECT host, greatest(coalesce(toxic, 0), 1 - coalesce(quality, 1)) AS bad FROM p JOIN labels ON doc_id = page_id
      WHERE toxic IS NOT NULL OR quality IS NOT NULL),
b AS (SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), ':[0-9]*$', '') AS bare FROM (SELECT DISTINCT host FROM p)),
lv AS (SELECT host, CASE WHEN address THEN bare WHEN two THEN array_to_string(string_split(bare, '.')[-3:], '.') ELSE last_two END AS domain,
              CASE WHEN address THEN '{reputation.ADDRESS}' WHEN two THEN last_two ELSE string_split(bare, '.')[-1] END AS suffix
       FROM (SELECT *, regexp_full_match(bare, '([0-9]+[.]){{3}}[0-9]+') OR starts_with(bare, '[') AS address, last_two IN ({", ".join(f"'{x}'" for x in reputation.SUFFIXES)}) AS two
             FROM (SELECT *, array_to_string(string_split(bare, '.')[-2:], '.') AS last_two FROM b))),
h AS (SELECT host, domain, suffix, n, bad FROM lv JOIN (SELECT host, count(*) AS n, sum(bad)::DOUBLE AS bad FROM o GROUP BY host) USING (host)),
dm AS (SELECT domain, suffix, sum(n) AS n, sum(bad) AS bad FROM h GROUP BY domain, suffix),
sx AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad FROM dm GROUP BY suffix),
st AS (SELECT 0 AS l, n, bad FROM sx UNION ALL SELECT 1, n, bad FROM dm UNION ALL SELECT 2, n, bad FROM h),
mo AS (SELECT l, count(*) AS k, sum(n)::DOUBLE AS n, sum(bad) / sum(n) AS m, sum(bad * bad / n) - sum(bad) * sum(bad) / sum(n) AS spread, sum(n * n) AS nn FROM st GROUP BY l),
rh AS (SELECT l, CASE WHEN k > 1 AND m > 0 AND m < 1 AND m * (1 - m) * (n - nn / n - (k - 1)) > 0
                      THEN (spread - (k - 1) * m * (1 - m)) / (m * (1 - m) * (n - nn / n - (k - 1))) END AS rho FROM mo),
ks AS (SELECT l, CASE WHEN rho > 0 THEN least(greatest(1 / rho - 1, 1), 10000) ELSE 10000 END AS k FROM rh),
kk AS (SELECT max(k) FILTER (l = 0) AS k0, max(k) FILTER (l = 1) AS k1, max(k) FILTER (l = 2) AS k2 FROM ks),
m0 AS (SELECT (sum(bad) + 1) / (sum(n) + 2) AS m0 FROM sx),
s2 AS (SELECT suffix, (bad + k0 * m0) / (n + k0) AS ms FROM sx, kk, m0),
d2 AS (SELECT domain, suffix, (bad + k1 * ms) / (n + k1) AS md FROM dm JOIN s2 USING (suffix), kk),
h2 AS (SELECT host, (bad + k2 * md) / (n + k2) AS rate, n + k2 AS size FROM h JOIN d2 USING (domain, suffix), kk
       UNION ALL SELECT host, coalesce(md, ms, m0), CASE WHEN md IS NOT NULL THEN k2 WHEN ms IS NOT NULL THEN k1 ELSE k0 END
       FROM lv ANTI JOIN h USING (host) LEFT JOIN d2 USING (domain, suffix) LEFT JOIN s2 USING (suffix), kk, m0 WHERE host <> ''),
q AS (SELECT host, rate - 1.645 * sqrt(rate * (1 - rate) / (size + 1)) AS bound, m0 FROM h2, m0)
SELECT page_id, p.host, p.path, rule, coalesce(v, CASE WHEN greatest(bound, 0) > m0 THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN u ON u.host = p.host AND u.path = p.path LEFT JOIN q ON q.host = p.host""",
    "op6_quality_rules": r"""
WITH d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, doc_id, text, list_filter(regexp_split_to_array(text, '[ \t-\r]+'), lambda x: x <> '') AS w,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^ \t-\r]')) AS lines FROM d),
p AS (SELECT row, w, unnest(generate_series(1, len(w) - 7)) AS i FROM t WHERE len(w) >= 8),
g AS (SELECT row, i, count(*) OVER (PARTITION BY row, array_to_string(w[i:i + 7], ' ')) AS n FROM p),
r AS (SELECT row, count(DISTINCT i + k) AS n FROM g, (SELECT unnest(range(8)) AS k) WHERE n >= 2 GROUP BY row),
m AS (SELECT doc_id, len(w) AS n_words, len(regexp_replace(text, '[ \t-\r]+', '', 'g')) AS word_chars,
             len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
             len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines,
             len(list_distinct(w)) AS n_distinct, coalesce(r.n, 0) AS n_repeat_words
      FROM t LEFT JOIN r USING (row)),
b AS (SELECT *, (n_words < 20)::BIGINT + 2 * (100 * n_repeat_words > 30 * n_words)::BIGINT
             + 4 * (10 * n_symbols > n_words)::BIGINT
             + 8 * (n_dup_lines >= 3 AND 100 * n_dup_lines > 30 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words)::BIGINT + 32 * (word_chars > 14 * n_words)::BIGINT
             + 64 * (n_words >= 20 AND 16 * n_distinct * n_distinct < n_words * least(n_words, 1000))::BIGINT AS fail_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       fail_bits & 3 <> 0 AS base_failed, fail_bits & 127 = 0 AS kept, fail_bits FROM b""",
}
