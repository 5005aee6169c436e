"""DuckDB SQL for those text queries that SQL can express over whole tables."""

from __future__ import annotations

import math

from . import license_scan, quality

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_PLAIN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_WHITE = r"[^\x20\x09-\x0D]+"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _plain_words(column: str) -> str:
    return f"regexp_extract_all(translate(coalesce({column}, ''), '{_UPPER}', '{_LOWER}'), '{_PLAIN}')"


def op2_sql(threshold: float = 0.8, block: int = license_scan.BLOCK_WORDS) -> str:
    """Blocks of lines (``b``), then windows over the texts' words (``v``) without the words of the lines' hits."""
    templates, vocabulary = [], set()
    for label, texts in license_scan.TEMPLATES.items():
        for t in texts:
            tokens = sorted(set(license_scan.tokens_of(t)))
            vocabulary |= set(tokens)
            templates.append(f"({_text(label)}, [{', '.join(map(_text, tokens))}], {math.ceil(threshold * len(tokens) - 1e-9)})")
    phrases = [f"({_text(label)}, {_text(' '.join(p))}, {len(p)})" for label, p in license_scan.PHRASES.items()]
    step, known = block // 2, f"[{', '.join(map(_text, sorted(vocabulary)))}]"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, {_plain_words("text")} AS w FROM documents),
p(label, phrase, n) AS (VALUES {", ".join(phrases)}),
places AS (SELECT rid, label, i - 1 AS pos FROM (SELECT rid, w, unnest(range(1, len(w) + 1)) AS i FROM d) x, p WHERE array_to_string(list_slice(w, i, i + n - 1), ' ') = phrase),
base AS (SELECT rid, count(*) AS n_base, min(pos) AS first_word, max(pos) AS last_word, list(DISTINCT label) AS base_labels FROM places GROUP BY rid),
t(label, tokens, need) AS (VALUES {", ".join(templates)}),
s AS (SELECT rid, string_split(text, chr(10)) AS ls, w FROM d),
j AS (SELECT rid, j, {_plain_words("line")} AS w FROM (SELECT rid, unnest(ls) AS line, unnest(range(1, len(ls) + 1)) AS j FROM s) x),
l AS (SELECT rid, w, sum(len(w)) OVER (PARTITION BY rid ORDER BY j) - len(w) AS start FROM j),
b AS (SELECT rid, start + h AS start, list_slice(w, h + 1, h + {block}) AS s FROM (SELECT rid, w, start, unnest(range(0, greatest(len(w) - {step} - 1, 0) + 1, {step})) AS h FROM l) x),
m AS (SELECT rid, start, s, label, len(list_intersect(tokens, s)) / len(tokens) AS containment FROM b, t WHERE len(list_intersect(tokens, s)) >= need),
marks AS (SELECT rid, start, list_filter(range(1, len(s) + 1), lambda i: list_contains({known}, s[i])) AS ks FROM m),
taken AS (SELECT DISTINCT rid, unnest(range(cast(start + list_min(ks) - 1 as bigint), cast(start + list_max(ks) as bigint))) AS q FROM marks),
v AS (SELECT rid, q, word, n FROM (SELECT rid, len(w) AS n, unnest(w) AS word, unnest(range(0, len(w))) AS q FROM s WHERE len(ls) > 1) x WHERE list_contains({known}, word)),
free AS (SELECT v.* FROM v LEFT JOIN taken ON taken.rid = v.rid AND taken.q = v.q WHERE taken.q IS NULL),
heads AS (SELECT rid, word, n, unnest([q // {step} - 1, q // {step}]) AS h FROM free),
windows AS (SELECT rid, h, list(DISTINCT word) AS s FROM heads WHERE h BETWEEN 0 AND greatest(n - {step} - 1, 0) // {step} GROUP BY rid, h),
wrapped AS (SELECT rid, label, len(list_intersect(tokens, s)) / len(tokens) AS containment FROM windows, t WHERE len(list_intersect(tokens, s)) >= need),
hits AS (SELECT rid, label, containment FROM m UNION ALL SELECT * FROM wrapped),
more AS (SELECT rid, list(DISTINCT label) AS labels, max(containment) AS best, count(*) AS n_blocks FROM hits GROUP BY rid)
SELECT doc_id, cast(len(w) as bigint) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
  array_to_string(list_sort(coalesce(base_labels, [])), ',') AS base_labels,
  array_to_string(list_sort(list_distinct(list_concat(coalesce(base_labels, []), coalesce(labels, [])))), ',') AS labels,
  CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(best, 0.0) END AS score, coalesce(n_blocks, 0) AS n_blocks
FROM d LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)"""


def op3_sql(alpha: float = 0.02, delta: float = 0.05) -> str:
    rules = quality.RULES
    rate = alpha / len(rules)
    n_tests = sum(len(c) for c in rules.values())
    grid = ", ".join(f"({_text(rule)}, {c!r})" for rule, cutoffs in rules.items() for c in cutoffs)
    value = "CASE rule " + " ".join(f"WHEN '{r}' THEN {r}" for r in rules) + " END"
    share = lambda a, b, name: f"CASE WHEN {b} > 0 THEN cast({a} as double) / {b} ELSE 0.0 END AS {name}"
    term = f"exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({rate!r}) + (n - i) * ln(1 - {rate!r}))"
    width = quality.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(lang, 'und') AS stratum, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WHITE}') AS w FROM documents),
g AS (SELECT rid, i, array_to_string(list_slice(w, i, i + {width - 1}), ' ') AS k FROM (SELECT rid, w, unnest(range(1, len(w) - {width - 2})) AS i FROM d) x),
r AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest(range(i, i + {width})) AS p FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM g) y WHERE n > 1) z GROUP BY rid),
c AS (SELECT rid, doc_id, stratum, cast(len(w) as bigint) AS n_words, cast(length(array_to_string(w, '')) as bigint) AS word_chars,
  cast(len(regexp_extract_all(text, '[#*$%&|<>]')) as bigint) AS n_symbols, cast(len(regexp_extract_all(text, '\\p{{Lu}}')) as bigint) AS n_capitals, cast(len(regexp_extract_all(text, '[!?]')) as bigint) AS n_marks,
  list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS lines, coalesce(n_repeat_words, 0) AS n_repeat_words FROM d LEFT JOIN r USING (rid)),
s AS (SELECT *, cast(len(lines) - len(list_distinct(lines)) as bigint) AS n_dup_lines, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM c),
f AS (SELECT *, {share("n_symbols", "word_chars", "symbol_share")}, {share("n_capitals", "word_chars", "capital_share")}, {share("n_marks", "word_chars", "mark_share")}, {share("n_dup_lines", "len(lines)", "dup_line_share")}, {share("n_repeat_words", "n_words", "repeat_share")} FROM s),
l AS (SELECT doc_id, min(quality) AS good FROM labels WHERE doc_id IS NOT NULL AND quality IN (0, 1) GROUP BY doc_id),
grid(rule, cutoff) AS (VALUES {grid}),
h AS (SELECT f.*, good FROM f JOIN l ON l.doc_id = f.doc_id WHERE NOT base_failed),
strata AS (SELECT stratum, sum(good) AS n, count(*) AS held FROM h GROUP BY stratum),
k AS (SELECT stratum, rule, cutoff, sum(good) AS k, sum(1 - good) AS caught FROM (SELECT stratum, rule, cutoff, good, {value} AS v FROM h, grid) x WHERE v > cutoff GROUP BY stratum, rule, cutoff),
tested AS (SELECT stratum, rule, cutoff, cast(n as bigint) AS n, cast(k as bigint) AS k, caught, (SELECT count(*) FROM strata) AS m FROM k JOIN strata USING (stratum)),
certified AS (SELECT stratum, rule, cutoff, caught FROM tested WHERE k < n * {rate!r} AND caught > 0 AND list_sum(list_transform(range(k + 1), lambda i: {term})) <= {delta / n_tests!r} / m),
chosen AS (SELECT stratum, rule, cutoff FROM (SELECT *, row_number() OVER (PARTITION BY stratum, rule ORDER BY caught DESC, cutoff DESC) AS rk FROM certified) x WHERE rk = 1),
bad AS (SELECT DISTINCT rid FROM (SELECT rid, cutoff, {value} AS v FROM f JOIN chosen USING (stratum)) x WHERE v > cutoff)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND bad.rid IS NULL AS kept FROM f LEFT JOIN bad USING (rid)"""


def op10_sql(width: int = 13) -> str:
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, {_plain_words("text")} AS w FROM documents),
b AS (SELECT cast(item_id as varchar) AS item, {_plain_words("text")} AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
win AS (SELECT DISTINCT item, least(len(w), {width}) AS n, array_to_string(list_slice(w, i, i + {width - 1}), ' ') AS k FROM (SELECT item, w, unnest(range(1, greatest(len(w) - {width - 1}, 1) + 1)) AS i FROM b WHERE len(w) > 0) x),
sizes AS (SELECT DISTINCT n FROM win),
seen AS (SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS k FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, sizes) x),
hit AS (SELECT DISTINCT rid, i, seen.n AS n, item FROM seen JOIN win ON win.k = seen.k AND win.n = seen.n),
words AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY rid),
items AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names FROM (SELECT DISTINCT rid, item FROM hit) x GROUP BY rid)
SELECT doc_id, cast(len(w) as bigint) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (rid) LEFT JOIN items USING (rid)"""


def oracle_sql() -> dict[str, str]:
    return {"op2_license_scan": op2_sql(), "op3_quality_rules": op3_sql(), "op10_decontamination": op10_sql()}
