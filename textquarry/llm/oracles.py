"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

import re

from textquarry.llm.license_templates import BASE_PHRASES, TEMPLATES, parse
from textquarry.llm.secrets import BASE_RULES, MORE_RULES

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

QUALITY = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, text, source, {_WORDS} AS ws FROM documents),
lines AS (SELECT r, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d),
dup AS (SELECT r, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines
        WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY r),
w AS (SELECT r, i, ws[i] || chr(10) || ws[i + 1] || chr(10) || ws[i + 2] AS g
      FROM (SELECT r, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM d)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM w) WHERE n > 1),
rep AS (SELECT r, sum(least(3, coalesce(nxt - i, 3)))::BIGINT AS n_repeat_words
        FROM (SELECT r, i, lead(i) OVER (PARTITION BY r ORDER BY i) AS nxt FROM twice) GROUP BY r),
m AS (SELECT d.r, doc_id, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
             len(regexp_extract_all(coalesce(text, ''), '[#*$%&|<>]'))::BIGINT AS n_symbols,
             coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM d LEFT JOIN dup USING (r) LEFT JOIN rep USING (r)),
f AS (SELECT *, (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AS base_failed,
             (n_words < 50 OR 100 * n_repeat_words > 50 * n_words OR 100 * n_symbols > 50 * n_words
              OR 100 * n_dup_lines > 10 * n_words) AS any_failed FROM m),
h AS (SELECT source, count(*) AS n, sum(any_failed::INT) AS bad FROM f GROUP BY source),
t AS (SELECT avg(bad / n) AS mean, var_pop(bad / n) AS var, avg(1 / n) AS chance FROM h),
p AS (SELECT mean, CASE WHEN var - mean * (1 - mean) * chance > 0
                   THEN least(1000, greatest(2, mean * (1 - mean) / (var - mean * (1 - mean) * chance) - 1)) ELSE 1000 END AS weight FROM t),
v AS (SELECT source, (bad + mean * weight) / (n + weight) > 0.6 AS host_rejected FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, host_rejected,
       NOT base_failed AND NOT host_rejected AS kept
FROM f JOIN v ON f.source IS NOT DISTINCT FROM v.source
"""

DECONTAMINATE = r"""
WITH w AS (SELECT row_number() OVER () AS r, doc_id,
                  list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM documents),
b AS (SELECT item_id::VARCHAR AS item,
             list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                         '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS ws FROM benchmark),
p AS (SELECT DISTINCT item, least(10, len(ws)) AS n, array_to_string(ws[i : i + least(10, len(ws)) - 1], ' ') AS phrase
      FROM (SELECT item, ws, unnest(generate_series(1, greatest(1, len(ws) - 9))) AS i FROM b WHERE len(ws) > 0)),
sizes AS (SELECT DISTINCT n FROM p),
g AS (SELECT r, n, i, array_to_string(ws[i : i + n - 1], ' ') AS phrase
      FROM (SELECT r, ws, n, unnest(generate_series(1, len(ws) - n + 1)) AS i FROM w, sizes)),
hit AS (SELECT r, g.n, i, item FROM g JOIN p ON g.phrase = p.phrase AND g.n = p.n),
places AS (SELECT DISTINCT r, unnest(generate_series(i, i + n - 1)) AS place FROM hit),
cover AS (SELECT r, count(*) AS n_hit FROM places GROUP BY r),
edge AS (SELECT r, min(place) - 1 AS s, max(place) AS e FROM (SELECT r, place, place - row_number() OVER (PARTITION BY r ORDER BY place) AS k FROM places)
         GROUP BY r, k),
span AS (SELECT r, string_agg(s || ':' || e, ',' ORDER BY s) AS spans FROM edge GROUP BY r),
items AS (SELECT r, list(item ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(len(items), 0)::BIGINT AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
       coalesce(spans, '') AS spans
FROM w LEFT JOIN cover USING (r) LEFT JOIN span USING (r) LEFT JOIN items USING (r)
"""

REPEATS = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
g AS (SELECT r, doc_id, i, md5(array_to_string(ws[i : i + 49], ' ')) AS h
      FROM (SELECT r, doc_id, ws, unnest(generate_series(1, len(ws) - 49)) AS i FROM d)),
first AS (SELECT h, min(doc_id) AS smallest FROM g GROUP BY h),
gone AS (SELECT DISTINCT r, unnest(generate_series(i, i + 49)) AS place FROM g JOIN first USING (h)
         WHERE smallest < coalesce(doc_id, 9223372036854775807)),
cut AS (SELECT r, list(place) AS places_ FROM gone GROUP BY r),
w AS (SELECT r, place, ws[place] AS word FROM (SELECT r, ws, unnest(generate_series(1, len(ws))) AS place FROM d)),
kept AS (SELECT r, string_agg(word, ' ' ORDER BY place) AS words FROM w ANTI JOIN gone USING (r, place) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(places_), 0)::BIGINT AS n_removed, sha256(coalesce(words, '')) AS kept_sha256
FROM d LEFT JOIN cut USING (r) LEFT JOIN kept USING (r)
"""


def _secret_spans() -> str:
    """Spans of every rule: the text between matches and the matches alternate, so a match starts at the lengths before it."""
    parts = []
    for rank, rule in enumerate((*BASE_RULES, *MORE_RULES)):
        # Letters in either case are those of ASCII; RE2's own flag would fold others in.
        folded = re.sub(r"\(\?i:([^)]*)\)", lambda m: "(?:" + re.sub("[a-z]", lambda c: f"[{c[0].upper()}{c[0]}]", m[1]) + ")", rule.pattern)
        pattern = folded.replace("'", "''")
        parts.append(
            f"""SELECT r, {rank} AS rank, '{rule.kind}' AS kind, v, length(m) AS n,
       sum(length(b)) OVER (PARTITION BY r ORDER BY i) + coalesce(sum(length(m)) OVER (PARTITION BY r ORDER BY i
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start, {rule.least} AS least
FROM (SELECT r, generate_subscripts(ms, 1) AS i, unnest(ms) AS m, unnest(vs) AS v, unnest(bs[1 : len(ms)]) AS b
      FROM (SELECT r, regexp_extract_all(body, '{pattern}', 0) AS ms, regexp_extract_all(body, '{pattern}', {rule.group}) AS vs,
                   string_split_regex(body, '{pattern}') AS bs FROM d) WHERE len(ms) > 0)"""
        )
    return "\nUNION ALL\n".join(parts)


SECRETS = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS body FROM documents),
every AS ({_secret_spans()}),
s AS (SELECT r, kind, rank, start, kind || ':' || start || ':' || (start + n) AS said FROM every WHERE length(v) >= least),
a AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access,
             count(*) FILTER (kind = 'hex') AS n_hex, string_agg(said, ',' ORDER BY start, rank) AS spans,
             string_agg(said, ',' ORDER BY start, rank) FILTER (rank < {len(BASE_RULES)}) AS base FROM s GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
       coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN a USING (r)
"""



def _trust(rounds: int = 86) -> str:
    """Rules by case, longest first, and the rounds of trust and distrust one after the other, until 0.85 ** rounds < 1e-6."""
    fits = lambda domain, path: f"(host = '{domain}' OR ends_with(host, '.{domain}')) AND starts_with(path, '{path}')"
    first = r"""
WITH u AS (SELECT row_number() OVER () AS r, page_id, html,
                  translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), ''),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
"""
    rules = f"""
ruled AS (SELECT *, CASE WHEN {fits("example.net", "/en/")} THEN 'example.net/en/' WHEN {fits("example.com", "/de/")} THEN 'example.com/de/'
                         WHEN {fits("org", "/fr/")} THEN 'org/fr/' WHEN {fits("net", "/")} THEN 'net/' END AS rule FROM u),
said AS (SELECT *, CASE WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow' WHEN rule IS NOT NULL THEN 'block' END AS said FROM ruled),
seeds AS (SELECT host, kind, CASE kind WHEN 0 THEN allowed ELSE blocked END / n AS score
          FROM (SELECT host, count(*) AS n, count(*) FILTER (said = 'allow') AS allowed, count(*) FILTER (said = 'block') AS blocked
                FROM said WHERE host <> '' GROUP BY host), (VALUES (0), (1)) AS k(kind)),
links AS (SELECT host AS src, translate(unnest(regexp_extract_all(regexp_replace(coalesce(html, ''),
                 '(?is)<!--.*?(?:-->|\\z)|<script\\b.*?(?:</script|\\z)|<style\\b.*?(?:</style|\\z)', ' ', 'g'),
                 '(?i)<(?:a|area)\\s(?:[^<>]*?[\\s"''/])?href\\s*=\\s*["'']?\\s*(?:[a-z][a-z0-9+.-]*:)?//([^/?#"''\\s<>]+)', 1)),
                 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS dst FROM u WHERE host <> ''),
e AS (SELECT src, dst, count(*) AS n FROM links WHERE src <> dst GROUP BY ALL),
both_ways AS (SELECT src AS host, dst AS towards, n, 0 AS kind FROM e UNION ALL SELECT dst, src, n, 1 FROM e),
steps AS MATERIALIZED (SELECT host, kind, towards, 0.85::DOUBLE * n / sum(n) OVER (PARTITION BY host, kind) AS share FROM both_ways),
s0 AS MATERIALIZED (SELECT * FROM seeds)"""
    each = "".join(
        f""",
s{i} AS MATERIALIZED (SELECT host, kind, sum(score) AS score FROM (SELECT host, kind, score FROM seeds UNION ALL
       SELECT towards, s.kind, s.score * share FROM s{i - 1} AS s JOIN steps USING (host, kind)) GROUP BY host, kind)"""
        for i in range(1, rounds + 1)
    )
    last = f""",
most AS (SELECT host, kind, sum(most) AS most FROM (SELECT host, kind, 1::DOUBLE AS most FROM seeds WHERE score > 0
                                                    UNION ALL SELECT towards, kind, share FROM steps) GROUP BY host, kind)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN distrust >= 0.5 AND distrust > trust THEN 'block' ELSE 'allow' END) AS verdict
FROM said LEFT JOIN (SELECT host, coalesce(max(score / most) FILTER (kind = 0), 0) AS trust, coalesce(max(score / most) FILTER (kind = 1), 0) AS distrust
                     FROM s{rounds} JOIN most USING (host, kind) GROUP BY host) USING (host)
"""
    return first + rules + each + last


def _merkle(levels: int = 24, top: int = 8) -> str:
    """The levels of all trees one after the other, of up to 2 ** levels leaves each, then those of the tree over 2 ** top of them."""
    field = lambda c: f"coalesce(octet_length(encode(({c})::VARCHAR)) || ':' || ({c}), '-')"
    row = lambda n: "sha256(" + " || ".join(map(field, ("doc_id", "source", "lang", n, "text"))) + ")"

    def climb(name: str, levels: int) -> str:
        """``name_k``: the nodes of level k (tree, i, digest d, the tree's nodes n), up to the root."""
        return "".join(
            f""",
{name}_{k} AS MATERIALIZED (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM (SELECT tree, i // 2 AS i,
       CASE WHEN any_value(n) = 1 THEN any_value(d) ELSE sha256(string_agg(d, '' ORDER BY i)) END AS d FROM {name}_{k - 1} GROUP BY tree, i // 2))"""
            for k in range(1, levels + 1)
        )

    def along(name: str, start: str, out: str, levels: int) -> str:
        """``out_k``: digest ``f`` and siblings ``p`` of every row of ``start`` (r, tree, i, f, p) after level k."""
        return f""",
{out}_0 AS MATERIALIZED ({start})""" + "".join(
            f""",
{out}_{k} AS MATERIALIZED (SELECT x.r, x.tree, x.i // 2 AS i, CASE WHEN h.n = 1 THEN f WHEN o.d IS NULL THEN sha256(f)
       WHEN x.i % 2 = 1 THEN sha256(o.d || f) ELSE sha256(f || o.d) END AS f, p || coalesce(o.d, '') AS p
       FROM {out}_{k - 1} AS x JOIN (SELECT tree, any_value(n) AS n FROM {name}_{k - 1} GROUP BY tree) AS h USING (tree)
       LEFT JOIN {name}_{k - 1} AS o ON o.tree = x.tree AND o.i = xor(x.i, 1))"""
            for k in range(1, levels + 1)
        )

    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS tree, {row("n_chars")} AS leaf,
     CASE WHEN doc_id IS NOT NULL AND xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(doc_id::VARCHAR, ''),
              lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
              lambda c, e: CASE WHEN e < 0 THEN xor(c >> 1, 3988292384 * (c & 1)) ELSE xor(c, e) END), 4294967295) % 7 = 0
          THEN {row("n_chars + 1")} END AS said FROM documents),
l_0 AS MATERIALIZED (SELECT r, tree, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf, r) - 1 AS i, leaf AS d,
       count(*) OVER (PARTITION BY tree) AS n FROM d){climb("l", levels)},
s AS (SELECT tree AS part, d FROM l_{levels}),
t_0 AS MATERIALIZED (SELECT '' AS tree, part, row_number() OVER (ORDER BY part) - 1 AS i, d, count(*) OVER () AS n FROM s){climb("t", top)}
{along("l", "SELECT r, tree, i, coalesce(said, d) AS f, '' AS p FROM l_0 JOIN d USING (r, tree)", "a", levels)}
{along("t", f"SELECT r, '' AS tree, t_0.i, f, p FROM a_{levels} AS a JOIN t_0 ON t_0.part = a.tree", "b", top)}
SELECT doc_id, leaf, s.d AS subroot, t.d AS root, sha256(p) AS proof_sha256, f AS folded_root, f = t.d AS verified
FROM d JOIN s ON s.part = d.tree JOIN b_{top} AS b USING (r), t_{top} AS t
"""


def _licenses() -> str:
    """Templates as regular expressions over the words, each followed by a space."""

    def pattern(nodes: list) -> str:
        out = ""
        for kind, value in nodes:
            if kind == "word":
                out += value + " "
            elif kind == "any":
                out += f"(?:[^ ]+ ){{0,{value}}}"
            elif kind == "one":
                out += "(?:" + "|".join("".join(w + " " for w in way) for way in value) + ")"
            else:
                out += "(?:" + pattern(value) + ")?"
        return out

    def starts(phrase: str) -> str:
        return "(" + " AND ".join(f"ws[i + {k}] = '{w}'" for k, w in enumerate(phrase.split(), 1)) + ")"

    every = " OR ".join(starts(p) for _, p in BASE_PHRASES)
    base = ", ".join(f"CASE WHEN contains(line, ' {p} ') THEN '{label}' END" for label, p in BASE_PHRASES)
    more = ", ".join(f"CASE WHEN regexp_matches(line, ' {pattern(parse(m))}') THEN '{label}' END" for label, m in TEMPLATES)
    named = lambda c: f"array_to_string(list_sort(list_distinct({c})), ',')"
    return rf"""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                  '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS ws FROM documents),
m AS (SELECT doc_id, ws, ' ' || array_to_string(ws, ' ') || ' ' AS line,
             list_filter(range(len(ws)), lambda i: {every}) AS places FROM w),
l AS (SELECT *, list_filter([{base}], lambda x: x IS NOT NULL) AS base, list_filter([{more}], lambda x: x IS NOT NULL) AS more FROM m)
SELECT doc_id, len(ws)::BIGINT AS n_words, len(places)::BIGINT AS n_base, list_min(places)::BIGINT AS first_word, list_max(places)::BIGINT AS last_word,
       {named("base")} AS base_labels, {named("list_concat(base, more)")} AS labels,
       CASE WHEN len(more) > 0 THEN 1.0 WHEN len(base) > 0 THEN 0.5 ELSE 0.0 END::DOUBLE AS score
FROM l
"""


ORACLES: dict[str, str] = {
    "op1_link_trust": _trust(),
    "op3_decontaminate": DECONTAMINATE,
    "op5_quality_rules": QUALITY,
    "op7_substring_dedup": REPEATS,
    "op9_secrets": SECRETS,
    "op11_license_templates": _licenses(),
    "op12_merkle_manifest": _merkle(),
}
