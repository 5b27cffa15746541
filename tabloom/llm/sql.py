"""SQL counterparts, for DuckDB, of the queries that SQL can express on whole tables."""

from __future__ import annotations

from tabloom.llm import rules, url_filter

WORD = r"[^\x20\x09-\x0D]+"

_FAILS = " + ".join(f"CASE WHEN {r.fails} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules.RULES))

OP5 = rf"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT *, regexp_extract_all(text, '{WORD}') AS ws, list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '{WORD}')) AS ls FROM t),
win AS (SELECT rid, unnest(range(1, len(ws) - 3)) AS i, ws FROM s WHERE len(ws) >= 5),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, list_slice(ws, i, i + 4)) AS n FROM win) WHERE n > 1),
marked AS (SELECT rid, count(DISTINCT i + k) AS n FROM twice, range(5) r(k) GROUP BY rid),
m AS (SELECT doc_id, len(ws) AS n_words, coalesce(list_sum(list_transform(ws, lambda w: length(w))), 0)::BIGINT AS word_chars,
  len(regexp_extract_all(text, '[#*$%&|<>]')) AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
  len(ls) AS n_lines, len(regexp_extract_all(text, '[A-Z]')) AS n_upper, len(regexp_extract_all(text, '!')) AS n_shouts FROM s LEFT JOIN marked USING (rid)),
f AS (SELECT *, ({_FAILS})::BIGINT AS failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed & {rules.bits_of(rules.POLICIES["base"])}) <> 0 AS base_failed,
  (failed & {rules.bits_of(rules.POLICIES["v2"])}) = 0 AS kept, failed FROM f"""

_ORDER = "ORDER BY rank, doc_id NULLS FIRST, size, nth"

OP7 = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, source, size) AS nth FROM d),
p AS (SELECT source, sum(size)::BIGINT AS source_size, count(*) FILTER (size > 0) AS n_docs FROM d GROUP BY source),
q AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place FROM p),
r AS (SELECT *, ([5, 2, 1])[(place - 1) % 3 + 1]::DOUBLE AS weight, (source_size * 3)::DOUBLE AS lim FROM q),
l AS (SELECT *, (sum(source_size::DOUBLE) OVER () - coalesce(sum(lim) OVER o, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER o, 0)) AS level FROM r
  WINDOW o AS (ORDER BY lim / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (SELECT min({{'r': lim / weight, 'p': place, 'l': level}}) FILTER (level <= lim / weight) AS x FROM l),
t AS (SELECT source, place, source_size, n_docs, least(lim, x.l * weight) AS target FROM l, v),
c AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS copies FROM t),
g AS (SELECT *, target - (copies * source_size)::DOUBLE AS open, CASE WHEN source_size > 0 THEN target / source_size - copies ELSE 0 END AS share FROM c),
h AS (SELECT u.*, g.* EXCLUDE (source), (('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null') || '/' || nth), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0 AS uni
  FROM u JOIN g ON u.source IS NOT DISTINCT FROM g.source),
k AS (SELECT *, CASE WHEN size > 0 AND share > 0 THEN uni / (1 - uni) / (least(greatest(size * n_docs / source_size, 0.25), 4.0) * share / (1 - share)) END AS rank FROM h),
p1 AS (SELECT *, rank IS NOT NULL AND size <= open AND sum(CASE WHEN size <= open THEN size ELSE 0 END) OVER (PARTITION BY place, rank IS NULL {_ORDER} ROWS UNBOUNDED PRECEDING) <= open AS one FROM k),
o1 AS (SELECT * REPLACE (open - coalesce(sum(CASE WHEN one THEN size END) OVER (PARTITION BY place), 0)::DOUBLE AS open) FROM p1),
p2 AS (SELECT *, rank IS NOT NULL AND NOT one AND size <= open AND sum(CASE WHEN NOT one AND size <= open THEN size ELSE 0 END) OVER (PARTITION BY place, rank IS NULL {_ORDER} ROWS UNBOUNDED PRECEDING) <= open AS two FROM o1),
o2 AS (SELECT * REPLACE (open - coalesce(sum(CASE WHEN two THEN size END) OVER (PARTITION BY place), 0)::DOUBLE AS open) FROM p2),
z AS (SELECT *, CASE WHEN rank IS NOT NULL AND NOT one AND NOT two AND abs(size - open) < open
  THEN row_number() OVER (PARTITION BY place, rank IS NOT NULL AND NOT one AND NOT two AND abs(size - open) < open ORDER BY abs(size - open), rank, doc_id NULLS FIRST, nth, size) = 1 ELSE false END AS three FROM o2)
SELECT doc_id, size, source_size, target, size * (copies + CASE WHEN one OR two OR three THEN 1 ELSE 0 END) AS taken FROM z"""


def _host(url: str) -> str:
    return f"coalesce(translate(regexp_extract({url}, '(?s)^.*?://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}'), '')"


def _path(url: str) -> str:
    return f"coalesce(regexp_extract({url}, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '')"


def _rule(host: str, path: str, rules_: list[tuple[str, str, str]], what: int) -> str:
    order = sorted(rules_, key=lambda r: (-len(r[0] + r[1]), r[2], r))
    cases = " ".join(f"WHEN ({host} = '{h}' OR ends_with({host}, '.{h}')) AND starts_with({path}, '{p}') THEN '{(h + p, v)[what]}'" for h, p, v in order)
    return f"CASE {cases} END"


def _node(url: str) -> str:
    host = f"regexp_replace({_host(url)}, ':(?:80|443)$', '')"
    kept = rf"array_to_string(list_filter(string_split(regexp_extract({url}, '(?s)^[^#?]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '{url_filter.TRACKING}')), '&')"
    return f"CASE WHEN {host} <> '' THEN {host} || regexp_replace({_path(url)}, '/$', '') || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END END"


def _attribute(tag: str, name: str) -> str:
    forms = ('"([^"]*)"', "''([^'']*)''", """([^\\s"''>]+)""")
    return "coalesce(" + ", ".join(rf"""nullif(regexp_extract({tag}, '(?is)[\s"'']{name}\s*=\s*{f}', 1), '')""" for f in forms) + ", '')"


_RESOLVED = rf"""CASE WHEN regexp_matches(link, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN link WHEN starts_with(link, '//') THEN scheme || ':' || link
  WHEN starts_with(link, '/') THEN scheme || '://' || host || link WHEN link = '' OR regexp_matches(link, '^(?:#|[A-Za-z][A-Za-z0-9+.-]*:)') THEN NULL
  ELSE scheme || '://' || host || CASE WHEN regexp_extract(path, '(?s)^(.*/)', 1) = '' THEN '/' ELSE regexp_extract(path, '(?s)^(.*/)', 1) END || link END"""

OP10 = rf"""
WITH RECURSIVE a AS (SELECT page_id, url, html, {_host("url")} AS host, {_path("url")} AS path FROM pages),
b AS (SELECT *, {_node("url")} AS node, {_rule("host", "path", url_filter.RULES, 0)} AS rule, {_rule("host", "path", url_filter.RULES, 1)} AS said, regexp_extract(url, '(?s)^(.*?)://', 1) AS scheme FROM a),
tags AS (SELECT node, host, path, scheme, unnest(regexp_extract_all(coalesce(html, ''), '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM b),
links AS (SELECT node, host, path, scheme, {_attribute("tag", "href")} AS link FROM tags WHERE regexp_matches(lower({_attribute("tag", "rel")}), '(?:^|\s)canonical(?:\s|$)')
  UNION ALL SELECT node, host, path, scheme, regexp_extract({_attribute("tag", "content")}, '(?i)url\s*=\s*[''"]?([^''"]*)', 1) FROM tags WHERE lower({_attribute("tag", "http-equiv")}) = 'refresh'),
whole AS (SELECT node AS u, {_RESOLVED} AS target FROM (SELECT * REPLACE (trim(replace(link, '&amp;', '&')) AS link) FROM links)),
e AS (SELECT u, target, {_node("target")} AS v FROM whole),
both_ways AS (SELECT u, v FROM e WHERE u IS NOT NULL AND v IS NOT NULL UNION SELECT v, u FROM e WHERE u IS NOT NULL AND v IS NOT NULL),
spoken AS (SELECT node, said FROM b WHERE node IS NOT NULL AND said IS NOT NULL
  UNION SELECT v, {_rule(f"regexp_replace({_host('target')}, ':(?:80|443)$', '')", _path("target"), url_filter.RULES, 1)} FROM e WHERE v IS NOT NULL),
reach(node, other) AS (SELECT node, node FROM b WHERE node IS NOT NULL UNION SELECT r.node, w.v FROM reach r JOIN both_ways w ON w.u = r.other),
heard AS (SELECT r.node, bool_or(said = 'block') AS blocks, bool_or(said = 'allow') AS allows FROM reach r JOIN spoken s ON s.node = r.other WHERE said IS NOT NULL GROUP BY r.node)
SELECT page_id, host, path, rule, coalesce(said, CASE WHEN blocks AND NOT allows THEN 'block' ELSE 'allow' END) AS verdict FROM b LEFT JOIN heard USING (node)"""

_FIELD = "coalesce(strlen({0}::VARCHAR)::VARCHAR || ':' || {0}::VARCHAR, '-')"
_IDS = " || ".join(_FIELD.format(c) for c in ("doc_id", "source", "lang", "n_chars"))
#: crc32 of the decimal id: each byte is mixed in, then shifted out bit by bit.
_CRC = """xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda ch: [ascii(ch)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))),
  lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END), 4294967295)"""
_LEVELS = """SELECT level + 1, tree, pos // 16, any_value((m + 15) // 16), sha256(string_agg(hash, '' ORDER BY pos)) FROM {0} WHERE m > 1 GROUP BY level, tree, pos // 16"""

OP11 = rf"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, source, sha256({_IDS} || {_FIELD.format("text")}) AS leaf, CASE WHEN {_CRC} % 5 = 0
  THEN sha256({_IDS} || {_FIELD.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) END AS tampered FROM documents),
s AS (SELECT source, row_number() OVER (ORDER BY encode(source) NULLS FIRST) - 1 AS tree, count(*) AS m FROM d GROUP BY source),
p AS (SELECT d.*, tree, m, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM d JOIN s ON d.source IS NOT DISTINCT FROM s.source),
lower_nodes AS (SELECT 0 AS level, tree, pos, m, leaf AS hash FROM p UNION ALL {_LEVELS.format("lower_nodes")}),
sub AS (SELECT tree, hash FROM lower_nodes WHERE m = 1),
upper_nodes AS (SELECT 0 AS level, -1 AS tree, tree AS pos, (SELECT count(*) FROM sub) AS m, hash FROM sub UNION ALL {_LEVELS.format("upper_nodes")}),
nodes AS (SELECT * FROM lower_nodes WHERE m > 1 UNION ALL SELECT * FROM upper_nodes WHERE m > 1),
runs AS (SELECT level, tree, pos // 16 AS up, list(hash ORDER BY pos) AS run FROM nodes GROUP BY ALL),
walk AS (SELECT rid, tree AS home, 0 AS level, tree, pos, m, '' AS proof, coalesce(tampered, leaf) AS hash FROM p
  UNION ALL
  SELECT w.rid, w.home, CASE WHEN w.m > 1 THEN w.level + 1 ELSE 0 END, CASE WHEN w.m > 1 THEN w.tree ELSE -1 END, CASE WHEN w.m > 1 THEN w.pos // 16 ELSE w.home END,
    CASE WHEN w.m > 1 THEN (w.m + 15) // 16 ELSE (SELECT count(*) FROM sub) END,
    CASE WHEN w.m > 1 THEN w.proof || array_to_string(r.run[:w.pos % 16], '') || array_to_string(r.run[w.pos % 16 + 2:], '') ELSE w.proof END,
    CASE WHEN w.m > 1 THEN sha256(array_to_string(r.run[:w.pos % 16], '') || w.hash || array_to_string(r.run[w.pos % 16 + 2:], '')) ELSE w.hash END
  FROM walk w LEFT JOIN runs r ON r.level = w.level AND r.tree = w.tree AND r.up = w.pos // 16 WHERE w.m > 1 OR w.tree >= 0)
SELECT doc_id, leaf, sub.hash AS subroot, walked.root_hash AS root, sha256(w.proof) AS proof_sha256, w.hash AS folded_root, w.hash = walked.root_hash AS verified
FROM walk w JOIN p USING (rid) JOIN sub ON sub.tree = p.tree, (SELECT hash AS root_hash FROM upper_nodes WHERE m = 1) walked WHERE w.m = 1 AND w.tree = -1"""

SQL = {"op5_quality_rules": OP5, "op7_pareto_mix": OP7, "op10_url_filter": OP10, "op11_merkle_manifest": OP11}
