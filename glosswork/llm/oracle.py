"""DuckDB SQL for the queries that it can express."""

from __future__ import annotations

from glosswork.llm import sharding

LOW = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ALNUM = r"regexp_extract_all({}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
T = "coalesce(text, '')"

OP1 = f"""
WITH item AS (SELECT item_id::varchar AS item, {ALNUM.format(LOW.format(T))} AS w FROM benchmark WHERE item_id IS NOT NULL),
win AS (SELECT item, i AS j, least(10, len(w)) AS k, w[i + 1:i + least(10, len(w))] AS x FROM (SELECT *, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT doc_id, row_number() OVER () AS r, {ALNUM.format(LOW.format(T))} AS w FROM documents),
met AS MATERIALIZED (SELECT r, i, j, d.k, item FROM (SELECT r, k, i, w[i + 1:i + k] AS x FROM (SELECT r, k, w, unnest(range(len(w) - k + 1)) AS i FROM doc, (SELECT DISTINCT k FROM win))) d JOIN win ON win.k = d.k AND win.x = d.x),
hit AS (SELECT DISTINCT r, i, k, item FROM met),
word AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT r, item FROM hit) GROUP BY r),
span AS (SELECT r, item, min(j) AS item_at, min(i) AS doc_at, any_value(k) + count(*) - 1 AS n FROM (SELECT *, i - row_number() OVER (PARTITION BY r, item, i - j ORDER BY i) AS run FROM met) GROUP BY r, item, i - j, run),
best AS (SELECT *, count(*) OVER (PARTITION BY r) AS spans FROM span QUALIFY row_number() OVER (PARTITION BY r ORDER BY n DESC, item, item_at, doc_at) = 1)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(word.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256, coalesce(word.n, 0) > 0 AS contaminated,
  coalesce(spans, 0) AS n_spans, best.n AS longest_words, best.item AS longest_item, item_at AS longest_item_start, doc_at AS longest_doc_start
FROM doc LEFT JOIN word USING (r) LEFT JOIN its USING (r) LEFT JOIN best USING (r)"""

OP2 = f"""
WITH RECURSIVE doc AS (SELECT doc_id, {WORDS.format(LOW.format(T))} AS w FROM documents),
shingle AS (SELECT DISTINCT doc_id, CASE WHEN len(w) < 5 THEN w ELSE w[i + 1:i + 5] END AS s FROM (SELECT *, unnest(range(greatest(len(w) - 4, 1))) AS i FROM doc WHERE len(w) > 0)),
size AS (SELECT doc_id, count(*) AS n FROM shingle GROUP BY doc_id),
link AS (SELECT x.a, x.b FROM (SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS k FROM shingle p JOIN shingle q ON p.s = q.s AND p.doc_id <> q.doc_id GROUP BY ALL) x
  JOIN size sa ON sa.doc_id = a JOIN size sb ON sb.doc_id = b WHERE 100 * k >= 75 * (sa.n + sb.n - k)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a)
SELECT r.a AS doc_id, coalesce(any_value(n), 0) AS n_shingles, min(r.b) AS component_id FROM reach r LEFT JOIN size ON size.doc_id = r.a GROUP BY r.a"""

_RULES = {"short": "n_words < 50", "repeats": "100 * n_repeat_words > 50 * n_words", "symbols": "100 * n_symbols > 10 * word_chars", "lines": "100 * n_dup_lines > 30 * n_lines"}


def _op3() -> str:
    sums = ", ".join(f"sum(({c})::int) AS f_{r}" for r, c in _RULES.items())
    rates, lows, verdict = [], [], []
    for r, c in _RULES.items():
        m, n = f"(sum(f_{r}) OVER () / sum(n) OVER ())", "sum(n) OVER ()"
        within = f"({m} * (1 - {m}))"
        between = f"((sum(f_{r} * f_{r} / n) OVER () - {n} * {m} * {m} - (count(*) OVER () - 1) * {within}) / nullif({n} - sum(n * n) OVER () / {n}, 0))"
        rates.append(f"{m} AS m_{r}, CASE WHEN coalesce({between}, 0) > 0 THEN greatest({within} / {between} - 1, 1.0) ELSE {n} END AS s_{r}")
        p = f"((f_{r} + s_{r} * m_{r}) / (n + s_{r}))"
        lows.append(f"m_{r}, {p} - 2.0 * sqrt({p} * (1 - {p}) / (n + s_{r} + 1)) AS low_{r}")
        verdict.append(f"low_{r} <= 4.0 * m_{r} AND NOT (low_{r} > m_{r} AND ({c}))")
    return rf"""
WITH t AS (SELECT doc_id, coalesce(source, chr(0)) AS host, {T} AS text, {WORDS.format(T)} AS w, list_filter(string_split({T}, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines, row_number() OVER () AS r FROM documents),
tri AS (SELECT r, i, w[i + 1:i + 3] AS x FROM (SELECT r, w, unnest(range(len(w) - 2)) AS i FROM t)),
rep AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM (SELECT *, count(*) OVER (PARTITION BY r, x) AS k FROM tri) WHERE k > 1) GROUP BY r),
m AS (SELECT doc_id, host, len(w)::bigint AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::bigint AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint AS n_symbols,
  (len(lines) - len(list_distinct(lines)))::bigint AS n_dup_lines, coalesce(n, 0) AS n_repeat_words, len(lines) AS n_lines FROM t LEFT JOIN rep USING (r)),
h AS (SELECT host, count(*)::double AS n, {sums} FROM m GROUP BY host),
prior AS (SELECT *, {", ".join(rates)} FROM h),
low AS (SELECT host, {", ".join(lows)} FROM prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, {_RULES["short"]} OR {_RULES["repeats"]} AS base_failed, NOT ({_RULES["short"]} OR {_RULES["repeats"]}) AND {" AND ".join(verdict)} AS kept FROM m JOIN low USING (host)"""


OP7 = f"""
WITH doc AS (SELECT doc_id, row_number() OVER () AS r, {WORDS.format(T)} AS w FROM documents),
win AS (SELECT r, doc_id, i, md5(array_to_string(w[i + 1:i + 50], ' ')) AS x FROM (SELECT *, unnest(range(len(w) - 49)) AS i FROM doc)),
gone AS (SELECT DISTINCT r, unnest(range(i, i + 50)) AS p FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS first FROM win) WHERE first < doc_id),
word AS (SELECT r, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM doc),
kept AS (SELECT word.r, string_agg(word, ' ' ORDER BY p) FILTER (gone.p IS NULL) AS s, count(gone.p) AS n FROM word LEFT JOIN gone USING (r, p) GROUP BY word.r)
SELECT doc_id, len(w)::bigint AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(s, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (r)"""


def _op10() -> str:
    """The placement; the table's entries are written out, and a test fills it by brute force."""
    table = ", ".join(map(str, sharding.lookup().tolist()))
    slot = f"('0x' || substr(md5(coalesce(doc_id::varchar, '')), 1, 8))::bigint % {sharding.SIZE}"
    return f"WITH t AS (SELECT [{table}] AS shard) SELECT doc_id, {slot} AS slot, 'shard-' || lpad(shard[({slot}) + 1]::varchar, 3, '0') AS shard FROM documents, t"


def _op8() -> str:
    """Budgets level by level as windows over the few nodes, then each leaf's documents in the order of their keys."""
    from glosswork.llm import mixing, registry

    levels = ("domain", "lang", "source")

    def weight(level: str) -> str:
        cases = " ".join(f"WHEN '{k}' THEN {float(v)}::double" for k, v in registry.MIX_WEIGHTS.get(level, {}).items())
        return f"(CASE {level} {cases} ELSE 1.0::double END)" if cases else "1.0::double"

    out = []
    for depth in range(1, 4):
        upper, own, here = levels[: depth - 1], levels[depth - 1], levels[:depth]
        given = "t.total AS given FROM leaf, (SELECT sum(tokens)::bigint AS total FROM leaf) t" if depth == 1 else f"any_value(got) AS given FROM leaf JOIN g{depth - 1} USING ({', '.join(upper)})"
        by = f"PARTITION BY {', '.join(upper)} " if upper else ""
        before = "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"
        out.append(f"""
n{depth} AS (SELECT {", ".join(f"leaf.{c}" if depth == 1 else c for c in here)}, sum(leaf.tokens)::bigint AS tokens, sum(leaf.tokens)::bigint * {mixing.EPOCHS} AS cap, {given} GROUP BY {", ".join(here)}{", t.total" if depth == 1 else ""}),
w{depth} AS (SELECT *, {weight(own)} AS w, cap / {weight(own)} AS ratio FROM n{depth}),
s{depth} AS (SELECT *, coalesce(sum(cap) OVER (ord {before}), 0) AS cap_before, coalesce(sum(w) OVER (ord {before}), 0) AS w_before, sum(w) OVER every AS w_all, sum(cap) OVER every AS cap_all FROM w{depth} WINDOW ord AS ({by}ORDER BY ratio, {own}), every AS ({by})),
l{depth} AS (SELECT *, max(CASE WHEN ratio > (given - cap_before) / (w_all - w_before) THEN (given - cap_before) / (w_all - w_before) END) OVER ({by}) AS lev FROM s{depth}),
f{depth} AS (SELECT *, (CASE WHEN given >= cap_all OR lev IS NULL THEN cap ELSE least(cap, floor(w * lev)) END)::bigint AS low FROM l{depth}),
r{depth} AS (SELECT *, least(given, cap_all) - sum(low) OVER ({by}) AS rest, coalesce(sum(cap - low) OVER ({by}ORDER BY ratio, {own} {before}), 0) AS room_before FROM f{depth}),
g{depth} AS (SELECT {", ".join(here)}, tokens, (low + greatest(0, least(cap - low, rest - room_before)))::bigint AS got FROM r{depth})""")
    return rf"""
WITH doc AS (SELECT doc_id, lang AS in_lang, source AS in_source, len({WORDS.format(T)})::bigint AS mix_tokens, row_number() OVER () AS r,
  'domain' || coalesce(try_cast(regexp_extract(source, '([0-9]+)', 1) AS int) % 4, 0)::varchar AS domain, coalesce(lang, chr(0)) AS lang, coalesce(source, chr(0)) AS source FROM documents),
leaf AS (SELECT domain, lang, source, sum(mix_tokens)::bigint AS tokens FROM doc GROUP BY domain, lang, source),{",".join(out)},
leaves AS (SELECT *, CASE WHEN tokens > 0 THEN got // tokens ELSE 0 END AS whole FROM g3),
keyed AS (SELECT doc.*, whole, got - whole * tokens AS rest, substr(md5('{mixing.SEED}:' || whole::varchar || ':' || doc_id::varchar), 1, 15) AS k FROM doc JOIN leaves USING (domain, lang, source)),
run AS (SELECT *, sum(mix_tokens) OVER (PARTITION BY domain, lang, source ORDER BY k, doc_id::varchar, mix_tokens RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto FROM keyed)
SELECT doc_id, in_lang AS lang, in_source AS source, mix_tokens, (whole + (upto <= rest)::int)::int AS mix_copies FROM run"""


OP11 = rf"""
WITH t AS (SELECT doc_id, {T} AS t, regexp_extract_all({T}, '[^\n]*\n|[^\n]+') AS u, sha256('7:' || coalesce(doc_id::varchar, '')) AS h FROM documents),
h AS (SELECT doc_id, t, u, len(u)::bigint AS n, [('0x' || substr(h, 8 * i + 1, 8))::bigint FOR i IN range(4)] AS h FROM t),
cut AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
  CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 THEN 'plain' WHEN h[4] % 100 < 50 THEN 'spm' ELSE 'psm' END AS form FROM h),
part AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid, array_to_string(u[b + 1:], '') AS suf FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256, sha256(t) AS restored_sha256 FROM part"""

OP13 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::bigint AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to FROM f"""


def sql() -> dict[str, str]:
    return {"op1_decontamination": OP1, "op2_ngram_join": OP2, "op3_quality_rules": _op3(), "op7_substring_dedup": OP7, "op8_mixing": _op8(), "op10_sharding": _op10(), "op11_fill_in_middle": OP11, "op13_warc": OP13}
