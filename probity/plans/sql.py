"""SQL that gives the rows of the registered queries, for checking them in another engine."""

from __future__ import annotations

import math

from probity.operators.stylometry import FUNCTION_WORDS

_DOWN = "list_transform(range(60, 0, -1), lambda n: n::DOUBLE)"


def erfc(x: str) -> str:
    low = f"(1e0 - {2 / math.sqrt(math.pi)!r} * {x} * exp(-{x} * {x}) * list_reduce(list_prepend(1e0, {_DOWN}), lambda a, n: 1e0 + a * 2e0 * {x} * {x} / (2e0 * n + 1e0)))"
    high = f"(exp(-{x} * {x}) / ({math.sqrt(math.pi)!r} * list_reduce(list_prepend({x}, {_DOWN}), lambda a, n: {x} + n / 2e0 / a)))"
    return f"(CASE WHEN {x} < 2 THEN {low} ELSE {high} END)"


def chi2_even(x: str, k: int) -> str:
    return f"(exp(-{x} / 2) * (" + " + ".join(f"power({x} / 2, {j}) / {math.factorial(j)}" for j in range(k // 2)) + "))"


def chi2_odd(x: str, k: int) -> str:
    terms, odd = [], 1.0
    for r in range(1, (k - 1) // 2 + 1):
        odd *= 2 * r - 1
        terms.append(f"power({x}, {r - 0.5}) / {odd!r}")
    tail = f" + {math.sqrt(2 / math.pi)!r} * exp(-{x} / 2) * ({' + '.join(terms)})" if terms else ""
    return f"({erfc(f'sqrt({x} / 2)')}{tail})"


def t_two_tailed(t: str, df: str) -> str:
    th, c = f"atan(abs({t}) / sqrt({df}::DOUBLE))", f"power(cos(atan(abs({t}) / sqrt({df}::DOUBLE))), 2)"
    series = lambda top, ratio: f"list_reduce(list_prepend(1e0, list_transform(range({top}, 0, -1), lambda k: k::DOUBLE)), lambda a, k: 1e0 + a * {c} * {ratio})"
    even = f"sin({th}) * {series(f'({df}) // 2 - 1', '(2e0 * k - 1e0) / (2e0 * k)')}"
    odd = f"{2 / math.pi!r} * ({th} + CASE WHEN {df} > 1 THEN sin({th}) * cos({th}) * {series(f'(({df}) - 3) // 2', '2e0 * k / (2e0 * k + 1e0)')} ELSE 0 END)"
    return f"(1e0 - CASE WHEN ({df}) % 2 = 0 THEN {even} ELSE {odd} END)"


LEAD = "substr(printf('%.14e', {x}), 1, 1)::INT"
BENFORD = [math.log10(1 + 1 / d) for d in range(1, 10)]


def _benford(tbl: str, value: str, by: str) -> str:
    counts = ", ".join(f"count(*) FILTER (d = {d}) AS c{d}" for d in range(1, 10))
    x2 = " + ".join(f"power(c{d} - n * {e!r}, 2) / (n * {e!r})" for d, e in enumerate(BENFORD, 1))
    dev = " + ".join(f"abs(c{d} / n - {e!r})" for d, e in enumerate(BENFORD, 1))
    return f"""
WITH v AS (SELECT {by}, {value} AS x, {LEAD.format(x=value)} AS d FROM {tbl} WHERE {value} > 0 AND isfinite({value})),
c AS (SELECT {by}, count(*) AS n, log10(max(x) / min(x)) AS span, {counts} FROM v GROUP BY {by}),
s AS (SELECT *, {x2} AS x2, ({dev}) / 9 AS dev FROM c), p AS (SELECT *, {chi2_even("x2", 8)} AS p, n >= 50 AS ok FROM s)
SELECT {by}, n, CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS status, CASE WHEN ok THEN round(x2, 3) END AS chi2, CASE WHEN ok THEN round(p, 4) END AS p_value, CASE WHEN ok THEN round(dev, 4) END AS mad,
  CASE WHEN ok THEN dev > 0.015 END AS mad_nonconforming, CASE WHEN ok THEN CASE WHEN p < 0.01 THEN 'SIGNIFICANT' WHEN p < 0.05 THEN 'SUSPICIOUS' WHEN p < 0.1 THEN 'MARGINAL' ELSE 'CONSISTENT' END END AS verdict,
  CASE WHEN ok THEN span >= 2 END AS applicable
FROM p"""


def _last(tbl: str, value: str, by: str) -> str:
    x2 = " + ".join(f"power(c{d} - n / 10, 2) / (n / 10)" for d in range(10))
    pick = lambda t: "concat_ws(','," + ",".join(f"CASE WHEN {t.format(c=f'c{d}')} THEN '{d}' END" for d in range(10)) + ")"
    return f"""
WITH v AS (SELECT {by}, floor(abs({value}))::BIGINT % 10 AS d FROM {tbl} WHERE {value} IS NOT NULL),
c AS (SELECT {by}, count(*) AS n, {", ".join(f"count(*) FILTER (d = {d}) AS c{d}" for d in range(10))} FROM v GROUP BY {by}),
s AS (SELECT *, {x2} AS x2 FROM c), p AS (SELECT *, {chi2_odd("x2", 9)} AS p, n >= 30 AS ok FROM s)
SELECT {by}, n, CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS status, CASE WHEN ok THEN round(x2, 2) END AS chi2, CASE WHEN ok THEN round(p, 4) END AS p_value, CASE WHEN ok THEN p > 0.01 END AS natural,
  CASE WHEN ok THEN {pick("{c} > n / 5")} END AS over, CASE WHEN ok THEN {pick("{c} < 0.03 * n AND {c} < 5")} END AS under, CASE WHEN ok THEN round((c0 + c5) / n, 4) END AS round_share
FROM p"""


def _simpson(f: str, low: str, high: str, n: int) -> str:
    """The integral of f, an expression in u, by Simpson's rule with n steps."""
    step = f"(({high}) - ({low})) / {n}"
    at = f"(({low}) + i * {step})"
    return f"list_sum(list_transform(range(0, {n + 1}), lambda i: (CASE WHEN i = 0 OR i = {n} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * {f.replace('u', at)})) * {step} / 3"


def t_integrated(t: str, v: str) -> str:
    """Both tails of Student's t by integration of its density, for any degrees of freedom."""
    body = _simpson(f"exp(-(({v}) + 1e0) / 2 * ln(1 + u * u / ({v})))", "0e0", t, 400)
    return f"(1 - 2 * exp(lgamma((({v}) + 1e0) / 2) - lgamma(({v}) / 2e0)) / sqrt(({v}) * pi()) * {body})"


def chi2_integrated(x: str, k: str) -> str:
    return _simpson(f"exp((({k}) / 2 - 1) * ln(u) - u / 2 - ({k}) / 2 * ln(2e0) - lgamma(({k}) / 2))", x, f"{x} + 160", 8000)


_CASE = "SELECT l_partkey % 40 AS case_id, round(avg(l_quantity) / 5, 2) AS stat FROM lineitem GROUP BY 1"


def _recheck(rows: str, p: str) -> str:
    return f"""
WITH r AS ({rows}), q AS (SELECT *, {p} AS p FROM r), g AS (SELECT *, abs(reported_p - p) AS gap FROM q)
SELECT case_id, CASE WHEN p IS NULL THEN 'invalid' ELSE 'ok' END AS status, round(p, 6) AS p_value, gap < 0.001 AS matches,
  CASE WHEN p IS NULL THEN 'INVALID' WHEN reported_p = 0 THEN 'CRITICAL_ZERO' WHEN reported_p < 0 THEN 'CRITICAL_NEGATIVE' WHEN reported_p > 1 THEN 'CRITICAL_ABOVE_ONE'
       WHEN gap > 0.05 THEN 'HIGH' WHEN gap > 0.01 THEN 'MODERATE' WHEN gap > 0.001 THEN 'MINOR' WHEN gap < 0.001 THEN 'OK' ELSE 'UNDETERMINED' END AS verdict
FROM g"""


_TOKENS = r"list_filter(regexp_split_to_array(regexp_replace(lower(replace(coalesce({t}, ''), chr(160), ' ')), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda x: x <> '')"
_DEDUP = "list_filter(" + _TOKENS + ", lambda x: length(x) > 1)"
_SHINGLES = "CASE WHEN len(w) < 6 THEN []::VARCHAR[] ELSE list_distinct(list_transform(range(1, len(w) - 4), lambda i: array_to_string(list_slice(w, i, i + 5), ' '))) END"


def _sets(tbl: str, key: str, extra: str = "") -> str:
    return f"SELECT {key}, unnest(s) AS x, len(s) AS n FROM (SELECT {key}, {_SHINGLES} AS s FROM (SELECT {key}, {_DEDUP.format(t='text')} AS w FROM {tbl} {extra}))"


def _style() -> str:
    words = ", ".join(f"'{w}'" for w in FUNCTION_WORDS)
    stats = lambda a: f"len({a})::BIGINT AS n_{a}, list_avg({a}) AS m_{a}, list_stddev_pop({a}) AS d_{a}"
    count = lambda a: f"list_filter(list_transform({a}, lambda y: len({_TOKENS.format(t='y')})::DOUBLE), lambda n: n > 0)"
    return rf"""
WITH b AS (
  SELECT doc_id, length(coalesce(text, ''))::BIGINT AS n_chars, {_TOKENS.format(t="text")} AS w,
    list_filter(string_split(regexp_replace(trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), '([.!?])\s+', concat('\1', chr(1)), 'g'), chr(1)), lambda x: length(trim(x)) > 5) AS ss,
    list_filter(regexp_split_to_array(coalesce(text, ''), '\n\s*\n'), lambda x: length(trim(x)) > 20) AS pp
  FROM (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN replace(text, chr(10), chr(10) || chr(10)) ELSE text END AS text FROM documents)
), l AS (SELECT doc_id, n_chars, w, len(w)::BIGINT AS n_words, {count("ss")} AS s, len(pp)::BIGINT AS n_paragraphs, {count("pp")} AS p FROM b),
f AS (SELECT *, {stats("s")}, {stats("p")}, list_distinct(w) AS dw FROM l),
g AS (SELECT doc_id, count(*) AS hapax_n FROM (SELECT doc_id, x FROM (SELECT doc_id, unnest(w) AS x FROM l) GROUP BY 1, 2 HAVING count(*) = 1) GROUP BY 1),
e AS (SELECT doc_id, log2(sum(c)) - sum(c * log2(c)) / sum(c) AS entropy FROM
  (SELECT doc_id, x, count(*) AS c FROM (SELECT doc_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS x FROM l) GROUP BY 1, 2) GROUP BY 1)
SELECT f.doc_id, n_chars, n_words, n_s AS n_sentences, round(coalesce(m_s, 0) + 1e-9, 2) AS sentence_mean, round(coalesce(d_s, 0) + 1e-9, 2) AS sentence_sd, round(coalesce(CASE WHEN m_s > 0 THEN d_s / m_s ELSE 0 END, 0) + 1e-9, 3) AS sentence_cv,
  round(CASE WHEN n_words > 0 THEN len(dw) / n_words ELSE 0 END, 4) AS type_token_ratio, round(coalesce(entropy, 0), 3) AS bigram_entropy, round(CASE WHEN len(dw) > 0 THEN coalesce(hapax_n, 0) / len(dw) ELSE 0 END, 4) AS hapax_ratio,
  round(CASE WHEN n_words > 0 THEN 100 * len(list_filter(w, lambda x: x IN ({words}))) / n_words ELSE 0 END, 2) AS function_word_pct, n_paragraphs,
  CASE WHEN n_paragraphs >= 2 THEN round(CASE WHEN m_p > 0 THEN d_p / m_p ELSE 0 END, 3) END AS paragraph_cv
FROM f LEFT JOIN g USING (doc_id) LEFT JOIN e USING (doc_id)"""


def _score() -> str:
    step = lambda c, rows, op: "CASE " + " ".join(f"WHEN {c} {op} {b} THEN {v}" for b, v in rows) + " ELSE 0 END"
    parts = (
        ("sentence_cv > 0", 20, step("sentence_cv", ((0.25, 20), (0.35, 10), (0.45, 3)), "<")), ("n_words > 200", 10, step("type_token_ratio", ((0.20, 10), (0.30, 5)), "<")),
        ("bigram_entropy > 0", 25, step("bigram_entropy", ((5, 25), (6.5, 18), (7.5, 10), (8.5, 3)), "<")), ("paragraph_cv > 0 AND n_paragraphs >= 3", 15, step("paragraph_cv", ((0.30, 15), (0.50, 7), (0.70, 2)), "<")),
        ("hapax_ratio > 0", 15, step("hapax_ratio", ((0.65, 15), (0.55, 8), (0.45, 3)), ">")), ("function_word_pct > 0", 15, step("function_word_pct", ((50, 15), (45, 8), (40, 3)), ">")),
    )
    points = " + ".join(f"CASE WHEN {g} THEN {s} ELSE 0 END" for g, _, s in parts)
    most = " + ".join(f"CASE WHEN {g} THEN {m} ELSE 0 END" for g, m, _ in parts)
    return f"""
WITH st AS ({_style()}), sc AS (SELECT *, ({points})::INT AS points, ({most})::INT AS possible FROM st), pc AS (SELECT *, CASE WHEN possible > 0 THEN 100e0 * points / possible ELSE 0 END AS x FROM sc)
SELECT doc_id, CASE WHEN n_chars >= 100 THEN 'ok' ELSE 'insufficient' END AS status, points, possible, round(x, 2) AS pct,
  CASE WHEN n_chars >= 100 THEN CASE WHEN x >= 60 THEN 'VERY_LIKELY_LLM' WHEN x >= 45 THEN 'LIKELY_ASSISTED' WHEN x >= 30 THEN 'POSSIBLY' WHEN x >= 15 THEN 'MOSTLY_HUMAN' ELSE 'STRONGLY_HUMAN' END END AS verdict
FROM pc"""


_LEVEL = "CASE WHEN j > 0.3 THEN 'HIGH' WHEN j > 0.15 THEN 'MODERATE' WHEN j > 0.05 THEN 'LOW' ELSE 'MINIMAL' END"
_TAGGED = """SELECT doc_id, source, concat(text, ' See doi:10.1234/abc.', doc_id, '), also 10.12/x', doc_id, '; <10.98765/Q-', doc_id % 7, '> and 10.5555/RET', doc_id % 5, '", 11.1234/no 10.1234/.') AS text FROM documents"""
_DOIS = rf"""SELECT DISTINCT doc_id, source, doi FROM (SELECT doc_id, source, rtrim(unnest(regexp_extract_all(text, '10\.[0-9]{{4,9}}/[^\s,;"''<>)]+')), '.,;:)"''>') AS doi FROM ({_TAGGED}))
  WHERE regexp_matches(rtrim(trim(doi), '.,;:'), '^10\.[0-9]{{4,9}}/.')"""
_SALAMI = """SELECT x.source, p.a, p.b, p.jaccard, p.level FROM ({pairs}) p JOIN documents x ON x.doc_id = p.a JOIN documents y ON y.doc_id = p.b WHERE x.source = y.source"""
_HASH = "SELECT vec_id, label, list_reduce(list_prepend(0::UBIGINT, list_transform(embedding, lambda x: (CASE WHEN x::DOUBLE > m THEN 1 ELSE 0 END)::UBIGINT)), lambda h, b: ((h & 9223372036854775807::UBIGINT) << 1) | b) AS h FROM (SELECT *, list_sum(list_transform(embedding, lambda x: x::DOUBLE)) / 64 AS m FROM embeddings)"
_EXIF = """SELECT *, CASE WHEN has THEN (t1 IS NOT NULL)::INT + (t2 IS NOT NULL)::INT + 1 ELSE 0 END::BIGINT AS n_times, has AND (coalesce(t1 <> '2024:01:01', false) OR coalesce(t2 <> '2024:01:01', false)) AS differ FROM (
  SELECT event_id, event_type, CASE WHEN event_id % 5 <> 0 THEN ['Adobe Photoshop 24', 'GIMP 2.10', 'Illustrator', 'Matplotlib 3', 'Inkscape', 'Canon', NULL][event_id % 7 + 1] END AS software,
  CASE WHEN event_id % 5 <> 0 AND event_id % 4 <> 0 THEN concat('2024:01:0', CASE WHEN event_type IN ('view', 'click') THEN 1 ELSE event_id % 3 + 1 END) END AS t1,
  CASE WHEN event_id % 5 <> 0 AND event_type = 'signup' AND event_id % 2 = 0 THEN '2024:01:05' END AS t2, event_id % 5 <> 0 AS has, event_id % 11 = 0 AS failed FROM events)"""
_CORR = """SELECT paper_id, s * r12 AS r12, s * (CASE WHEN paper_id % 3 = 0 THEN r12 ELSE r13 END) AS r13, s * (CASE WHEN paper_id % 3 = 0 THEN -r12 ELSE r23 END) AS r23, CASE WHEN paper_id % 4 = 1 THEN 5e-1 ELSE 1e0 END AS half, CASE WHEN paper_id % 4 = 2 THEN 98e-2 ELSE 1e0 END AS r33
  FROM (SELECT l_suppkey AS paper_id, corr(l_quantity, l_extendedprice) AS r12, corr(l_quantity, l_discount) AS r13, corr(l_extendedprice, l_tax) AS r23, CASE WHEN l_suppkey % 4 = 3 THEN 12e-1 ELSE 1e0 END AS s FROM lineitem GROUP BY l_suppkey)"""
_MATRIX = f"""SELECT paper_id, i, j, CASE WHEN i = 3 AND j = 3 THEN r33 WHEN i = j THEN 1e0 WHEN i = 1 AND j = 2 THEN r12 WHEN i = 2 AND j = 1 THEN r12 * half WHEN i + j = 4 THEN r13 ELSE r23 END AS r
  FROM ({_CORR}), (VALUES (1, 1), (2, 2), (3, 3), (1, 2), (2, 1), (1, 3), (3, 1), (2, 3), (3, 2)) m(i, j)"""
_PIXELS = """SELECT vec_id // 64 AS image_id, ((vec_id % 64) % 8) * 8 + (k - 1) % 8 AS x, ((vec_id % 64) // 8) * 8 + (k - 1) // 8 AS y, floor((v::DOUBLE + 1) * 127.5) AS v FROM (SELECT vec_id, unnest(embedding) AS v, unnest(range(1, 65)) AS k FROM embeddings)"""


def _findings() -> str:
    return f"""
SELECT o_orderpriority AS paper_id, '1.2' AS dim, CASE WHEN verdict = 'SIGNIFICANT' THEN 'HIGH' WHEN verdict = 'SUSPICIOUS' THEN 'MEDIUM' END AS sev FROM ({SQL["benford_orders"]})
UNION ALL SELECT o_orderpriority, '1.2', CASE WHEN NOT "natural" THEN 'MEDIUM' END FROM ({_last("orders", "o_totalprice", "o_orderpriority")})
UNION ALL SELECT o_orderpriority, '2.1', CASE WHEN uniform_like THEN 'HIGH' END FROM ({_uniform("orders", "o_totalprice", "o_orderpriority")})
UNION ALL SELECT source, '1.1', CASE WHEN n >= 10 THEN 'MEDIUM' WHEN n > 0 THEN 'LOW' END FROM (SELECT source, count(*) FILTER (verdict IN ('VERY_LIKELY_LLM', 'LIKELY_ASSISTED')) AS n FROM ({_score()}) JOIN documents USING (doc_id) GROUP BY source)
UNION ALL SELECT source, '1.3', CASE WHEN n_retracted > 0 THEN 'CRITICAL' END FROM ({SQL["retraction_join"]})"""


def _uniform(tbl: str, value: str, by: str) -> str:
    return f"""
WITH e AS (SELECT {by}, {value} AS x, min({value}) OVER (PARTITION BY {by}) AS lo, max({value}) OVER (PARTITION BY {by}) AS hi FROM {tbl} WHERE {value} IS NOT NULL),
c AS (SELECT {by}, count(*) AS n, max(lo) AS lo, max(hi) AS hi, {", ".join(f"count(*) FILTER (least(floor((x - lo) / ((hi - lo) / 10)), 9) = {b}) AS b{b}" for b in range(10))} FROM e GROUP BY {by}),
s AS (SELECT *, {" + ".join(f"power(b{b} - n / 10, 2) / (n / 10)" for b in range(10))} AS x2, n >= 20 AND hi > lo AS ok FROM c), p AS (SELECT *, {chi2_odd("x2", 9)} AS p FROM s)
SELECT {by}, n, CASE WHEN n < 20 THEN 'insufficient' WHEN hi = lo THEN 'constant' ELSE 'ok' END AS status, CASE WHEN ok THEN round(x2, 3) END AS chi2, CASE WHEN ok THEN round(p, 4) END AS p_value, CASE WHEN ok THEN p > 0.05 END AS uniform_like, CASE WHEN ok THEN p < 0.001 END AS strongly_not
FROM p"""


def _anderson(tbl: str, value: str, by: str, digits: int) -> str:
    return f"""WITH r AS (SELECT {by}, row_number() OVER (PARTITION BY {by} ORDER BY {value}) AS i, count(*) OVER (PARTITION BY {by}) AS n, ({value} - avg({value}) OVER (PARTITION BY {by})) / stddev_samp({value}) OVER (PARTITION BY {by}) AS z FROM {tbl}),
      h AS (SELECT *, abs(z) / sqrt(2e0) AS y FROM r), u AS (SELECT *, {erfc("y")} / 2 AS tail FROM h), f AS (SELECT *, CASE WHEN z >= 0 THEN 1 - tail ELSE tail END AS p, CASE WHEN z >= 0 THEN tail ELSE 1 - tail END AS q FROM u)
      SELECT {by}, max(n) AS n, round(-max(n) - sum((2 * i - 1) * ln(greatest(p, 1e-10)) + (2 * (n - i) + 1) * ln(greatest(q, 1e-10))) / max(n), {digits}) AS a2 FROM f GROUP BY 1"""


def _totals(pairs: str) -> str:
    return f"""WITH p AS ({pairs}) SELECT label, n_images, n_images * (n_images - 1) // 2 AS n_pairs, coalesce(n, 0) AS n_suspicious FROM (SELECT label, count(*) AS n_images FROM embeddings GROUP BY 1) LEFT JOIN (SELECT label, count(*) AS n FROM p JOIN embeddings ON vec_id = a GROUP BY 1) USING (label)"""


def _clones(threshold: int) -> str:
    return f"""WITH o AS ({_PIXELS}), p AS (SELECT * FROM o WHERE NOT (image_id % 2 = 0 AND x >= 32 AND y >= 32) UNION ALL SELECT image_id, x + 32, y + 32, v FROM o WHERE image_id % 2 = 0 AND x < 32 AND y < 32),
      w AS (SELECT image_id, i.range * 16 AS x0, j.range * 16 AS y0, (y - j.range * 16) // 4 AS r, (x - i.range * 16) // 4 AS c, v FROM p, range(3) i, range(3) j WHERE x >= i.range * 16 AND x < i.range * 16 + 32 AND y >= j.range * 16 AND y < j.range * 16 + 32),
      c AS (SELECT image_id, x0, y0, r, c, avg(v) AS m, sum(v) AS s, sum(v * v) AS q, count(*) AS n FROM w GROUP BY ALL), g AS (SELECT image_id, x0, y0, list(m ORDER BY r, c) AS g, sqrt(greatest(sum(q) / sum(n) - power(sum(s) / sum(n), 2), 0)) AS sd FROM c GROUP BY ALL HAVING count(*) = 64),
      h AS (SELECT image_id, x0, y0, list_reduce(list_prepend(0::UBIGINT, list_transform(g, lambda z: (CASE WHEN z > list_sum(g) / 64 THEN 1 ELSE 0 END)::UBIGINT)), lambda a, b: ((a & 9223372036854775807::UBIGINT) << 1) | b) AS h FROM g WHERE sd >= 15),
      d AS (SELECT a.image_id, a.x0 AS x1, a.y0 AS y1, b.x0 AS x2, b.y0 AS y2, bit_count(xor(a.h, b.h))::BIGINT AS distance FROM h a JOIN h b ON a.image_id = b.image_id AND (a.y0, a.x0) < (b.y0, b.x0) WHERE abs(a.x0 - b.x0) >= 32 OR abs(a.y0 - b.y0) >= 32)
      SELECT image_id, x1, y1, x2, y2, distance, CASE WHEN distance = 0 THEN 'CRITICAL' ELSE 'HIGH' END AS severity FROM d WHERE distance <= {threshold}"""


def _lines(rows: str, key: str, parts: list[str]) -> str:
    """One row for each part that is not null."""
    return f"""WITH r AS ({rows}), l AS (SELECT {key}, list_filter([{", ".join(parts)}], lambda x: x IS NOT NULL) AS ls FROM r)
      SELECT {key}, unnest(range(1, len(ls) + 1))::INT AS line_no, unnest(ls) AS line FROM l"""


def _field(label: str, value: str, form: str = "%s") -> str:
    return f"CASE WHEN {value} IS NOT NULL THEN printf('{label}: {form}', {value}) END"


_T_ROWS = """SELECT l_partkey % 40 AS case_id, l_partkey % 40 + 3 AS df, round((avg(l_quantity) - 25) / (stddev_samp(l_quantity) / sqrt(count(*))), 2) AS stat,
  CASE WHEN case_id % 8 = 0 THEN 0e0 WHEN case_id % 8 = 1 THEN 12e-1 WHEN case_id % 8 = 2 THEN -1e-1 ELSE case_id * 2e-2 END AS reported_p FROM lineitem GROUP BY l_partkey % 40"""
_skew = "CASE WHEN n < 3 OR lo = hi THEN 0 ELSE sk END"
_kurt = "CASE WHEN n < 4 OR lo = hi THEN 0 ELSE ku END"

SQL = {
    "benford_audit": _benford("events", "value", "event_type"),
    "benford_orders": _benford("orders", "o_totalprice", "o_orderpriority"),
    "benford_digits": f"""WITH v AS (SELECT l_returnflag, {LEAD.format(x="l_extendedprice")} AS digit FROM lineitem WHERE l_extendedprice > 0), t AS (SELECT l_returnflag, count(*) AS n FROM v GROUP BY 1),
      g AS (SELECT l_returnflag, n, d.range::INT AS digit, log10(1 + 1e0 / d.range) AS e FROM t, range(1, 10) d WHERE n >= 50), o AS (SELECT l_returnflag, digit, count(*) AS c FROM v GROUP BY 1, 2)
      SELECT l_returnflag, digit, round(e * 100, 2) AS expected_pct, round(coalesce(c, 0) * 100 / n, 2) AS actual_pct, round(n * e, 1) AS expected, coalesce(c, 0) AS actual, round((coalesce(c, 0) - n * e) / sqrt(n * e), 2) AS z, abs((coalesce(c, 0) - n * e) / sqrt(n * e)) > 2 AS flagged
      FROM g LEFT JOIN o USING (l_returnflag, digit)""",
    "last_digit": _last("lineitem", "l_extendedprice", "l_returnflag"),
    "uniform_chi2": _uniform("customer", "c_acctbal", "c_mktsegment"),
    "moments": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(avg(l_quantity), 6) AS mean, round(var_samp(l_quantity), 6) AS variance, round(stddev_samp(l_quantity), 6) AS sd, round(skewness(l_quantity), 6) AS skewness, round(kurtosis(l_quantity), 6) AS kurtosis FROM lineitem GROUP BY ALL",
    "normality": f"""WITH m AS (SELECT event_type, count(*) AS n, avg(value) AS mean, stddev_samp(value) AS sd, skewness(value) AS sk, kurtosis(value) AS ku, min(value) AS lo, max(value) AS hi FROM events GROUP BY 1), q AS (SELECT *, {_skew} AS s, {_kurt} AS k FROM m)
      SELECT event_type, n, CASE WHEN n >= 10 THEN 'ok' ELSE 'insufficient' END AS status, round(mean, 4) AS mean, round(sd, 4) AS sd, round(s, 4) AS skewness, round(k, 4) AS kurtosis, CASE WHEN n >= 10 THEN round(greatest(0, 1 - (0.05 * abs(k) + 0.1 * abs(s))), 4) END AS w_surrogate,
      CASE WHEN n >= 10 THEN concat_ws(',', CASE WHEN abs(s) > 2 THEN 'strong skew' WHEN abs(s) > 1 THEN 'moderate skew' END, CASE WHEN k > 2 THEN 'heavy tails' WHEN k < -1 THEN 'too uniform' END) END AS notes FROM q""",
    "anderson_darling": _anderson("customer", "c_acctbal", "c_mktsegment", 4),
    "runs_test": f"""WITH b AS (SELECT user_id, (value > 50)::INT AS b, lag((value > 50)::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events), c AS (SELECT user_id, count(*) AS n, sum(b)::BIGINT AS n1, (count(*) FILTER (prev IS NULL OR prev <> b))::BIGINT AS runs FROM b GROUP BY 1),
      m AS (SELECT *, 2e0 * n1 * (n - n1) AS k FROM c), v AS (SELECT *, k / n + 1 AS mu, k * (k - n) / (n * n * (n - 1e0)) AS var FROM m), z AS (SELECT *, CASE WHEN var > 0 THEN (runs - mu) / sqrt(var) END AS z FROM v), y AS (SELECT *, abs(z) / sqrt(2e0) AS y FROM z), p AS (SELECT *, {erfc("y")} AS p FROM y),
      s AS (SELECT *, CASE WHEN n < 10 THEN 'insufficient' WHEN n1 = 0 OR n1 = n OR z IS NULL THEN 'invalid' ELSE 'ok' END AS status FROM p)
      SELECT user_id, n, n1, runs, status, CASE WHEN status = 'ok' THEN round(mu, 4) END AS expected_runs, CASE WHEN status = 'ok' THEN round(z, 4) END AS z, CASE WHEN status = 'ok' THEN round(p, 4) END AS p_value, CASE WHEN status = 'ok' THEN p > 0.01 END AS random, CASE WHEN status = 'ok' THEN CASE WHEN z < -2 THEN 'too few' WHEN z > 2 THEN 'too many' ELSE 'as expected' END END AS note FROM s""",
    "p_curve": f"""WITH b AS (SELECT l_returnflag AS paper_id, CASE WHEN NOT (l_tax > 0 AND l_tax < 5e-2) THEN NULL WHEN l_tax <= 1e-2 THEN 0 WHEN l_tax <= 2e-2 THEN 1 WHEN l_tax <= 3e-2 THEN 2 WHEN l_tax <= 4e-2 THEN 3 ELSE 4 END AS b FROM lineitem),
      c AS (SELECT paper_id, count(*) AS n_all, count(b) AS n, {", ".join(f"count(*) FILTER (b = {i}) AS c{i + 1}" for i in range(5))} FROM b GROUP BY 1),
      s AS (SELECT *, CASE WHEN n < 5 THEN 0 ELSE 25e-3 - ({" + ".join(f"{(2 * i + 1) * 0.005!r}::DOUBLE * c{i + 1} / n" for i in range(5))}) END AS k, {" + ".join(f"power(c{i} - n / 5, 2) / (n / 5)" for i in range(1, 6))} AS x2, n_all >= 3 AND n >= 1 AS ok FROM c), p AS (SELECT *, round({chi2_even("x2", 4)}, 4) AS pv FROM s)
      SELECT paper_id, n_all, n, c1, c2, c3, c4, c5, CASE WHEN ok THEN 'ok' ELSE 'insufficient' END AS status, CASE WHEN ok THEN round(k, 4) END AS skew, CASE WHEN ok THEN round(x2, 3) END AS chi2, CASE WHEN ok THEN pv END AS p_value,
        CASE WHEN ok THEN CASE WHEN k > 0.005 THEN 'RIGHT' WHEN k > 1e-12 THEN 'WEAK' WHEN k > -0.003 THEN 'FLAT' ELSE 'LEFT' END END AS shape, CASE WHEN ok THEN CASE WHEN pv < 0.05 AND c5 / (n / 5) > 1.5 AND c1 / (n / 5) < 0.8 THEN 'CLIFF' WHEN pv < 0.05 AND c5 / (n / 5) > 1.3 THEN 'CLUSTER' ELSE 'NONE' END END AS cluster,
        CASE WHEN ok THEN CASE WHEN c5 / n > 0.3 THEN 'HIGH' WHEN c5 / n > 0.2 THEN 'WARN' ELSE 'OK' END END AS borderline, CASE WHEN ok THEN concat_ws(',', {", ".join(f"CASE WHEN abs(c{i} - n / 5) / (n / 5) > 0.5 THEN '{i}' END" for i in range(1, 6))}) END AS odd_bins FROM p""",
    "stat_check_t": _recheck(_T_ROWS, t_two_tailed("stat", "df")),
    "stat_check_f": _recheck(f"SELECT case_id, stat, case_id + 2 AS df2, case_id * 3e-3 AS reported_p FROM ({_CASE})", "power(df2 / (df2 + 2 * stat), df2 / 2)"),
    "stat_check_chi2": _recheck(f"SELECT case_id, stat * 2 AS stat, case_id % 6 + 1 AS df, case_id * 1e-2 AS reported_p FROM ({_CASE})", "CASE df " + " ".join(f"WHEN {k} THEN {chi2_odd('stat', k) if k % 2 else chi2_even('stat', k)}" for k in range(1, 7)) + " END"),
    "stat_check_r": _recheck(f"SELECT *, CASE WHEN abs(r) < 1 AND df > 0 THEN r * sqrt(df / (1 - r * r)) END AS tt FROM (SELECT case_id, stat / 6 AS r, case_id + 1 AS df, case_id * 1e-2 AS reported_p FROM ({_CASE}))", f"CASE WHEN tt IS NOT NULL THEN {t_two_tailed('tt', 'df')} END"),
    "df_consistency": """WITH r AS (SELECT ['independent_t', 'paired_t', 'correlation', 'anova_between'][l_linenumber % 4 + 1] AS design, floor(l_quantity)::BIGINT AS n, l_orderkey % 50 AS df FROM lineitem), q AS (SELECT *, df + CASE design WHEN 'paired_t' THEN 1 WHEN 'anova_between' THEN 3 ELSE 2 END AS need FROM r)
      SELECT design, count(*) AS n_cases, count(*) FILTER (n = need) AS n_consistent, sum(need)::BIGINT AS sum_implied FROM q GROUP BY 1""",
    "effect_sizes": f"""WITH r AS (SELECT case_id, ['t', 't_paired', 'corr', 'anova', 'chisq', 'sign'][case_id % 6 + 1] AS test, case_id * 2 + 6 AS n, stat, case_id * 3e-2 AS res FROM ({_CASE})),
      e AS (SELECT *, CASE test WHEN 't' THEN stat * sqrt(1e0 / n + 1e0 / n) WHEN 't_paired' THEN stat / sqrt(n - 1e0) WHEN 'corr' THEN sqrt(stat * stat / (stat * stat + (n - 2))) WHEN 'anova' THEN stat * 1 / (stat * 1 + (n - 2)) WHEN 'chisq' THEN sqrt(stat / n) END AS e FROM r)
      SELECT case_id, test, CASE WHEN test = 'sign' THEN 'skipped' ELSE 'ok' END AS status, round(e, 4) AS implied_es, CASE WHEN test = 'anova' THEN round(sqrt(e / (1 - e)), 4) END AS cohens_f, CASE WHEN test = 'chisq' AND e < 1 THEN round((1 + e) / (1 - e), 4) END AS odds_ratio,
        CASE WHEN e IS NULL THEN NULL WHEN test IN ('t', 't_paired') THEN CASE WHEN e > 2.5 THEN 'EXTREME' WHEN e > 1.5 AND n < 30 THEN 'SUSPICIOUS' WHEN e > 1 THEN 'LARGE' WHEN e > 0.5 THEN 'MEDIUM' WHEN e > 0.2 THEN 'SMALL' ELSE 'VERY_SMALL' END
          WHEN test = 'anova' THEN CASE WHEN e > 0.5 THEN 'SUSPICIOUS' WHEN e > 0.14 THEN 'LARGE' WHEN e > 0.06 THEN 'MEDIUM' WHEN e > 0.01 THEN 'SMALL' ELSE 'VERY_SMALL' END
          ELSE CASE WHEN e > 0.95 AND n < 30 THEN 'SUSPICIOUS' WHEN e > 0.7 THEN 'LARGE' WHEN e > 0.3 THEN 'MEDIUM' WHEN e > 0.1 THEN 'SMALL' ELSE 'VERY_SMALL' END END AS size_class,
        round(res - e, 4) AS es_gap, CASE WHEN abs(res - e) > 0.3 THEN 'MAJOR' WHEN abs(res - e) >= 0.1 THEN 'MODERATE' WHEN e IS NOT NULL THEN 'CONSISTENT' END AS agreement FROM e""",
    "stylometry": _style(),
    "llm_score": _score(),
    "dedup_pairs": f"""WITH t AS (SELECT doc_id, list_sort(s) AS s FROM (SELECT doc_id, {_SHINGLES} AS s FROM (SELECT doc_id, {_DEDUP.format(t="text")} AS w FROM documents)) WHERE len(s) > 0), k AS (SELECT s, min(doc_id) AS rep FROM t GROUP BY s),
      x AS (SELECT rep AS doc_id, len(s) AS n, unnest(s) AS x FROM k), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, max(a.n)::BIGINT AS n_a, max(b.n)::BIGINT AS n_b FROM x a JOIN x b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2
        UNION ALL SELECT rep, doc_id, len(s)::BIGINT, len(s)::BIGINT, len(s)::BIGINT FROM t JOIN k USING (s) WHERE rep < doc_id), q AS (SELECT *, shared / (n_a + n_b - shared) AS j FROM p)
      SELECT a, b, shared, n_a, n_b, round(j, 4) AS jaccard, round(shared / n_a, 4) AS overlap_ratio, {_LEVEL} AS level FROM q WHERE j > 0.15""",
    "dedup_minhash": f"""WITH s AS ({_sets("documents", "doc_id")}), p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared, max(a.n) AS n_a FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id WHERE a.doc_id % 50 = 0 GROUP BY 1, 2),
      d AS (SELECT a AS doc_id FROM p UNION SELECT b FROM p), m AS (SELECT doc_id, i.range AS i, min(md5(i.range::VARCHAR || x)) AS h FROM s JOIN d USING (doc_id), range(128) i GROUP BY 1, 2), j AS (SELECT p.a, p.b, p.shared, p.n_a, count(*) FILTER (x.h = y.h) / 128 AS j FROM p JOIN m x ON x.doc_id = p.a JOIN m y ON y.doc_id = p.b AND y.i = x.i GROUP BY ALL)
      SELECT a, b, shared, round(j, 3) AS jaccard_estimate, round(shared / n_a, 4) AS overlap_ratio, {_LEVEL} AS level FROM j WHERE j > 0.05""",
    "self_duplicates": f"""WITH t AS (SELECT doc_id, {_DEDUP.format(t="CASE WHEN doc_id % 100 = 3 THEN text || ' ' || text ELSE text END")} AS ws FROM documents), p AS (SELECT doc_id, a, list_slice(ws, a + 1, a + 200) AS w FROM (SELECT doc_id, ws, unnest(range(0, len(ws) - 199, 50)) AS a FROM t WHERE len(ws) >= 700)),
      s AS (SELECT doc_id, a, w, {_SHINGLES} AS s FROM p), x AS (SELECT doc_id, a, unnest(s) AS x FROM s), c AS (SELECT DISTINCT doc_id, u.a AS f, v.a AS g FROM x u JOIN x v USING (doc_id, x) WHERE v.a - u.a >= 500),
      h AS (SELECT doc_id, f AS a FROM c UNION SELECT doc_id, g FROM c), m AS (SELECT doc_id, a, i.range AS i, min(md5(i.range::VARCHAR || x)) AS h FROM x JOIN h USING (doc_id, a), range(64) i GROUP BY ALL),
      j AS (SELECT c.doc_id, f, g, count(*) FILTER (u.h = v.h) / 64 AS j FROM c JOIN m u ON u.doc_id = c.doc_id AND u.a = f JOIN m v ON v.doc_id = c.doc_id AND v.a = g AND v.i = u.i GROUP BY ALL),
      r AS (SELECT * FROM j WHERE j >= 0.6)
      SELECT r.doc_id, f::INT AS "first", g::INT AS "second", round(j, 3) AS similarity, array_to_string(list_slice(w, 1, 20), ' ') AS snippet FROM r JOIN p ON p.doc_id = r.doc_id AND p.a = f""",
    "contamination": f"""WITH d AS ({_sets("documents", "doc_id")}), t AS ({_sets("benchmark", "item_id")}) SELECT doc_id, item_id, count(*) AS shared, max(t.n)::BIGINT AS n_test, round(count(*) / max(t.n), 4) AS containment FROM d JOIN t USING (x) GROUP BY 1, 2 HAVING count(*) / max(t.n) >= 0.5""",
    "doi_extract": f"SELECT doc_id, doi FROM ({_DOIS})",
    "doi_summary": rf"""WITH r AS (SELECT * FROM ({_DOIS}) UNION ALL SELECT doc_id, source, '10.12/x' FROM documents), w AS (SELECT lower(concat('10.1234/ABC.', doc_id)) AS d FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT concat('10.98765/q-', range) FROM range(7)),
      c AS (SELECT source, CASE WHEN NOT regexp_matches(doi, '^10\.[0-9]{{4,9}}') THEN 'invalid_format' WHEN lower(doi) IN (SELECT d FROM w) THEN 'ok' ELSE 'not_found' END AS st FROM r)
      SELECT source, count(*) AS total, count(*) FILTER (st = 'ok') AS n_ok, count(*) FILTER (st = 'not_found') AS n_not_found, count(*) FILTER (st = 'invalid_format') AS n_invalid, round(count(*) FILTER (st <> 'ok') / count(*), 4) AS failure_rate FROM c GROUP BY 1""",
    "retraction_join": f"SELECT source, count(*) AS total, count(*) FILTER (lower(doi) IN ('10.5555/ret0', '10.5555/ret1', '10.5555/ret2')) AS n_retracted FROM ({_DOIS}) GROUP BY 1",
    "image_hash": f"SELECT vec_id, lower(printf('%016x', h)) AS ahash FROM ({_HASH})",
    "image_pairs": f"""WITH h AS ({_HASH}), r AS (SELECT h, min(vec_id) AS a FROM h GROUP BY 1), d AS (SELECT x.a, y.a AS b, bit_count(xor(x.h, y.h))::BIGINT AS distance FROM r x JOIN r y ON x.a < y.a UNION ALL SELECT r.a, vec_id, 0 FROM h JOIN r USING (h) WHERE r.a < vec_id)
      SELECT *, CASE WHEN distance = 0 THEN 'IDENTICAL' WHEN distance <= 5 THEN 'HIGH' ELSE 'MODERATE' END AS assessment FROM d WHERE distance <= 15""",
    "image_clones": _clones(5),
    "exif_inspect": f"""SELECT event_id, has AS has_exif, CASE WHEN has THEN concat_ws(',', CASE WHEN t1 IS NOT NULL THEN 'DateTime' END, CASE WHEN t2 IS NOT NULL THEN 'DateTimeDigitized' END, 'DateTimeOriginal', CASE WHEN software IS NOT NULL THEN 'Software' END) END AS fields, software,
      CASE WHEN software LIKE '%Photoshop%' OR software LIKE 'GIMP%' THEN 'HIGH' WHEN software IN ('Illustrator', 'Inkscape') THEN 'MODERATE' WHEN software LIKE 'Matplotlib%' THEN 'OK' WHEN software IS NOT NULL THEN 'OTHER' END AS software_class,
      n_times, CASE WHEN has THEN differ END AS mixed_dates FROM ({_EXIF})""",
    "exif_summary": f"""SELECT event_type, count(*) AS n_images, count(*) FILTER (failed) AS n_errors, count(*) FILTER (NOT failed AND has) AS n_with, count(*) FILTER (NOT failed AND NOT has) AS n_without, array_to_string(list_sort(list(DISTINCT software) FILTER (software IS NOT NULL)), ',') AS software,
      event_type IN (SELECT event_type FROM (SELECT event_type, unnest([t1, t2, CASE WHEN has THEN '2024:01:01' END]) AS d FROM ({_EXIF})) GROUP BY 1 HAVING count(DISTINCT d) > 1) AS mixed_dates FROM ({_EXIF}) GROUP BY 1""",
    "metadata_map": "SELECT event_type, k AS key, count(*) AS n, count(DISTINCT v) AS n_values FROM (SELECT event_type, unnest(json_keys(props)) AS k, props ->> 'k' AS v FROM events) GROUP BY 1, 2",
    "digit_windows": f"""SELECT date_trunc('day', ts)::TIMESTAMP AS window_start, event_type, count(*) AS n, count(*) FILTER (d = 1) AS c1, count(*) FILTER (d = 9) AS c9, count(*) FILTER (l = 0) AS last0, count(*) FILTER (l = 9) AS last9 FROM (SELECT ts, event_type, {LEAD.format(x="value")} AS d, floor(abs(value))::BIGINT % 10 AS l FROM events) GROUP BY 1, 2""",
    "rule_impossible_p": "SELECT l_returnflag AS paper_id, CASE WHEN l_tax = 0 THEN 'zero' ELSE 'exactly_05' END AS problem, count(*) AS n FROM lineitem WHERE l_tax = 0 OR l_tax = 5e-2 GROUP BY 1, 2",
    "rule_same_p": "SELECT l_orderkey, count(*) AS n, min(l_tax) AS p FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT l_tax) = 1",
    "rule_identical_summaries": "SELECT l_orderkey, round(l_tax, 2) AS mean, round(l_discount, 2) AS sd, count(*) AS n_groups FROM lineitem GROUP BY ALL HAVING count(*) > 1",
    "rule_changing_n": "SELECT l_partkey, l_returnflag, count(DISTINCT l_linenumber) AS n_values, min(l_linenumber) AS least, max(l_linenumber) AS most FROM lineitem GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber) > 1",
    "rule_prolific": "SELECT o_custkey, year(o_orderdate)::INT AS year, count(*) AS n_papers FROM orders GROUP BY ALL HAVING count(*) > 3",
    "rule_over_citation": "WITH p AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY 1, 2), t AS (SELECT *, sum(n) OVER (PARTITION BY l_orderkey)::BIGINT AS total FROM p) SELECT * FROM t WHERE n > 0.4 * total",
    "rule_citation_rings": "WITH e AS (SELECT l_suppkey % 50 AS a, l_partkey % 50 AS b, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) >= 5 AND l_suppkey % 50 <> l_partkey % 50) SELECT e.a, e.b, e.n, f.n AS n_back FROM e JOIN e f ON f.a = e.b AND f.b = e.a WHERE e.a < e.b",
    "rule_mill": "SELECT l_suppkey, count(DISTINCT l_partkey) AS n_first_authors, count(*) AS n_papers FROM lineitem GROUP BY 1 HAVING count(DISTINCT l_partkey) >= 20",
    "rule_straight_lining": "SELECT l_orderkey, count(*) AS n_items, min(l_linestatus) AS answer FROM lineitem GROUP BY 1 HAVING count(*) >= 5 AND count(DISTINCT l_linestatus) = 1",
    "rule_alternating": """WITH s AS (SELECT l_orderkey, l_linenumber, l_suppkey % 2 - lag(l_suppkey % 2) OVER w AS d, l_partkey, l_suppkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), e AS (SELECT *, lag(d) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS e FROM s),
      g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (d <> 0 AND d = -e) AS turns, count(*) FILTER (d <> 0 AND d = e) AS climbs FROM e GROUP BY 1) SELECT l_orderkey, n, CASE WHEN turns = n - 2 THEN 'alternating' ELSE 'diagonal' END AS pattern FROM g WHERE n >= 5 AND (turns = n - 2 OR climbs = n - 2)""",
    "rule_speeding": "WITH m AS (SELECT event_type, median(value) AS m FROM events GROUP BY 1) SELECT event_type, count(*) AS n, round(max(m), 6) AS median FROM events JOIN m USING (event_type) WHERE value < m / 3 GROUP BY 1",
    "rule_duplicate_keys": "SELECT user_id, value, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) >= 2",
    "rule_alpha": """WITH l AS (SELECT * FROM lineitem), i AS (SELECT l_returnflag, sum(v) AS sv, count(*) AS k FROM (SELECT l_returnflag, l_linenumber, var_samp(l_quantity) AS v FROM l GROUP BY 1, 2) GROUP BY 1), t AS (SELECT l_returnflag, var_samp(t) AS vt FROM (SELECT l_returnflag, l_orderkey, sum(l_quantity) AS t FROM l GROUP BY 1, 2) GROUP BY 1)
      SELECT l_returnflag, k, round(k / (k - 1) * (1 - sv / vt), 4) AS alpha, k / (k - 1) * (1 - sv / vt) > 0.95 AS too_high FROM i JOIN t USING (l_returnflag)""",
    "rule_r2": "SELECT l_returnflag, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_r2(l_extendedprice, l_quantity) > 0.99 AS too_good FROM lineitem GROUP BY 1",
    "rule_adjusted_p": f"""WITH r AS (SELECT case_id % 4 AS family, case_id, round(stat / 100, 4) AS p FROM ({_CASE})), k AS (SELECT *, count(*) OVER (PARTITION BY family) AS m, row_number() OVER (PARTITION BY family ORDER BY p, case_id) AS i FROM r),
      a AS (SELECT *, least(1, max(p * (m - i + 1)) OVER (PARTITION BY family ORDER BY i)) AS h, least(1, min(p * m / i) OVER (PARTITION BY family ORDER BY i DESC)) AS b FROM k) SELECT family, case_id, p, round(least(1, p * m), 6) AS bonferroni, round(h, 6) AS holm, round(b, 6) AS fdr, p < 0.05 AND b >= 0.05 AS lost FROM a""",
    "rule_power": f"""WITH r AS (SELECT case_id, stat / 10 AS d, case_id + 4 AS n FROM ({_CASE})), z AS (SELECT *, d * sqrt(n / 2) - 196e-2 AS z FROM r), y AS (SELECT *, abs(z) / sqrt(2e0) AS y FROM z), q AS (SELECT *, {erfc("y")} / 2 AS tail FROM y), w AS (SELECT *, round(CASE WHEN z >= 0 THEN 1 - tail ELSE tail END, 6) AS power FROM q) SELECT case_id, d, n, power FROM w WHERE power < 0.5""",
    "rule_matrix": f"""WITH m AS ({_MATRIX}) SELECT a.paper_id, a.i, a.j, round(a.r, 6) AS r, CASE WHEN a.i = a.j AND a.r <> 1 THEN 'diagonal' WHEN abs(a.r) > 1 THEN 'range' ELSE 'asymmetric' END AS problem FROM m a LEFT JOIN m b ON b.paper_id = a.paper_id AND b.i = a.j AND b.j = a.i
      WHERE (a.i = a.j AND a.r <> 1) OR abs(a.r) > 1 OR (a.i <> a.j AND (b.r IS NULL OR abs(b.r - a.r) > 1e-9))""",
    "rule_equal_counts": "SELECT l_orderkey, count(*) AS n, min(l_quantity) AS value FROM lineitem GROUP BY 1 HAVING count(*) >= 2 AND count(DISTINCT l_quantity) = 1",
    "rule_monotone": "WITH a AS (SELECT l_orderkey, l_linenumber, avg(l_quantity) AS q FROM lineitem GROUP BY 1, 2), d AS (SELECT l_orderkey, q - lag(q) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS d FROM a), g AS (SELECT l_orderkey, count(*) AS n, count(*) FILTER (d < 0) AS falls, count(*) FILTER (d > 0) AS rises FROM d GROUP BY 1) SELECT *, falls = 0 OR rises = 0 AS monotone FROM g",
    "rule_model_phrases": """SELECT phrases, count(*) AS n FROM (SELECT concat_ws(',', CASE WHEN regexp_matches(t, 'as an ai language model', 'i') THEN 'as an ai language model' END, CASE WHEN regexp_matches(t, 'i don''t have access to', 'i') THEN 'i don''t have access to' END) AS phrases
      FROM (SELECT concat_ws(' ', text, CASE WHEN doc_id % 9 = 0 THEN 'As an AI language model, I cannot say.' END, CASE WHEN doc_id % 7 = 0 THEN 'I don''t have access to it.' END) AS t FROM documents)) WHERE phrases <> '' GROUP BY 1""",
    "rule_reverse_items": "SELECT l_suppkey, round(corr(l_quantity, l_discount), 4) AS r FROM lineitem GROUP BY 1 HAVING corr(l_quantity, l_discount) >= 0",
}
_HUNDRED = "greatest(least(floor((x::DOUBLE + 1) * 127.5), 255), 0)"
_LARGE = """SELECT concat_ws('/', test, l_linenumber, df) AS case_id, test, df, CASE test WHEN 'F' THEN stat + 1 ELSE stat END AS stat FROM
  (SELECT l_linenumber, l_linenumber * 2e-1 + 15e-1 AS stat, unnest([count(*) - 3, (count(*) - 3) * 50]) AS df FROM lineitem GROUP BY l_linenumber), (VALUES ('t'), ('F'), ('r')) k(test)"""
_YEARS = "CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 25 + 2000)::VARCHAR WHEN doc_id % 2 <> 0 THEN (doc_id % 25 + 1980)::VARCHAR WHEN doc_id % 5 <> 0 THEN (doc_id % 25 + 1960)::VARCHAR ELSE '?' END"
_PRICED = "FROM orders WHERE o_orderkey % 7 <> 0"
SQL |= {
    "stat_check_large": f"""WITH q AS (SELECT *, CASE test WHEN 'F' THEN power(df / (df + 2 * stat), df / 2e0) ELSE {t_integrated("stat", "df")} END AS p FROM ({_LARGE})), g AS (SELECT *, abs(5e-2 - p) AS gap FROM q)
      SELECT case_id, df, 'ok' AS status, round(p, 6) AS p_value, gap < 0.001 AS matches, CASE WHEN gap > 0.05 THEN 'HIGH' WHEN gap > 0.01 THEN 'MODERATE' WHEN gap > 0.001 THEN 'MINOR' ELSE 'OK' END AS verdict FROM g""",
    "stat_check_fractional": f"SELECT case_id, 'ok' AS status, round({chi2_integrated('x', 'k')}, 6) AS p_value FROM (SELECT case_id, stat * 2 AS x, case_id * 35e-2 + 4e-1 AS k FROM ({_CASE}))",
    "effect_kinds": f"""WITH r AS (SELECT case_id, case_id + 1 AS n, stat / 8 AS stat, CASE WHEN case_id % 2 = 0 THEN 'r' ELSE 't' END AS stat_kind FROM ({_CASE})),
      e AS (SELECT *, CASE WHEN n <= 2 THEN NULL WHEN stat_kind = 'r' THEN abs(stat) ELSE sqrt(stat * stat / (stat * stat + (n - 2))) END AS e FROM r)
      SELECT case_id, stat_kind, CASE WHEN e IS NULL THEN 'invalid' ELSE 'ok' END AS status, round(e, 4) AS implied_es, CASE WHEN e IS NULL THEN NULL WHEN e > 0.95 AND n < 30 THEN 'SUSPICIOUS' WHEN e > 0.7 THEN 'LARGE' WHEN e > 0.3 THEN 'MEDIUM' WHEN e > 0.1 THEN 'SMALL' ELSE 'VERY_SMALL' END AS size_class,
        CASE WHEN abs(5e-1 - e) > 0.3 THEN 'MAJOR' WHEN abs(5e-1 - e) >= 0.1 THEN 'MODERATE' WHEN e IS NOT NULL THEN 'CONSISTENT' END AS agreement FROM e""",
    "normality_report": f"""SELECT m.*, a.a2, l.chi2 AS last_chi2, l.p_value AS last_p, l."natural", l.over, l."under" FROM ({SQL["normality"]}) m JOIN ({_anderson("events", "value", "event_type", 3)}) a USING (event_type) JOIN ({_last("events", "value", "event_type")}) l USING (event_type)""",
    "benford_kinds": f"SELECT o_orderpriority, n, verdict, applicable AND NOT starts_with(o_orderpriority, '2') AS applicable FROM ({SQL['benford_orders']})",
    "doi_listed": f"SELECT DISTINCT doi FROM ({_DOIS})",
    "work_metadata": f"""SELECT doc_id, CASE WHEN doc_id % 11 <> 0 AND doc_id % 10 <> 0 THEN coalesce(source, '?') ELSE '?' END AS title,
      CASE WHEN doc_id % 11 <> 0 THEN CASE WHEN doc_id % 6 = 0 THEN '' ELSE array_to_string(list_transform(range(1, least(3, doc_id % 5 + 1) + 1), lambda i: concat('F', doc_id % 100, '_', i, ', G', i)), '; ') END END AS authors,
      CASE WHEN doc_id % 11 <> 0 AND doc_id % 4 <> 0 THEN coalesce(lang, '?') ELSE '?' END AS journal, CASE WHEN doc_id % 11 <> 0 THEN {_YEARS} ELSE '?' END AS year,
      CASE WHEN doc_id % 11 <> 0 AND doc_id % 7 <> 0 THEN 'press' ELSE '?' END AS publisher, CASE WHEN doc_id % 11 <> 0 AND doc_id % 9 <> 0 THEN 'article' ELSE '?' END AS "type" FROM documents""",
    "work_updates": """SELECT doc_id, CASE WHEN doc_id % 11 = 0 THEN 'not_found' WHEN doc_id % 8 = 0 THEN 'retracted' ELSE 'ok' END AS status, CASE WHEN doc_id % 11 <> 0 AND doc_id % 8 = 0 THEN CASE WHEN doc_id % 16 = 0 THEN 'data' ELSE '(no reason given)' END END AS reason,
      CASE WHEN doc_id % 11 <> 0 AND doc_id % 8 = 0 THEN concat('10.1/r', doc_id) END AS notice FROM documents""",
    "retraction_pages": "SELECT concat('10.5555/c', c_custkey) AS doi FROM customer WHERE c_custkey < 900",
    "source_csv": f"SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total {_PRICED}",
    "source_lines": f"SELECT count(*) AS n, round(sum(o_totalprice), 2) AS total {_PRICED}",
    "source_inline": "SELECT count(*) AS n, round(sum(v), 2) AS total FROM (SELECT n_regionkey::DOUBLE AS v FROM nation UNION ALL SELECT 2.5)",
    "source_reported": f"""SELECT CASE WHEN case_id % 5 = 0 OR case_id % 7 = 0 THEN 'skipped' ELSE 'ok' END AS status, count(*) AS n_rows, sum(CASE WHEN case_id % 5 <> 0 THEN case_id END)::BIGINT AS sum_n, round(sum(CASE WHEN case_id % 7 <> 0 THEN stat END), 2) AS sum_stat FROM ({_CASE}) GROUP BY 1""",
    "source_bits": "SELECT sum(8 * (length(s_name) + 1))::BIGINT AS n_bits, sum(2 + list_sum(list_transform(string_split(s_name, ''), lambda c: bit_count(ascii(c)))))::BIGINT AS n_ones FROM supplier",
    "source_texts": "SELECT sum(length(regexp_replace(coalesce(text, ''), '[\\r\\n]+', ' ', 'g')) + 1)::BIGINT AS n_chars FROM documents",
    "source_dois": "SELECT concat('10.1234/s', s_suppkey) AS doi FROM supplier WHERE s_suppkey % 4 > 1",
    "source_files": "SELECT length(t)::BIGINT AS length, substr(md5(t), 1, 16) AS file_hash FROM (SELECT string_agg(r_name, chr(10) ORDER BY r_name) || chr(10) AS t FROM region)",
    "source_cache": "SELECT concat('10.5555/s', s_suppkey) AS doi FROM supplier WHERE s_suppkey % 2 = 0 OR s_suppkey % 3 = 0",
    "image_decode": f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: {_HUNDRED}) AS p FROM embeddings), m AS (SELECT *, list_sum(p) / 64 AS m FROM e)
      SELECT vec_id, lower(printf('%016x', list_reduce(list_prepend(0::UBIGINT, list_transform(p, lambda x: (CASE WHEN x > m THEN 1 ELSE 0 END)::UBIGINT)), lambda h, b: ((h & 9223372036854775807::UBIGINT) << 1) | b))) AS ahash, NULL::VARCHAR AS error FROM m""",
    "image_totals": _totals(f"WITH h AS ({_HASH}) SELECT x.vec_id AS a FROM h x JOIN h y ON x.vec_id < y.vec_id WHERE bit_count(xor(x.h, y.h)) <= 15"),
    "image_clone_report": f"""SELECT image_id, place::INT AS place, greatest(n - 20, 0) AS n_more, x1, y1, x2, y2, distance FROM (SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY y1, x1, y2, x2) AS place, count(*) OVER (PARTITION BY image_id) AS n FROM ({_clones(24)})) WHERE place <= 20""",
    "rule_psd": f"""WITH c AS (SELECT paper_id, r12 * (1 + half) / 2 AS a, r13 AS b, r23 AS c, r33 AS d, (2 + r33) / 3 AS q FROM ({_CORR})), p AS (SELECT *, sqrt((2 * power(1 - q, 2) + power(d - q, 2) + 2 * (a * a + b * b + c * c)) / 6) AS p FROM c),
      r AS (SELECT *, (power(1 - q, 2) * (d - q) + 2 * a * b * c - (1 - q) * c * c - (1 - q) * b * b - (d - q) * a * a) / power(p, 3) / 2 AS r FROM p),
      e AS (SELECT paper_id, q + 2 * p * cos(acos(greatest(-1, least(1, r))) / 3 + 2 * pi() / 3) AS e FROM r) SELECT paper_id, round(e, 6) AS least_eigenvalue FROM e WHERE e < -1e-8""",
    "rule_ci": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_discount - 45e-3 < 0 AND l_discount - 15e-3 > 0 AND l_tax < 5e-2 GROUP BY 1",
    "rule_precision": "SELECT c_mktsegment, count(*) AS n, max(d)::BIGINT AS most FROM (SELECT c_mktsegment, length(regexp_extract(c_acctbal::VARCHAR, '\\.([0-9]+)$', 1)) AS d FROM customer) WHERE d > 1 GROUP BY 1",
    "rule_recruitment": "SELECT *, round(n / days, 4) AS per_day FROM (SELECT o_custkey, count(*) AS n, date_diff('day', min(o_orderdate), max(o_orderdate))::INT AS days FROM orders GROUP BY 1) WHERE days > 0 AND n / days > 0.02",
    "rule_salami": _SALAMI.format(pairs=SQL["dedup_pairs"]),
    "rule_similar_mill": f"""SELECT source, n_first_authors, n_papers, n_similar FROM (SELECT source, count(DISTINCT doc_id) AS n_first_authors, count(*) AS n_papers FROM documents GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10) JOIN (SELECT source, count(*) AS n_similar FROM ({_SALAMI.format(pairs=SQL["dedup_pairs"])}) GROUP BY 1) USING (source)""",
    "rule_absent_bars": "SELECT l_orderkey, count(*) AS n, CASE WHEN max(l_discount) = 0 THEN 'absent' ELSE 'one_height' END AS problem FROM lineitem GROUP BY 1 HAVING count(*) > 1 AND count(DISTINCT l_discount) = 1",
    "rule_weak_instruments": f"SELECT case_id, round(f, 4) AS f FROM (SELECT case_id, stat * case_id / 10 AS f FROM ({_CASE})) WHERE f < 10",
    "rule_yields": "SELECT l_returnflag, count(*) AS n FROM lineitem WHERE l_quantity * 21e-1 >= 100 AND l_linenumber > 1 GROUP BY 1",
    "rule_elemental": "SELECT l_returnflag, count(*) AS n, round(sum(round(l_tax * 50 - l_discount * 50, 4)), 2) AS off FROM lineitem WHERE abs(l_tax * 50 - l_discount * 50) > 0.4 GROUP BY 1",
    "rule_regressions": """WITH s AS (SELECT l_orderkey, l_linenumber, (max(l_discount) - 5e-2) * 24 AS beta, max(l_quantity) AS r2 FROM lineitem GROUP BY 1, 2), g AS (SELECT *, r2 - lag(r2) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber) AS gap FROM s)
      SELECT CASE WHEN abs(beta) > 1 THEN 'beta' ELSE 'falling_r2' END AS problem, count(*) AS n FROM g WHERE abs(beta) > 1 OR gap < 0 GROUP BY 1""",
    "rule_resolution": "SELECT p_brand, round(max(p_size * p_retailprice) / min(p_size * p_retailprice), 4) AS spread FROM part GROUP BY 1 HAVING round(max(p_size * p_retailprice) / min(p_size * p_retailprice), 4) > 4",
    "rule_missing_n": "SELECT l_returnflag, count(*) AS n_missing FROM lineitem WHERE l_linenumber = 3 GROUP BY 1",
    "rule_registration": "SELECT CASE WHEN r.o_orderkey IS NULL THEN 'unregistered' ELSE 'other_endpoint' END AS problem, count(*) AS n FROM orders t LEFT JOIN orders r ON r.o_orderkey + 3 = t.o_orderkey WHERE r.o_orderkey IS NULL OR r.o_orderpriority <> t.o_orderpriority GROUP BY 1",
}
SQL["risk_rollup"] = f"""
WITH f AS (SELECT * FROM ({_findings()}) WHERE sev IS NOT NULL),
c AS (SELECT paper_id, count(*) AS n_findings, count(*) FILTER (sev IN ('CRITICAL', 'HIGH')) AS n_high, count(DISTINCT dim) FILTER (sev IN ('CRITICAL', 'HIGH')) AS n_high_dimensions, count(*) FILTER (sev = 'MEDIUM') AS n_medium FROM f GROUP BY 1),
p AS (SELECT DISTINCT source AS paper_id FROM documents UNION SELECT o_orderpriority FROM orders UNION SELECT concat('clean', range) FROM range(2)),
j AS (SELECT paper_id, coalesce(n_findings, 0) AS n_findings, coalesce(n_high, 0) AS n_high, coalesce(n_high_dimensions, 0) AS n_high_dimensions, coalesce(n_medium, 0) AS n_medium FROM p LEFT JOIN c USING (paper_id))
SELECT *, CASE WHEN n_high >= 2 AND n_high_dimensions >= 2 THEN 'CRITICAL' WHEN n_high >= 2 OR n_medium >= 5 THEN 'HIGH' WHEN n_high >= 1 OR n_medium >= 1 THEN 'MODERATE' WHEN n_findings > 0 THEN 'LOW' ELSE 'CLEAN' END AS risk FROM j"""

SQL |= {
    "report_benford": _lines(SQL["benford_orders"], "o_orderpriority", ["printf('Leading digits of %s', o_orderpriority)", _field("Values", "n", "%d"), "CASE WHEN status <> 'ok' THEN printf('Not audited: %d values, 50 are needed', n) END", _field("Chi-square", "chi2", "%.3f"), _field("p", "p_value", "%.4f"), _field("Mean absolute deviation", "mad", "%.4f"), _field("Verdict", "verdict")]),
    "report_normality": _lines(SQL["normality_report"], "event_type", ["printf('Distribution of %s', event_type)", _field("Values", "n", "%d"), _field("Skewness", "skewness", "%.4f"), _field("Excess kurtosis", "kurtosis", "%.4f"), _field("W surrogate", "w_surrogate", "%.4f"), _field("A-squared", "a2", "%.3f"), "CASE WHEN notes <> '' THEN printf('Notes: %s', notes) END", _field("Last digits, chi-square", "last_chi2", "%.2f"), "CASE WHEN NOT \"natural\" THEN 'Last digits look made up' END"]),
    "report_statistics": _lines(SQL["stat_check_t"], "case_id", ["printf('Statistic %s', case_id::VARCHAR)", _field("Recomputed p", "p_value", "%.6f"), _field("Verdict", "verdict")]),
    "report_effects": _lines(SQL["effect_sizes"], "case_id", ["printf('Effect %s (%s)', case_id::VARCHAR, test)", _field("Implied", "implied_es", "%.4f"), _field("Size", "size_class"), _field("Gap to the reported effect", "es_gap", "%.4f"), _field("Agreement", "agreement")]),
    "report_overlaps": _lines(SQL["dedup_pairs"], "a, b", ["printf('Texts %s and %s share %d shingles', a::VARCHAR, b::VARCHAR, shared)", _field("Similarity", "jaccard", "%.4f"), _field("Level", "level")]),
    "report_passages": _lines(f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY "first", "second")::INT AS rank FROM ({SQL["self_duplicates"]})) WHERE rank <= 10""", "doc_id, rank", ["""printf('Words %d and %d repeat (%.3f)', "first", "second", similarity)""", "snippet"]),
    "report_images": _lines(_totals(SQL["image_pairs"]), "label", [_field("Images", "n_images", "%d"), _field("Pairs", "n_pairs", "%d"), _field("Suspicious pairs", "n_suspicious", "%d")]),
    "report_clones": _lines(SQL["image_clone_report"], "image_id, place", ["printf('(%d, %d) and (%d, %d) differ in %d bits', x1, y1, x2, y2, distance)", "CASE WHEN place = 20 AND n_more > 0 THEN printf('and %d more', n_more) END"]),
    "report_metadata": _lines(SQL["exif_summary"], "event_type", [_field("Images", "n_images", "%d"), _field("With metadata", "n_with", "%d"), _field("Unreadable", "n_errors", "%d"), "CASE WHEN software <> '' THEN printf('Software: %s', software) END", "CASE WHEN mixed_dates THEN 'Dates differ' END"]),
    "report_references": _lines(SQL["doi_summary"], "source", [_field("References", "total", "%d"), _field("Not found", "n_not_found", "%d"), _field("Malformed", "n_invalid", "%d"), _field("Failure rate", "failure_rate", "%.4f")]),
    "report_risks": _lines(SQL["risk_rollup"], "paper_id", [_field("Risk", "risk"), _field("Findings", "n_findings", "%d"), "CASE WHEN n_high > 0 THEN printf('High or critical: %d', n_high) END"]),
}
