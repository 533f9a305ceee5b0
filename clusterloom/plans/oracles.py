"""DuckDB SQL of the registered coreference queries, written independently of the operators."""

from __future__ import annotations

M = """m AS (
  SELECT l_orderkey AS topic, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) - 1 AS idx,
         l_suppkey % 3 AS gold, l_partkey % 3 AS sys, l_returnflag <> 'A' AS in_key, l_returnflag <> 'R' AS in_sys, l_partkey AS part
  FROM lineitem)"""
A = M + """,
a AS (SELECT topic AS doc, idx AS mention, CASE WHEN in_key THEN gold END AS key, CASE WHEN in_sys THEN sys END AS sys FROM m WHERE in_key OR in_sys),
kz AS (SELECT doc, key, count(*) AS sz FROM a WHERE key IS NOT NULL GROUP BY 1, 2),
sz AS (SELECT doc, sys, count(*) AS sz FROM a WHERE sys IS NOT NULL GROUP BY 1, 2),
n AS (SELECT doc, key, sys, count(*) AS n FROM a WHERE key IS NOT NULL AND sys IS NOT NULL GROUP BY 1, 2, 3),
x AS (SELECT n.*, kz.sz AS k, sz.sz AS s FROM n JOIN kz USING (doc, key) JOIN sz USING (doc, sys)),
kd AS (SELECT DISTINCT doc FROM kz)"""
P = M + """,
p AS (SELECT a.topic, a.idx AS i, b.idx AS j, (a.part + b.part) % 2001 / 500.0 - 2 AS logit, CASE WHEN a.gold = b.gold THEN 1 ELSE 0 END AS label FROM m a JOIN m b ON a.topic = b.topic AND a.idx < b.idx),
q AS (SELECT topic, i, j, label, round(1 / (1 + exp(-CAST(logit AS DOUBLE) / 1.7)), 6) AS p FROM p)"""
PRF = "SELECT round({r}, 6) AS recall, round({p}, 6) AS precision, round(CASE WHEN {r} + {p} > 0 THEN 2 * {r} * {p} / ({r} + {p}) ELSE 0 END, 6) AS f1"


def _prf(rn: str, rd: str, pn: str, pd: str, ctes: str = A) -> str:
    """Recall, precision and F1 of four scalar subqueries."""
    return f"WITH {ctes}, v AS (SELECT coalesce(({rn}) / nullif(CAST(({rd}) AS DOUBLE), 0), 0) AS r, coalesce(({pn}) / nullif(CAST(({pd}) AS DOUBLE), 0), 0) AS p) " + PRF.format(r="r", p="p") + " FROM v"


MENTION = ("SELECT CAST(count(*) AS DOUBLE) FROM a WHERE key IS NOT NULL AND sys IS NOT NULL", "SELECT count(*) FROM a WHERE key IS NOT NULL", "SELECT CAST(count(*) AS DOUBLE) FROM a WHERE key IS NOT NULL AND sys IS NOT NULL", "SELECT count(*) FROM a WHERE sys IS NOT NULL AND doc IN (FROM kd)")
MUC = ("SELECT sum(c) FROM (SELECT sum(n) - count(*) AS c FROM x GROUP BY doc, key)", "SELECT sum(sz - 1) FROM kz", "SELECT sum(c) FROM (SELECT sum(n) - count(*) AS c FROM x GROUP BY doc, sys)", "SELECT sum(sz - 1) FROM sz WHERE doc IN (FROM kd)")
B3 = ("SELECT sum(n * n / CAST(k AS DOUBLE)) FROM x", "SELECT sum(sz) FROM kz", "SELECT sum(n * n / CAST(s AS DOUBLE)) FROM x", "SELECT sum(sz) FROM sz WHERE doc IN (FROM kd)")
_LEA = "SELECT sum(CASE WHEN {0} > 1 THEN {0} * (n * (n - 1) / 2.0) / ({0} * ({0} - 1) / 2.0) WHEN {1} = 1 THEN 1 ELSE 0 END) FROM x"
LEA = (_LEA.format("k", "s"), B3[1], _LEA.format("s", "k"), B3[3])
_PERM = "(VALUES (0, 1, 2), (0, 2, 1), (1, 0, 2), (1, 2, 0), (2, 0, 1), (2, 1, 0)) AS g(a, b, c)"


def _ceaf(phi: str) -> str:
    best = f"SELECT sum(best) FROM (SELECT doc, max(t) AS best FROM (SELECT doc, a, b, c, sum(CASE WHEN (key = 0 AND sys = a) OR (key = 1 AND sys = b) OR (key = 2 AND sys = c) THEN {phi} ELSE 0 END) AS t FROM x, {_PERM} GROUP BY 1, 2, 3, 4) GROUP BY doc)"
    return _prf(best, "SELECT count(*) FROM kz", best, "SELECT count(*) FROM sz WHERE doc IN (FROM kd)")


ORACLES: dict[str, str] = {
    "mention_prf": _prf(*MENTION),
    "muc": _prf(*MUC),
    "b_cubed": _prf(*B3),
    "lea": _prf(*LEA),
    "ceafe": _ceaf("2.0 * n / (k + s)"),
    "ceafm": _ceaf("n"),
}
ORACLES["coref_scores"] = " UNION ALL ".join(f"SELECT '{n}' AS metric, * FROM ({_prf(*m)})" for n, m in (("mention", MENTION), ("muc", MUC), ("b3", B3), ("lea", LEA)))
_F1 = lambda m: _prf(*m).replace("SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(CASE", "SELECT (CASE").replace("ELSE 0 END, 6) AS f1", "ELSE 0 END) AS f1")
ORACLES["conll_avg"] = f"SELECT round(((SELECT f1 FROM ({_F1(MUC)})) + (SELECT f1 FROM ({_F1(B3)})) + (SELECT f1 FROM ({_ceaf('2.0 * n / (k + s)').replace('SELECT round(r, 6) AS recall, round(p, 6) AS precision, round(CASE', 'SELECT (CASE').replace('ELSE 0 END, 6) AS f1', 'ELSE 0 END) AS f1')}))) / 3, 6) AS conll"
_SIDE = """
SELECT {z}.doc, CAST(sum(coalesce(y.m, 0) - coalesce(y.l, 0)) AS DOUBLE) AS muc_{t}_num, CAST(sum({z}.sz - 1) AS DOUBLE) AS muc_{t}_den, round(sum(coalesce(y.q, 0) / CAST({z}.sz AS DOUBLE)), 6) AS b3_{t}_num,
       CAST(sum({z}.sz) AS DOUBLE) AS b3_{t}_den, round(sum(CASE WHEN {z}.sz > 1 THEN coalesce(y.c, 0) / ({z}.sz * ({z}.sz - 1) / 2.0) * {z}.sz WHEN y.o = 1 THEN 1 ELSE 0 END), 6) AS lea_{t}_num, CAST(sum({z}.sz) AS DOUBLE) AS lea_{t}_den
FROM {z} LEFT JOIN (SELECT doc, {c}, sum(n) AS m, count(*) AS l, sum(n * n) AS q, sum(n * (n - 1) / 2.0) AS c, max({o}) AS o FROM x GROUP BY 1, 2) y USING (doc, {c}) GROUP BY 1"""
ORACLES["per_doc_scores"] = f"WITH {A}, r AS ({_SIDE.format(z='kz', t='r', c='key', o='s')}), p AS ({_SIDE.format(z='sz', t='p', c='sys', o='k')}) SELECT r.*, " + ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("muc_p_num", "muc_p_den", "b3_p_num", "b3_p_den", "lea_p_num", "lea_p_den")) + " FROM r LEFT JOIN p USING (doc)"
ORACLES["singleton_filter"] = f"WITH {M} SELECT topic, idx, gold FROM (SELECT *, count(*) OVER (PARTITION BY topic, gold) AS c FROM m WHERE in_key) WHERE c > 1"
ORACLES["fbeta_scores"] = f"WITH {A}, v AS (SELECT ({B3[0]}) / ({B3[1]}) AS r, ({B3[2]}) / ({B3[3]}) AS p) SELECT beta, round((1 + beta * beta) * p * r / (beta * beta * p + r), 6) AS f1 FROM v, (VALUES (CAST(0.5 AS DOUBLE)), (1), (2)) AS b(beta)"
ORACLES["pairwise_prf"] = f"""WITH {M}, t AS (
  SELECT count(*) FILTER (WHERE a.in_key AND b.in_key AND a.gold = b.gold AND a.in_sys AND b.in_sys AND a.sys = b.sys) AS tp, count(*) FILTER (WHERE a.in_key AND b.in_key AND a.gold = b.gold) AS key_pairs,
         count(*) FILTER (WHERE a.in_sys AND b.in_sys AND a.sys = b.sys) AS sys_pairs FROM m a JOIN m b ON a.topic = b.topic AND a.idx < b.idx)
SELECT tp, key_pairs, sys_pairs, round(tp / key_pairs, 6) AS recall, round(tp / sys_pairs, 6) AS precision, round(2.0 * tp / (key_pairs + sys_pairs), 6) AS f1 FROM t"""
ORACLES["all_pairs"] = f"WITH {P} SELECT topic, i, j, round(CAST(logit AS DOUBLE), 6) AS logit, CAST(label AS BIGINT) AS label FROM p"
ORACLES["pair_labels"] = f"WITH {P} SELECT topic, count(*) AS n_pairs, CAST(sum(label) AS BIGINT) AS n_pos, round(avg(label), 6) AS pos_rate FROM p GROUP BY 1"
ORACLES["positive_pairs"] = f"WITH {P} SELECT topic, i, j FROM p WHERE label = 1"
ORACLES["ordered_pairs"] = f"WITH {M} SELECT a.topic, count(*) AS n, count(*) FILTER (WHERE a.gold = b.gold) AS same FROM m a JOIN m b USING (topic) GROUP BY 1"
ORACLES["neg_sample_counts"] = f"WITH {P}, t AS (SELECT topic, sum(label) AS pos, count(*) - sum(label) AS neg FROM p GROUP BY 1) SELECT topic, CAST(pos AS BIGINT) AS n_pos, CAST(least(neg, CASE WHEN pos > 0 THEN pos ELSE 32 END) AS BIGINT) AS n_neg FROM t"
ORACLES["sigmoid_temperature"] = f"WITH {P} SELECT topic, i, j, round(1 / (1 + exp(-CAST(logit AS DOUBLE) / 1.7)), 6) AS p, round(1 - 1 / (1 + exp(-CAST(logit AS DOUBLE) / 1.7)), 6) AS d FROM p"
ORACLES["log_loss"] = f"""WITH {P} SELECT round(avg(-(label * ln(greatest(p, 1e-8)) + (1 - label) * ln(greatest(1 - p, 1e-8)))), 6) AS log_loss, round(avg(CASE WHEN (p >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 6) AS accuracy,
  count(*) FILTER (WHERE p >= 0.5 AND label = 1) AS tp, count(*) FILTER (WHERE p >= 0.5 AND label = 0) AS fp, count(*) FILTER (WHERE p < 0.5 AND label = 1) AS fn, count(*) FILTER (WHERE p < 0.5 AND label = 0) AS tn FROM q"""
_GRID = "g AS (SELECT unnest([0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6, 0.7, 0.7999999999999999, 0.8999999999999999]::DOUBLE[]) AS tau)"
_CURVE = f"""{P}, {_GRID}, c AS (
  SELECT topic, tau, count(*) FILTER (WHERE p >= tau AND label = 1) AS tp, count(*) FILTER (WHERE p >= tau AND label = 0) AS fp, count(*) FILTER (WHERE p < tau AND label = 1) AS fn FROM q, g GROUP BY 1, 2),
f AS (SELECT *, coalesce(tp / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS pr, coalesce(2.0 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1 FROM c),
o AS (SELECT * FROM (SELECT *, max(f1) OVER (PARTITION BY topic) AS top FROM f) WHERE abs(f1 - top) <= 1e-8 + 1e-5 * top QUALIFY row_number() OVER (PARTITION BY topic ORDER BY pr DESC, tau DESC) = 1)"""
ORACLES["tau_grid"] = f"WITH {_CURVE} SELECT round(tau, 6) AS tau, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, round(coalesce(sum(tp) / nullif(CAST(sum(tp + fp) AS DOUBLE), 0), 0), 6) AS precision, round(sum(tp) / CAST(sum(tp + fn) AS DOUBLE), 6) AS recall, round(2.0 * sum(tp) / sum(2 * tp + fp + fn), 6) AS f1 FROM c GROUP BY tau"
_PR = f"{P}, s AS (SELECT p, sum(label) AS pos, count(*) AS n FROM q GROUP BY 1), r AS (SELECT p, pos, sum(pos) OVER w AS tp, sum(n) OVER w AS kept, (SELECT sum(label) FROM q) AS allpos FROM s WINDOW w AS (ORDER BY p DESC))"
ORACLES["pr_curve"] = f"WITH {_PR} SELECT p AS threshold, CAST(tp AS BIGINT) AS tp, CAST(kept - tp AS BIGINT) AS fp, round(tp / CAST(kept AS DOUBLE), 6) AS precision, round(tp / CAST(allpos AS DOUBLE), 6) AS recall FROM r"
ORACLES["average_precision"] = f"WITH {_PR} SELECT round(sum(pos / CAST(allpos AS DOUBLE) * tp / kept), 6) AS average_precision FROM r"
ORACLES["oracle_tau"] = f"WITH {_CURVE} SELECT topic, round(tau, 6) AS tau, tp, fp, fn, round(f1, 6) AS f1 FROM o"
ORACLES["oracle_gap"] = f"WITH {_CURVE}, v AS (SELECT (SELECT 2.0 * sum(tp) / sum(2 * tp + fp + fn) FROM o) AS a, (SELECT max(y) FROM (SELECT 2.0 * sum(tp) / sum(2 * tp + fp + fn) AS y FROM c GROUP BY tau)) AS b) SELECT round(a, 6) AS oracle_f1, round(b, 6) AS global_f1, round(a - b, 6) AS gap FROM v"
ORACLES["tau_summary"] = f"WITH {_CURVE} SELECT round(avg(tau), 6) AS mean, round(stddev_pop(tau), 6) AS std, round(quantile_cont(tau, 0.1), 6) AS p10, round(quantile_cont(tau, 0.5), 6) AS p50, round(quantile_cont(tau, 0.9), 6) AS p90 FROM o"
ORACLES["tau_correlation"] = f"""WITH {_CURVE}, z AS (SELECT topic, count(*) AS n FROM m GROUP BY 1), b AS (
  SELECT tau, n, rank() OVER (ORDER BY tau) + (count(*) OVER (PARTITION BY tau) - 1) / 2.0 AS rt, rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0 AS rn FROM o JOIN z USING (topic))
SELECT round(corr(tau, n), 6) AS pearson, round(corr(rt, rn), 6) AS spearman FROM b"""
_STATS = f"{M}, c AS (SELECT topic, gold, count(*) AS size FROM m GROUP BY 1, 2), t AS (SELECT topic, CAST(sum(size) AS BIGINT) AS n_mentions, count(*) AS n_clusters, max(size) AS max_cluster_size, min(size) AS min_cluster_size, CAST(sum(size * (size - 1) // 2) AS BIGINT) AS pos_pairs FROM c GROUP BY 1), u AS (SELECT *, n_mentions * (n_mentions - 1) // 2 AS total_pairs FROM t), s AS (SELECT *, coalesce(pos_pairs / nullif(CAST(total_pairs AS DOUBLE), 0), 0) AS pos_rate FROM u)"
ORACLES["topic_stats"] = f"WITH {_STATS} SELECT * REPLACE (round(pos_rate, 6) AS pos_rate) FROM s"
ORACLES["topic_stats_describe"] = f"WITH {_STATS} " + " UNION ALL ".join(f"SELECT '{c}' AS column, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, CAST(round(min({c}), 6) AS DOUBLE) AS min, CAST(round(max({c}), 6) AS DOUBLE) AS max, " + ", ".join(f"round(quantile_cont(CAST({c} AS DOUBLE), {q}), 6) AS p{round(q * 100)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + " FROM s" for c in ("n_mentions", "n_clusters", "pos_rate"))
ORACLES["cluster_size_hist"] = f"WITH {_STATS} SELECT CAST(least(5, floor((size - 1) / 2.0)) AS BIGINT) AS bin, count(*) AS n FROM c WHERE size BETWEEN 1 AND 13 GROUP BY 1"
ORACLES["cluster_size_summary"] = f"WITH {_STATS} SELECT min(size) AS min, max(size) AS max, round(avg(size), 6) AS mean, round(quantile_cont(CAST(size AS DOUBLE), 0.5), 6) AS median, round(quantile_cont(CAST(size AS DOUBLE), 0.9), 6) AS p90 FROM c"
_COMP = f"""RECURSIVE {P}, e AS (SELECT topic, i AS a, j AS b FROM q WHERE p >= 1 - 0.3 UNION ALL SELECT topic, j, i FROM q WHERE p >= 1 - 0.3),
r(topic, a, b) AS (SELECT topic, idx, idx FROM m UNION SELECT r.topic, r.a, e.b FROM r JOIN e ON e.topic = r.topic AND e.a = r.b),
l AS (SELECT topic, a AS idx, min(b) AS least FROM r GROUP BY 1, 2), k AS (SELECT topic, idx, dense_rank() OVER (PARTITION BY topic ORDER BY least) - 1 AS label FROM l)"""
ORACLES["components"] = f"WITH {_COMP} SELECT topic, idx, label FROM k"
ORACLES["impurity"] = f"""WITH {_COMP}, c AS (SELECT topic, label, count(DISTINCT gold) AS g, count(*) AS n FROM k JOIN m USING (topic, idx) GROUP BY 1, 2)
SELECT topic, count(*) FILTER (WHERE g > 1) AS impure, CAST(sum(CASE WHEN g > 1 THEN g - 1 ELSE 0 END) AS BIGINT) AS extra, round(sum(CASE WHEN g > 1 THEN n ELSE 0 END) / CAST(sum(n) AS DOUBLE), 6) AS share, max(CASE WHEN g > 1 THEN n ELSE 0 END) AS largest FROM c GROUP BY 1"""
H = """gold AS (
  SELECT CAST(n_regionkey AS BIGINT) AS topic, 'r' || n_regionkey AS src, 'n' || n_nationkey AS dst, n_nationkey AS nation FROM nation
  UNION ALL SELECT CAST(n_regionkey AS BIGINT), 'n' || n_nationkey, 's' || s_suppkey, n_nationkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
sys AS (SELECT * FROM gold WHERE nation % 3 <> 0),
gc(topic, src, dst, hops) AS (SELECT topic, src, dst, 1 FROM gold UNION ALL SELECT c.topic, c.src, g.dst, c.hops + 1 FROM gc c JOIN gold g ON g.topic = c.topic AND g.src = c.dst WHERE c.hops < 10),
sc(topic, src, dst, hops) AS (SELECT topic, src, dst, 1 FROM sys UNION ALL SELECT c.topic, c.src, g.dst, c.hops + 1 FROM sc c JOIN sys g ON g.topic = c.topic AND g.src = c.dst WHERE c.hops < 10),
gr AS (SELECT topic, src, dst, min(hops) AS hops FROM gc GROUP BY 1, 2, 3), sr AS (SELECT topic, src, dst, min(hops) AS hops FROM sc GROUP BY 1, 2, 3)"""
ORACLES["closure"] = f"WITH RECURSIVE {H} SELECT topic, src, dst FROM gr WHERE hops > 1"
ORACLES["shortest_path"] = f"WITH RECURSIVE {H} SELECT topic, src, dst, CAST(hops AS BIGINT) AS hops FROM gr"
_HYP = """t AS (
  SELECT topic, count(*) AS g, count(*) FILTER (WHERE {cond} AND (topic, src, dst) IN (SELECT (topic, src, dst) FROM sr)) AS gh FROM gr GROUP BY 1),
u AS (SELECT topic, count(*) AS s, count(*) FILTER (WHERE {cond} AND (topic, src, dst) IN (SELECT (topic, src, dst) FROM gr)) AS sh FROM sr GROUP BY 1),
v AS (SELECT topic, g, gh, coalesce(s, 0) AS s, coalesce(sh, 0) AS sh, gh / CAST(g AS DOUBLE) AS r, coalesce(sh / CAST(s AS DOUBLE), 0) AS p FROM t LEFT JOIN u USING (topic))
SELECT CAST(sum(g) AS BIGINT) AS gold, CAST(sum(gh) AS BIGINT) AS gold_hit, CAST(sum(s) AS BIGINT) AS sys, CAST(sum(sh) AS BIGINT) AS sys_hit, round(sum(gh) / CAST(sum(g) AS DOUBLE), 6) AS recall, round(sum(sh) / CAST(sum(s) AS DOUBLE), 6) AS precision,
       round(2.0 * (sum(gh) / CAST(sum(g) AS DOUBLE)) * (sum(sh) / CAST(sum(s) AS DOUBLE)) / (sum(gh) / CAST(sum(g) AS DOUBLE) + sum(sh) / CAST(sum(s) AS DOUBLE)), 6) AS f1, round(avg(CASE WHEN r + p > 0 THEN 2 * r * p / (r + p) ELSE 0 END), 6) AS macro_f1 FROM v"""
ORACLES["hypernym"] = f"WITH RECURSIVE {H}, " + _HYP.format(cond="src NOT LIKE 'r%'")
_H50 = _HYP.replace("WHERE {cond} AND (topic, src, dst) IN (SELECT (topic, src, dst) FROM sr)", "WHERE (topic, src, dst) IN (SELECT (topic, src, dst) FROM sr) OR src LIKE 'r%' AND (topic, dst) IN (SELECT (topic, dst) FROM sr)").replace("WHERE {cond} AND (topic, src, dst) IN (SELECT (topic, src, dst) FROM gr)", "WHERE (topic, src, dst) IN (SELECT (topic, src, dst) FROM gr) OR src LIKE 'r%' AND (topic, dst) IN (SELECT (topic, dst) FROM gr)")
ORACLES["hypernym50"] = f"WITH RECURSIVE {H}, " + _H50
ORACLES["path_ratio"] = f"""WITH RECURSIVE {H}, nd AS (SELECT DISTINCT topic, dst AS c FROM gold),
gd AS (SELECT topic, src, dst, hops + 1 AS d FROM gr WHERE src NOT LIKE 'r%' UNION ALL SELECT topic, c, c, 1 FROM nd), sd AS (SELECT topic, src, dst, hops + 1 AS d FROM sr WHERE src NOT LIKE 'r%' UNION ALL SELECT topic, c, c, 1 FROM nd),
b AS (SELECT topic, coalesce(gd.d, 0) AS g, coalesce(sd.d, 0) AS s FROM gd FULL JOIN sd USING (topic, src, dst))
SELECT topic, round(sum(least(g, s) / CAST(greatest(g, s) AS DOUBLE)), 6) AS total, count(*) AS pairs, round(sum(least(g, s) / CAST(greatest(g, s) AS DOUBLE)) / count(*), 6) AS path_ratio FROM b GROUP BY 1"""
D = r"""d AS (SELECT doc_id AS doc, doc_id // 8 AS topic, row_number() OVER (PARTITION BY doc_id // 8 ORDER BY doc_id) - 1 AS para, list_filter(string_split(regexp_replace(regexp_replace(text, '([,.;:%()\[\]])', ' \1 ', 'g'), '[ \t\n\x0b\f\r]+', ' ', 'g'), ' '), lambda x: x <> '') AS tokens FROM documents)"""
_DETOK = r"regexp_replace(regexp_replace(array_to_string({0}, ' '), '\s+([,.;:%)\]])', '\1', 'g'), '([\[(])\s+', '\1', 'g')"
ORACLES["detok"] = rf"WITH {D} SELECT doc, md5(regexp_replace(regexp_replace(array_to_string(tokens, ' '), '\s+([,.;:%)\]])', '\1', 'g'), '([\[(])\s+', '\1', 'g')) AS digest, len(tokens) AS n_tokens FROM d"
_NORM = r"trim(regexp_replace(translate(lower({0}), '‘’“”', '''''\"\"'), '\s+', ' ', 'g'))".replace('\\"', '"')
ORACLES["norm_text"] = f"SELECT item_id, {_NORM.format('text')} AS norm FROM benchmark"
S_ = D + r""",
s AS (SELECT doc, sent, list_slice(tokens, sent * 48 + 1, sent * 48 + 48) AS tokens FROM (SELECT doc, tokens, unnest(range(0, (len(tokens) + 47) // 48)) AS sent FROM d))"""
_HALF = "w[{0}+1] || ' [ ' || w[{0}+2] || ' ' || w[{0}+3] || ' | method | used for = ' || w[{0}+5] || ' | part of = ' || w[{0}+4] || ' ] ' || w[{0}+6] || ' [ ' || w[{0}+7] || ' | task ] [ 12 ] ' || array_to_string(w[{0}+8:{0}+12], ' ') || ' [ ' || w[{0}+13] || ' ' || w[{0}+14] || ' |  | used for = ' || w[{0}+2] || ' ' || w[{0}+3] || ' ] ' || array_to_string(w[{0}+15:{0}+18], ' ') || ' [ ' || w[{0}+19] || ' | task | odd relation | compare = ' || w[{0}+7] || ' = ' || w[{0}+20] || ' ] ' || array_to_string(w[{0}+21:{0}+24], ' ') || ' '"
_TRIM = r"regexp_replace({0}, '^\s+|\s+$', '', 'g')"
_CLEAN = r"regexp_replace(regexp_replace({0}, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')"
#: Brackets with a mandatory type; the second kind lets a mention hold anything.
_RX = r"\[\s*([^|\]]+?)\s*\|\s*([^|\]]+?)\s*(?:\|\s*(.+?))?\s*\]"
_RX3 = _RX.replace(r"([^|\]]+?)\s*\|\s*(", r"(.+?)\s*\|\s*(", 1)
O_ = S_ + r""",
w AS (SELECT doc, sent, tokens, list_transform(range(1, 49), lambda k: regexp_replace(coalesce(tokens[k], 'x'), '[\[\]|=;]', '_', 'g')) AS w FROM s),
o AS (SELECT doc, sent, tokens, """ + _HALF.format(0) + " || " + _HALF.format(24) + " AS output FROM w)"


def _brackets(rx: str) -> str:
    return f"""b AS (SELECT doc, sent, tokens, regexp_extract_all(output, '{rx}', 1) AS t, regexp_extract_all(output, '{rx}', 2) AS y, regexp_extract_all(output, '{rx}', 3) AS r FROM o),
e AS (SELECT doc, sent, tokens, i AS ord, {_TRIM.format('t[i + 1]')} AS text, nullif({_TRIM.format('y[i + 1]')}, '') AS type, coalesce(r[i + 1], '') AS rels FROM (SELECT *, unnest(range(0, len(t))) AS i FROM b))"""


E_ = O_ + ", " + _brackets(_RX) + rf""",
pc AS (SELECT doc, sent, ord, text, type, i, x FROM (SELECT *, unnest(range(0, len(ps))) AS i, unnest(ps) AS x FROM (SELECT *, string_split(rels, '|') AS ps FROM e)) WHERE contains(x, '=')),
rel AS (SELECT doc, sent, ord, text, type, row_number() OVER (PARTITION BY doc, sent, ord ORDER BY i) - 1 AS k, {_CLEAN.format("substr(x, 1, strpos(x, '=') - 1)")} AS pred, {_CLEAN.format("substr(x, strpos(x, '=') + 1)")} AS obj FROM pc),
nm AS (SELECT *, {_NORM.format('text')} AS name FROM e)"""
ORACLES["parse_entities"] = f"WITH {E_} SELECT doc, sent, ord, text, type, (SELECT count(*) FROM rel WHERE rel.doc = e.doc AND rel.sent = e.sent AND rel.ord = e.ord) AS n_rels FROM e"
ORACLES["parse_relations"] = f"WITH {E_} SELECT doc, sent, ord, k, pred, obj FROM rel"
N_ = O_ + ", " + _brackets(_RX3) + r""",
nr AS (SELECT doc, sent, ord, i, regexp_extract_all(rels, '([a-zA-Z_]+)\s*=\s*([^;|]+)', 1)[i + 1] AS pred, """ + _TRIM.format(r"regexp_extract_all(rels, '([a-zA-Z_]+)\s*=\s*([^;|]+)', 2)[i + 1]") + r""" AS obj FROM (SELECT *, unnest(range(0, len(regexp_extract_all(rels, '([a-zA-Z_]+)\s*=\s*([^;|]+)')))) AS i FROM e)),
fi AS (SELECT doc, sent, lower(text) AS name, min(ord) AS place FROM e GROUP BY 1, 2, 3)"""
ORACLES["parse_named"] = f"WITH {N_} SELECT e.doc, e.sent, e.ord, e.text, coalesce(e.type, '') AS type, count(nr.i) AS n_rels FROM e LEFT JOIN nr USING (doc, sent, ord) GROUP BY ALL"
ORACLES["entity_links"] = f"WITH {N_} SELECT nr.doc, nr.sent, a.place AS subj, nr.pred, b.place AS obj, nr.obj AS obj_text FROM nr JOIN e USING (doc, sent, ord) JOIN fi a ON a.doc = nr.doc AND a.sent = nr.sent AND a.name = lower(e.text) LEFT JOIN fi b ON b.doc = nr.doc AND b.sent = nr.sent AND b.name = lower(nr.obj)"
ORACLES["bracket_mentions"] = rf"WITH {O_}, b AS (SELECT doc, sent, regexp_extract_all(output, '(?s)\[\s*(.+?)\s*\]', 1) AS t FROM o) SELECT doc, sent, i AS ord, {_TRIM.format("string_split(t[i + 1], '|')[1]")} AS text FROM (SELECT *, unnest(range(0, len(t))) AS i FROM b)"
ORACLES["incoming_relations"] = f"WITH {E_}, ro AS (SELECT doc, sent, pred, {_NORM.format('obj')} AS name FROM rel) SELECT doc, sent, ord, count(*) AS n, min(pred) AS first_pred FROM nm JOIN ro USING (doc, sent, name) GROUP BY 1, 2, 3"
_NEAR = "SELECT doc, sent, ord, string_agg(text || '/' || type, ';' ORDER BY text, type) AS near FROM (SELECT a.doc, a.sent, a.ord, b.text, coalesce(b.type, '') AS type, row_number() OVER (PARTITION BY a.doc, a.sent, a.ord ORDER BY b.text, coalesce(b.type, '')) AS r FROM e a JOIN e b ON a.doc = b.doc AND a.sent = b.sent AND a.ord <> b.ord) WHERE r <= 6 GROUP BY 1, 2, 3"
ORACLES["co_mentions"] = f"WITH {E_} {_NEAR}"
_DT = _DETOK.format
ORACLES["signature_fields"] = f"""WITH {E_},
ou AS (SELECT doc, sent, ord, string_agg(pred || '/' || obj, ';' ORDER BY pred, obj) AS outgoing FROM (SELECT *, row_number() OVER (PARTITION BY doc, sent, ord ORDER BY pred, obj) AS r FROM rel) WHERE r <= 6 GROUP BY 1, 2, 3),
ic AS (SELECT nm.doc, nm.sent, nm.ord, rel.pred, rel.text AS subject, coalesce(rel.type, '') AS st, row_number() OVER (PARTITION BY nm.doc, nm.sent, nm.ord ORDER BY rel.pred, rel.text, rel.type NULLS FIRST) AS r FROM nm JOIN rel ON rel.doc = nm.doc AND rel.sent = nm.sent AND {_NORM.format('rel.obj')} = nm.name),
ii AS (SELECT doc, sent, ord, string_agg(pred || '/' || subject || '/' || st, ';' ORDER BY r) AS incoming FROM ic WHERE r <= 6 GROUP BY 1, 2, 3),
ne AS ({_NEAR}),
wi AS (SELECT doc, sent, st, en, {_NORM.format(_DT('tokens[st + 1:en]'))} AS g FROM (SELECT doc, sent, tokens, st, st + unnest([1, 2, 3]) AS en FROM (SELECT doc, sent, tokens, unnest(range(0, len(tokens))) AS st FROM s)) WHERE en <= len(tokens)),
fs AS (SELECT nm.doc, nm.sent, nm.ord, min(struct_pack(a := st, b := en)) AS p FROM nm JOIN wi ON wi.doc = nm.doc AND wi.sent = nm.sent AND wi.g = nm.name AND nm.name <> '' GROUP BY 1, 2, 3)
SELECT nm.doc, nm.sent, nm.ord, nm.text, nm.type, coalesce(outgoing, '') AS outgoing, coalesce(incoming, '') AS incoming, coalesce(near, '') AS near,
       CASE WHEN p IS NULL THEN {_DT('tokens')} ELSE {_DT("list_concat(list_concat(list_concat(tokens[1:p.a], ['<m>']), list_concat(tokens[p.a + 1:p.b], ['</m>'])), tokens[p.b + 1:])")} END AS context
FROM nm LEFT JOIN ou USING (doc, sent, ord) LEFT JOIN ii USING (doc, sent, ord) LEFT JOIN ne USING (doc, sent, ord) LEFT JOIN fs USING (doc, sent, ord)"""
ORACLES["mention_signatures"] = f"WITH {S_}, v AS (SELECT doc, sent, tokens, unnest([1, 4]) AS a FROM s WHERE len(tokens) > 6) SELECT doc, sent, CAST(a AS BIGINT) AS start, CAST(a + 1 AS BIGINT) AS \"end\", {_DT('tokens[a + 1:a + 2]')} AS signature FROM v"
ORACLES["span_alignment"] = f"""WITH {S_},
t AS (SELECT DISTINCT doc, sent, target, {_NORM.format('target')} AS g FROM (SELECT doc, sent, unnest([concat_ws(' ', tokens[6], tokens[7]), concat_ws(' ', tokens[10]), concat_ws(' ', tokens[21], tokens[22], tokens[23])]) AS target FROM s) WHERE {_NORM.format('target')} <> ''),
wi AS (SELECT doc, sent, st, en, {_NORM.format(_DT('tokens[st + 1:en]'))} AS g FROM (SELECT doc, sent, tokens, st, st + unnest([1, 2, 3, 4]) AS en FROM (SELECT doc, sent, tokens, unnest(range(0, len(tokens))) AS st FROM s)) WHERE en <= len(tokens)),
f AS (SELECT t.doc, t.sent, target, st, min(en) AS en FROM t JOIN wi USING (doc, sent, g) GROUP BY 1, 2, 3, 4)
SELECT doc, sent, count(*) AS n, min(st) AS first_start, max(en) AS last_end FROM f GROUP BY 1, 2"""
ORACLES["exact_recall"] = f"""WITH {E_}, g AS (SELECT doc, sent, k, {_NORM.format('tokens[k + 1]')} AS name FROM s, (VALUES (1), (6), (7), (18), (30), (42)) AS v(k) WHERE k < len(tokens)), f AS (SELECT DISTINCT doc, sent, name FROM nm)
SELECT doc, count(*) AS gold, count(f.name) AS hits FROM g LEFT JOIN f USING (doc, sent, name) GROUP BY 1"""
ORACLES["flatten_offsets"] = f"WITH {D} SELECT topic, para, CAST(sum(len(tokens)) OVER (PARTITION BY topic ORDER BY para) - len(tokens) AS BIGINT) AS flatten_offset FROM d"
ORACLES["fuzzy_match"] = f"""WITH {M}, g AS (SELECT topic, idx AS id, part % 20 AS g0, part % 20 + gold AS g1 FROM m WHERE in_key), e AS (SELECT topic, idx AS ord, part % 23 AS e0, part % 23 + sys AS e1 FROM m WHERE in_sys)
SELECT g.topic, id, min(ord) AS ord FROM g LEFT JOIN e ON g.topic = e.topic AND abs(g0 - e0) <= 3 AND abs((g1 - g0) - (e1 - e0)) <= 3 GROUP BY 1, 2"""
ORACLES["sentence_assign"] = f"""WITH {M}, s AS (SELECT topic, idx, part % 18 AS st FROM m), o AS (SELECT topic, idx, st, k, greatest(0, least(st + 4, 5 * k + 5) - greatest(st, 5 * k)) AS v FROM s, (VALUES (0), (1), (2), (3)) AS q(k))
SELECT topic, idx, CAST(arg_max(k, v * 10 - k) AS BIGINT) AS sentence, CAST(greatest(0, least(st + 4, 10) - greatest(st, 5)) AS BIGINT) AS in_second, CAST(CASE WHEN st <= 5 AND 9 <= st + 3 AND NOT (st = 5 AND st + 3 = 9) THEN 1 WHEN 5 <= st AND st + 3 <= 9 THEN -1 ELSE 0 END AS BIGINT) AS inside FROM o GROUP BY topic, idx, st"""
ORACLES["interval_merge"] = """WITH p AS (SELECT conv_id, turn, CASE WHEN turn - 1 > lag(turn) OVER w + 3 OR lag(turn) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM conversations WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS run FROM p) SELECT conv_id, min(turn) - 1 AS start, max(turn) + 1 AS "end", count(*) AS n FROM r GROUP BY conv_id, run"""
ORACLES["conll_encode"] = f"""WITH {M}, s AS (SELECT topic AS doc, idx AS st, least(idx + part % 3, max(idx) OVER (PARTITION BY topic)) AS en, gold AS c FROM m),
o AS (SELECT doc, st AS pos, string_agg('(' || c || ')', '|' ORDER BY c) AS v FROM s WHERE st = en GROUP BY 1, 2), a AS (SELECT doc, st AS pos, string_agg('(' || c, '|' ORDER BY en DESC, c DESC) AS v FROM s WHERE st < en GROUP BY 1, 2),
b AS (SELECT doc, en AS pos, string_agg(c || ')', '|' ORDER BY st DESC, c DESC) AS v FROM s WHERE st < en GROUP BY 1, 2)
SELECT topic AS doc, idx AS pos, coalesce(o.v, a.v, b.v, '-') AS cell FROM m LEFT JOIN o ON o.doc = topic AND o.pos = idx LEFT JOIN a ON a.doc = topic AND a.pos = idx LEFT JOIN b ON b.doc = topic AND b.pos = idx"""
ORACLES["conll_decode"] = f"WITH {M} SELECT topic AS doc, min(idx) AS start, max(idx) AS \"end\", arg_min(gold, idx) AS cluster FROM m GROUP BY topic, idx // 2"
ORACLES["range_alignment"] = f"""WITH {M} SELECT k.topic AS doc, k.idx AS key_id, min(r.idx) AS resp_id FROM m k JOIN m r ON k.topic = r.topic AND k.in_key AND r.in_sys AND r.part % 23 BETWEEN k.part % 20 AND k.part % 20 + 1 AND r.part % 23 + 2 BETWEEN k.part % 20 + 2 AND k.part % 20 + 4 GROUP BY 1, 2"""
ORACLES["nested_removal"] = f"""WITH {M}, s AS (SELECT topic AS doc, gold AS cluster, idx AS id, part % 7 AS st, part % 7 + sys AS en FROM m),
f AS (SELECT *, around > 0 AS inner_ FROM (SELECT s.*, (SELECT count(*) FROM s o WHERE o.doc = s.doc AND o.cluster = s.cluster AND o.st <= s.st AND s.en <= o.en AND (o.st < s.st OR s.en < o.en)) AS around FROM s)),
g AS (SELECT *, count(*) OVER (PARTITION BY doc, cluster) - sum(around) OVER (PARTITION BY doc, cluster) AS left_, count(*) OVER (PARTITION BY doc, cluster) AS n FROM f)
SELECT doc, cluster, id, st AS start, en AS "end" FROM g WHERE (left_ = 1 AND n > 1) OR NOT inner_"""
ORACLES["non_referring_prf"] = f"WITH {M}, c AS (SELECT count(*) FILTER (WHERE in_key AND in_sys) AS tp, count(*) FILTER (WHERE in_key) AS k, count(*) FILTER (WHERE in_sys) AS s FROM m WHERE part % 5 = 0) SELECT tp, round(tp / CAST(k AS DOUBLE), 6) AS recall, round(tp / CAST(s AS DOUBLE), 6) AS precision, round(2.0 * tp / (k + s), 6) AS f1 FROM c"
ORACLES["last_wins_scan"] = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC) AS r FROM lineitem) WHERE r = 1"
ORACLES["subset_semi_join"] = "SELECT l_orderkey AS id, count(*) AS n, round(sum(l_quantity), 6) AS quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F') GROUP BY 1"
ORACLES["pair_scores_dump"] = f"WITH {P} SELECT topic AS topic_id, CAST(max(j) + 1 AS BIGINT) AS n, count(*) AS n_edges, round(CAST(max(CASE WHEN i = 0 AND j = 1 THEN logit END) AS DOUBLE), 6) AS first_logit FROM p GROUP BY 1"


def _labels(name: str, linkage: str, threshold: float, steps: int = 20) -> str:
    """CTEs that end in {name}(topic, idx, label): merges of the nearest clusters below the threshold, one level each; topics have fewer than `steps` mentions."""
    fold = {"average": "avg", "complete": "max"}[linkage]
    out = [f"{name}0 AS (SELECT topic, idx, idx AS label FROM m)"]
    for k in range(1, steps):
        was = f"{name}{k - 1}"
        pairs = f"SELECT q.topic, least(a.label, b.label) AS la, greatest(a.label, b.label) AS lb, {fold}(1 - q.p) AS d FROM q JOIN {was} a ON a.topic = q.topic AND a.idx = q.i JOIN {was} b ON b.topic = q.topic AND b.idx = q.j WHERE a.label <> b.label GROUP BY 1, 2, 3"
        out.append(f"{name}{k} AS MATERIALIZED (SELECT l.topic, l.idx, CASE WHEN l.label = n.lb THEN n.la ELSE l.label END AS label FROM {was} l LEFT JOIN (SELECT topic, la, lb FROM ({pairs}) WHERE d < {threshold} QUALIFY row_number() OVER (PARTITION BY topic ORDER BY d, la, lb) = 1) n USING (topic))")
    return ", ".join(out) + f", {name} AS (SELECT topic, idx, dense_rank() OVER (PARTITION BY topic ORDER BY label) - 1 AS label FROM {name}{steps - 1})"


ORACLES["agglomerative"] = f"WITH {P}, {_labels('z', 'average', 0.4)} SELECT topic, CAST(0.4 AS DOUBLE) AS threshold, idx, label FROM z"


def _sweep() -> str:
    marks = (0.2, 0.3, 0.4)
    ctes = ", ".join(_labels(f"z{i}_", "complete", t) for i, t in enumerate(marks))
    every = " UNION ALL ".join(f"SELECT CAST({t} AS DOUBLE) AS threshold, topic, idx, label FROM z{i}_" for i, t in enumerate(marks))
    return f"""{P}, {ctes}, ev AS ({every}), eb AS (SELECT threshold, topic, gold, label, count(*) AS n FROM ev JOIN m USING (topic, idx) GROUP BY ALL),
    es AS (SELECT *, sum(n) OVER (PARTITION BY threshold, topic, gold) AS g, sum(n) OVER (PARTITION BY threshold, topic, label) AS l FROM eb),
    sw AS (SELECT threshold, sum(n * n / CAST(g AS DOUBLE)) / sum(n) AS r, sum(n * n / CAST(l AS DOUBLE)) / sum(n) AS p FROM es GROUP BY 1)"""


ORACLES["threshold_sweep"] = f"WITH {_sweep()} SELECT threshold, round(r, 6) AS recall, round(p, 6) AS precision, round(2 * r * p / (r + p), 6) AS f1 FROM sw"
ORACLES["sweep_winner"] = ORACLES["threshold_sweep"] + " ORDER BY 2 * r * p / (r + p) DESC, threshold LIMIT 1"
ORACLES["system_topics"] = f"WITH {M} SELECT topic, idx AS para, part AS start, part + 1 AS \"end\", sys AS cluster FROM m WHERE topic IN (SELECT topic FROM m GROUP BY 1 HAVING bool_and(in_sys))"
ORACLES["skipped_topics"] = f"WITH {M} SELECT topic FROM m GROUP BY 1 HAVING NOT bool_and(in_sys)"
ORACLES["merged_clusters"] = f"""WITH RECURSIVE {M}, rl AS (SELECT * FROM (SELECT topic, part AS src, lead(part) OVER (PARTITION BY topic ORDER BY idx) AS dst FROM m WHERE gold = sys) WHERE dst IS NOT NULL),
bo AS (SELECT topic, src AS a, dst AS b FROM rl UNION SELECT topic, dst, src FROM rl), re(topic, a, b) AS (SELECT DISTINCT topic, part, part FROM m UNION SELECT re.topic, re.a, bo.b FROM re JOIN bo ON bo.topic = re.topic AND bo.a = re.b),
le AS (SELECT topic, a, min(b) AS least FROM re GROUP BY 1, 2), nu AS (SELECT topic, a, dense_rank() OVER (PARTITION BY topic ORDER BY least) - 1 AS merged FROM le)
SELECT m.topic, m.part AS cluster, m.idx, merged FROM m JOIN nu ON nu.topic = m.topic AND nu.a = m.part"""
ORACLES["closure_cyclic"] = """WITH RECURSIVE ed AS (
  SELECT CAST(n_regionkey AS BIGINT) AS topic, 'n' || n_nationkey AS src, 'n' || coalesce(lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), min(n_nationkey) OVER (PARTITION BY n_regionkey)) AS dst FROM nation
  UNION SELECT CAST(n_regionkey AS BIGINT), 'n' || n_nationkey, 's' || s_suppkey FROM supplier JOIN nation ON s_nationkey = n_nationkey),
re(topic, src, dst) AS (SELECT * FROM ed UNION SELECT re.topic, re.src, ed.dst FROM re JOIN ed ON ed.topic = re.topic AND ed.src = re.dst)
SELECT topic, src, dst FROM re WHERE src <> dst AND (topic, src, dst) NOT IN (SELECT (topic, src, dst) FROM ed)"""


def _wide(phi: str) -> str:
    """Sum of best assignments over documents, key clusters one by one with the set of taken system clusters as bits."""
    levels = ["v0 AS (SELECT doc, 0 AS mask, CAST(0 AS DOUBLE) AS v FROM kd)"]
    for k in range(7):
        take = f"SELECT v.doc, v.mask | (1 << CAST(x.sys AS INTEGER)) AS mask, v.v + {phi} AS v FROM v{k} v JOIN x ON x.doc = v.doc AND x.key = {k} WHERE v.mask & (1 << CAST(x.sys AS INTEGER)) = 0"
        levels.append(f"v{k + 1} AS (SELECT doc, mask, max(v) AS v FROM (SELECT * FROM v{k} UNION ALL {take}) GROUP BY 1, 2)")
    return ", ".join(levels)


_WIDE = A.replace("CASE WHEN in_key THEN gold END AS key, CASE WHEN in_sys THEN sys END AS sys", "CASE WHEN in_key THEN part % 7 END AS key, CASE WHEN in_sys THEN (part + gold) % 6 END AS sys")


def _ceaf_wide(name: str, phi: str) -> str:
    best = "SELECT sum(v) FROM (SELECT doc, max(v) AS v FROM v7 GROUP BY 1)"
    return f"SELECT '{name}' AS metric, * FROM ({_prf(best, 'SELECT count(*) FROM kz', best, 'SELECT count(*) FROM sz WHERE doc IN (FROM kd)', _WIDE + ', ' + _wide(phi))})"


ORACLES["ceaf_wide"] = _ceaf_wide("ceafe", "2.0 * x.n / (x.k + x.s)") + " UNION ALL " + _ceaf_wide("ceafm", "x.n")
_BOTH = f"""{M}, gs AS (SELECT topic, list(struct_pack(o := idx, s := part % 20) ORDER BY idx) AS g FROM m WHERE in_key GROUP BY 1), ps AS (SELECT topic, list(struct_pack(s := part % 23) ORDER BY idx) AS p FROM m WHERE in_sys GROUP BY 1),
r(topic, k, used, hit, g, p) AS (
  SELECT topic, 0, CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), g, coalesce(p, []) FROM gs LEFT JOIN ps USING (topic)
  UNION ALL SELECT topic, k + 1, CASE WHEN c IS NULL THEN used ELSE list_append(used, c) END, c, g, p FROM (SELECT *, list_filter(p, lambda x: NOT list_contains(used, x.s) AND abs(x.s - g[k + 1].s) <= 2)[1].s AS c FROM r WHERE k < len(g))),
h AS (SELECT topic, g[k].o AS ord, g[k].s AS start, hit FROM r WHERE k > 0)"""
ORACLES["extraction_recall"] = f"WITH RECURSIVE {_BOTH}, t AS (SELECT topic, count(hit) AS hits, count(*) AS gold FROM h GROUP BY 1) SELECT CAST(sum(hits) AS BIGINT) AS hits, CAST(sum(gold) AS BIGINT) AS gold, round(sum(hits) / CAST(sum(gold) AS DOUBLE), 6) AS micro, round(avg(hits / CAST(gold AS DOUBLE)), 6) AS macro FROM t"
ORACLES["extraction_misses"] = f"WITH RECURSIVE {_BOTH} SELECT topic, ord, start, start + 2 AS \"end\" FROM h WHERE hit IS NULL"
ORACLES["conll_marks_odd"] = rf"""WITH {M}, c AS (SELECT topic AS doc, idx AS pos, [ '(' || part || ')(' || gold || ')', '(' || part || '(' || gold || ')', part || ')(' || gold, part || ')' || gold || ')', '()(' || part || '|(' || gold || 'x', '*(' || part || 'a)|' || gold || '|-'][idx % 6 + 1] AS cell FROM m),
k AS (SELECT doc, pos, regexp_extract_all(regexp_replace(cell, '[^0-9()|]', '', 'g'), '[(]?[0-9]+(?:[)]|[|]|$)') AS ms FROM c),
u AS (SELECT doc, pos, list_filter(ms, lambda x: x LIKE '(%' OR x LIKE '%)') AS ms FROM k)
SELECT doc, pos, i AS k, CAST(regexp_extract(ms[i + 1], '[0-9]+') AS BIGINT) AS cluster, ms[i + 1] LIKE '(%' AS opens, ms[i + 1] LIKE '%)' AS closes FROM (SELECT *, unnest(range(0, len(ms))) AS i FROM u)"""
ORACLES["file_scores"] = ORACLES["coref_scores"]
ORACLES["score_report"] = " UNION ALL ".join(f"SELECT rpad('{n}', 10, ' ') || printf(' Recall: %.2f  Precision: %.2f  F1: %.2f', 100 * recall, 100 * precision, 100 * f1) AS line FROM ({_prf(*m)})" for n, m in (("muc", MUC), ("b3", B3)))
ORACLES["unseen_mask"] = f"WITH {M}, u AS (SELECT *, count(*) FILTER (WHERE in_sys) OVER (PARTITION BY topic, gold) AS c, count(*) OVER (PARTITION BY topic, gold) AS n FROM m) SELECT topic AS doc, gold AS cluster, idx AS start, idx AS \"end\" FROM u WHERE in_sys AND (c > 1 OR c = n)"
ORACLES["common_topics"] = f"WITH {M} SELECT topic FROM m WHERE in_key INTERSECT SELECT topic FROM m WHERE in_sys"
ORACLES["topic_density"] = f"""WITH {_STATS.replace('SELECT topic, gold, count(*) AS size FROM m', 'SELECT topic, gold, count(*) AS size FROM m WHERE in_key')}, {D}, y AS (SELECT topic, count(*) AS n_docs, CAST(sum(len(tokens)) AS BIGINT) AS n_tokens FROM d GROUP BY 1)
SELECT y.topic, n_docs, n_tokens, coalesce(n_mentions, 0) AS n_mentions, coalesce(n_clusters, 0) AS n_clusters, coalesce(max_cluster_size, 0) AS max_cluster_size, coalesce(min_cluster_size, 0) AS min_cluster_size, coalesce(pos_pairs, 0) AS pos_pairs,
       coalesce(total_pairs, 0) AS total_pairs, round(coalesce(pos_rate, 0), 6) AS pos_rate, round(coalesce(100 * n_mentions / nullif(CAST(n_tokens AS DOUBLE), 0), 0), 6) AS mentions_per_100_tokens FROM y LEFT JOIN s ON s.topic = y.topic"""


def _fit(source: str, rounds: int = 6, width: int = 16) -> str:
    """CTEs that end in b{rounds}(low, high): brackets of log(1 / T) around the least loss of {source}(logit, label)."""
    out = ["b0 AS (SELECT CAST(-6 AS DOUBLE) AS low, CAST(6 AS DOUBLE) AS high)"]
    for k in range(1, rounds + 1):
        out.append(f"m{k} AS MATERIALIZED (SELECT ix, low + (high - low) * ix / {width - 1} AS v FROM b{k - 1}, range({width}) AS t(ix))")
        out.append(f"i{k} AS MATERIALIZED (SELECT ix FROM (SELECT ix, avg(greatest(z, 0) - z * label + ln(1 + exp(-abs(z)))) AS loss FROM (SELECT ix, CAST(logit AS DOUBLE) * exp(v) AS z, label FROM {source}, m{k}) GROUP BY ix) ORDER BY loss, ix LIMIT 1)")
        out.append(f"b{k} AS MATERIALIZED (SELECT (SELECT v FROM m{k} WHERE ix = greatest(0, (SELECT ix FROM i{k}) - 1)) AS low, (SELECT v FROM m{k} WHERE ix = least({width - 1}, (SELECT ix FROM i{k}) + 1)) AS high)")
    return ", ".join(out)


ORACLES["fitted_temperature"] = f"WITH {P}, {_fit('p')} SELECT round(exp(-(low + high) / 2), 3) AS temperature FROM b6"
ORACLES["temperature_record"] = f"WITH {P}, pp AS (SELECT logit, label FROM p WHERE topic IN (SELECT topic FROM m GROUP BY 1 HAVING bool_and(in_sys))), {_fit('pp')} SELECT round(exp(-(low + high) / 2), 3) AS temperature, 'validation' AS split, (SELECT count(*) FROM pp) AS num_pairs, (SELECT round(avg(label), 6) FROM pp) AS pos_rate, 'pairs' AS scores_path FROM b6"
ORACLES["lexical_scores"] = r"""WITH w AS (SELECT item_id, item_id // 8 AS t, list_distinct(list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS w FROM benchmark),
j AS (SELECT a.item_id AS i, b.item_id AS j, len(list_intersect(a.w, b.w)) AS c, len(a.w) AS na, len(b.w) AS nb FROM w a JOIN w b ON a.t = b.t AND a.item_id < b.item_id)
SELECT i, j, round(-4.0 + 6.0 * coalesce(c / nullif(CAST(na + nb - c AS DOUBLE), 0), 0) + 2.0 * coalesce(c / nullif(CAST(least(na, nb) AS DOUBLE), 0), 0), 6) AS logit FROM j"""
