"""DuckDB SQL for the registered queries, over the same inputs."""

from __future__ import annotations

import re

K, ALPHA = 3, 0.005

#: Common tables, each of those before it in the dictionary.
PARTS = {
    "vec": "SELECT vec_id AS cell, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings",
    "flat": "SELECT cell AS col, g, 'g' || lpad(CAST(g AS VARCHAR), 2, '0') AS gene, v[g + 1] AS value FROM vec, LATERAL (SELECT unnest(range(0, len(v))) AS g)",
    "bulk": "SELECT gene, col, value FROM flat WHERE col % 10 = 0 AND g < 60",
    "cells": "SELECT gene, col, value FROM flat WHERE col % 10 <> 0 AND g >= 4",
    "common": "SELECT DISTINCT gene FROM bulk WHERE gene IN (SELECT gene FROM cells)",
    "cols": "SELECT 'bulk' AS side, * FROM bulk WHERE gene IN (FROM common) UNION ALL SELECT 'cell', * FROM cells WHERE gene IN (FROM common)",
    "target": "SELECT rank, avg(value) AS target FROM (SELECT *, row_number() OVER (PARTITION BY side, col ORDER BY value, gene) AS rank FROM cols) GROUP BY rank",
    "qn": """SELECT r.side, r.gene, r.col, CASE WHEN r.many % 2 = 0 THEN (t.target + u.target) / 2 ELSE t.target END AS value
      FROM (SELECT *, rank() OVER (PARTITION BY side, col ORDER BY value) AS low, count(*) OVER (PARTITION BY side, col, value) AS many FROM cols) r
      JOIN target t ON t.rank = r.low + (r.many - 1) // 2 LEFT JOIN target u ON u.rank = t.rank + 1""",
    "z0": "SELECT side, gene, col, (value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1) AS value FROM cols WINDOW w AS (PARTITION BY side, col)",
    "z": "SELECT side, gene, col, (value - avg(value) OVER w) / coalesce(nullif(stddev_samp(value) OVER w, 0), 1) AS value FROM qn WINDOW w AS (PARTITION BY side, col)",
    "corr": "SELECT b.col AS sample, c.col AS cell, sum(b.value * c.value) / (count(*) - 1) AS value FROM z b JOIN z c ON b.gene = c.gene AND b.side = 'bulk' AND c.side = 'cell' GROUP BY ALL",
    "x": "SELECT sample, cell, value / (SELECT sqrt(sum(value * value)) FROM corr) AS value FROM corr",
    "pos": "SELECT sample, greatest(value, 0) / (SELECT sqrt(sum(greatest(value, 0) * greatest(value, 0))) FROM corr) AS v, cell FROM corr",
    "patients": "SELECT cell AS col, CAST(1 + (cell * 7919) % 37 AS DOUBLE) AS time, CAST(label % 2 AS INTEGER) AS status FROM vec WHERE cell % 10 = 0",
    "labelled": "SELECT cell AS col, CASE WHEN label < 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS label FROM vec WHERE cell % 10 = 0",
    "customers_of": """SELECT o_custkey AS col, CAST(date_diff('day', min(CAST(o_orderdate AS DATE)), max(CAST(o_orderdate AS DATE))) AS DOUBLE) AS time,
      CASE WHEN arg_max(o_orderstatus, (CAST(o_orderdate AS DATE), o_orderkey)) = 'F' THEN 1 ELSE 0 END AS status FROM orders GROUP BY o_custkey""",
    "h": f"SELECT cell, k, ((cell * 31 + k * 17) % 97 + 1) / 98.0::DOUBLE AS v FROM vec, range(0, {K}) t(k) WHERE cell % 10 <> 0",
    "w": f"SELECT cell AS sample, k, ((cell * 13 + k * 29) % 89 + 1) / 90.0::DOUBLE AS v FROM vec, range(0, {K}) t(k) WHERE cell % 10 = 0",
    "dots": "SELECT a.cell AS src, b.cell AS dst, list_dot_product(a.v, b.v) AS score FROM vec a JOIN vec b ON a.cell <> b.cell WHERE a.cell % 10 <> 0 AND b.cell % 10 <> 0",
    "near": "SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM dots QUALIFY rank <= 20",
    "all_dots": "SELECT a.cell AS src, b.cell AS dst, list_dot_product(a.v, b.v) AS score FROM vec a JOIN vec b ON a.cell <> b.cell",
    "all_near": "SELECT *, row_number() OVER (PARTITION BY src ORDER BY score DESC, dst) AS rank FROM all_dots QUALIFY rank <= 20",
    "all_directed": "SELECT src, dst, 1.0::DOUBLE AS w FROM all_near WHERE rank <= 5",
    "directed": "SELECT src, dst, 1.0::DOUBLE AS w FROM near WHERE rank <= 5",
    "links": "SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT src, dst FROM directed UNION SELECT dst, src FROM directed)",
    "degs": "SELECT src AS cell, sum(w) AS deg FROM links GROUP BY src",
    "e": "SELECT l.src, l.dst, l.w / sqrt(a.deg * b.deg) AS w FROM links l JOIN degs a ON a.cell = l.src JOIN degs b ON b.cell = l.dst",
    "hat": "SELECT e.src AS cell, h.k, sum(e.w * h.v) AS v FROM e JOIN h ON h.cell = e.dst GROUP BY ALL",
    "all_h": f"SELECT cell, k, ((cell * 31 + k * 17) % 97 + 1) / 98.0::DOUBLE AS v FROM vec, range(0, {K}) t(k)",
    "all_links": "SELECT src, dst, 1.0::DOUBLE AS w FROM (SELECT src, dst FROM all_directed UNION SELECT dst, src FROM all_directed)",
    "all_degs": "SELECT src AS cell, sum(w) AS deg FROM all_links GROUP BY src",
    "all_e": "SELECT l.src, l.dst, l.w / sqrt(a.deg * b.deg) AS w FROM all_links l JOIN all_degs a ON a.cell = l.src JOIN all_degs b ON b.cell = l.dst",
    "all_hat": "SELECT e.src AS cell, h.k, sum(e.w * h.v) AS v FROM all_e e JOIN all_h h ON h.cell = e.dst GROUP BY ALL",
    "edges": "SELECT a.l_partkey AS src, b.l_partkey AS dst, 1.0::DOUBLE AS w FROM lineitem a JOIN lineitem b USING (l_orderkey) WHERE a.l_partkey <> b.l_partkey GROUP BY ALL",
    "degree": "SELECT p_partkey AS cell, coalesce(deg, 0.0) AS deg, CASE WHEN deg > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS d FROM part LEFT JOIN (SELECT src, sum(w) AS deg FROM edges GROUP BY src) ON src = p_partkey",
    "normal": "SELECT src, dst, w / sqrt(a.deg * b.deg) AS w FROM edges JOIN degree a ON a.cell = src JOIN degree b ON b.cell = dst",
    "counts": "SELECT 'p' || l_partkey AS gene, l_suppkey AS col, sum(l_quantity) AS value FROM lineitem GROUP BY ALL",
    "rc": "SELECT gene, col, value / sum(value) OVER (PARTITION BY col) * 10000 AS value FROM counts",
    "logn": "SELECT gene, col, ln(1 + value) AS value FROM rc",
    "stats": "SELECT gene, sum(value) / n AS mean, (sum(value * value) - n * (sum(value) / n) * (sum(value) / n)) / (n - 1) AS variance FROM logn, (SELECT count(*) AS n FROM supplier) GROUP BY gene, n",
    "cv": """SELECT l_linenumber % 3 / 100.0::DOUBLE AS alpha1, l_suppkey % 3 / 100.0::DOUBLE AS alpha2, CAST(l_partkey % 5 + 1 AS INTEGER) AS fold,
      avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS cindex FROM lineitem GROUP BY ALL""",
    "means": "SELECT alpha1, alpha2, avg(cindex) AS cindex FROM cv GROUP BY ALL",
    "folded": "SELECT *, CAST((row_number() OVER (ORDER BY col * 7919 % 101, col) - 1) % 5 + 1 AS INTEGER) AS fold FROM patients",
}


def sql(body: str, *uses: str, more: str = "") -> str:
    """The body with the common tables that it needs; more: tables of its own."""
    needed, todo = set(), list(uses)
    while todo:
        name = todo.pop()
        if name not in needed:
            needed.add(name)
            text = f" {PARTS[name]} ".replace("(", " ( ").replace(")", " ) ").replace(",", " , ")
            todo += [p for p in PARTS if f" {p} " in text and p != name]
    tables = [f"{p} AS MATERIALIZED ({PARTS[p]})" for p in PARTS if p in needed]
    return f"WITH {', '.join(tables + ([more] if more else []))} {body}" if tables or more else body


def km(source: str, by: str = "") -> str:
    """Tables km_at and km: the survival rate of each patient of ``source``."""
    own, keys = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    return f"""km_at AS MATERIALIZED (SELECT *, 1 - events / sum(n) OVER ({own}ORDER BY time DESC) AS step FROM (SELECT {keys}time, sum(status) AS events, count(*) AS n FROM {source} GROUP BY ALL)),
    km_rate AS MATERIALIZED (SELECT {keys}time, product(step) OVER ({own}ORDER BY time) AS r FROM km_at),
    km AS MATERIALIZED (SELECT s.*, k.r FROM {source} s JOIN km_rate k ON k.time = s.time{f" AND k.{by} = s.{by}" if by else ""})"""


def ranked(by: str = "") -> str:
    """Table ranks: the pairwise ranks by a join of the patients with the sums by time, straight from the definition."""
    own, keys = (f"PARTITION BY {by} ", f"{by}, ") if by else ("", "")
    same = f"PARTITION BY {keys}time"
    return f"""rank_raw AS MATERIALIZED (SELECT *, CASE WHEN status = 1 THEN
      count(*) OVER d - count(*) OVER s + r * sum(CASE WHEN status = 0 THEN 1 / r ELSE 0 END) OVER u + 0.5 * count(*) FILTER (status = 1) OVER s
      ELSE count(*) FILTER (status = 0) OVER d - 0.5 * coalesce(sum(r) FILTER (status = 0) OVER d, 0) / r + count(*) FILTER (status = 1) OVER d - coalesce(sum(r) FILTER (status = 1) OVER d, 0) / r
      + 0.5 * r * (sum(CASE WHEN status = 0 THEN 1 / r ELSE 0 END) OVER u - sum(CASE WHEN status = 0 THEN 1 / r ELSE 0 END) OVER s) END - 0.5 AS raw
      FROM km WINDOW u AS ({own}ORDER BY time), d AS ({own}ORDER BY time DESC), s AS ({same})),
    ranks AS MATERIALIZED (SELECT *, raw / max(raw) OVER ({f"PARTITION BY {by}" if by else ""}) AS rank FROM rank_raw)"""


def steps(n: int, graph: bool, x: str = "pos", v: str = "v", guard: bool = False, factors: int = K) -> str:
    """Tables h0, w0 ... hn, wn of n multiplicative updates in long form; guard: what isn't finite and above 0 becomes 0."""
    def safe(value: str) -> str:
        return f"CASE WHEN isfinite({value}) AND {value} > 0 THEN {value} ELSE 0 END" if guard else value

    out = [f"h0 AS MATERIALIZED (FROM h WHERE k < {factors})", f"w0 AS MATERIALIZED (FROM w WHERE k < {factors})"]
    if graph:
        out += [km("patients"), ranked(), "s2 AS MATERIALIZED (SELECT col AS sample, (1 - rank) * (1 - rank) AS v FROM ranks)"]
    for i in range(1, n + 1):
        h, w = f"h{i - 1}", f"w{i - 1}"
        up, down = (f"+ {ALPHA} * coalesce(g.v, 0)", f"+ {ALPHA} * h.v") if graph else ("", "")
        if graph:
            out.append(f"g{i} AS MATERIALIZED (SELECT e.src AS cell, h.k, sum(e.w * h.v) AS v FROM e JOIN {h} h ON h.cell = e.dst GROUP BY ALL)")
        out += [
            f"wtw{i} AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM {w} a JOIN {w} b USING (sample) GROUP BY ALL)",
            f"wtx{i} AS MATERIALIZED (SELECT w.k, x.cell, sum(w.v * x.{v}) AS v FROM {w} w JOIN {x} x USING (sample) GROUP BY ALL)",
            f"den{i} AS MATERIALIZED (SELECT m.i AS k, h.cell, sum(m.v * h.v) AS v FROM wtw{i} m JOIN {h} h ON h.k = m.j GROUP BY ALL)",
            f"h{i} AS MATERIALIZED (SELECT h.cell, h.k, {safe(f"(h.v * (a.v {up}) / (b.v {down}))")} AS v FROM {h} h JOIN wtx{i} a USING (cell, k) JOIN den{i} b USING (cell, k) {f'LEFT JOIN g{i} g USING (cell, k)' if graph else ''})",
            f"hht{i} AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM h{i} a JOIN h{i} b USING (cell) GROUP BY ALL)",
            f"xht{i} AS MATERIALIZED (SELECT x.sample, h.k, sum(x.{v} * h.v) AS v FROM {x} x JOIN h{i} h USING (cell) GROUP BY ALL)",
            f"whh{i} AS MATERIALIZED (SELECT w.sample, m.j AS k, sum(w.v * m.v) AS v FROM {w} w JOIN hht{i} m ON m.i = w.k GROUP BY ALL)",
            f"w{i} AS MATERIALIZED (SELECT w.sample, w.k, {safe(f"(w.v * a.v / (b.v {f'+ {ALPHA} * s.v * w.v' if graph else ''}))")} AS v FROM {w} w JOIN xht{i} a USING (sample, k) JOIN whh{i} b USING (sample, k) {'JOIN s2 s USING (sample)' if graph else ''})",
        ]
    return ", ".join(out)


FITTED = "SELECT 'w' AS matrix, sample AS id, CAST(k AS INTEGER) AS k, round(v, 6) + 0.0 AS value FROM w2 UNION ALL SELECT 'h', cell, CAST(k AS INTEGER), round(v, 6) + 0.0 FROM h2"
MONTHS = """item AS MATERIALIZED (SELECT strftime(l_shipdate, '%m') AS gene, l_suppkey AS s, CAST(l_linenumber AS BIGINT) AS n FROM lineitem),
genes AS (SELECT DISTINCT gene FROM item),
b AS (SELECT gene, n AS col, floor(count(*) / 100)::DOUBLE AS value FROM item GROUP BY ALL), c AS (SELECT gene, s AS col, floor(count(*) / 10)::DOUBLE AS value FROM item GROUP BY ALL),
cols AS MATERIALIZED (
  SELECT 'bulk' AS side, gene, col, coalesce(value, 0) AS value FROM ((SELECT DISTINCT col FROM b) CROSS JOIN genes) LEFT JOIN b USING (col, gene)
  UNION ALL SELECT 'cell', gene, col, coalesce(value, 0) FROM ((SELECT DISTINCT col FROM c) CROSS JOIN genes) LEFT JOIN c USING (col, gene)),
target AS MATERIALIZED (""" + PARTS["target"] + "), qn AS MATERIALIZED (" + PARTS["qn"] + ")"
#: The counts with their zeros filled in, and the same statistics by the same words as for dense columns.
SPARSE = """bc AS MATERIALIZED (SELECT gene, col, value FROM counts WHERE col % 5 = 0 AND gene <> 'p1'), cc AS MATERIALIZED (SELECT gene, col, value FROM counts WHERE col % 5 <> 0),
genes AS MATERIALIZED (SELECT DISTINCT gene FROM bc WHERE gene IN (SELECT gene FROM cc)),
cols AS MATERIALIZED (
  SELECT 'bulk' AS side, gene, col, coalesce(value, 0) AS value, value IS NOT NULL AS stored FROM ((SELECT DISTINCT col FROM bc) CROSS JOIN genes) LEFT JOIN bc USING (col, gene)
  UNION ALL SELECT 'cell', gene, col, coalesce(value, 0), value IS NOT NULL FROM ((SELECT DISTINCT col FROM cc) CROSS JOIN genes) LEFT JOIN cc USING (col, gene)),
target AS MATERIALIZED (""" + PARTS["target"] + "), qn AS MATERIALIZED (" + PARTS["qn"].replace("SELECT r.side", "SELECT r.stored, r.side", 1) + """),
z0 AS MATERIALIZED (""" + PARTS["z0"].replace("SELECT side", "SELECT stored, side", 1) + "), z AS MATERIALIZED (" + PARTS["z"] + """),
corr0 AS MATERIALIZED (""" + PARTS["corr"].replace("FROM z b JOIN z c", "FROM z0 b JOIN z0 c") + "), corr AS MATERIALIZED (" + PARTS["corr"] + ")"


def k_steps() -> str:
    """Tables losses of the fixed start after two updates, with 2 and with 3 factors."""
    out = []
    for f in (2, 3):
        named = re.sub(r"\b((?:h|w|wtw|wtx|den|hht|xht|whh)[0-2])\b", rf"\1_{f}", steps(2, False, factors=f))
        out += [named, f"fit_{f} AS MATERIALIZED (SELECT sample, cell, sum(w.v * h.v) AS v FROM w2_{f} w JOIN h2_{f} h USING (k) GROUP BY ALL)"]
        out.append(f"loss_{f} AS MATERIALIZED (SELECT {f} AS k, sum((p.v - f.v) * (p.v - f.v)) AS loss FROM pos p JOIN fit_{f} f USING (sample, cell))")
    return ", ".join(out)


def fold_steps() -> tuple[str, str]:
    """Tables, and the rows of W, of the models of two folds with and without the graph's term, after two updates."""
    out, rows = ["folds2 AS MATERIALIZED (SELECT *, CAST((row_number() OVER (ORDER BY col * 7919 % 101, col) - 1) % 2 + 1 AS INTEGER) AS fold FROM patients)"], []
    for f in (1, 2):
        out += [
            f"people_{f} AS MATERIALIZED (SELECT * FROM folds2 WHERE fold <> {f})", f"{km(f'people_{f}')}, {ranked()}, s2 AS MATERIALIZED (SELECT col AS sample, (1 - rank) * (1 - rank) AS v FROM ranks)",
            f"px AS MATERIALIZED (SELECT sample, cell, v / (SELECT sqrt(sum(v * v)) FROM pos WHERE sample IN (SELECT col FROM people_{f})) AS v FROM pos WHERE sample IN (SELECT col FROM people_{f}))",
        ]
        out[-2:] = [re.sub(r"\b(km_at|km_rate|km|rank_raw|ranks|s2|px)\b", rf"\1_{f}", t) for t in out[-2:]]
        for name, penalty in (("a", ALPHA), ("b", 0.0)):
            text = steps(2, True, x="px").replace(f"+ {ALPHA} * coalesce(g.v, 0)", f"+ {penalty} * coalesce(g.v, 0)").replace(f"+ {ALPHA} * h.v", f"+ {penalty} * h.v")
            text = text[: text.index("km_at AS")] + text[text.index("g1 AS") :]  # ranks are those of the fold
            text = text.replace(f"w0 AS MATERIALIZED (FROM w WHERE k < {K})", f"w0 AS MATERIALIZED (FROM w WHERE k < {K} AND sample IN (SELECT col FROM people_{f}))")
            text = re.sub(r"\b(s2|px)\b", rf"\1_{f}", text)
            out.append(re.sub(r"\b((?:h|w|g|wtw|wtx|den|hht|xht|whh)[0-2])\b", rf"\1_{f}{name}", text))
            rows.append(f"SELECT {f} AS fold, {penalty}::DOUBLE AS alpha2, sample, CAST(k AS INTEGER) AS k, round(v, 6) + 0.0 AS value FROM w2_{f}{name}")
    return ", ".join(out), " UNION ALL ".join(rows)


#: W = XH' inverse(HH') for three factors, the inverse by cofactors.
PROJECTED = """g AS MATERIALIZED (SELECT a.k AS i, b.k AS j, sum(a.v * b.v) AS v FROM h a JOIN h b USING (cell) GROUP BY ALL),
t AS MATERIALIZED (SELECT sample, k, sum(value * v) AS v FROM x JOIN h USING (cell) GROUP BY ALL),
co AS MATERIALIZED (SELECT a.i, a.j, p.v * s.v - q.v * r.v AS c FROM g a
  JOIN g p ON p.i = (a.i + 1) % 3 AND p.j = (a.j + 1) % 3 JOIN g s ON s.i = (a.i + 2) % 3 AND s.j = (a.j + 2) % 3
  JOIN g q ON q.i = (a.i + 1) % 3 AND q.j = (a.j + 2) % 3 JOIN g r ON r.i = (a.i + 2) % 3 AND r.j = (a.j + 1) % 3),
det AS MATERIALIZED (SELECT sum(g.v * c) AS d FROM g JOIN co USING (i, j) WHERE i = 0)"""


def stored(source: str) -> str:
    """The stored rows, each with what its column's absent genes have."""
    return f"SELECT side, gene, col, round(value, 6) + 0.0 AS value, round(zero, 6) + 0.0 AS zero FROM (SELECT *, max(value) FILTER (NOT stored) OVER (PARTITION BY side, col) AS zero FROM {source}) WHERE stored"


SUB = ", ".join(f"CASE WHEN v[{i}] - m{i} > 1.5 * s{i} THEN 'selected' ELSE 'Other cells' END AS subset{i}, round(v[{i}], 6) + 0.0 AS subset{i}_loading" for i in range(1, 65))
SUB_ANY = " OR ".join(f"v[{i}] - m{i} > 1.5 * s{i}" for i in range(1, 65))
SUB_STATS = ", ".join(f"avg(v[{i}]) AS m{i}, stddev_samp(v[{i}]) AS s{i}" for i in range(1, 65))
ELF = """fut AS MATERIALIZED (SELECT *, lead(time) OVER o AS after, sum(area) OVER (ORDER BY time, col ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS future_time
  FROM (SELECT *, coalesce((lead(time) OVER p - time) * r, 0) AS area FROM km WINDOW p AS (ORDER BY time, col)) WINDOW o AS (ORDER BY time, col)),
elf AS MATERIALIZED (SELECT *, CASE WHEN after IS NULL OR status <> 0 THEN time ELSE time + coalesce(future_time / nullif(r, 0), (after - time) * 0.5) END AS exp_time FROM fut)"""
MARK = """plus AS MATERIALIZED (SELECT l.*, CASE WHEN col % 3 = 0 THEN 1 ELSE 0 END AS chosen FROM logn l WHERE value > 0),
sizes AS (SELECT count(*) AS n, count(*) FILTER (s_suppkey % 3 = 0) AS n1 FROM supplier),
rk AS MATERIALIZED (SELECT plus.*, n - count(*) OVER g AS zeros, n - count(*) OVER g + rank() OVER (PARTITION BY gene ORDER BY value) + (count(*) OVER t - 1) / 2.0::DOUBLE AS r, count(*) OVER t AS tie
  FROM plus, sizes WINDOW g AS (PARTITION BY gene), t AS (PARTITION BY gene, value)),
a AS MATERIALIZED (SELECT gene, coalesce(sum(exp(value) - 1) FILTER (chosen = 1), 0) AS one, coalesce(sum(exp(value) - 1) FILTER (chosen = 0), 0) AS two, coalesce(sum(r) FILTER (chosen = 1), 0) AS rs,
  sum(chosen) AS hits, CAST(any_value(zeros) AS DOUBLE) AS zeros, sum(CAST(tie AS DOUBLE) * tie - 1) AS ties FROM rk GROUP BY gene),
m AS MATERIALIZED (SELECT gene, log2(one / n1 + 1) - log2(two / (n - n1) + 1) AS log_fc, rs + (n1 - hits) * (zeros + 1) / 2 - n1 * (n1 + 1) / 2.0::DOUBLE AS u,
  sqrt(n1 * (n - n1) / 12.0::DOUBLE * (n + 1 - (ties + zeros * (zeros * zeros - 1)) / (n * (n - 1.0::DOUBLE)))) AS dev, n, n1 FROM a, sizes),
zs AS MATERIALIZED (SELECT gene, log_fc, u, coalesce((u - n1 * (n - n1) / 2.0::DOUBLE) / nullif(dev, 0), 0) AS z FROM m),
area AS MATERIALIZED (SELECT a, sum((CASE WHEN i = 0 OR i = 800 THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END) * exp(-0.5::DOUBLE * (a * i / 800.0::DOUBLE) * (a * i / 800.0::DOUBLE))) * a / 2400.0::DOUBLE * sqrt(2 / pi()) AS inner_p
  FROM (SELECT DISTINCT abs(z) AS a FROM zs), range(0, 801) t(i) GROUP BY a)"""

#: Expected times as in ELF, of any table km.
ELF_OUT = "SELECT col, round(exp_time, 6) + 0.0 AS exp_time, round(1 - (exp_time - min(exp_time) OVER ()) / (max(exp_time) OVER () - min(exp_time) OVER ()), 6) + 0.0 AS rank FROM elf"
PAIRS_OF = "FROM q a JOIN q b ON a.col <> b.col AND a.status = 1 AND (a.time < b.time OR (a.time = b.time AND b.status = 0))"
AGREE = "round(avg(CASE WHEN b.p > a.p THEN 1.0::DOUBLE WHEN b.p = a.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6)"
COX = "cox AS MATERIALIZED (SELECT c.time, c.status, k.c_acctbal / 10000 AS x1, CAST(k.c_nationkey % 5 AS DOUBLE) AS x2 FROM customers_of c JOIN customer k ON k.c_custkey = c.col), b0 AS (SELECT 0.0::DOUBLE AS b1, 0.0::DOUBLE AS b2)"


def cox(steps: int) -> str:
    """Tables cox, then e0, e1, ... with log-likelihood v, gradient g1 g2 and information h11 h12 h22 of Newton's steps from 0."""
    out = [COX]
    weights = {"s0": "r", "s1": "r * x1", "s2": "r * x2", "s11": "r * x1 * x1", "s12": "r * x1 * x2", "s22": "r * x2 * x2"}
    for i in range(steps + 1):
        sums = ", ".join(f"sum({w}) AS {n}, coalesce(sum({w}) FILTER (status = 1), 0) AS d{n[1:]}" for n, w in weights.items())
        out += [
            f"r{i} AS MATERIALIZED (SELECT cox.*, b1 * x1 + b2 * x2 AS lin, exp(b1 * x1 + b2 * x2) AS r FROM cox, b{i})",
            f"t{i} AS MATERIALIZED (SELECT time, count(*) FILTER (status = 1) AS d, coalesce(sum(lin) FILTER (status = 1), 0) AS l, coalesce(sum(x1) FILTER (status = 1), 0) AS e1, coalesce(sum(x2) FILTER (status = 1), 0) AS e2, {sums} FROM r{i} GROUP BY time)",
            f"c{i} AS MATERIALIZED (SELECT time, d, l, e1, e2, {', '.join(f'sum({n}) OVER o AS {n}, d{n[1:]}' for n in weights)} FROM t{i} WINDOW o AS (ORDER BY time DESC))",
            f"k{i} AS MATERIALIZED (SELECT s0 - f * d0 AS a, {', '.join(f'({n} - f * d{n[1:]}) / (s0 - f * d0) AS m{n[1:]}' for n in weights if n != 's0')} FROM (SELECT *, unnest(range(0, d)) / d::DOUBLE AS f FROM c{i} WHERE d > 0))",
            f"e{i} AS MATERIALIZED (SELECT l - la AS v, e1 - q1 AS g1, e2 - q2 AS g2, h11, h12, h22 FROM (SELECT sum(l) AS l, sum(e1) AS e1, sum(e2) AS e2 FROM c{i}), (SELECT sum(ln(a)) AS la, sum(m1) AS q1, sum(m2) AS q2, sum(m11 - m1 * m1) AS h11, sum(m12 - m1 * m2) AS h12, sum(m22 - m2 * m2) AS h22 FROM k{i}))",
            f"b{i + 1} AS MATERIALIZED (SELECT b1 + (h22 * g1 - h12 * g2) / (h11 * h22 - h12 * h12) AS b1, b2 + (h11 * g2 - h12 * g1) / (h11 * h22 - h12 * h12) AS b2 FROM b{i}, e{i})",
        ]
    return ", ".join(out)


FOLD_TABLES, FOLD_ROWS = fold_steps()

ORACLE = {
    "fold_fits": sql(FOLD_ROWS, "pos", "h", "w", "e", "patients", more=FOLD_TABLES),
    "select_k_far": sql("SELECT CAST(k AS INTEGER) AS k, round(loss, 6) AS mean_loss, round(lag(loss) OVER (ORDER BY k) - loss, 6) + 0.0 AS loss_drop FROM (FROM loss_2 UNION ALL FROM loss_3)", "pos", "h", "w", more=k_steps()),
    "scan_expr": sql("SELECT 'bulk' AS side, gene, count(*) AS n, round(sum(value), 6) + 0.0 AS total FROM bulk GROUP BY gene UNION ALL SELECT 'cell', gene, count(*), round(sum(value), 6) + 0.0 FROM cells GROUP BY gene", "bulk", "cells"),
    "x_block_scan": sql("SELECT sample, cell, round(value, 6) + 0.0 AS value FROM x WHERE cell BETWEEN 100 AND 299", "x"),
    "x_dim": sql("SELECT count(DISTINCT sample) AS n_sample, count(DISTINCT cell) AS n_cell FROM corr", "corr"),
    "x_blocks": sql("SELECT block, min(cell) AS first_cell, count(*) AS n_cells FROM (SELECT cell, CAST((row_number() OVER (ORDER BY cell) - 1) // 100 AS BIGINT) AS block FROM vec WHERE cell % 10 <> 0) GROUP BY block", "vec"),
    "row_view": sql("SELECT sample, cell, round(2 * value, 6) + 0.0 AS value FROM x JOIN (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS p FROM (SELECT DISTINCT sample FROM x)) USING (sample) WHERE p % 2 = 0", "x"),
    "read_graph": sql("SELECT * FROM (SELECT a.l_partkey AS src, b.l_partkey AS dst, count(*)::DOUBLE AS w FROM lineitem a JOIN lineitem b USING (l_orderkey) GROUP BY ALL) WHERE (src + dst) % 3 <> 0"),
    "x_sink": sql("SELECT sample, cell, round(value, 6) + 0.0 AS value FROM x", "x"),
    "x_difference": sql("SELECT round(max(abs(c.value - o.value)), 6) AS max_difference FROM corr c JOIN o USING (sample, cell)", "corr", "z0", more="o AS MATERIALIZED (" + PARTS["corr"].replace("FROM z b JOIN z c", "FROM z0 b JOIN z0 c") + ")"),
    "nested_view": sql("SELECT sample, cell, round(0.5 * value, 6) + 0.0 AS value FROM x JOIN (SELECT sample, row_number() OVER (ORDER BY sample) - 1 AS p FROM (SELECT DISTINCT sample FROM x)) USING (sample) WHERE p % 6 = 0", "x"),
    "constant_cells": sql("SELECT b.col AS sample, c.col AS cell, round(CASE WHEN max(c.col) % 7 = 1 THEN 0 ELSE sum(b.value * c.value) / (count(*) - 1) END, 6) + 0.0 AS value FROM z0 b JOIN z0 c ON b.gene = c.gene AND b.side = 'bulk' AND c.side = 'cell' GROUP BY ALL", "z0"),
    "common_genes": sql("FROM common", "common"),
    "center_scale": sql("SELECT side, gene, col, round(value, 6) + 0.0 AS value FROM z0", "z0"),
    "quantile_target": sql("SELECT CAST(rank AS INTEGER) AS rank, round(target, 6) + 0.0 AS target FROM target", "target"),
    "quantile_normalize": sql("SELECT side, gene, col, round(value, 6) + 0.0 AS value FROM qn", more=MONTHS),
    "corr_matrix": sql("SELECT b.col AS sample, c.col AS cell, round(sum(b.value * c.value) / (count(*) - 1), 6) + 0.0 AS value FROM z0 b JOIN z0 c ON b.gene = c.gene AND b.side = 'bulk' AND c.side = 'cell' GROUP BY ALL", "z0"),
    "center_scale_sparse": sql(stored("z0"), "counts", more=SPARSE),
    "quantile_target_sparse": sql("SELECT CAST(rank AS INTEGER) AS rank, round(target, 6) + 0.0 AS target FROM target", "counts", more=SPARSE),
    "quantile_normalize_sparse": sql(stored("qn"), "counts", more=SPARSE),
    "corr_matrix_sparse": sql("SELECT sample, cell, round(value, 6) + 0.0 AS value FROM corr0", "counts", more=SPARSE),
    "create_x_sparse": sql("SELECT sample, cell, round(value / (SELECT sqrt(sum(value * value)) FROM corr), 6) + 0.0 AS value FROM corr", "counts", more=SPARSE),
    "fro_norm": sql("SELECT round(sqrt(sum(value * value)), 6) AS fro_norm FROM corr", "corr"),
    "create_x": sql("SELECT sample, cell, round(value, 6) + 0.0 AS value FROM x", "x"),
    "graph_binarize": sql("FROM edges", "edges"),
    "graph_degree": sql("FROM degree", "degree"),
    "graph_info": sql("SELECT count(*) FILTER (deg = 0) AS n_zero, min(deg) AS min_deg, max(deg) AS max_deg, round(avg(deg), 6) AS mean_deg FROM degree", "degree"),
    "graph_normalize": sql("SELECT src, dst, round(w, 6) AS w FROM normal", "normal"),
    "graph_laplacian": sql("SELECT cell AS src, cell AS dst, d AS w FROM degree WHERE d > 0 UNION ALL SELECT src, dst, round(-w, 6) FROM normal", "normal", "degree"),
    "graph_symmetrize": sql("SELECT src, dst, sum(w) / 2 AS w FROM (FROM directed UNION ALL SELECT dst, src, w FROM directed) GROUP BY src, dst", "directed"),
    "graph_symmetry": sql("SELECT round(sqrt(sum(d * d)), 6) AS sym_fro, sqrt(sum(d * d)) <= 1e-12 AS is_symmetric FROM (SELECT coalesce(a.w, 0) - coalesce(b.w, 0) AS d FROM all_directed a FULL JOIN all_directed b ON a.src = b.dst AND a.dst = b.src)", "all_directed"),
    "graph_spmm": sql("SELECT cell, CAST(k AS INTEGER) AS k, round(v, 6) + 0.0 AS value FROM hat", "hat"),
    "graph_quadratic": sql("SELECT round(sum(g.v * h.v), 6) AS quadratic FROM all_hat g JOIN all_h h USING (cell, k)", "all_hat", "all_h"),
    "knn_graph": sql("SELECT src, CAST(rank AS INTEGER) AS rank, dst, round(score, 6) + 0.0 AS score FROM all_near", "all_near"),
    "approx_knn_recall": sql("SELECT count(*) AS n_pairs, true AS reached FROM (SELECT row_number() OVER (PARTITION BY a.cell ORDER BY list_dot_product(a.v, b.v) DESC, b.cell) AS rank FROM vec a JOIN vec b ON a.cell <> b.cell WHERE a.cell % 50 = 0) WHERE rank <= 20", "vec"),
    "snn_graph": sql(
        "SELECT p.src, p.dst, round(c / (a.n + b.n - c), 6) AS w FROM p JOIN sz a ON a.src = p.src JOIN sz b ON b.src = p.dst WHERE c / (a.n + b.n - c) >= 1 / 15.0::DOUBLE", "all_near",
        more="own AS MATERIALIZED (SELECT src, dst FROM all_near UNION SELECT src, src FROM all_near), sz AS MATERIALIZED (SELECT src, count(*) AS n FROM own GROUP BY src), p AS MATERIALIZED (SELECT a.src, b.src AS dst, count(*) AS c FROM own a JOIN own b ON a.dst = b.dst AND a.src <> b.src GROUP BY ALL)",
    ),
    "km_curve": sql("SELECT col, time, status, round(r, 6) AS survival_rate FROM km", "customers_of", more=km("customers_of")),
    "future_time": sql("SELECT col, round(future_time, 6) + 0.0 AS future_time FROM fut", "patients", more=km("patients") + ", " + ELF),
    "guanrank_elf": sql("SELECT col, round(exp_time, 6) + 0.0 AS exp_time, round(1 - (exp_time - min(exp_time) OVER ()) / (max(exp_time) OVER () - min(exp_time) OVER ()), 6) + 0.0 AS rank FROM elf", "patients", more=km("patients") + ", " + ELF),
    "guanrank": sql("SELECT col, round(rank, 6) + 0.0 AS rank FROM ranks", "customers_of", more=km("customers_of") + ", " + ranked()),
    "coerce_phenotype": sql("SELECT col, CASE WHEN label <> 0 THEN 1.0::DOUBLE ELSE 100.0::DOUBLE END AS time, CASE WHEN label <> 0 THEN 1 ELSE 0 END AS status FROM labelled", "labelled"),
    "phenotype_s": sql("SELECT 'survival' AS method, col, round(1 - rank, 6) + 0.0 AS s FROM ranks UNION ALL SELECT 'binary', col, 1 - label FROM labelled", "patients", "labelled", more=km("patients") + ", " + ranked()),
    "concordance": sql("SELECT count(*) AS n_pairs, round(avg(CASE WHEN b.p > a.p THEN 1.0::DOUBLE WHEN b.p = a.p THEN 0.5::DOUBLE ELSE 0.0::DOUBLE END), 6) AS concordance FROM q a JOIN q b ON a.col <> b.col AND a.status = 1 AND (a.time < b.time OR (a.time = b.time AND b.status = 0))", "patients", more="q AS (SELECT *, col * 37 % 11 AS p FROM patients)"),
    "concordance_cohorts": sql(f"SELECT a.cohort, count(*) AS n_pairs, {AGREE} AS concordance {PAIRS_OF} AND a.cohort = b.cohort GROUP BY a.cohort", "customers_of", more="q AS (SELECT *, col % 3 AS cohort, col * 37 % 101 AS p FROM customers_of)"),
    "concordance_customers": sql(f"SELECT count(*) AS n_pairs, {AGREE.replace('b.p > a.p', 'b.p < a.p')} AS concordance {PAIRS_OF}", "customers_of", more="q AS (SELECT *, col * 37 % 101 AS p FROM customers_of)"),
    "future_time_customers": sql("SELECT col, round(future_time, 6) + 0.0 AS future_time FROM fut", "customers_of", more=km("customers_of") + ", " + ELF),
    "guanrank_elf_customers": sql(ELF_OUT, "customers_of", more=km("customers_of") + ", " + ELF),
    "cox_steps": sql(
        "SELECT part, i, j, round(v, 6) + 0.0 AS value FROM (SELECT 'value' AS part, 0 AS i, 0 AS j, v FROM e0 UNION ALL SELECT 'gradient', 0, 0, g1 FROM e0 UNION ALL SELECT 'gradient', 1, 0, g2 FROM e0"
        " UNION ALL SELECT 'information', 0, 0, h11 FROM e0 UNION ALL SELECT 'information', 0, 1, h12 FROM e0 UNION ALL SELECT 'information', 1, 0, h12 FROM e0 UNION ALL SELECT 'information', 1, 1, h22 FROM e0)",
        "customers_of", more=cox(0),
    ),
    "cox_fit": sql("SELECT 'coefficient' AS part, 0 AS i, round(b1, 6) + 0.0 AS value FROM b8 UNION ALL SELECT 'coefficient', 1, round(b2, 6) + 0.0 FROM b8 UNION ALL SELECT 'gain', 0, round(e8.v - e0.v, 6) + 0.0 FROM e8, e0", "customers_of", more=cox(8)),
    "nmf_steps": sql(FITTED, "pos", "h", "w", more=steps(2, False)),
    "regularised_steps": sql(FITTED, "pos", "h", "w", "e", "patients", more=steps(2, True)),
    "gram_h": sql("SELECT CAST(a.k AS INTEGER) AS i, CAST(b.k AS INTEGER) AS j, round(sum(a.v * b.v), 6) AS value FROM h a JOIN h b USING (cell) GROUP BY ALL", "h"),
    "xht": sql("SELECT sample, CAST(k AS INTEGER) AS k, round(sum(value * v), 6) + 0.0 AS value FROM x JOIN h USING (cell) GROUP BY ALL", "x", "h"),
    "recon_loss": sql("SELECT round(sum((x.value - p.v) * (x.value - p.v)), 6) AS loss FROM x JOIN p USING (sample, cell)", "x", "h", "w", more="p AS (SELECT sample, cell, sum(w.v * h.v) AS v FROM w JOIN h USING (k) GROUP BY ALL)"),
    "clamped_steps": sql(FITTED, "x", "h", "w", more=steps(2, False, "x", "value", True)),
    "local_steps": sql(FITTED, "pos", "h", "w", "e", "patients", more=steps(2, True)),
    "project_w": sql("SELECT sample, CAST(co.i AS INTEGER) AS k, round(sum(t.v * c / d), 6) + 0.0 AS value FROM t JOIN co ON co.j = t.k, det GROUP BY ALL", "x", "h", more=PROJECTED),
    "select_k_steps": sql("SELECT k, round(loss, 6) AS mean_loss, round(lag(loss) OVER (ORDER BY k) - loss, 6) + 0.0 AS loss_drop FROM (FROM loss_2 UNION ALL FROM loss_3)", "pos", "h", "w", more=k_steps()),
    "elbow_eii": sql(
        "SELECT k, round(m, 6) AS mean_loss, round(lag(m) OVER o - m, 6) + 0.0 AS loss_drop, round(first_value(m) OVER o - m, 6) + 0.0 AS denom, CASE WHEN k > 2 AND first_value(m) OVER o - m > 0 THEN round((lag(m) OVER o - m) / (first_value(m) OVER o - m), 6) + 0.0 END AS eii FROM l WINDOW o AS (ORDER BY k)",
        more="l AS MATERIALIZED (SELECT k, avg(loss) AS m FROM (SELECT p_size AS k, p_partkey % 3 AS repeat, avg(p_retailprice) / any_value(p_size) AS loss FROM part WHERE p_size >= 2 GROUP BY 1, 2) GROUP BY k)",
    ),
    "cv_folds": sql("SELECT col, fold FROM folded", "folded"),
    "cv_grid": "SELECT a.v AS alpha1, b.v AS alpha2, CAST(f AS INTEGER) AS fold FROM (VALUES (0.01::DOUBLE), (0.005::DOUBLE), (0.001::DOUBLE)) a(v), (VALUES (0.01::DOUBLE), (0.005::DOUBLE), (0.001::DOUBLE)) b(v), range(1, 6) t(f)",
    "cv_summary": sql("SELECT alpha1, alpha2, round(cindex, 6) AS cindex FROM means", "means"),
    "cv_best": sql("SELECT alpha1, alpha2, round(cindex, 6) AS cindex FROM means ORDER BY means.cindex DESC, alpha1, alpha2 LIMIT 1", "means"),
    "cv_best_dense": sql("SELECT alpha1, alpha2, round(cindex, 6) AS cindex FROM means ORDER BY means.cindex DESC, list_position([0.01, 0.02, 0.0]::DOUBLE[], alpha2), list_position([0.02, 0.0, 0.01]::DOUBLE[], alpha1) LIMIT 1", "means"),
    "cv_ordered": sql("SELECT CAST(row_number() OVER (ORDER BY alpha1, alpha2, fold) AS INTEGER) AS place, alpha1, alpha2, fold, round(cindex, 6) AS cindex FROM cv", "cv"),
    "cv_pivot": sql("SELECT alpha1, " + ", ".join(f"round(max(cindex) FILTER (alpha2 = {a}::DOUBLE), 6) AS {n}" for a, n in (("0.0", "a0"), ("0.01", "a1"), ("0.02", "a2"))) + " FROM means GROUP BY alpha1", "means"),
    "fold_s": sql("SELECT fold, col, round(1 - rank, 6) + 0.0 AS s FROM ranks", "folded", more="train AS MATERIALIZED (SELECT p.col, p.time, p.status, CAST(f AS INTEGER) AS fold FROM folded p, range(1, 6) t(f) WHERE p.fold <> f), " + km("train", "fold") + ", " + ranked("fold")),
    "find_module": sql("SELECT CAST(i AS INTEGER) AS factor, cell FROM (SELECT cell, i, x, avg(x) OVER f AS m, stddev_samp(x) OVER f AS s FROM (SELECT cell, i, v[i] AS x FROM vec, range(1, 65) t(i)) WINDOW f AS (PARTITION BY i)) WHERE x - m > 1.5 * s", "vec"),
    "find_subset": sql(f"SELECT cell, CASE WHEN {SUB_ANY} THEN 'selected' ELSE 'Other cells' END AS selected, {SUB} FROM vec, st", "vec", more=f"st AS (SELECT {SUB_STATS} FROM vec)"),
    "find_subset_dip": "SELECT l_orderkey * 10 + l_linenumber AS cell, CASE WHEN l_returnflag = 'R' THEN 'selected' ELSE 'Other cells' END AS selected FROM lineitem",
    "log_normalize": sql("SELECT gene, col, round(value, 6) AS value FROM logn", "logn"),
    "rc_normalize": sql("SELECT gene, col, round(value, 6) AS value FROM rc", "rc"),
    "clr_normalize": sql("SELECT gene, col, round(ln(1 + value / exp(sum(ln(1 + value)) OVER (PARTITION BY col) / (SELECT count(DISTINCT gene) FROM counts))), 6) AS value FROM counts", "counts"),
    # one window over one use of the values
    "scale_data": sql("SELECT gene, col, round(least((value - mean) / coalesce(nullif(sqrt(greatest(variance, 0)), 0), 1), 10), 6) + 0.0 AS value FROM (SELECT gene, col, value, sum(value) OVER g / n AS mean, (sum(value * value) OVER g - n * (sum(value) OVER g / n) * (sum(value) OVER g / n)) / (n - 1) AS variance FROM logn, (SELECT count(*) AS n FROM supplier) WINDOW g AS (PARTITION BY gene))", "logn"),
    "variable_genes_mvp": sql(
        "SELECT gene, round(score, 6) + 0.0 AS score FROM (SELECT gene, coalesce((d - avg(d) OVER b) / nullif(stddev_samp(d) OVER b, 0), 0) AS score FROM bins WINDOW b AS (PARTITION BY bin)) r ORDER BY r.score DESC, gene LIMIT 300", "stats",
        more="dm AS MATERIALIZED (SELECT gene, ln(1 + mean) AS m, ln(variance / mean) AS d FROM stats WHERE mean > 0), bins AS MATERIALIZED (SELECT *, least(floor((m - (SELECT min(m) FROM dm)) / ((SELECT max(m) - min(m) FROM dm) / 20)), 19) AS bin FROM dm)",
    ),
    "pca_variance": sql(
        "SELECT CAST(c AS INTEGER) AS component, round(t, 6) + 0.0 AS total, true AS exact FROM (SELECT sum(v) AS t FROM (SELECT gene, var_samp(value) AS v FROM whole GROUP BY gene)), range(1, 6) r(c)", "logn", "stats",
        more="top AS MATERIALIZED (SELECT * FROM stats ORDER BY variance / mean DESC, gene LIMIT 50), whole AS MATERIALIZED (SELECT t.gene, s_suppkey, least((coalesce(l.value, 0) - t.mean) / coalesce(nullif(sqrt(greatest(t.variance, 0)), 0), 1), 10) AS value FROM top t CROSS JOIN supplier LEFT JOIN logn l ON l.gene = t.gene AND l.col = s_suppkey)",
    ),
    "markers_significant": sql("SELECT gene, round(log_fc, 6) + 0.0 AS log_fc, round(1 - inner_p, 6) + 0.0 AS p_value FROM zs JOIN area ON a = abs(z) WHERE 1 - inner_p < 0.05", "logn", more=MARK),
    "variable_genes": sql("SELECT gene, round(variance / mean, 6) + 0.0 AS score FROM stats ORDER BY variance / mean DESC, gene LIMIT 300", "stats"),
    "markers_logfc": sql("SELECT gene, round(log_fc, 6) + 0.0 AS log_fc, round(u, 6) + 0.0 AS u, round(z, 6) + 0.0 AS z, round(1 - inner_p, 6) + 0.0 AS p_value, round(least(1, (1 - inner_p) * (SELECT count(*) FROM zs)), 6) + 0.0 AS p_adj FROM zs JOIN area ON a = abs(z)", "logn", more=MARK),
}
