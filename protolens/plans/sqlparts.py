"""DuckDB text fragments shared by the SQL oracles (test-side twins of the Spark plans)."""

from __future__ import annotations

from protolens.sources.fixtures import with_views


def vec_base(extra: str, view: str = "vectors") -> str:
    """CTEs v (layers 1-3), tr (train), te (test), tre/tee (exploded) then ``extra``."""
    body = f"""
WITH v AS (SELECT example_id, layer, label, category, split, dataset, dataset_type, vector
           FROM {view} WHERE layer <> 0),
tr AS (SELECT * FROM v WHERE split = 'train'),
te AS (SELECT * FROM v WHERE split = 'test'),
tre AS (SELECT example_id, layer, label, category, dataset, CAST(unnest(range(len(vector))) AS INTEGER) AS i,
               unnest(vector) AS x FROM tr),
tee AS (SELECT example_id, layer, label, category, dataset, dataset_type, CAST(unnest(range(len(vector))) AS INTEGER) AS i,
               unnest(vector) AS x FROM te),
{extra}"""
    sql = with_views(body, view)
    return sql.replace("WITH ", "WITH RECURSIVE ", 1) if "gj_" in extra or "USING KEY" in extra else sql


def nmc_ctes(label: str = "label") -> str:
    """Nearest-mean scores of test rows against train means of ``label``: tables nd, probs, preds."""
    return f"""
mu AS (SELECT layer, {label} AS cls, i, avg(x) AS m FROM tre GROUP BY ALL),
nd AS (SELECT t.example_id, t.layer, t.dataset, t.dataset_type, t.label, t.category, mu.cls,
              -sqrt(sum((t.x - mu.m) * (t.x - mu.m))) AS s
       FROM tee t JOIN mu ON t.layer = mu.layer AND t.i = mu.i
       GROUP BY t.example_id, t.layer, t.dataset, t.dataset_type, t.label, t.category, mu.cls),
mx AS (SELECT example_id, layer, max(s) AS ms FROM nd GROUP BY ALL),
probs AS (SELECT nd.*, mx.ms, exp(nd.s - mx.ms) / sum(exp(nd.s - mx.ms)) OVER (PARTITION BY nd.example_id, nd.layer) AS prob
          FROM nd JOIN mx USING (example_id, layer)),
preds AS (SELECT example_id, layer, any_value(dataset) AS dataset, any_value(dataset_type) AS dataset_type,
                 any_value(label) AS label, any_value(category) AS category,
                 CAST(min(cls) FILTER (WHERE s = ms) AS INTEGER) AS pred,
                 max(prob) FILTER (WHERE cls = 1) AS score
          FROM probs GROUP BY example_id, layer)"""


def scatter_ctes(label: str = "label", keys: str = "layer", src: str = "tr") -> str:
    """Class means and scatter of ``src``: g_x (rows), g_xe (entries), g_mue, g_mu (cls, n, m[]), g_se (keys, cls, i, j, s)."""
    kj = ", ".join(x.strip() for x in keys.split(","))
    return f"""
g_x AS (SELECT row_number() OVER () AS rid, {kj}, {label} AS cls, vector FROM {src}),
g_xe AS (SELECT rid, {kj}, cls, unnest(range(len(vector))) AS i, unnest(vector) AS x FROM g_x),
g_mue AS (SELECT {kj}, cls, i, avg(x) AS m, count(*) AS n FROM g_xe GROUP BY ALL),
g_mu AS (SELECT {kj}, cls, any_value(n) AS n, list(m ORDER BY i) AS m FROM g_mue GROUP BY {kj}, cls),
g_c AS (SELECT e.rid, {", ".join("e." + k for k in kj.split(", "))}, e.cls, e.i, e.x - u.m AS xc
        FROM g_xe e JOIN g_mue u USING ({kj}, cls, i)),
g_se AS (SELECT {", ".join("a." + k for k in kj.split(", "))}, a.cls, a.i, b.i AS j, sum(a.xc * b.xc) AS s
         FROM g_c a JOIN g_c b ON a.rid = b.rid GROUP BY ALL)"""


def precision_ctes(keys: str, scatter: str, name: str) -> str:
    """Precision d ((n - 1) C + tr(C) I)^-1 = d (S + tr(S) / (n - 1) I)^-1 per ``keys`` by Gauss-Jordan elimination.

    ``scatter``: a table (keys, nn, i, j, s).  Makes ``name`` (keys, nn, p[][]).  The matrices are positive
    definite, so the diagonal pivots need no exchange."""
    kj = ", ".join(x.strip() for x in keys.split(","))
    return f"""
gj_tr_{name} AS (SELECT {kj}, any_value(nn) AS nn, sum(s) FILTER (WHERE i = j) / (any_value(nn) - 1) AS t, max(i) + 1 AS d
          FROM {scatter} GROUP BY {kj}),
gj_row_{name} AS (SELECT {kj}, nn, d, i, list_concat(list(s + CASE WHEN i = j THEN t ELSE 0 END ORDER BY j),
                 list_transform(range(d), lambda q: CASE WHEN q = i THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)) AS r
           FROM {scatter} JOIN (SELECT {kj}, t, d FROM gj_tr_{name}) USING ({kj}) GROUP BY {kj}, nn, d, i),
gj_{name} AS (SELECT {kj}, nn, d, 1 AS k, list(r ORDER BY i) AS m FROM gj_row_{name} GROUP BY {kj}, nn, d
       UNION ALL
       SELECT {kj}, nn, d, k + 1, list_transform(m, lambda r, q: CASE WHEN q = k THEN list_transform(r, lambda x: x / m[k][k])
              ELSE list_transform(r, lambda x, c: x - r[k] * m[k][c] / m[k][k]) END) FROM gj_{name} WHERE k <= d),
{name} AS (SELECT {kj}, nn, list_transform(m, lambda r: list_transform(r[d + 1:2 * d], lambda x: x * d)) AS p
       FROM gj_{name} WHERE k = d + 1)"""


def gda_ctes(label: str = "label", keys: str = "layer", src: str = "tr") -> str:
    """GDA fit on ``src`` at full width: g_prec (keys, nn, p[][]), g_params (keys, cls, m[], w[], b)."""
    kj = ", ".join(x.strip() for x in keys.split(","))
    return scatter_ctes(label, keys, src) + f""",
g_n AS (SELECT {kj}, count(*) AS nn FROM g_x GROUP BY ALL),
g_s AS (SELECT {kj}, nn, i, j, sum(s) AS s FROM g_se JOIN g_n USING ({kj}) GROUP BY {kj}, nn, i, j),
""" + precision_ctes(keys, "g_s", "g_prec").lstrip() + f""",
g_k AS (SELECT {kj}, count(*) AS kk FROM g_mu GROUP BY ALL),
g_w AS (SELECT {kj}, cls, m, kk, list_transform(p, lambda r: list_dot_product(r, m)) AS w
        FROM g_mu JOIN g_prec USING ({kj}) JOIN g_k USING ({kj})),
g_params AS (SELECT {kj}, cls, m, w, ln(1.0 / kk) - 0.5 * list_dot_product(w, m) AS b FROM g_w)"""


def l1_ctes(features: str, cs: str, name: str = "l1", steps: int = 3500) -> str:
    """L1 logistic stacks by descent along lines, one line a step, with the curvature bound 1/4.

    ``features``: a table (grp, rid, x[], y) whose x ends with the constant 1; ``cs``: a table (grp, C).  Makes ``name``
    (grp, C, w[]).  Lines 1..p move one weight, the others a weight and the intercept so that the mean of z stays, since
    features that vary little are almost the constant.  Along a line the objective is a parabola and two absolute values,
    whose least point is a stationary point of one of its four pieces or a kink.  The recursion keeps each row's z."""
    return f"""
{name}_in AS (SELECT CAST(c.grp AS VARCHAR) AS grp, CAST(c.C AS DOUBLE) AS C, f.rid, f.x, CAST(f.y AS DOUBLE) AS y FROM {features} f JOIN {cs} c ON c.grp = f.grp),
{name}_m AS (SELECT grp, C, list(m ORDER BY j) AS a FROM (SELECT grp, C, j, avg(v) AS m
             FROM (SELECT grp, C, unnest(x) AS v, unnest(range(1, len(x) + 1)) AS j FROM {name}_in) GROUP BY grp, C, j) GROUP BY grp, C),
{name}_l AS (SELECT grp, C, list_concat(list_transform(a, lambda v: 0.0::DOUBLE), a[1:-2]) AS m FROM {name}_m),
{name}_h AS (SELECT grp, C, any_value(m) AS m, list(h ORDER BY j) AS h FROM (SELECT grp, C, j, any_value(m) AS m, greatest(C / 4 * sum(v * v), 1e-300) AS h
             FROM (SELECT grp, C, m, unnest(list_transform(m, lambda q, j: x[1 + (j - 1) % len(x)] - q)) AS v, unnest(range(1, len(m) + 1)) AS j
                   FROM {name}_in JOIN {name}_l USING (grp, C)) GROUP BY grp, C, j) GROUP BY grp, C),
{name}_r(grp, C, rid, k, x, y, m, h, z, w) USING KEY (grp, C, rid) AS (
  SELECT i.grp, i.C, i.rid, 0, i.x, i.y, q.m, q.h, 0.0::DOUBLE, list_transform(i.x, lambda v: 0.0::DOUBLE) FROM {name}_in i JOIN {name}_h q ON q.grp = i.grp AND q.C = i.C
  UNION
  SELECT grp, C, rid, k + 1, x, y, m, h, z + t * (x[j] - m[l]),
         list_transform(w, lambda v, q: v + CASE WHEN q = j THEN t ELSE 0 END - CASE WHEN q = len(w) THEN m[l] * t ELSE 0 END)
  FROM (SELECT *, list_sort(list_transform(list_concat([-w[j], CASE WHEN m[l] <> 0 THEN w[-1] / m[l] ELSE 0 END],
                 list_transform([[1, 1], [1, -1], [-1, 1], [-1, -1]], lambda s: -(g + s[1] - m[l] * s[2]) / h[l])),
                 lambda t: struct_pack(v := h[l] * t * t / 2 + g * t + abs(w[j] + t) + CASE WHEN m[l] <> 0 THEN abs(w[-1] - m[l] * t) ELSE 0 END, t := t)))[1].t AS t
        FROM (SELECT *, sum(C * (1 / (1 + exp(-z)) - y) * (x[j] - m[l])) OVER (PARTITION BY grp, C) AS g
              FROM (SELECT *, 1 + k % len(m) AS l, 1 + (k % len(m)) % len(x) AS j FROM {name}_r WHERE k < {steps})))),
{name} AS (SELECT grp, C, any_value(w) AS w FROM {name}_r GROUP BY grp, C)"""


#: squared Mahalanobis distance of the difference z[] under the matrix p[][]
DISTANCE = "list_sum(list_transform(range(1, len(z) + 1), lambda q: z[q] * list_dot_product(p[q], z)))"


def lit(s: str) -> str:
    """A Python string as a DuckDB string expression (newlines via chr(10))."""
    parts = ["'" + p.replace("'", "''") + "'" for p in s.split("\n")]
    return "(" + " || chr(10) || ".join(parts) + ")"


def fill_sql(template: str, **slots: str) -> str:
    """DuckDB concat() of a ``{slot}`` template with SQL expressions bound to the slots."""
    import re

    out, pos = [], 0
    for m in re.finditer(r"\{([a-zA-Z_][a-zA-Z0-9_]*)\}", template):
        if m.start() > pos:
            out.append(lit(template[pos:m.start()]))
        out.append(f"({slots[m.group(1)]})")
        pos = m.end()
    if pos < len(template):
        out.append(lit(template[pos:]))
    return "concat(" + ", ".join(out) + ")"


STRIP = "regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def strip(x: str) -> str:
    return STRIP.format(x=x)
