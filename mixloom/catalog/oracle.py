"""SQL counterparts of the registered queries, written independently of them.

The fits are unrolled into common table expressions: plain densities and
two-pass moments about the new mean, where the library works in log space with
sums about the old mean.
"""

from __future__ import annotations

from mixloom.catalog.views import (
    RECORDED_COVS,
    RECORDED_MEANS,
    RECORDED_WEIGHTS,
    SEED,
)

# ---------------------------------------------------------------- views

PTS_ORDERS = (
    "SELECT o_orderkey AS id, o_totalprice AS x, "
    "CAST(date_diff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS DOUBLE) AS y FROM orders"
)
PTS_PIXELS = f"SELECT id, x / 1000.0 AS x, (y + 1.0) / 5.0 AS y FROM ({PTS_ORDERS})"
PTS_EVENTS = (
    "SELECT event_id AS id, value AS x, "
    "hour(ts) + minute(ts) / 60.0::DOUBLE AS y FROM events"
)
BOXES = """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice,
  p_type AS category, CASE WHEN l_linestatus = 'F' THEN 'val' ELSE 'train' END AS split,
  l_tax * 100 AS w, l_discount * 100 AS h, l_quantity AS area_segm
FROM lineitem JOIN part ON l_partkey = p_partkey"""
KEPT = f"""SELECT *, w * h AS area_box, w / h AS ratio, h / w AS inverse_ratio
FROM ({BOXES}) WHERE w <> 0 AND h <> 0"""
CATEGORIES = """SELECT min(p_partkey) AS id, p_type AS name FROM part GROUP BY p_type
UNION ALL SELECT -1, 'UNUSED'"""
# the columns that identify a box, as one string
BOX_ID = """concat_ws('-', l_orderkey, l_partkey, l_suppkey, l_linenumber,
  CAST(l_quantity AS BIGINT), CAST(round(l_extendedprice * 100) AS BIGINT))"""
BOX_SIDES = f"""SELECT {BOX_ID} AS id, sqrt(area_segm / inverse_ratio) AS x, sqrt(area_segm * inverse_ratio) AS y
FROM ({KEPT})"""
BOX_ORDER = "l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice"


def scaled(points: str) -> str:
    return (
        "SELECT id, (x - x0) / nullif(x1 - x0, 0) AS x, (y - y0) / nullif(y1 - y0, 0) AS y "
        f"FROM ({points}), (SELECT min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM ({points}))"
    )


def digest_word(digest: str, word: int) -> str:
    return f"('0x' || substr({digest}, {8 * word + 1}, 8))::BIGINT"


def augmented(points: str, extra: int, seed: int) -> str:
    """Points and jittered copies ``(id, copy, x, y)``."""
    unit = [f"{digest_word('dg', i)} / 4294967296.0::DOUBLE" for i in range(3)]
    angle = f"radians(floor({unit[0]} * 360)::DOUBLE)"
    step_x = f"({unit[1]} * (0.1::DOUBLE - 0.0001::DOUBLE) + 0.0001::DOUBLE)"
    step_y = f"({unit[2]} * (0.1::DOUBLE - 0.0001::DOUBLE) + 0.0001::DOUBLE)"
    return f"""SELECT id, copy,
  CASE WHEN copy = 0 THEN x ELSE x + x * {step_x} * cos({angle}) END AS x,
  CASE WHEN copy = 0 THEN y ELSE y + y * {step_y} * sin({angle}) END AS y
FROM (SELECT id, x, y, copy, md5(concat_ws(':', id, copy, {seed})) AS dg
  FROM ({points}), (SELECT unnest(range({extra + 1}))::INT AS copy))"""


# ---------------------------------------------------------------- fits (d = 2)


class Fit:
    """Common table expressions of a fit over scaled points ``p(id, x, y)``."""

    def __init__(self, points: str, k: int, seed: int = SEED, scale: bool = True):
        self.k = k
        self.parts = [("p", scaled(points) if scale else points)]
        self.add(
            "starts",
            f"""SELECT row_number() OVER (ORDER BY key, id) - 1 AS k, id, x, y FROM (
  SELECT md5(concat_ws(':', id, {seed})) AS key, id, x, y FROM p ORDER BY 1, 2 LIMIT {k})""",
        )
        self.model = self.add(
            "m0",
            f"""SELECT k, 1.0::DOUBLE / {k} AS w, x AS mx, y AS my,
  1.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 1.0::DOUBLE AS syy FROM starts""",
        )
        self.steps = 0
        self.logliks: list[str] = []

    def add(self, name: str, body: str) -> str:
        self.parts.append((name, body))
        return name

    def shares(self, tag: str, points: str, model: str) -> str:
        """``r(id, x, y, k, r, s)``: responsibilities and the point's density."""
        self.add(
            f"e{tag}",
            f"""SELECT id, x, y, k, w / (2 * pi() * sqrt(sxx * syy - sxy * sxy)) * exp(-0.5 * (
    (x - mx) * (x - mx) * syy - 2 * (x - mx) * (y - my) * sxy + (y - my) * (y - my) * sxx)
    / (sxx * syy - sxy * sxy)) AS g FROM {points}, {model}""",
        )
        return self.add(
            f"r{tag}",
            f"SELECT id, x, y, k, g / sum(g) OVER (PARTITION BY id) AS r, "
            f"sum(g) OVER (PARTITION BY id) AS s FROM e{tag}",
        )

    def em(self, reg: float = 0.0) -> "Fit":
        t = f"{self.steps}"
        r = self.shares(t, "p", self.model)
        self.add(
            f"u{t}",
            f"SELECT k, sum(r) AS n, sum(r * x) / sum(r) AS mx, sum(r * y) / sum(r) AS my FROM {r} GROUP BY k",
        )
        self.model = self.add(
            f"m{self.steps + 1}",
            f"""SELECT u.k AS k, u.n / (SELECT count(*) FROM p) AS w, u.mx AS mx, u.my AS my,
  sum(r * (x - u.mx) * (x - u.mx)) / u.n + {reg} AS sxx, sum(r * (x - u.mx) * (y - u.my)) / u.n AS sxy,
  sum(r * (y - u.my) * (y - u.my)) / u.n + {reg} AS syy
FROM {r} r JOIN u{t} u ON r.k = u.k GROUP BY u.k, u.n, u.mx, u.my""",
        )
        self.logliks.append(
            f"SELECT {self.steps + 1} AS epoch, sum(ln(s)) AS loglik FROM (SELECT DISTINCT id, s FROM {r})"
        )
        self.steps += 1
        return self

    def em_until(self, tol: float, rounds: int, reg: float = 0.0) -> "Fit":
        """EM until the mean log-likelihood changes by less than ``tol``; ``climb`` has every round."""
        self.recursive()
        self.add(
            "climb",
            f"""SELECT 0 AS round, k, w, mx, my, sxx, sxy, syy, CAST(NULL AS DOUBLE) AS level,
  CAST('inf' AS DOUBLE) AS change FROM {self.model}
UNION ALL
SELECT round + 1, k, n / sum(n) OVER (), sx / n, sy / n, qxx / n - (sx / n) * (sx / n) + {reg},
  qxy / n - (sx / n) * (sy / n), qyy / n - (sy / n) * (sy / n) + {reg}, sum(ls) OVER () / sum(n) OVER (),
  coalesce(abs(sum(ls) OVER () / sum(n) OVER () - before), CAST('inf' AS DOUBLE))
FROM (SELECT max(round) AS round, k, sum(r) AS n, sum(r * x) AS sx, sum(r * y) AS sy, sum(r * x * x) AS qxx,
    sum(r * x * y) AS qxy, sum(r * y * y) AS qyy, sum(r * ln(s)) AS ls, max(level) AS before
  FROM (SELECT *, g / sum(g) OVER (PARTITION BY id) AS r, sum(g) OVER (PARTITION BY id) AS s
    FROM (SELECT id, x, y, k, round, level, w / (2 * pi() * sqrt(sxx * syy - sxy * sxy)) * exp(-0.5 * (
        (x - mx) * (x - mx) * syy - 2 * (x - mx) * (y - my) * sxy + (y - my) * (y - my) * sxx)
        / (sxx * syy - sxy * sxy)) AS g
      FROM p, climb WHERE change >= {tol} AND round < {rounds})) GROUP BY k)""",
        )
        self.model = self.add("mc", "SELECT * FROM climb WHERE round = (SELECT max(round) FROM climb)")
        return self

    def recursive(self) -> None:
        name, body = self.parts[0]
        self.parts[0] = (f"RECURSIVE {name.removeprefix('RECURSIVE ')}", body)

    def nearest(self, tag: str, centres: str) -> str:
        return self.add(
            f"near{tag}",
            f"""SELECT id, x, y, k, d2 FROM (SELECT id, x, y, k, d2,
    row_number() OVER (PARTITION BY id ORDER BY d2, k) AS place FROM (
      SELECT id, x, y, k, (x - mx) * (x - mx) + (y - my) * (y - my) AS d2 FROM p, {centres}))
WHERE place = 1""",
        )

    def lloyd(self) -> "Fit":
        t = f"{self.steps}"
        near = self.nearest(t, self.model)
        self.model = self.add(
            f"m{self.steps + 1}",
            f"""SELECT m.k AS k, m.w AS w, coalesce(avg(x), m.mx) AS mx, coalesce(avg(y), m.my) AS my,
  1.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy, 1.0::DOUBLE AS syy
FROM {self.model} m LEFT JOIN {near} n ON m.k = n.k GROUP BY m.k, m.w, m.mx, m.my""",
        )
        self.steps += 1
        return self

    def lloyd_until(self, tol: float, rounds: int = 300) -> "Fit":
        """Lloyd rounds until no centre moves farther than ``tol``; ``walk`` has every round."""
        self.recursive()
        self.add(
            "walk",
            f"""SELECT 0 AS round, k, mx, my, CAST('inf' AS DOUBLE) AS shift FROM {self.model}
UNION ALL
SELECT round + 1, k, nx, ny, max(sqrt((nx - mx) * (nx - mx) + (ny - my) * (ny - my))) OVER () FROM (
  SELECT c.round AS round, c.k AS k, c.mx AS mx, c.my AS my,
    coalesce(n.ax, c.mx) AS nx, coalesce(n.ay, c.my) AS ny
  FROM walk c LEFT JOIN (
    SELECT k, avg(x) AS ax, avg(y) AS ay FROM (
      SELECT p.id, any_value(p.x) AS x, any_value(p.y) AS y,
        min({{'d': (p.x - w.mx) * (p.x - w.mx) + (p.y - w.my) * (p.y - w.my), 'k': w.k}}).k AS k
      FROM p, walk w GROUP BY p.id) GROUP BY k) n ON n.k = c.k
  WHERE c.shift > {tol} AND c.round < {rounds})""",
        )
        self.model = self.add(
            "mw",
            """SELECT k, 1.0::DOUBLE / count(*) OVER () AS w, mx, my, 1.0::DOUBLE AS sxx, 0.0::DOUBLE AS sxy,
  1.0::DOUBLE AS syy FROM walk WHERE round = (SELECT max(round) FROM walk)""",
        )
        return self

    def hard_moments(self, reg: float = 0.0) -> "Fit":
        """Weights and covariances of the nearest-centre groups; means stay."""
        near = self.nearest("h", self.model)
        self.model = self.add(
            "mh",
            f"""SELECT m.k AS k, count(*) / (SELECT count(*) FROM p)::DOUBLE AS w, m.mx AS mx, m.my AS my,
  covar_pop(x, x) + {reg} AS sxx, covar_pop(x, y) AS sxy, covar_pop(y, y) + {reg} AS syy
FROM {self.model} m JOIN {near} n ON m.k = n.k GROUP BY m.k, m.mx, m.my""",
        )
        return self

    def minibatch(
        self, batch_size: int | None, rate: float, decay: float, seed: int, batches: int | None = None
    ) -> "Fit":
        t = self.steps
        if t == 0:
            number = f"{batches}::BIGINT" if batches else f"ceil(count(*) / {batch_size}.0)::BIGINT"
            self.add("nb", f"SELECT {number} AS nb FROM p" + (" LIMIT 1" if batches else ""))
        self.add(
            f"b{t}",
            f"""SELECT id, x, y FROM p, nb
WHERE {digest_word(f"md5(concat_ws(':', id, {seed}, {t} // nb))", 0)} % nb = {t} % nb""",
        )
        r = self.shares(f"b{t}", f"b{t}", self.model)
        eta = f"({rate} / (1 + {t} / {decay}::DOUBLE))"
        share = f"(sum(r) / (SELECT count(*) FROM b{t}))"
        each = f"(SELECT count(*) FROM b{t})"
        self.add(
            f"g{t}",
            f"""SELECT m.k AS k, exp(ln(m.w) + {eta} * ({share} - m.w)) AS v,
  m.mx + {eta} * sum(r * (x - m.mx)) / {each} AS mx, m.my + {eta} * sum(r * (y - m.my)) / {each} AS my,
  (1 - {eta} * {share}) * m.sxx + {eta} * sum(r * (x - m.mx) * (x - m.mx)) / {each} AS sxx,
  (1 - {eta} * {share}) * m.sxy + {eta} * sum(r * (x - m.mx) * (y - m.my)) / {each} AS sxy,
  (1 - {eta} * {share}) * m.syy + {eta} * sum(r * (y - m.my) * (y - m.my)) / {each} AS syy
FROM {r} r JOIN {self.model} m ON r.k = m.k GROUP BY m.k, m.w, m.mx, m.my, m.sxx, m.sxy, m.syy""",
        )
        self.model = self.add(
            f"m{t + 1}", f"SELECT k, v / sum(v) OVER () AS w, mx, my, sxx, sxy, syy FROM g{t}"
        )
        self.steps += 1
        return self

    def minibatch_walk(self, steps: int, batch_size: int, rate: float, decay: float, seed: int) -> "Fit":
        """All steps of a mini-batch fit; ``stride`` has every step."""
        self.recursive()
        self.add("nb", f"SELECT ceil(count(*) / {batch_size}.0)::BIGINT AS nb FROM p")
        batch = digest_word(f"md5(concat_ws(':', id, {seed}, step // nb))", 0)
        self.add(
            "stride",
            f"""SELECT 0 AS step, k, w, mx, my, sxx, sxy, syy FROM {self.model}
UNION ALL
SELECT step + 1, k, v / sum(v) OVER (), mx + eta * dx, my + eta * dy, (1 - eta * share) * sxx + eta * dxx,
  (1 - eta * share) * sxy + eta * dxy, (1 - eta * share) * syy + eta * dyy
FROM (SELECT *, exp(ln(w) + eta * (share - w)) AS v FROM (
  SELECT step, k, w, mx, my, sxx, sxy, syy, {rate} / (1 + step / {decay}::DOUBLE) AS eta, avg(r) AS share,
    avg(r * (x - mx)) AS dx, avg(r * (y - my)) AS dy, avg(r * (x - mx) * (x - mx)) AS dxx,
    avg(r * (x - mx) * (y - my)) AS dxy, avg(r * (y - my) * (y - my)) AS dyy
  FROM (SELECT *, g / sum(g) OVER (PARTITION BY id) AS r
    FROM (SELECT *, w / (2 * pi() * sqrt(sxx * syy - sxy * sxy)) * exp(-0.5 * (
        (x - mx) * (x - mx) * syy - 2 * (x - mx) * (y - my) * sxy + (y - my) * (y - my) * sxx)
        / (sxx * syy - sxy * sxy)) AS g
      FROM p, stride, nb
      WHERE step < {steps} AND CASE WHEN nb = 1 THEN true ELSE {batch} % nb = step % nb END))
  GROUP BY step, k, w, mx, my, sxx, sxy, syy))""",
        )
        self.model = self.add("ms", f"SELECT * FROM stride WHERE step = {steps}")
        return self

    def loglik(self, name: str = "closing") -> str:
        """Log-likelihood of the current model as ``name(loglik)``."""
        r = self.shares(name, "p", self.model)
        return self.add(name, f"SELECT sum(ln(s)) AS loglik FROM (SELECT DISTINCT id, s FROM {r})")

    def sql(self, final: str) -> str:
        # a recursive table cannot be told to be materialised
        ctes = ",\n".join(f"{n} AS {'' if n in ('walk', 'climb', 'stride') else 'MATERIALIZED '}(\n{b}\n)" for n, b in self.parts)
        return f"WITH {ctes}\n{final}"

    def model_sql(self, digits: int = 6) -> str:
        return self.sql(model_select(self.model, digits))


def model_select(model: str, digits: int = 6) -> str:
    return (
        "SELECT CAST(k AS INT) AS component, "
        + ", ".join(
            f"round({c}, {digits}) AS {n}"
            for c, n in (
                ("w", "weight"),
                ("mx", "mean_x"),
                ("my", "mean_y"),
                ("sxx", "cov_xx"),
                ("sxy", "cov_xy"),
                ("syy", "cov_yy"),
            )
        )
        + f" FROM {model}"
    )


def fixed_model(idle: bool = False) -> str:
    """The recorded model as a SQL table ``(k, w, mx, my, sxx, sxy, syy)``."""
    rows = [
        (i, w, m[0], m[1], c[0][0], c[0][1], c[1][1])
        for i, (w, m, c) in enumerate(
            zip(RECORDED_WEIGHTS, RECORDED_MEANS, RECORDED_COVS)
        )
    ]
    if idle:
        rows.append((3, 1e-6, -100000.0, -100000.0, 1.0, 0.0, 1.0))
    values = ", ".join(
        "(" + ", ".join([str(r[0]), *(f"{v!r}::DOUBLE" for v in r[1:])]) + ")" for r in rows
    )
    return f"SELECT * FROM (VALUES {values}) AS t(k, w, mx, my, sxx, sxy, syy)"


def scored(points: str = PTS_PIXELS, idle: bool = False) -> str:
    """``WITH`` prefix defining model, log-densities ``e``, posteriors ``r`` and labels ``lab``."""
    return f"""WITH model AS MATERIALIZED ({fixed_model(idle)}),
p AS MATERIALIZED ({points}),
e AS MATERIALIZED (SELECT id, x, y, k, ((x - mx) * (x - mx) * syy - 2 * (x - mx) * (y - my) * sxy
    + (y - my) * (y - my) * sxx) / (sxx * syy - sxy * sxy) AS q,
  ln(w) - ln(2 * pi()) - 0.5 * ln(sxx * syy - sxy * sxy) AS c FROM p, model),
d AS MATERIALIZED (SELECT id, x, y, k, q, c - 0.5 * q AS ld FROM e),
r AS MATERIALIZED (SELECT id, k, ld, exp(ld) / sum(exp(ld)) OVER (PARTITION BY id) AS r,
  ln(sum(exp(ld)) OVER (PARTITION BY id)) AS loglik FROM d),
lab AS MATERIALIZED (SELECT id, x, y, k, q FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ld DESC, k) AS place
  FROM d) WHERE place = 1)
"""
