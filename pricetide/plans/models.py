"""Model queries.  What follows from the data alone — folds, halves, offsets, grids, permuted rules — has a SQL twin; what a
fitted model adds is unit-tested."""

from __future__ import annotations

from pyspark.sql import functions as F

from pricetide.operators import annual, evaluation
from pricetide.operators import models as ops
from pricetide.plans.history import UNIFORM, tidy
from pricetide.plans.joins import ANNUAL, LEVELS, annual_types
from pricetide.plans.registry import query
from pricetide.plans.snapshots import HORIZONS, SNAP, label_panel, panel_sql, snapshot
from pricetide.session import durable, stored
from pricetide.sources.domain import clean, with_trades

INPUTS = ["year", "area", "age", "prior_price", "prior_peer", "momentum", "prior_count", "peer_count", "reference_anchor", "last_price", "history_gap", "matched_peer"]
# Trees of the boosted fits that a query repeats over years, origins or blocks; a cluster would take the operator's default.
REPEATED = 20


def frame(spark, sf_dir):
    """Annual reference panel in the shape the evaluation operators read."""
    rows = annual.reference_frame(annual_types(spark, sf_dir)).where("reference_anchor IS NOT NULL")
    return stored(
        rows.withColumns(
            {"actual": F.col("target"), "anchor": F.col("reference_anchor"), "region": F.col("gu"), "price_oku": F.exp("target") * F.col("area") / 10000,
             "has_prior": F.col("prior_price").isNotNull()}
        )
    )


FRAME = ANNUAL + """
, frame AS (SELECT *, target AS actual, reference_anchor AS anchor, gu AS region, exp(target) * area / 10000 AS price_oku, prior_price IS NOT NULL AS has_prior
  FROM panel WHERE reference_anchor IS NOT NULL)
"""


@query(
    "ml1_training_inputs",
    with_trades(
        FRAME
        + "SELECT CAST(year AS BIGINT) AS year, count(*) AS rows, "
        + ", ".join(f"CAST(sum(CASE WHEN {c} IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS missing_{c}" for c in INPUTS)
        + ", round(avg(actual - anchor), 6) + 0.0 AS mean_residual FROM frame WHERE year < 2000 GROUP BY year"
    ),
)
def training_inputs(spark, sf_dir):
    rows = ops.with_inputs(frame(spark, sf_dir).where("year < 2000"), INPUTS)
    flags = F.slice(ops.vector_to_array("_x"), len(INPUTS) + 1, len(INPUTS))
    counts = [F.sum(flags[i]).cast("long").alias(f"missing_{c}") for i, c in enumerate(INPUTS)]
    return tidy(rows.groupBy("year").agg(F.count("*").alias("rows"), *counts, F.avg(F.col("actual") - F.col("anchor")).alias("mean_residual")))


@query("ml1_fit_residual")
def fit_residual(spark, sf_dir):
    rows = frame(spark, sf_dir)
    model = ops.fit_residual(rows.where("year < 2000"), INPUTS, trees=100)
    return tidy(evaluation.metric(model.transform(rows.where("year >= 2000")), "prediction", ["region"]))


@query(
    "ml2_folds",
    with_trades(
        FRAME
        + """SELECT CAST(f.year AS BIGINT) AS year, count(*) AS test_rows, any_value(t.n) AS training_rows,
  round(avg(abs(exp(anchor - actual) - 1) * price_oku), 6) AS anchor_mae_oku FROM frame f
  JOIN (SELECT y.year, count(*) AS n FROM (SELECT DISTINCT year FROM frame) y JOIN frame e ON e.year < y.year GROUP BY y.year) t USING (year)
WHERE f.year >= 1996 GROUP BY f.year HAVING any_value(t.n) >= 100"""
    ),
)
def folds(spark, sf_dir):
    rows = frame(spark, sf_dir)
    scored = evaluation.metric(rows, "anchor", ["year"]).select("year", F.col("transactions").alias("test_rows"), F.col("mae_oku").alias("anchor_mae_oku"))
    return tidy(scored.join(ops.earlier_rows(rows), "year").where("year >= 1996 AND training_rows >= 100"))


@query("ml2_walk_forward")
def walk_forward(spark, sf_dir):
    rows = frame(spark, sf_dir)
    years = [r["year"] for r in rows.select("year").distinct().orderBy("year").collect() if r["year"] >= 1996]
    out = durable(ops.walk_forward(rows, years, {"price_inputs": INPUTS[:8], "all_inputs": INPUTS}, trees=REPEATED))
    scored = [evaluation.metric(out, m, ["year"]).withColumn("method", F.lit(m)) for m in ("anchor", "price_inputs", "all_inputs")]
    return tidy(ops.union(scored))


HALF = "CAST('0x' || substr(sha256(complex), 1, 8) AS BIGINT) % 2"


@query(
    "ml3_blend_zero",
    with_trades(
        FRAME
        + f"""SELECT CAST(year AS BIGINT) AS year, round(avg(abs(exp(target) - exp(reference_anchor))), 4) AS mae, count(*) AS rows FROM frame
WHERE {HALF} = 0 GROUP BY year"""
    ),
)
def blend_zero(spark, sf_dir):
    """Every year's tuning half at weight 0: the anchor alone."""
    tuning, _ = ops.halves(frame(spark, sf_dir), "complex")
    years = [r["year"] for r in tuning.select("year").distinct().collect()]
    parts = [ops.blend_errors(tuning.where(F.col("year") == y).withColumn("prediction", F.col("reference_anchor"))).where("blend = 0").withColumn("year", F.lit(y)) for y in years]
    return tidy(ops.union(parts).select("year", "mae", "rows"), 4)


@query(
    "ml3_conformal_half",
    with_trades(
        FRAME
        + f""", err AS (SELECT *, abs(target - reference_anchor) / sqrt(1 + 2 / greatest(n, 1)) AS e FROM frame WHERE year = 2000 AND {HALF} = 1),
lv AS (SELECT 'history' AS level, gu || '|' || CAST(has_prior AS VARCHAR) AS grp, e FROM err UNION ALL SELECT 'gu', gu, e FROM err UNION ALL SELECT 'all', '', e FROM err),
ranked AS (SELECT *, row_number() OVER (PARTITION BY level, grp ORDER BY e) AS r, count(*) OVER (PARTITION BY level, grp) AS n FROM lv)
SELECT level, grp AS "group", any_value(n) AS n, round(min(e) FILTER (WHERE r = least(n, CAST(ceil((n + 1) * 0.8) AS BIGINT))), 6) AS radius FROM ranked
GROUP BY level, grp HAVING any_value(n) >= 20 OR level = 'all'"""
    ),
)
def conformal_half(spark, sf_dir):
    """Radii of the calibration half for the anchor alone."""
    rows = frame(spark, sf_dir).where("year = 2000").withColumn("prediction", F.col("reference_anchor"))
    return tidy(ops.split_conformal(ops.halves(rows, "complex")[1], 0.0, LEVELS, min_rows=20))


@query("ml3_tune")
def tune(spark, sf_dir):
    errors, radii = ops.tune(frame(spark, sf_dir), 2000, INPUTS, "complex", LEVELS, trees=REPEATED)
    chosen = radii.select(F.concat_ws(":", "level", "group").alias("part"), F.lit(None).cast("double").alias("blend"), F.col("n").alias("rows"), F.col("radius").alias("value"), F.lit(False).alias("selected"))
    return tidy(errors.select(F.lit("tuning").alias("part"), "blend", "rows", F.col("mae").alias("value"), "selected").unionByName(chosen))


@query("ml4_fit_quantiles")
def fit_quantiles(spark, sf_dir):
    rows = frame(spark, sf_dir)
    model = ops.fit_quantiles(rows.where("year < 2000"), INPUTS)
    out = model.transform(rows.where("year >= 2000"))
    return tidy(evaluation.quantile_metrics(out, {"region": F.col("region"), "year": F.col("year")}))


OFFSETS = """
, cal AS (SELECT year + 1 AS year, count(*) AS n, quantile_cont(actual - anchor, 0.1) AS o10, quantile_cont(actual - anchor, 0.5) AS o50,
  quantile_cont(actual - anchor, 0.9) AS o90 FROM frame GROUP BY year)
"""


@query(
    "ml5_anchor_offsets",
    with_trades(
        FRAME
        + OFFSETS
        + """SELECT CAST(f.year AS BIGINT) AS year, region, any_value(n) AS calibration_rows, count(*) AS transactions,
  round(any_value(o10), 6) + 0.0 AS o10, round(any_value(o90), 6) + 0.0 AS o90,
  round(avg(CASE WHEN actual >= anchor + o10 AND actual <= anchor + o90 THEN 100.0 ELSE 0.0 END), 6) AS coverage80_pct
FROM (SELECT year, region, actual, anchor FROM frame) f JOIN cal USING (year) WHERE f.year >= 1999 GROUP BY f.year, region"""
    ),
)
def anchor_offsets(spark, sf_dir):
    """The anchor as every level, shifted by the residual quantiles of the year before."""
    rows = frame(spark, sf_dir)
    parts = []
    for year in (y for (y,) in rows.select("year").distinct().orderBy("year").collect() if y >= 1999):
        flat = {n: F.col("anchor") for n in ops.LEVELS}
        found = ops.residual_offsets(rows.where(F.col("year") == year - 1).withColumns(flat), ops.LEVELS)
        o = {r["level"]: r for r in found.collect()}
        test = rows.where(F.col("year") == year).withColumns({n: F.col("anchor") + o[n]["offset"] for n in ops.LEVELS})
        hit = ((F.col("actual") >= F.col("p10")) & (F.col("actual") <= F.col("p90"))).cast("double")
        parts.append(
            test.groupBy("year", "region").agg(F.count("*").alias("transactions"), (F.avg(hit) * 100).alias("coverage80_pct")).withColumns(
                {"calibration_rows": F.lit(o["p10"]["n"]), "o10": F.lit(o["p10"]["offset"]), "o90": F.lit(o["p90"]["offset"])}
            )
        )
    return tidy(ops.union(parts))


@query("ml5_calibrate")
def calibrate(spark, sf_dir):
    rows = frame(spark, sf_dir)
    parts = []
    for year in (2000, 2001):
        before = rows.where(F.col("year") < year - 1)
        model = ops.calibrate(ops.fit_quantiles(before, INPUTS), rows.where(F.col("year") == year - 1))
        point = ops.fit_residual(before, INPUTS, trees=REPEATED)
        parts.append(ops.retain_median(model.transform(point.transform(rows.where(F.col("year") == year), "point")), "point"))
    return tidy(evaluation.quantile_metrics(ops.union(parts), {"region": F.col("region"), "year": F.col("year")}))


RADIUS_INPUTS = ["area", "age", "prior_count", "peer_count", "history_gap"]


@query(
    "ml6_balanced_offsets",
    with_trades(
        FRAME
        + """, v AS (SELECT region, abs(actual - anchor) AS e, 1.0::DOUBLE / count(*) OVER (PARTITION BY region, complex) AS w FROM frame WHERE year = 1999),
c AS (SELECT *, sum(w) OVER (PARTITION BY region ORDER BY e ROWS UNBOUNDED PRECEDING) AS cw, sum(w) OVER (PARTITION BY region) AS tw FROM v),
q AS (SELECT region, min(e) FILTER (WHERE cw >= tw * 0.8 - 1e-9) AS r FROM c GROUP BY region)
SELECT region, CAST(year AS BIGINT) AS year, count(*) AS transactions, round(any_value(r), 6) AS radius,
  round(avg(CASE WHEN abs(actual - anchor) <= r THEN 100.0 ELSE 0.0 END), 6) AS coverage_pct FROM frame JOIN q USING (region) WHERE year >= 2000 GROUP BY region, year"""
    ),
)
def balanced_offsets(spark, sf_dir):
    """Complex-balanced 80 % radius of the anchor per region, judged on later years."""
    rows = frame(spark, sf_dir).withColumn("prediction", F.col("anchor"))
    errors = evaluation.complex_weights(rows.where("year = 1999").withColumn("_e", F.abs(F.col("actual") - F.col("anchor"))))
    radius = evaluation.weighted_quantile(errors, ["region"], "_e", F.col("weight"), 0.8, "radius")
    judged = evaluation.confidence_stats(rows.where("year >= 2000").join(radius, "region"), ["region", "year"])
    return tidy(judged.select("region", "year", "transactions", "coverage_pct").join(radius, "region"))


@query("ml6_fit_radius")
def fit_radius(spark, sf_dir):
    rows = frame(spark, sf_dir).withColumn("prediction", F.col("anchor"))
    model = ops.fit_radius(rows.where("year < 1999"), rows.where("year = 1999"), RADIUS_INPUTS)
    return tidy(evaluation.confidence_stats(model.transform(rows.where("year >= 2000")), ["region", "year"]))


GROWTH_ORIGINS = ("2000-01-01", "2000-07-01", "2001-01-01", "2001-07-01")


@query(
    "ml7_growth_support",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + f""", asks AS (SELECT CAST(unnest([{", ".join(f"'{o}'" for o in GROWTH_ORIGINS)}]) AS DATE) AS ask),
m AS (SELECT ask, horizon_months, origin, label_available FROM panel JOIN asks ON label_available <= ask WHERE target IS NOT NULL),
s AS (SELECT ask, horizon_months, origin, sum(count(*)) OVER (PARTITION BY ask, horizon_months ORDER BY origin DESC) AS c FROM m GROUP BY ask, horizon_months, origin),
b AS (SELECT ask, horizon_months, max(origin) AS b FROM s WHERE c >= 100 GROUP BY ALL)
SELECT CAST(ask AS VARCHAR) AS ask, CAST(horizon_months AS BIGINT) AS horizon_months, CASE WHEN origin >= b THEN 'calibration' ELSE 'learn' END AS part,
  count(*) AS rows, count(DISTINCT origin) AS origins FROM m JOIN b USING (ask, horizon_months) WHERE origin >= b OR label_available <= b GROUP BY ALL"""
    ),
)
def growth_support(spark, sf_dir):
    panel = label_panel(spark, sf_dir)
    parts = []
    for ask in GROWTH_ORIGINS:
        for horizon in HORIZONS:
            try:
                split = ops.growth_split(panel.where(F.col("horizon_months") == horizon), ask)
            except ValueError:
                continue
            parts.append(ops.growth_support(split).withColumns({"ask": F.lit(ask), "horizon_months": F.lit(horizon)}))
    none = spark.createDataFrame([], "part string, rows long, origins long, ask string, horizon_months int")
    return tidy(ops.union([none, *parts]))


@query("ml7_fit_growth")
def fit_growth(spark, sf_dir):
    panel, snap = label_panel(spark, sf_dir), durable(snapshot(spark, sf_dir))

    def ranked(cell):
        origin, horizon = cell
        try:
            model, _ = ops.fit_growth(panel.where(F.col("horizon_months") == horizon), origin, min_rows=200)
        except ValueError:  # Too few labels were public.
            return None
        now = snap.where(F.col("origin") == origin).withColumn("horizon_months", F.lit(horizon))
        return durable(evaluation.rank_candidates(model.transform(now), ["origin", "horizon_months"], "p50"))

    names = ["origin", "horizon_months", "key", "p10", "p50", "p90", "rank", "top_percent"]
    found = [r.select(*names) for r in ops.at_once(ranked, [(o, h) for o in GROWTH_ORIGINS for h in HORIZONS]) if r is not None]
    if not found:
        kinds = "origin date, horizon_months int, key string, p10 double, p50 double, p90 double, rank long, top_percent double"
        return tidy(spark.createDataFrame([], kinds))
    return tidy(ops.union(found))


# Regions are blocks; their neighbours are those next to them in this order.
REGIONS = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")
AS_OF, MIN_ROWS = "2001-12-31", 60


def neighbours(spark):
    return spark.createDataFrame([(a, b) for a, b in zip(REGIONS, REGIONS[1:], strict=False)] + [(b, a) for a, b in zip(REGIONS, REGIONS[1:], strict=False)], "block string, other string")


@query(
    "ml8_blocked_grid",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + f""", r AS (SELECT * FROM (VALUES {", ".join(f"('{n}', {i})" for i, n in enumerate(REGIONS))}) v(gu, i)),
g AS (SELECT origin, horizon_months, gu, i, count(*) AS rows, count(target) AS labels, max(label_available) AS mature FROM panel JOIN r USING (gu) GROUP BY ALL),
s AS (SELECT g.origin, g.horizon_months, g.gu, count(*) AS n, count(DISTINCT p.origin) AS o FROM g JOIN (SELECT * FROM panel JOIN r USING (gu)) p
  ON p.horizon_months = g.horizon_months AND p.target IS NOT NULL AND p.label_available <= g.origin AND abs(p.i - g.i) > 1 GROUP BY ALL)
SELECT CAST(origin AS VARCHAR) AS origin, CAST(horizon_months AS BIGINT) AS horizon_months, gu AS block, rows, labels, coalesce(n, 0) AS training_rows,
  coalesce(o, 0) AS training_origins, CASE WHEN mature > DATE '{AS_OF}' THEN '{ops.NOT_MATURE}' WHEN coalesce(n, 0) < {MIN_ROWS} OR coalesce(o, 0) < 3 THEN '{ops.TOO_FEW}' END AS skipped
FROM g LEFT JOIN s USING (origin, horizon_months, gu)"""
    ),
)
def blocked_grid(spark, sf_dir):
    return tidy(ops.evaluation_grid(label_panel(spark, sf_dir), AS_OF, neighbours(spark), min_rows=MIN_ROWS))


@query(
    "ml8_origin_grid",
    with_trades(
        SNAP
        + panel_sql(HORIZONS, 6, True)
        + f""", g AS (SELECT origin, horizon_months, count(*) AS rows, count(target) AS labels, max(label_available) AS mature FROM panel GROUP BY ALL),
s AS (SELECT g.origin, g.horizon_months, count(*) AS n, count(DISTINCT p.origin) AS o FROM g JOIN panel p
  ON p.horizon_months = g.horizon_months AND p.target IS NOT NULL AND p.label_available <= g.origin GROUP BY ALL)
SELECT CAST(origin AS VARCHAR) AS origin, CAST(horizon_months AS BIGINT) AS horizon_months, 'all' AS block, rows, labels, coalesce(n, 0) AS training_rows,
  coalesce(o, 0) AS training_origins, CASE WHEN mature > DATE '{AS_OF}' THEN '{ops.NOT_MATURE}' WHEN coalesce(n, 0) < 500 OR coalesce(o, 0) < 3 THEN '{ops.TOO_FEW}' END AS skipped
FROM g LEFT JOIN s USING (origin, horizon_months)"""
    ),
)
def origin_grid(spark, sf_dir):
    return tidy(ops.evaluation_grid(label_panel(spark, sf_dir), AS_OF))


@query("ml8_evaluate_origins")
def evaluate_origins(spark, sf_dir):
    panel = label_panel(spark, sf_dir)
    results, grid = ops.evaluate_origins(panel, AS_OF, neighbours(spark), min_rows=MIN_ROWS, trees=REPEATED)
    # Without any cell to fit, the grid with its reasons is what there is to tell.
    return tidy(grid if results is None else results)


GROUPS = {"price_history": ["prior_price", "last_price"], "siblings": ["sibling_price"], "peers": ["matched_peer", "prior_peer"]}
CHAIN = ["prior_price", "last_price", "sibling_price", "matched_peer", "prior_peer"]


def _permuted_sql():
    parts = []
    for name, cols in GROUPS.items():
        for r in range(3):
            chain = ", ".join(f"{'b' if c in cols else 'a'}.{c}" for c in CHAIN)
            parts.append(
                f"""SELECT '{name}' AS name, avg(abs(exp(a.actual) - exp(coalesce({chain})))) AS e FROM t a
  JOIN (SELECT *, row_number() OVER (ORDER BY md5('{ops.SEED + r}|' || CAST(i AS VARCHAR)), i) AS j FROM t) b ON a.i = b.j"""
            )
    return " UNION ALL ".join(parts)


@query(
    "ml9_permuted_rule",
    with_trades(
        FRAME
        + ", t AS (SELECT *, row_number() OVER (ORDER BY dong, key, year) AS i FROM frame WHERE year >= 2000), m AS ("
        + _permuted_sql()
        + """), z AS (SELECT avg(abs(exp(actual) - exp(anchor))) AS e FROM t)
SELECT name, round(avg(m.e - z.e), 3) + 0.0 AS error_increase, round(stddev_pop(m.e - z.e), 3) AS repeat_std FROM m, z GROUP BY name"""
    ),
)
def permuted_rule(spark, sf_dir):
    """Sensitivity of the anchor rule itself to its inputs: the same permutations as for a model."""
    rows = frame(spark, sf_dir).where("year >= 2000")
    error = F.abs(F.exp("actual") - F.exp(F.coalesce(*CHAIN)))
    return tidy(ops.permutation_importance(lambda df: df, rows, GROUPS, ["dong", "key", "year"], error), 3)


@query("ml9_permutation_importance")
def permutation_importance(spark, sf_dir):
    rows = frame(spark, sf_dir)
    model = ops.fit_residual(rows.where("year < 2000"), INPUTS, trees=REPEATED)
    groups = {"price_history": ["prior_price", "prior_peer", "last_price"], "area": ["area"], "counts": ["prior_count", "peer_count"]}
    error = F.abs(F.exp("actual") - F.exp("prediction"))
    return tidy(ops.permutation_importance(model.transform, rows.where("year >= 2000"), groups, ["dong", "key", "year"], error))


@query(
    "ml10_current_templates",
    with_trades(
        """, base AS (SELECT * FROM clean WHERE date < DATE '2000-05-01'),
latest AS (SELECT key, arg_max({'complex': complex, 'gu': gu, 'area': area, 'built': built}, {'date': date, 'price': price, 'floor': floor}) AS t FROM base GROUP BY key),
floors AS (SELECT key, median(floor) AS floor FROM base WHERE date <= DATE '2000-05-01' - 31 AND date > DATE '2000-05-01' - 31 - 365 GROUP BY key)
SELECT key, t.complex AS complex, t.gu AS gu, CAST(t.area AS BIGINT) AS area, CAST(t.built AS BIGINT) AS built, floor FROM latest LEFT JOIN floors USING (key)"""
    ),
)
def current_templates(spark, sf_dir):
    trades = clean(spark, sf_dir)
    found = ops.current_templates(trades, trades.where("date < DATE '2000-05-01'"), "2000-05")
    return tidy(found.select("key", "complex", "gu", "area", "built", "floor"))


@query("ml10_predict_current")
def predict_current(spark, sf_dir):
    from pricetide.operators import history

    # Training, templates and valuation read the joined trades.
    trades = stored(clean(spark, sf_dir).select("key", "complex", "peer", "gu", "area", "built", "floor", "date", "day", "year", "price", "log_price", "price_oku"))
    inputs = ["area", "age", "anchor", "median365", "ew90", "peer365", "complex365", "n90", "n365", "floor"]
    train = stored(history.monthly_features(trades, UNIFORM, "1996-03-01", "2000-04-01").where("anchor IS NOT NULL").select(*inputs, "actual"))
    model = ops.fit_residual(train, inputs, trees=REPEATED)
    out = ops.predict_current(trades, trades.where("date < DATE '2000-05-01'"), model, "2000-05")
    return tidy(out.select("key", "month", "feature_cutoff", "floor", "n90", "anchor", "estimated_price_oku"))


@query(
    "ml11_rule_grid",
    with_trades(
        FRAME
        + """, rows AS (SELECT *, coalesce(momentum, 0) AS d_momentum, coalesce(prior_peer - anchor, 0) AS d_peer FROM frame WHERE year >= 1999),
x AS (SELECT complex, actual, price_oku, 'momentum' AS method, s AS strength, anchor + s * d_momentum AS p FROM rows CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) v(s)
  UNION ALL SELECT complex, actual, price_oku, 'peer', s, anchor + s * d_peer FROM rows CROSS JOIN (VALUES (0.0::DOUBLE), (0.25), (0.5), (1.0)) v(s)),
c AS (SELECT method, strength, complex, avg(abs(exp(p - actual) - 1)) AS m, sum(abs(exp(p - actual) - 1) * price_oku) AS t, count(*) AS n FROM x GROUP BY ALL),
g AS (SELECT method, strength, sum(t) / sum(n) AS mae, avg(m) * 100 AS cb, sum(n) AS n FROM c GROUP BY ALL),
k AS (SELECT g.*, (g.mae / z.mae + g.cb / z.cb) / 2 AS score FROM g JOIN g z ON z.method = g.method AND z.strength = 0)
SELECT method, strength, CAST(n AS BIGINT) AS transactions, round(mae, 6) AS mae_oku, round(cb, 6) AS complex_balanced_mape_pct, round(score, 6) AS selection_score,
  row_number() OVER (PARTITION BY method ORDER BY score, strength) = 1 AS selected FROM k"""
    ),
)
def rule_grid(spark, sf_dir):
    """The strength grid over two corrections that need no model."""
    rows = frame(spark, sf_dir).where("year >= 1999").withColumns(
        {"d_momentum": F.coalesce("momentum", F.lit(0.0)), "d_peer": F.coalesce(F.col("prior_peer") - F.col("anchor"), F.lit(0.0))}
    )
    out = ops.correction_grid(rows, "anchor", {"momentum": "d_momentum", "peer": "d_peer"})
    return tidy(out.select("method", "strength", "transactions", "mae_oku", "complex_balanced_mape_pct", "selection_score", "selected"))


@query("ml11_correction_grid")
def correction_grid(spark, sf_dir):
    rows = frame(spark, sf_dir).withColumn("_res", F.col("actual") - F.col("anchor"))
    early = rows.where("year < 1999")
    a = ops.fit_residual(early, ["area", "age"], "_res", None, trees=REPEATED)
    b = ops.fit_residual(early, ["area", "age", "prior_count", "peer_count"], "_res", None, trees=REPEATED)
    scored = b.transform(a.transform(rows.where("year >= 1999"), "d_controls"), "d_counts")
    return tidy(ops.correction_grid(scored, "anchor", {"controls": "d_controls", "counts": "d_counts"}))
