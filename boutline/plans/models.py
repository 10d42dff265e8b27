"""Odds, priors, splits and metrics on the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from boutline.operators import boosting, models
from boutline.operators.durable import checkpointed
from boutline.plans.registry import query

C = F.col
_P = "1 / (1 + exp(-(value - 50) / 40))"


@query("m01_predict", "SELECT event_id, round(1 / (1 + exp(-(0.25 + 0.8 * (value - 50) / 30 - 0.3 * (event_id % 7 - 3) / 2.0))), 6) AS p FROM events")
def m01_predict(t):
    model = models.Logistic(("value", "k"), (0.8, -0.3), 0.25, (50.0, 3.0), (30.0, 2.0))
    return t.events.withColumn("k", C("event_id") % 7).select("event_id", F.round(model.predict(), 6).alias("p"))


def _solved(k: int) -> list[str]:
    """SQL: the solution of h m = g for a symmetric h of k rows (at most three), by Cramer's rule."""
    h = [[f"h{min(i, j)}{max(i, j)}" for j in range(k)] for i in range(k)]

    def det(m: list[list[str]]) -> str:
        if len(m) == 1:
            return m[0][0]
        return "(" + " + ".join(f"({'-' if c % 2 else ''}1) * {m[0][c]} * {det([row[:c] + row[c + 1:] for row in m[1:]])}" for c in range(len(m))) + ")"

    return [f"{det([[f'g{i}' if c == j else h[i][c] for c in range(k)] for i in range(k)])} / {det(h)}" for j in range(k)]


def _newton(rows: str, k: int, start: list[float], pull: list[str], steps: int = 12) -> str:
    """SQL: weights a0.. by win of the logistic fit to `rows` (win, y, x0..), with `pull` towards `start` in each weight (an expression of n, the number of rows)."""
    names, z = ", ".join(f"a{j}" for j in range(k)), " + ".join(f"a{j} * x{j}" for j in range(k))
    sums = [f"sum((p - y) * x{j}) + ({pull[j]}) * (a{j} - {start[j]}) AS g{j}" for j in range(k)] + [f"sum(p * (1 - p) * x{i} * x{j}){f' + ({pull[i]})' if i == j else ''} AS h{i}{j}" for i in range(k) for j in range(i, k)]
    moved = ", ".join(f"a{j} - {m} AS a{j}" for j, m in enumerate(_solved(k)))
    return f"""r AS MATERIALIZED ({rows}), n AS (SELECT win, CAST(count(*) AS DOUBLE) AS n FROM r GROUP BY win), w AS (SELECT win, 0 AS i, {", ".join(f"{v}::DOUBLE AS a{j}" for j, v in enumerate(start))} FROM n
 UNION ALL SELECT win, i + 1, {moved} FROM (SELECT win, i, {names}, n, {", ".join(sums)} FROM (SELECT w.*, n.n, r.y, {", ".join(f"r.x{j}" for j in range(k))}, 1 / (1 + exp(-({z}))) AS p FROM w JOIN r ON r.win = w.win JOIN n ON n.win = w.win) GROUP BY win, i, {names}, n) WHERE i < {steps}),
 fitted AS (SELECT * FROM w WHERE i = {steps})"""


_TEXTS = "SELECT ln(length(text) + 1) AS size, len(string_split(text, ' ')) / (length(text) + 1)::DOUBLE AS spaces, quality AS y FROM documents JOIN labels USING (doc_id) WHERE text IS NOT NULL AND quality IS NOT NULL"
_TEXT_ROWS = f"SELECT 0 AS win, y, (size - avg(size) OVER ()) / stddev_pop(size) OVER () AS x0, (spaces - avg(spaces) OVER ()) / stddev_pop(spaces) OVER () AS x1, 1.0::DOUBLE AS x2 FROM ({_TEXTS})"
_TEXT_FIT = _newton(_TEXT_ROWS, 3, [0.0, 0.0, 0.0], ["0.01 * n", "0.01 * n", "0"])
_GAPS = "SELECT CAST(ts AS DATE) AS d, (value - 50) / 40 AS x0, (event_id % 7 - 3) / 2.0::DOUBLE AS x1, CAST(event_type IN ('purchase', 'signup') AS INT) AS y FROM events"
_GAP_FIT = _newton(f"SELECT 0 AS win, y, x0, x1 FROM ({_GAPS})", 2, [1.0, 0.0], ["40", "40"])


def texts(t):
    """Log of the size and share of spaces of labelled documents; a batch's numbers are all that a fit keeps of a text."""
    return t.documents.join(t.labels, "doc_id").select(F.ln(F.length("text") + 1).alias("size"), (F.size(F.split("text", " ")) / (F.length("text") + 1)).alias("spaces"), "quality")


def gaps(t):
    return t.events.select(F.to_date("ts").alias("day"), ((C("value") - 50) / 40).alias("gap"), ((C("event_id") % 7 - 3) / 2).alias("reach"), C("event_type").isin("purchase", "signup").cast("int").alias("y"))


@query("m01_fit", f"WITH RECURSIVE {_TEXT_FIT} SELECT unnest(['size', 'spaces', 'bias']) AS feature, round(unnest([a0, a1, a2]), 5) AS weight FROM fitted")
def m01_fit(t):
    model = models.fit_logistic(texts(t), ["size", "spaces"], "quality")
    return t.spark.createDataFrame([(n, round(w, 5)) for n, w in zip((*model.features, "bias"), (*model.weights, model.bias))], "feature string, weight double")


@query("m01_minimum", f"WITH RECURSIVE {_TEXT_FIT}, s AS (SELECT r.*, 1 / (1 + exp(-(a0 * x0 + a1 * x1 + a2 * x2))) AS p, a0, a1, a2 FROM r JOIN fitted USING (win)) SELECT unnest(['size', 'spaces', 'bias']) AS feature, unnest([abs(avg((p - y) * x0) + 0.01 * any_value(a0)) < 1e-6, abs(avg((p - y) * x1) + 0.01 * any_value(a1)) < 1e-6, abs(avg((p - y) * x2)) < 1e-6]) AS flat FROM s")
def m01_minimum(t):
    """Whether the loss is flat where the fit ends; the twin asks the same of its own fit."""
    d = checkpointed(texts(t))
    model = models.fit_logistic(d, ["size", "spaces"], "quality")
    return t.spark.createDataFrame([(n, abs(g) < 1e-6) for n, g in zip((*model.features, "bias"), models.slopes(d, model, "quality"))], "feature string, flat boolean")


@query("m06_fit", f"WITH RECURSIVE {_GAP_FIT} SELECT unnest(['gap', 'reach']) AS feature, round(unnest([a0, a1]), 6) AS weight FROM fitted")
def m06_fit(t):
    """The fit that is pulled to prior weights, without a bias."""
    model = models.fit_logistic(gaps(t), ["gap", "reach"], "y", l2=40.0, prior=[1.0, 0.0], intercept=False, standardize=False, per_row=False)
    return t.spark.createDataFrame([(n, round(w, 6)) for n, w in zip(model.features, model.weights)], "feature string, weight double")


@query("m06_minimum", f"WITH RECURSIVE {_GAP_FIT}, s AS (SELECT r.*, 1 / (1 + exp(-(a0 * x0 + a1 * x1))) AS p, a0, a1 FROM r JOIN fitted USING (win)) SELECT unnest(['gap', 'reach']) AS feature, unnest([abs(sum((p - y) * x0) + 40 * (any_value(a0) - 1)) / count(*) < 1e-6, abs(sum((p - y) * x1) + 40 * any_value(a1)) / count(*) < 1e-6]) AS flat FROM s")
def m06_minimum(t):
    """The loss of that fit is a sum, and flat where it ends."""
    d = gaps(t)
    model = models.fit_logistic(d, ["gap", "reach"], "y", l2=40.0, prior=[1.0, 0.0], intercept=False, standardize=False, per_row=False)
    found = models.slopes(d, model, "y", l2=40.0, prior=[1.0, 0.0], per_row=False)
    return t.spark.createDataFrame([(n, abs(g) < 1e-6) for n, g in zip(model.features, found)], "feature string, flat boolean")


_SCALE = """x AS MATERIALIZED (SELECT list((value - 20) / 100) AS xs FROM events), k AS (SELECT list_reduce(list_prepend(1.0::DOUBLE, range(30)), lambda k, i: greatest(0, least(50, k + list_sum(list_transform(xs, lambda x: x / (1 + exp(k * x)))) / list_sum(list_transform(xs, lambda x: x * x / (1 + exp(k * x)) / (1 + exp(-k * x))))))) AS k FROM x)"""


@query("m10_minimum", f"WITH {_SCALE} SELECT k = 50 AND g > 0 OR abs(g) < 1e-6 AS flat FROM (SELECT k, list_avg(list_transform(xs, lambda x: x / (1 + exp(k * x)))) AS g FROM x, k)")
def m10_minimum(t):
    d = t.events.select(((C("value") - 20) / 100).alias("x"))
    k = models.fit_scale(d, "x")
    slope = d.agg(F.avg((1 - models.sigmoid(k * C("x"))) * C("x"))).first()[0]
    return t.spark.createDataFrame([(k == 50.0 and slope > 0 or abs(slope) < 1e-6,)], "flat boolean")


@query("m16_compare", "SELECT count(*) AS both, CAST(0 AS BIGINT) AS first_only, (SELECT count(*) FROM orders WHERE o_orderstatus = 'P') AS second_only, count(*) FILTER (WHERE month(o_orderdate) = 6) AS moved, round(avg(CASE WHEN month(o_orderdate) = 6 THEN 5 ELSE 0 END), 6) AS mean_move, 5.0::DOUBLE AS largest_move FROM orders WHERE o_orderstatus <> 'P'")
def m16(t):
    one = t.orders.where("o_orderstatus != 'P'").select("o_orderkey", "o_totalprice")
    other = t.orders.select("o_orderkey", (C("o_totalprice") + F.when(F.month("o_orderdate") == 6, 5.0).otherwise(0.0)).alias("o_totalprice"))
    d = models.compare_runs(one, other, ["o_orderkey"], "o_totalprice")
    return d.withColumns({"mean_move": F.round("mean_move", 6), "largest_move": F.round("largest_move", 6)})


@query("m03_split", "SELECT o_orderkey, row_number() OVER (ORDER BY CAST(o_orderdate AS DATE), o_orderkey) <= floor((SELECT count(*) FROM orders) * 0.8) AS is_train FROM orders")
def m03(t):
    return models.chronological_split(t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("day")), "day", "o_orderkey").select("o_orderkey", "is_train")


@query("m04_odds", """WITH n AS (SELECT c_nationkey AS k, 1500 + avg(c_acctbal) / 20 AS r, 150 + stddev_pop(c_acctbal) / 100 AS d FROM customer GROUP BY 1)
 SELECT a.k AS a, b.k AS b, round(1 / (1 + pow(10, -(1 / sqrt(1 + 3 * pow(ln(10) / 400, 2) * (a.d * a.d + b.d * b.d) / pow(pi(), 2))) * (a.r - b.r) / 400)), 6) AS win_a, CASE WHEN greatest(a.d, b.d) <= 170 THEN 'high' WHEN greatest(a.d, b.d) <= 215 THEN 'medium' ELSE 'low' END AS confidence
 FROM n a JOIN n b ON a.k < b.k JOIN nation x ON x.n_nationkey = a.k JOIN nation y ON y.n_nationkey = b.k AND y.n_regionkey = x.n_regionkey""")
def m04(t):
    n = t.customer.groupBy("c_nationkey").agg((1500 + F.avg("c_acctbal") / 20).alias("r"), (150 + F.stddev_pop("c_acctbal") / 100).alias("d")).join(t.nation, C("c_nationkey") == C("n_nationkey"))
    n = n.select(C("c_nationkey").alias("k"), C("n_regionkey").alias("g"), "r", "d")
    pairs = n.alias("a").join(n.alias("b"), (C("a.g") == C("b.g")) & (C("a.k") < C("b.k")))
    odds = models.pairwise_odds(C("a.r"), C("a.d"), C("b.r"), C("b.d"))
    return pairs.select(C("a.k").alias("a"), C("b.k").alias("b"), odds.alias("o")).select("a", "b", F.round("o.win_a", 6).alias("win_a"), "o.confidence")


_FINISHES = "SELECT o_orderpriority AS division, CASE WHEN month(o_orderdate) = 12 THEN 5 ELSE 3 END AS scheduled, CASE o_orderstatus WHEN 'F' THEN 'ko' WHEN 'O' THEN 'sub' ELSE 'dec' END AS method, CAST(day(o_orderdate) % 6 AS INT) AS finish FROM orders"


def finishes(t):
    method = F.when(C("o_orderstatus") == "F", "ko").when(C("o_orderstatus") == "O", "sub").otherwise("dec")
    return t.orders.select(C("o_orderpriority").alias("division"), F.when(F.month("o_orderdate") == 12, 5).otherwise(3).alias("scheduled"), method.alias("method"), (F.dayofmonth("o_orderdate") % 6).alias("finish"))


@query("m08_methods", f"""WITH f AS ({_FINISHES}), g AS (SELECT method, count(*) FILTER (WHERE scheduled = 3) / sum(count(*) FILTER (WHERE scheduled = 3)) OVER () AS a, count(*) FILTER (WHERE scheduled = 5) / sum(count(*) FILTER (WHERE scheduled = 5)) OVER () AS b FROM f GROUP BY 1),
 d AS (SELECT division, method, count(*) FILTER (WHERE scheduled = 3) AS n FROM f GROUP BY ALL) SELECT division, method, round((n + 30 * a) / (sum(n) OVER (PARTITION BY division) + 30), 6) AS share, round(b / a, 6) AS five FROM d JOIN g USING (method) UNION ALL SELECT NULL, method, round(a, 6), round(b / a, 6) FROM g""")
def m08(t):
    return models.method_priors(finishes(t), "division", "scheduled", "method").select("division", "method", F.round("share", 6).alias("share"), F.round("five", 6).alias("five"))


@query("m08_rounds", f"""WITH s AS (SELECT r AS scheduled, m AS method, k AS round FROM (VALUES (3), (5)) a(r), (VALUES ('ko'), ('sub')) b(m), range(1, 6) c(k) WHERE k <= r), n AS (SELECT scheduled, method, finish AS round, count(*) AS n FROM ({_FINISHES}) GROUP BY ALL)
 SELECT scheduled, method, CAST(round AS INT) AS round, round((coalesce(n, 0) + 1) / sum(coalesce(n, 0) + 1) OVER (PARTITION BY scheduled, method), 6) AS share FROM s LEFT JOIN n USING (scheduled, method, round)""")
def m08_rounds(t):
    return models.round_shares(finishes(t), "scheduled", "method", "finish").withColumn("share", F.round("share", 6))


def odds(t):
    from boutline.functions.bouts import sigmoid

    return t.events.withColumn("p", sigmoid((C("value") - 50) / 40)).withColumn("y", C("event_type").isin("purchase", "signup"))


@query("m09_metrics", f"SELECT user_id, round(avg(-ln(greatest(1e-12, own))), 5) AS log_loss, round(avg(CASE WHEN own > 0.5 THEN 1 WHEN own = 0.5 THEN 0.5 ELSE 0 END), 5) AS accuracy, count(*) AS n FROM (SELECT user_id, CASE WHEN event_type IN ('purchase', 'signup') THEN {_P} ELSE 1 - {_P} END AS own FROM events) GROUP BY 1")
def m09(t):
    loss, accuracy, n = models.metrics(C("p"), C("y"))
    return odds(t).groupBy("user_id").agg(F.round(loss, 5).alias("log_loss"), F.round(accuracy, 5).alias("accuracy"), n)


@query("m09_calibration", f"SELECT CAST(least(4, floor(p * 5)) AS INT) AS bin, round(avg(p), 6) AS predicted, round(avg(CASE WHEN y THEN 1 ELSE 0 END), 6) AS observed, count(*) AS n FROM (SELECT {_P} AS p, event_type IN ('purchase', 'signup') AS y FROM events) GROUP BY 1")
def m09_calibration(t):
    return models.calibration(odds(t), C("p"), C("y")).withColumn("predicted", F.round("predicted", 6)).withColumn("observed", F.round("observed", 6))


@query("m10_scale", f"WITH {_SCALE} SELECT round(k, 5) AS scale FROM k")
def m10(t):
    k = models.fit_scale(t.events.select(((C("value") - 20) / 100).alias("x")), "x")
    return t.spark.createDataFrame([(round(k, 5),)], "scale double")


WINDOWS = [("1997-01-01", "1998-01-01"), ("1998-01-01", "1999-06-01"), ("1999-06-01", "9999-12-31")]


@query("m13_walk_forward", "SELECT w AS \"window\", CASE WHEN d < a THEN 'train' ELSE 'test' END AS part, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM (SELECT CAST(o_orderdate AS DATE) AS d, o_totalprice FROM orders) JOIN (VALUES (0, DATE '1997-01-01', DATE '1998-01-01'), (1, DATE '1998-01-01', DATE '1999-06-01'), (2, DATE '1999-06-01', DATE '9999-12-31')) v(w, a, b) ON d < b GROUP BY ALL")
def m13(t):
    d = models.walk_forward(t.orders.select(F.to_date("o_orderdate").alias("day"), "o_totalprice"), "day", WINDOWS)
    return d.groupBy("window", "part").agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))


REFITS = [("2024-01-05", "2024-01-12"), ("2024-01-12", "2024-01-20"), ("2024-01-20", "9999-12-31")]
_REFIT = _newton(f"SELECT win, y, x0, x1 FROM ({_GAPS}) JOIN (VALUES (0, DATE '2024-01-05'), (1, DATE '2024-01-12'), (2, DATE '2024-01-20')) v(win, a) ON d < a", 2, [1.0, 0.0], ["40", "40"])


@query("m13_refits", f"""WITH RECURSIVE {_REFIT}, v(win, a, z) AS (VALUES {", ".join(f"({n}, DATE '{a}', DATE '{z}')" for n, (a, z) in enumerate(REFITS))}), e AS ({_GAPS}),
 s AS (SELECT v.win, CASE WHEN d < v.a THEN 'train' ELSE 'test' END AS part, a0, a1, CASE WHEN y = 1 THEN 1 ELSE -1 END * (a0 * x0 + a1 * x1) AS z FROM e JOIN v ON d < v.z JOIN fitted ON fitted.win = v.win)
 SELECT CAST(win AS INT) AS "window", part, round(a0, 6) AS gap, round(a1, 6) AS reach, round(avg(ln(1 + exp(-z))), 6) AS log_loss, round(avg(CASE WHEN z > 0 THEN 1 WHEN z = 0 THEN 0.5 ELSE 0 END), 6) AS accuracy, count(*) AS n FROM s GROUP BY win, part, a0, a1""")
def m13_refits(t):
    """Three windows, each fitted on the rows before it in one common loop and judged on both parts."""
    rows = models.prepared(gaps(t), ["gap", "reach"], "y", "day")
    fits = models.fit_windows(rows, ["gap", "reach"], REFITS, l2=40.0, prior=[1.0, 0.0], intercept=False, standardize=False, per_row=False)
    weights = t.spark.createDataFrame([(w, round(m.weights[0], 6), round(m.weights[1], 6)) for w, m in enumerate(fits)], "window int, gap double, reach double")
    found = models.window_metrics(rows, fits, REFITS).join(weights, "window")
    return found.select("window", "part", "gap", "reach", F.round("log_loss", 6).alias("log_loss"), F.round("accuracy", 6).alias("accuracy"), "n")


@query("m15_boosting")
def m15(t):
    """Odds of an event's kind by boosted trees on its value, hour and user, against which the linear fit is measured; fitted and stopped on two halves by hash."""
    d = t.events.select("event_id", "value", F.hour("ts").cast("double").alias("hour"), (C("user_id") % 10).cast("double").alias("user"), C("event_type").isin("purchase", "signup").cast("int").alias("y"))
    half = F.pmod(F.xxhash64("event_id"), F.lit(2)) == 0
    model, _ = boosting.fit(d.where(half), ["value", "hour", "user"], "y", boosting.Boosting(trees=8, rate=0.3, depth=2, patience=3), d.where(~half), "event_id")
    return model.predict(d).select("event_id", F.round("p", 6).alias("p"))
