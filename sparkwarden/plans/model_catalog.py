"""Model queries that SQL can follow: a forest whose nodes come from the table by a stated rule, walked by recursion.

Tree ``t`` cuts feature ``t`` at its mean; rows above are cut in the next feature at half its maximum. Node sizes are the
rows that reach a node. A fitted forest, whose cuts are random, is held to what must be true of any such tree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkwarden.operators.anomaly import anomaly_alerts
from sparkwarden.operators.features import feature_matrix
from sparkwarden.operators.iforest import SAMPLE, TREES, fit_iforest, predict, score, training_set, with_threshold
from sparkwarden.plans import sql
from sparkwarden.plans.catalog import _PORTS_CTE, _VELOCITY, CFG, alert_view, query, us
from sparkwarden.plans.materialize import materialize
from sparkwarden.schema import FEATURE_NAMES
from sparkwarden.sources.adapter import sec_events


def _matrix(spark, sf) -> DataFrame:
    return materialize(feature_matrix(sec_events(spark, sf), CFG))


def given_forest(matrix: DataFrame) -> DataFrame:
    """Node table of the rule above, of five nodes a tree."""
    after = FEATURE_NAMES[1:] + FEATURE_NAMES[:1]
    pairs = ", ".join(
        f"struct({t} AS tree_id, double({x}) AS x, double({y}) AS y)"
        for t, (x, y) in enumerate(zip(FEATURE_NAMES, after, strict=True))
    )
    rows = matrix.selectExpr(f"inline(array({pairs}))")
    cuts = rows.groupBy("tree_id").agg(F.avg("x").alias("p"), (F.max("y") / 2).alias("q"))
    sizes = (
        rows.join(F.broadcast(cuts), "tree_id")
        .groupBy("tree_id", "p", "q")
        .agg(
            F.count_if(F.expr("x <= p")).alias("low"),
            F.count_if(F.expr("x > p AND y <= q")).alias("mid"),
            F.count_if(F.expr("x > p AND y > q")).alias("high"),
        )
    )

    def node(number, feature, threshold, left, right, size, depth):
        return (
            f"struct(tree_id, {number} AS node_id, {feature} AS feature, {threshold} AS threshold, {left} AS left, "
            f"{right} AS right, {size} AS size, {depth} AS depth)"
        )

    nodes = (
        node(0, "tree_id", "p", 1, 2, "low + mid + high", 0),
        node(1, -1, "0D", -1, -1, "low", 1),
        node(2, f"(tree_id + 1) % {len(FEATURE_NAMES)}", "q", 3, 4, "mid + high", 1),
        node(3, -1, "0D", -1, -1, "mid", 2),
        node(4, -1, "0D", -1, -1, "high", 2),
    )
    return sizes.selectExpr(f"inline(array({', '.join(nodes)}))")


def _average_path(n: str) -> str:
    n = f"CAST({n} AS DOUBLE)"
    return f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329e0) - 2 * ({n} - 1) / {n} WHEN {n} = 2 THEN 1e0 ELSE 0e0 END"


_N = len(FEATURE_NAMES)
_SCORED = f"""
mx AS (
  SELECT event_seq, CAST([hour(wall), CAST(isodow(wall) >= 6 AS BIGINT), CAST(action = 'FAILED_LOGIN' AS BIGINT),
    CAST(action = 'SUDO_COMMAND' AS BIGINT), {_VELOCITY}, distinct_ports] AS DOUBLE[]) AS x
  FROM ev JOIN pw USING (event_seq)),
pairs AS (SELECT CAST(t AS BIGINT) AS tree_id, x[t + 1] AS a, x[(t + 1) % {_N} + 1] AS b FROM mx, range({_N}) r(t)),
cuts AS (SELECT tree_id, avg(a) AS p, max(b) / 2 AS q FROM pairs GROUP BY tree_id),
sizes AS (
  SELECT tree_id, p, q, count(*) AS n, count(*) FILTER (a <= p) AS low, count(*) FILTER (a > p AND b <= q) AS mid,
    count(*) FILTER (a > p AND b > q) AS high
  FROM pairs JOIN cuts USING (tree_id) GROUP BY tree_id, p, q),
nodes(tree_id, node_id, feature, threshold, below, above, size, depth) AS (
  SELECT tree_id, 0, tree_id, p, 1, 2, n, 0 FROM sizes
  UNION ALL SELECT tree_id, 1, -1, 0, -1, -1, low, 1 FROM sizes
  UNION ALL SELECT tree_id, 2, (tree_id + 1) % {_N}, q, 3, 4, mid + high, 1 FROM sizes
  UNION ALL SELECT tree_id, 3, -1, 0, -1, -1, mid, 2 FROM sizes
  UNION ALL SELECT tree_id, 4, -1, 0, -1, -1, high, 2 FROM sizes),
vectors AS (SELECT DISTINCT x FROM mx),
walk(x, tree_id, node_id) AS (
  SELECT x, tree_id, 0 FROM vectors, sizes
  UNION ALL
  SELECT w.x, w.tree_id, CASE WHEN w.x[n.feature + 1] <= n.threshold THEN n.below ELSE n.above END
  FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.feature >= 0),
paths AS (
  SELECT w.x, sum(n.depth + {_average_path("n.size")}) / {_N} AS mean
  FROM walk w JOIN nodes n ON n.tree_id = w.tree_id AND n.node_id = w.node_id WHERE n.feature < 0 GROUP BY w.x),
scored AS (
  SELECT event_seq, x, pow(2e0, -mean / {_average_path("(SELECT max(n) FROM sizes)")}) AS score FROM mx JOIN paths USING (x)),
bound AS (SELECT quantile_cont(score, 0.95) AS threshold FROM scored)
"""


@query(
    "o33_newest_thousand",
    sql.with_ctes("SELECT event_seq, ts_us, source_ip, action FROM ev ORDER BY ts_us DESC, event_seq DESC LIMIT 1000"),
)
def o33(spark, sf):
    """A training set smaller than the table; the limit is the feature."""
    return training_set(sec_events(spark, sf), 1000).select("event_seq", us(), "source_ip", "action")


@query(
    "o37_fitted_trees",
    sql.with_ctes(
        f"""SELECT CAST(t AS BIGINT) AS tree_id, s AS root_rows, s AS leaf_rows, CAST(0 AS BIGINT) AS bad_splits,
  CAST(0 AS BIGINT) AS bad_cuts, CAST(0 AS BIGINT) AS bad_leaves
FROM range({TREES}) r(t), (SELECT CAST(least({SAMPLE}, count(*)) AS BIGINT) AS s FROM (SELECT 1 FROM ev LIMIT 10000)) WHERE s > 0"""
    ),
)
def o37(spark, sf):
    """What holds for each tree of a forest fitted on the newest events: rows of the sample at its root and in its leaves;
    splits whose two children don't part their rows; cuts outside the feature's range; leaves that lie too deep."""
    matrix = materialize(feature_matrix(training_set(sec_events(spark, sf)), CFG))
    nodes = materialize(fit_iforest(matrix))
    ends = ", ".join(f"struct({i} AS feature, double(min({f})) AS low, double(max({f})) AS high)" for i, f in enumerate(FEATURE_NAMES))
    ranges = matrix.selectExpr(f"array({ends}) AS r").selectExpr("inline(r)")
    inner = nodes.where("feature >= 0").join(F.broadcast(ranges), "feature", "left")
    inner = inner.selectExpr("*", "explode(array(left, right)) AS child")
    children = nodes.selectExpr("tree_id", "node_id AS child", "size AS child_size", "depth AS child_depth")
    splits = (
        inner.join(children, ["tree_id", "child"], "left")
        .groupBy("tree_id", "node_id", "size", "depth", "threshold", "low", "high")
        .agg(F.sum("child_size").alias("rows"), F.min("child_size").alias("least"), F.count_if(F.expr("child_depth = depth + 1")).alias("n"))
        .groupBy("tree_id")
        .agg(
            F.count_if(F.expr("NOT coalesce(rows = size AND least > 0 AND n = 2, false)")).alias("bad_splits"),
            F.count_if(F.expr("NOT coalesce(threshold >= low AND threshold < high, false)")).alias("bad_cuts"),
        )
    )
    deepest = (SAMPLE - 1).bit_length()
    trees = nodes.groupBy("tree_id").agg(
        F.sum(F.expr("CASE WHEN node_id = 0 THEN size END")).alias("root_rows"),
        F.sum(F.expr("CASE WHEN feature < 0 THEN size END")).alias("leaf_rows"),
        F.count_if(F.expr(f"feature < 0 AND (depth > {deepest} OR size < 1)")).alias("bad_leaves"),
    )
    told = trees.join(splits, "tree_id", "left").na.fill(0, ["bad_splits", "bad_cuts"])
    return told.select(F.col("tree_id").cast("bigint"), "root_rows", "leaf_rows", "bad_splits", "bad_cuts", "bad_leaves")


@query("o38_score_by_nodes", sql.with_ctes("SELECT event_seq, round(score, 9) AS score FROM scored", _PORTS_CTE, _SCORED))
def o38(spark, sf):
    """Scores of every event by a given node table."""
    matrix = _matrix(spark, sf)
    return score(matrix, given_forest(matrix)).select("event_seq", F.round("score", 9).alias("score"))


@query(
    "o39_predict_by_nodes",
    sql.with_ctes("SELECT event_seq, score > threshold AS is_outlier FROM scored, bound", _PORTS_CTE, _SCORED),
)
def o39(spark, sf):
    """Every event, with the mark of those above the threshold of a given forest."""
    matrix = _matrix(spark, sf)
    return predict(matrix, with_threshold(given_forest(matrix), matrix)).select("event_seq", "is_outlier")


@query(
    "o26_alerts_by_nodes",
    sql.with_ctes(
        """SELECT sha256('ml_behavioral_anomaly|' || source_ip || '|' || ts_us || '|' || event_seq) AS alert_id,
  'ml_behavioral_anomaly' AS rule_name, 'high' AS severity, source_ip, CAST(NULL AS VARCHAR) AS "user",
  'Machine Learning Anomaly: Activity from ' || source_ip || ' is highly unusual compared to the historical baseline. Action: '
    || action || ', Time: Hour ' || hour(wall) || '.' AS description,
  CAST(NULL AS VARCHAR) AS context, CAST(1 AS BIGINT) AS evidence_count, 'new' AS status, CAST(ts_us AS BIGINT) AS created_us,
  event_seq AS trigger_seq, CAST(x[5] AS BIGINT) AS velocity_60s, CAST(x[6] AS BIGINT) AS unique_ports_60s
FROM scored JOIN ev USING (event_seq), bound WHERE score > threshold AND source_ip IS NOT NULL""",
        _PORTS_CTE,
        _SCORED,
    ),
)
def o26(spark, sf):
    """Alerts of the outlier rule by a given forest, with the features that explain them."""
    matrix = _matrix(spark, sf)
    model = materialize(with_threshold(given_forest(matrix), matrix))
    found = materialize(anomaly_alerts(sec_events(spark, sf), model, CFG))
    f = F.col("metadata.features")
    why = found.select(
        "alert_id", f.velocity_60s.cast("bigint").alias("velocity_60s"), f.unique_ports_60s.cast("bigint").alias("unique_ports_60s")
    )
    return alert_view(found).join(why, "alert_id")
