"""Queries on losses and metric logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cubespark.operators import logs, metrics
from cubespark.plans.cube import r
from cubespark.plans.registry import query
from cubespark.sources import adapters as a

NAMES = ["click", "error", "purchase", "signup", "view"]
E = "abs(prediction - target)"
HUBER = f"CASE WHEN {E} < 0.3 THEN 0.5 * {E} * {E} ELSE 0.3 * ({E} - 0.15) END"
NLL = "(0.5 * (ln(greatest(variance, 1e-6)) + (target - prediction) * (target - prediction) / greatest(variance, 1e-6)) + 0.5 * ln(2 * pi())) * power(greatest(variance, 1e-6), 0.5)"


@query("j8_pred_obs", "SELECT a.sample, a.step, round(a.prediction, 6) AS prediction, b.target FROM pred_obs a JOIN (SELECT sample, step, max(target) AS target FROM pred_obs GROUP BY 1, 2) b USING (sample, step)")
def j8(spark, sf_dir):
    rows = a.pred_obs(spark, sf_dir)
    obs = rows.groupBy("sample", "step").agg(F.max("target").alias("target"))
    return metrics.pred_obs(rows.select("sample", "step", "prediction"), obs, ["sample", "step"]).select("sample", "step", r("prediction"), "target")


def _both(df, kind):
    whole = metrics.masked_loss(df, kind).withColumn("reduction", F.lit("all"))
    return whole.unionByName(metrics.masked_loss(df, kind, "sample").withColumn("reduction", F.lit("sample_wise"))).withColumn("kind", F.lit(kind))


@query(
    "a8_masked_loss",
    " UNION ALL ".join(
        f"SELECT '{k}' AS kind, 'all' AS reduction, round(avg({e}), 6) AS loss FROM pred_obs WHERE target IS NOT NULL UNION ALL SELECT '{k}', 'sample_wise', round(avg(l), 6) FROM (SELECT avg({e}) AS l FROM pred_obs WHERE target IS NOT NULL GROUP BY sample)"
        for k, e in (("l1", E), ("l2", f"{E} * {E}"), ("huber", HUBER))
    ),
)
def a8(spark, sf_dir):
    df = a.pred_obs(spark, sf_dir)
    out = _both(df, "l1").unionByName(_both(df, "l2")).unionByName(_both(df, "huber"))
    return out.select("kind", "reduction", r("loss"))


@query("a9_beta_nll", f"SELECT round(avg({NLL}), 6) AS loss FROM pred_obs WHERE target IS NOT NULL")
def a9(spark, sf_dir):
    return metrics.beta_nll(a.pred_obs(spark, sf_dir)).select(r("loss"))


@query(
    "a10_nan_loss",
    f"SELECT 'element' AS reduction, round(sum({E} * variance) / sum(variance), 6) AS loss FROM pred_obs WHERE target IS NOT NULL UNION ALL SELECT 'batch', round(avg(l), 6) FROM (SELECT avg({E} * {E}) AS l FROM pred_obs WHERE target IS NOT NULL GROUP BY sample)",
)
def a10(spark, sf_dir):
    df = a.pred_obs(spark, sf_dir)
    one = metrics.nan_loss(df, "l1", "element", "sample", "variance").select(F.lit("element").alias("reduction"), r("loss"))
    return one.unionByName(metrics.nan_loss(df, "l2", "batch", "sample").select(F.lit("batch").alias("reduction"), r("loss")))


@query("a11_nan_mse_mae", f"SELECT sample, round(avg({E} * {E}), 8) AS mse, round(avg({E}), 8) AS mae FROM pred_obs GROUP BY 1")
def a11(spark, sf_dir):
    return metrics.nan_mse_mae(a.pred_obs(spark, sf_dir), ["sample"]).select("sample", r("mse", digits=8), r("mae", digits=8))


@query(
    "a12_step_losses",
    "WITH t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS rn FROM lineitem) WHERE rn <= 3), e AS (SELECT 'ts' AS kind, abs(l_extendedprice / 2000 - l_quantity) AS e FROM t UNION ALL SELECT 'msc', abs(l_tax * 100 - l_discount * 100) FROM t), m AS (SELECT kind, avg(e) AS loss FROM e GROUP BY 1) SELECT kind, round(loss, 6) AS loss FROM m UNION ALL SELECT 'sum', round(sum(loss), 6) FROM m",
)
def a12(spark, sf_dir):
    df = a.table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("sample"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("step"),
        (F.col("l_extendedprice") / 2000).alias("ts_hat"),
        F.col("l_quantity").alias("ts"),
        (F.col("l_tax") * 100).alias("msc_hat"),
        (F.col("l_discount") * 100).alias("msc"),
    )
    return metrics.step_losses(df, ["ts", "msc"], 3).select("kind", r("loss"))


@query("a13_epoch_mean", "SELECT trial, name, round(sum(value * (step + 1)) / sum(step + 1), 6) AS value FROM metric_log GROUP BY 1, 2")
def a13(spark, sf_dir):
    return metrics.epoch_mean(a.metric_log(spark, sf_dir).withColumn("n", F.col("step") + 1), ["trial", "name"], "value", "n").select("trial", "name", r("value"))


def deduped(spark, sf_dir):
    return logs.dedupe_keep_last(a.metric_log(spark, sf_dir), ["trial", "name", "step"], ["wall_time", "event_id"])


@query("w3_dedupe_keep_last", "SELECT trial, name, step, value FROM last_log")
def w3(spark, sf_dir):
    return deduped(spark, sf_dir).select("trial", "name", "step", "value")


@query("a21_pivot_metrics", "SELECT trial, step, " + ", ".join(f"max(CASE WHEN name = '{n}' THEN value END) AS {n}" for n in NAMES) + " FROM last_log GROUP BY 1, 2")
def a21(spark, sf_dir):
    return logs.pivot_metrics(deduped(spark, sf_dir), NAMES)


@query("f6_not_null", "SELECT trial, step, max(CASE WHEN name = 'error' THEN value END) AS error FROM last_log GROUP BY 1, 2 HAVING max(CASE WHEN name = 'error' THEN value END) IS NOT NULL")
def f6(spark, sf_dir):
    return logs.pivot_metrics(deduped(spark, sf_dir), NAMES).filter(F.col("error").isNotNull()).select("trial", "step", "error")


@query("t1_sort_by", "SELECT trial, name, step, strftime(wall_time, '%Y-%m-%d %H:%M:%S') AS wall_time, value FROM last_log ORDER BY trial, name, step")
def t1(spark, sf_dir):
    rows = deduped(spark, sf_dir).orderBy("trial", "name", "step")
    return rows.select("trial", "name", "step", F.date_format("wall_time", "yyyy-MM-dd HH:mm:ss").alias("wall_time"), "value")


@query("a20_best_trial", "SELECT trial, round(score, 6) AS score FROM (SELECT trial, min(value) AS score FROM metric_log WHERE name = 'error' GROUP BY 1) ORDER BY score, trial LIMIT 1")
def a20(spark, sf_dir):
    scores = a.metric_log(spark, sf_dir).filter("name = 'error'").groupBy("trial").agg(F.min("value").alias("score"))
    return logs.best_trial(scores).select("trial", r("score"))


@query("w7_best_so_far", "SELECT trial, name, step, value, min(value) OVER (PARTITION BY trial, name ORDER BY step ROWS UNBOUNDED PRECEDING) AS best FROM last_log")
def w7(spark, sf_dir):
    return logs.best_so_far(deduped(spark, sf_dir), ["trial", "name"], ["step"], "value").select("trial", "name", "step", "value", "best")


@query(
    "w7_early_stop_step",
    "WITH c AS (SELECT *, row_number() OVER w AS c, min(value) OVER (PARTITION BY trial, name ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prior FROM last_log WINDOW w AS (PARTITION BY trial, name ORDER BY step)), h AS (SELECT *, max(CASE WHEN prior IS NULL OR value < prior THEN c END) OVER (PARTITION BY trial, name ORDER BY step ROWS UNBOUNDED PRECEDING) AS hit FROM c), s AS (SELECT *, min(CASE WHEN c - hit >= 20 THEN c END) OVER (PARTITION BY trial, name) AS stop FROM h) SELECT trial, name, CAST(max(c) AS INTEGER) AS checks, CAST(max(hit) AS INTEGER) AS best_check, min(value) AS best, coalesce(CAST(max(stop) AS INTEGER), -1) AS stop_check FROM s WHERE stop IS NULL OR c <= stop GROUP BY 1, 2",
)
def w7_stop(spark, sf_dir):
    out = logs.early_stop_step(deduped(spark, sf_dir), ["trial", "name"], ["step"], "value")
    return out.select("trial", "name", "checks", "best_check", "best", F.coalesce("stop_check", F.lit(-1)).alias("stop_check"))


@query("u1_concat", "SELECT trial, name, count(*) AS n FROM (SELECT trial, name FROM metric_log WHERE trial < 3 UNION ALL SELECT trial, NULL FROM metric_log WHERE trial >= 3) GROUP BY 1, 2")
def u1(spark, sf_dir):
    rows = a.metric_log(spark, sf_dir)
    both = rows.filter("trial < 3").select("trial", "name").unionByName(rows.filter("trial >= 3").select("trial"), allowMissingColumns=True)
    return both.groupBy("trial", "name").agg(F.count("*").alias("n"))
