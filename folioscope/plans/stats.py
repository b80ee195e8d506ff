"""Queries for the statistics layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.operators import stats
from folioscope.plans.remap import RUNS, half_up, read, runs

def spearman_by_group(spark, sf_dir):
    return stats.spearman(runs(spark, sf_dir), "score", "fidelity", ["target_name"])


def ols_slope(spark, sf_dir):
    return stats.slopes(runs(spark, sf_dir), "score", "fidelity", ["target_name"])


def partial_spearman(spark, sf_dir):
    return stats.partial_spearman(runs(spark, sf_dir), "score", "fidelity", "cost_cents", ["target_name"])


def repeat_spread(spark, sf_dir):
    return stats.spread(runs(spark, sf_dir), "score", ["target_name", "page_key"])


def sign_flips(spark, sf_dir):
    """Whether scores differ from fidelity, by target."""
    rows = runs(spark, sf_dir).select("target_name", "run_id", (F.col("score") - F.col("fidelity")).alias("d"))
    return stats.sign_flips(rows, "d", ["target_name"], "run_id")


def permuted_correlation(spark, sf_dir):
    return stats.permutations(runs(spark, sf_dir), "score", "fidelity", ["target_name"], "run_id")


def priority_shares(spark, sf_dir):
    from folioscope.operators.views import shares

    return shares(read(spark, sf_dir, "orders"), "o_orderpriority")


RANK = lambda x: f"rank() OVER (PARTITION BY target_name ORDER BY {x}) + (count(*) OVER (PARTITION BY target_name, {x}) - 1) / 2 "
VAR = lambda x: f"(count(*) * sum({x} * {x}) - sum({x}) * sum({x}))"
COV = lambda x, y: f"(count(*) * sum({x} * {y}) - sum({x}) * sum({y}))"
PEARSON = lambda x, y: f"CASE WHEN count(*) > 1 AND {VAR(x)} > 0 AND {VAR(y)} > 0 THEN {COV(x, y)} / sqrt({VAR(x)} * {VAR(y)}) END"
SQL = {
    "sign_flips": f"""WITH {RUNS}, d AS (SELECT target_name, run_id, score - fidelity AS d FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL),
      w AS (SELECT target_name, count(*) AS n, {half_up('avg(d)', 4)} AS mean FROM d GROUP BY ALL),
      r AS (SELECT target_name, run_id, sign(d) AS sign, rank() OVER (PARTITION BY target_name ORDER BY abs(d)) + (count(*) OVER (PARTITION BY target_name, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0),
      o AS (SELECT target_name, abs(sum(sign * r)) AS observed FROM r GROUP BY ALL),
      s AS (SELECT target_name, draw, abs(sum(CASE WHEN md5(draw || ':' || run_id)[1] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN r ELSE -r END)) AS s FROM r, range(1, 201) t(draw) GROUP BY ALL)
      SELECT w.*, p FROM w LEFT JOIN (SELECT target_name, {half_up('(count(*) FILTER (s >= observed - 1e-9) + 1) / 201.0::DOUBLE', 4)} AS p FROM s JOIN o USING (target_name) GROUP BY target_name) USING (target_name)""",
    "permuted_correlation": f"""WITH {RUNS}, v AS (SELECT target_name, run_id, score, fidelity FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL),
      r AS (SELECT target_name, run_id, {", ".join(f"rank() OVER (PARTITION BY target_name ORDER BY {c}) + (count(*) OVER (PARTITION BY target_name, {c}) - 1) / 2.0::DOUBLE - (count(*) OVER (PARTITION BY target_name) + 1) / 2.0::DOUBLE AS {n}" for c, n in (("score", "rx"), ("fidelity", "ry")))} FROM v),
      o AS (SELECT target_name, count(*) AS n, {half_up('sum(rx * ry) / sqrt(sum(rx * rx) * sum(ry * ry))', 3)} AS rho, abs(sum(rx * ry)) AS observed FROM r GROUP BY ALL),
      d AS (SELECT target_name, draw, rx, ry, row_number() OVER (PARTITION BY target_name, draw ORDER BY run_id) AS i, row_number() OVER (PARTITION BY target_name, draw ORDER BY md5(draw || ':' || run_id), run_id) AS j FROM r, range(1, 201) t(draw)),
      s AS (SELECT a.target_name, a.draw, abs(sum(a.rx * b.ry)) AS s FROM d a JOIN d b ON a.target_name = b.target_name AND a.draw = b.draw AND a.i = b.j GROUP BY ALL)
      SELECT target_name, any_value(n) AS n, any_value(rho) AS rho, {half_up('(count(*) FILTER (s >= observed - 1e-9) + 1) / 201.0::DOUBLE', 4)} AS p FROM s JOIN o USING (target_name) GROUP BY target_name""",
    "spearman_by_group": f"WITH {RUNS}, r AS (SELECT target_name, ({RANK('score')})::DOUBLE AS rx, ({RANK('fidelity')})::DOUBLE AS ry FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL) SELECT target_name, count(*) AS n, {half_up(PEARSON('rx', 'ry'), 3)} AS rho FROM r GROUP BY target_name",
    "ols_slope": f"WITH {RUNS}, r AS (SELECT target_name, score::DOUBLE AS x, fidelity::DOUBLE AS y FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL), n AS (SELECT DISTINCT target_name FROM runs) SELECT target_name, {half_up(f'CASE WHEN {VAR('x')} > 0 THEN {COV('x', 'y')} / {VAR('x')} END', 3)} AS slope FROM n LEFT JOIN r USING (target_name) GROUP BY target_name",
    "partial_spearman": f"""WITH {RUNS}, r AS (SELECT target_name, ({RANK('score')})::DOUBLE AS a, ({RANK('fidelity')})::DOUBLE AS b, ({RANK('cost_cents')})::DOUBLE AS c FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL),
      p AS (SELECT target_name, {PEARSON('a', 'b')} AS xy, {PEARSON('a', 'c')} AS xz, {PEARSON('b', 'c')} AS yz FROM r GROUP BY target_name)
      SELECT target_name, {half_up('CASE WHEN (1 - xz * xz) * (1 - yz * yz) > 1e-12 THEN (xy - xz * yz) / sqrt((1 - xz * xz) * (1 - yz * yz)) END', 3)} AS rho FROM p""",
    "repeat_spread": f"WITH {RUNS} SELECT target_name, page_key, count(score) AS n, {half_up('avg(score)', 4)} AS mean, {half_up('CASE WHEN count(score) > 1 THEN stddev_samp(score) END', 4)} AS sd, max(score) - min(score) AS range FROM runs GROUP BY target_name, page_key",
    "priority_shares": f"SELECT o_orderpriority, count(*) AS n, {half_up('count(*)::DOUBLE / sum(count(*)) OVER ()', 4)} AS share FROM orders GROUP BY o_orderpriority",
}
QUERIES = [sign_flips, permuted_correlation, spearman_by_group, ols_slope, partial_spearman, repeat_spread, priority_shares]
