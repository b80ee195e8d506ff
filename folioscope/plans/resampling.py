"""Queries over seeded shuffles, bootstrap intervals, null distributions and the agreement of repeats."""

from __future__ import annotations

from pyspark.sql import functions as F

from folioscope.functions.draws import draw_sql, poisson_sql
from folioscope.operators import resampling, sampling, stats
from folioscope.plans.remap import RESULTS, RUNS, half_up, read, results, runs
from folioscope.plans.stats import SQL as STATS_SQL
from folioscope.plans.stats import permuted_correlation

SEED, DRAWS, RERANKED = 20260918, 200, 120
SECTION = "concat('s', CAST(s_nationkey AS STRING))"


def seeded_order(spark, sf_dir):
    """Customers of each nation in the order that a seeded shuffle gives their keys."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey")
    return sampling.seeded_shuffle(rows, ["c_nationkey"], ["c_custkey"], SEED)


def sections_sampled(spark, sf_dir):
    """Eighteen suppliers, two of a nation at most, by a seeded shuffle of suppliers and then of nations."""
    rows = read(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("page"), F.expr(SECTION).alias("section"))
    return sampling.spread_over_sections(rows, "section", ["page"], SEED, 18, 2).select("page", "section", F.col("pick").cast("long").alias("pick"))


def bootstrap_intervals(spark, sf_dir):
    return resampling.bootstrap(runs(spark, sf_dir), "score", "fidelity", ["target_name"], "run_id", "ranks", DRAWS)


def bootstrap_slopes(spark, sf_dir):
    return resampling.bootstrap(runs(spark, sf_dir), "score", "fidelity", ["target_name"], "run_id", "slope", DRAWS)


def bootstrap_reranked(spark, sf_dir):
    """Intervals whose draws are ranked anew, by kind of target; too few draws give none."""
    few = resampling.bootstrap(runs(spark, sf_dir), "score", "fidelity", ["target_type"], "run_id", "reranked", 99).select("target_type", F.col("low").isNull().alias("none_of_99"))
    return resampling.bootstrap(runs(spark, sf_dir), "score", "fidelity", ["target_type"], "run_id", "reranked", RERANKED).join(few, "target_type")


def seeded_intervals(spark, sf_dir):
    """Intervals of the correlation of balance and segment by nation, from draws of exactly as many customers by a seeded generator."""
    rows = read(spark, sf_dir, "customer").select("c_nationkey", "c_custkey", F.floor(F.col("c_acctbal") / 500).alias("x"), (F.col("c_custkey") * 7 % 31).alias("y"))
    return resampling.seeded_bootstrap(rows, "x", "y", ["c_nationkey"], "c_custkey", "ranks", 150)


def resampled_correlation(spark, sf_dir):
    """Rank correlations by target with a permutation p and a bootstrap interval."""
    return permuted_correlation(spark, sf_dir).join(bootstrap_intervals(spark, sf_dir).select("target_name", "low", "high"), "target_name")


def detectable_correlations(spark, sf_dir):
    """For each target the rank correlation that its number of measured runs can tell from chance."""
    sizes = runs(spark, sf_dir).where("score is not null and fidelity is not null").groupBy("target_name").agg(F.count("*").alias("n"))
    return sizes.join(resampling.detectable(sizes, "n", DRAWS), "n")


def label_reliability(spark, sf_dir):
    return stats.reliability(runs(spark, sf_dir).where("score is not null"), "score", "page_key", ["target_type"])


def repeat_reliability(spark, sf_dir):
    """How far repeated scores of a page agree, by kind of target; pages have different numbers of repeats."""
    return resampling.repeat_reliability(runs(spark, sf_dir), "score", "page_key", ["target_type"])


def attenuation(spark, sf_dir):
    """What a true correlation of 0.6 shrinks to by how far probes of a page and mode agree."""
    rows = resampling.repeat_reliability(results(spark, sf_dir).where("page_key % 5 > 0 or mode = 'web'"), "fidelity", "page_key", ["mode"])
    return resampling.attenuation(rows.withColumn("icc", F.greatest(F.col("icc"), F.lit(0.05))), "icc", [4, 6, 8, 10, 12]).select("mode", F.col("repeats").cast("long").alias("repeats"), "reliability", "observed_r")


def signed_rank(spark, sf_dir):
    """Whether a search lifts fidelity, by archetype: signed ranks of the difference of a page's means in both modes, in whole ten-thousandths, whose sums no order of rows changes."""
    means = results(spark, sf_dir).groupBy("archetype", "page_key").agg(*[F.avg(F.when(F.col("mode") == m, F.col("fidelity"))).alias(m) for m in ("web", "closed")])
    return stats.sign_flips(means.select("archetype", "page_key", F.floor((F.col("web") - F.col("closed")) * 10000 + 0.5).alias("d")), "d", ["archetype"], "page_key")


RANKED = """r AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY x) + (count(*) OVER (PARTITION BY {by}, x) - 1) / 2.0::DOUBLE AS rx, rank() OVER (PARTITION BY {by} ORDER BY y) + (count(*) OVER (PARTITION BY {by}, y) - 1) / 2.0::DOUBLE AS ry FROM v)"""
SUMS = lambda a, b, w: f"sum({w})::DOUBLE AS s1, sum({w} * {a})::DOUBLE AS sx, sum({w} * {b})::DOUBLE AS sy, sum({w} * {a} * {a})::DOUBLE AS sxx, sum({w} * {b} * {b})::DOUBLE AS syy, sum({w} * {a} * {b})::DOUBLE AS sxy"
XX, YY, XY = "(s1 * sxx - sx * sx)", "(s1 * syy - sy * sy)", "(s1 * sxy - sx * sy)"
R_OF, SLOPE_OF = f"CASE WHEN s1 > 1 AND {XX} > 0 AND {YY} > 0 THEN {XY} / sqrt({XX} * {YY}) END", f"CASE WHEN s1 > 1 AND {XX} > 0 THEN {XY} / {XX} END"


def bootstrap_sql(by: str, slope: bool = False, reranked: bool = False, draws: int = DRAWS) -> str:
    stat, (a, b) = (SLOPE_OF, "xy") if slope else (R_OF, ("rx", "ry"))
    weight = poisson_sql("md5(draw || ':' || run_id)")
    drawn = f"d AS (SELECT {by}, draw, x, y, rx, ry, {weight} AS w FROM r, range(1, {draws + 1}) t(draw))"
    if reranked:
        below = lambda c: f"sum(w) OVER (PARTITION BY {by}, draw ORDER BY {c}) - (sum(w) OVER (PARTITION BY {by}, draw, {c}) - 1) / 2.0::DOUBLE"
        drawn += f", e AS (SELECT {by}, draw, w, {below('x')} AS rx, {below('y')} AS ry FROM d WHERE w > 0)"
    return f"""WITH {RUNS}, v AS (SELECT {by}, run_id, score::DOUBLE AS x, fidelity::DOUBLE AS y FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL), {RANKED.format(by=by)},
      o AS (SELECT {by}, count(*) AS n, {SUMS(a, b, "1")} FROM r GROUP BY {by}), {drawn},
      s AS (SELECT {by}, draw, {SUMS(a, b, "w")} FROM {"e" if reranked else "d"} WHERE w > 0 GROUP BY {by}, draw), c AS (SELECT {by}, {stat} AS v FROM s),
      l AS (SELECT {by}, list_sort(list(v)) AS v FROM c WHERE v IS NOT NULL GROUP BY {by})
      SELECT o.{by}, n, {half_up(stat, 3)} AS estimate, coalesce(len(v), 0) AS valid, {half_up("CASE WHEN len(v) >= 100 THEN v[1 + floor(0.025::DOUBLE * len(v))::BIGINT] END", 3)} AS low,
        {half_up("CASE WHEN len(v) >= 100 THEN v[1 + least(len(v) - 1, floor(0.975::DOUBLE * len(v))::BIGINT)] END", 3)} AS high FROM o LEFT JOIN l USING ({by})"""


def shuffle_sql(name: str, rows: str, group: str, key: str, seed: int, skip: str = "0") -> str:
    """CTEs that end in `name` (group, key, place): swaps one after the other, from the last place to the first, on a list for each group."""
    numbered = f"SELECT {group}, {key}, row_number() OVER (PARTITION BY {group} ORDER BY {key}) - 1 AS i, count(*) OVER (PARTITION BY {group}) AS n FROM {rows}"
    return f"""{name}_b AS ({numbered}), {name}_u AS ({draw_sql(f"n - i + {skip}", seed, f"{name}_b", f"{group}, i")}), {name}_s AS (SELECT {group}, i, (u * (i + 1)) >> 32 AS j FROM {name}_u WHERE i > 0),
      {name}_w AS (SELECT {group}, max(i) AS i, list({key} ORDER BY i) AS a FROM {name}_b GROUP BY {group}
        UNION ALL SELECT w.{group}, w.i - 1, list_transform(range(len(a)), lambda k: CASE WHEN k = w.i THEN a[s.j + 1] WHEN k = s.j THEN a[w.i + 1] ELSE a[k + 1] END) FROM {name}_w w JOIN {name}_s s ON w.{group} = s.{group} AND w.i = s.i WHERE w.i > 0),
      {name} AS (SELECT {group}, unnest(a) AS {key}, generate_subscripts(a, 1) - 1 AS place FROM {name}_w WHERE i = 0)"""


RELIABILITY = """per AS (SELECT {by}, {unit}, count(*)::DOUBLE AS k, avg({value})::DOUBLE AS m, var_samp({value})::DOUBLE AS v, sum({value})::DOUBLE AS s, sum({value} * {value})::DOUBLE AS q FROM {rows} WHERE {value} IS NOT NULL GROUP BY {by}, {unit}),
  w AS (SELECT {by}, count(*) AS units, sqrt(avg(v) FILTER (k > 1)) AS w, stddev_samp(m) AS b, avg(k) AS k, sum(k) AS n, sum(k * k) AS kk, sum(s) AS s, sum(q) AS q, sum(s * s / k) AS sk FROM per GROUP BY {by}),
  i AS (SELECT *, greatest(0.0::DOUBLE, b * b - w * w / k) AS own, (sk - s * s / n) / nullif(units - 1, 0) AS msb, (q - sk) / nullif(n - units, 0) AS msw, (n - kk / n) / nullif(units - 1, 0) AS k0 FROM w),
  icc AS (SELECT {by}, units, w, b, k, CASE WHEN own + w * w > 0 THEN own / (own + w * w) END AS icc, CASE WHEN msb + (k0 - 1) * msw > 1e-9 THEN (msb - msw) / (msb + (k0 - 1) * msw) END AS anova FROM i)"""
SQL = {
    "seeded_order": f"WITH RECURSIVE {shuffle_sql('shuffled', 'customer', 'c_nationkey', 'c_custkey', SEED)} SELECT c_nationkey, c_custkey, place FROM shuffled",
    "sections_sampled": f"""WITH RECURSIVE p AS (SELECT 1 AS g, s_suppkey AS page FROM supplier), {shuffle_sql('x', 'p', 'g', 'page', SEED)},
      y AS (SELECT page, place, 's' || s_nationkey AS section FROM x JOIN supplier ON page = s_suppkey), f AS (SELECT 1 AS g, min(place) AS up FROM y GROUP BY section),
      {shuffle_sql('z', 'f', 'g', 'up', SEED, '(SELECT count(*) - 1 FROM supplier)')}, m AS (SELECT section, min(place) AS up FROM y GROUP BY section), n AS (SELECT section, place AS nth FROM m JOIN z USING (up)),
      t AS (SELECT page, section, nth, row_number() OVER (PARTITION BY section ORDER BY y.place) AS turn FROM y JOIN n USING (section))
      SELECT page, section, row_number() OVER (ORDER BY turn, nth) AS pick FROM t WHERE turn <= 2 QUALIFY pick <= 18""",
    "bootstrap_intervals": bootstrap_sql("target_name"),
    "bootstrap_slopes": bootstrap_sql("target_name", slope=True),
    "bootstrap_reranked": f"SELECT *, true AS none_of_99 FROM ({bootstrap_sql('target_type', reranked=True, draws=RERANKED)})",
    "seeded_intervals": f"""WITH v AS (SELECT c_nationkey, c_custkey, floor(c_acctbal / 500) AS x, c_custkey * 7 % 31 AS y FROM customer), {RANKED.format(by="c_nationkey")},
      m AS (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) - 1 AS i FROM r), o AS (SELECT c_nationkey, count(*) AS n, {SUMS("rx", "ry", "1")} FROM r GROUP BY c_nationkey),
      k AS (SELECT c_nationkey, n, draw, slot, draw * n + slot AS nth FROM o, range(150) t(draw), range(1, n + 1) q(slot)), u AS ({draw_sql("nth", 11, "k", "c_nationkey, n, draw, slot")}),
      d AS (SELECT u.c_nationkey, draw, rx, ry FROM u JOIN m ON u.c_nationkey = m.c_nationkey AND m.i = (u * n) >> 32),
      s AS (SELECT c_nationkey, draw, {SUMS("rx", "ry", "1")} FROM d GROUP BY ALL), c AS (SELECT c_nationkey, {R_OF} AS v FROM s), l AS (SELECT c_nationkey, list_sort(list(v)) AS v FROM c WHERE v IS NOT NULL GROUP BY ALL)
      SELECT o.c_nationkey, n, {half_up(R_OF, 3)} AS estimate, coalesce(len(v), 0) AS valid, {half_up("CASE WHEN len(v) >= 100 THEN v[1 + floor(0.025::DOUBLE * len(v))::BIGINT] END", 3)} AS low,
        {half_up("CASE WHEN len(v) >= 100 THEN v[1 + least(len(v) - 1, floor(0.975::DOUBLE * len(v))::BIGINT)] END", 3)} AS high FROM o LEFT JOIN l USING (c_nationkey)""",
    "resampled_correlation": f"SELECT * FROM ({STATS_SQL['permuted_correlation']}) JOIN (SELECT target_name, low, high FROM ({bootstrap_sql('target_name')})) USING (target_name)",
    "detectable_correlations": f"""WITH {RUNS}, z AS (SELECT target_name, count(*) AS n FROM runs WHERE score IS NOT NULL AND fidelity IS NOT NULL GROUP BY ALL), e AS (SELECT DISTINCT n FROM z WHERE n > 1),
      p AS (SELECT n, draw, i, row_number() OVER (PARTITION BY n, draw ORDER BY md5(draw || ':' || n || ':' || i), i) AS j FROM e, range(1, {DRAWS + 1}) t(draw), range(1, n + 1) k(i)),
      r AS (SELECT n, abs(1 - 6.0::DOUBLE * sum((i - j) * (i - j)) / (n * (n * n - 1))) AS r FROM p GROUP BY n, draw), l AS (SELECT n, list_sort(list(r)) AS v FROM r GROUP BY n)
      SELECT z.n, target_name, {half_up(f'v[1 + floor({1 - 0.05}::DOUBLE * len(v))::BIGINT]', 3)} AS detectable FROM z LEFT JOIN l USING (n)""",
    "label_reliability": f"""WITH {RUNS}, per AS (SELECT target_type, page_key, count(*) AS k, avg(score) AS m, var_samp(score) AS v FROM runs WHERE score IS NOT NULL GROUP BY ALL), w AS (SELECT target_type, avg(k) AS k, var_samp(m) AS vm, avg(v) AS w FROM per GROUP BY ALL)
      SELECT target_type, {half_up('CASE WHEN k * vm + (k - 1) * w > 0 THEN (k * vm - w) / (k * vm + (k - 1) * w) END', 3)} AS icc FROM w""",
    "repeat_reliability": f"WITH {RUNS}, {RELIABILITY.format(by='target_type', unit='page_key', value='score', rows='runs')} SELECT target_type, units, {half_up('w', 3)} AS within_sd, {half_up('b', 3)} AS between_sd, {half_up('k', 3)} AS k, {half_up('icc', 3)} AS icc, {half_up('anova', 3)} AS icc_anova FROM icc",
    "attenuation": f"""WITH {RESULTS}, part_of AS (SELECT * FROM results WHERE page_key % 5 > 0 OR mode = 'web'), {RELIABILITY.format(by='mode', unit='page_key', value='fidelity', rows='part_of')},
      a AS (SELECT mode, repeats, repeats * r / (1 + (repeats - 1) * r) AS rel FROM (SELECT mode, greatest({half_up('icc', 3)}, 0.05::DOUBLE) AS r FROM icc), (VALUES (4), (6), (8), (10), (12)) t(repeats))
      SELECT mode, repeats, {half_up('rel', 3)} AS reliability, {half_up('0.6::DOUBLE * sqrt(rel)', 2)} AS observed_r FROM a""",
    "signed_rank": f"""WITH {RESULTS}, m AS (SELECT archetype, page_key, avg(fidelity) FILTER (mode = 'web') AS w, avg(fidelity) FILTER (mode = 'closed') AS c FROM results GROUP BY ALL), d AS (SELECT archetype, page_key, floor((w - c) * 10000 + 0.5::DOUBLE)::BIGINT AS d FROM m WHERE w IS NOT NULL AND c IS NOT NULL),
      w AS (SELECT archetype, count(*) AS n, {half_up('avg(d)', 4)} AS mean FROM d GROUP BY ALL),
      r AS (SELECT archetype, page_key, sign(d) AS sign, rank() OVER (PARTITION BY archetype ORDER BY abs(d)) + (count(*) OVER (PARTITION BY archetype, abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0),
      o AS (SELECT archetype, abs(sum(sign * r)) AS observed FROM r GROUP BY ALL),
      s AS (SELECT archetype, draw, abs(sum(CASE WHEN md5(draw || ':' || page_key)[1] IN ('0', '2', '4', '6', '8', 'a', 'c', 'e') THEN r ELSE -r END)) AS s FROM r, range(1, 201) t(draw) GROUP BY ALL)
      SELECT w.*, p FROM w LEFT JOIN (SELECT archetype, {half_up('(count(*) FILTER (s >= observed - 1e-9) + 1) / 201.0::DOUBLE', 4)} AS p FROM s JOIN o USING (archetype) GROUP BY archetype) USING (archetype)""",
}
QUERIES = [seeded_order, sections_sampled, bootstrap_intervals, bootstrap_slopes, bootstrap_reranked, seeded_intervals, resampled_correlation, detectable_correlations, label_reliability, repeat_reliability, attenuation, signed_rank]
