"""Ranking-quality metrics and load/latency statistics.

Ranking metrics (per query, then macro-averaged):
  P@K   = relevant hits in the top K / K (K <= 0 -> 0)
  R@K   = relevant hits in the top K / |relevant| (no relevant -> 0)
  NDCG@K = DCG / IDCG with gain 2^g - 1 and discount log2(rank + 1); IDCG
          from the best K judged grades; IDCG 0 -> 0
  AP    = sum of precision at each relevant hit / |relevant|
Unjudged retrieved documents have grade 0; relevant means grade > 0.

Inputs are decomposed so relevance never needs a pair table:
  graded   (query_id, doc_id, rank, grade)  - the retrieved list with grades
  relevant (query_id, n_relevant)
  ideal    (query_id, ideal_rank, grade)    - top judged grades, ideal_rank <= max K
``rank_metrics`` builds them from an explicit qrels table; callers with
implicit relevance (e.g. label equality) build them from counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_KS = (1, 3, 5, 10)


def _gain(g):
    return F.pow(F.lit(2.0), g) - F.lit(1.0)


def _disc(r):
    return F.log2(r + F.lit(1.0))


def metrics_from_parts(queries: DataFrame, graded: DataFrame, relevant: DataFrame, ideal: DataFrame,
                       ks=DEFAULT_KS) -> DataFrame:
    """One row per query of ``queries`` (query_id): p/r/ndcg at each K and ap."""
    rel = (F.col("grade") > 0).cast("int")
    run = graded.withColumn("_rel", rel) \
                .withColumn("_cum", F.sum("_rel").over(
                    Window.partitionBy("query_id").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)))
    aggs = []
    for k in ks:
        aggs.append(F.sum(F.when(F.col("rank") <= k, F.col("_rel")).otherwise(0)).alias(f"_hits_{k}"))
        aggs.append(F.sum(F.when(F.col("rank") <= k, _gain(F.col("grade")) / _disc(F.col("rank")))
                          .otherwise(0.0)).alias(f"_dcg_{k}"))
    aggs.append(F.sum(F.when(F.col("_rel") == 1, F.col("_cum") / F.col("rank")).otherwise(0.0)).alias("_ap_sum"))
    per_q = run.groupBy("query_id").agg(*aggs)
    ideal_aggs = [F.sum(F.when(F.col("ideal_rank") <= k, _gain(F.col("grade")) / _disc(F.col("ideal_rank")))
                        .otherwise(0.0)).alias(f"_idcg_{k}") for k in ks]
    idl = ideal.groupBy("query_id").agg(*ideal_aggs)
    base = (queries.select("query_id").join(per_q, "query_id", "left")
                   .join(relevant, "query_id", "left").join(idl, "query_id", "left"))
    n_rel = F.coalesce(F.col("n_relevant"), F.lit(0))
    cols = ["query_id"]
    for k in ks:
        hits = F.coalesce(F.col(f"_hits_{k}"), F.lit(0))
        cols.append((hits / F.lit(float(k)) if k > 0 else F.lit(0.0)).alias(f"p_at_{k}"))
        cols.append(F.when(n_rel > 0, hits / n_rel).otherwise(0.0).alias(f"r_at_{k}"))
        idcg = F.coalesce(F.col(f"_idcg_{k}"), F.lit(0.0))
        cols.append(F.when(idcg > 0, F.coalesce(F.col(f"_dcg_{k}"), F.lit(0.0)) / idcg).otherwise(0.0)
                    .alias(f"ndcg_at_{k}"))
    cols.append(F.when(n_rel > 0, F.coalesce(F.col("_ap_sum"), F.lit(0.0)) / n_rel).otherwise(0.0).alias("ap"))
    return base.select(*cols)


def rank_metrics(queries: DataFrame, ranked: DataFrame, qrels: DataFrame, ks=DEFAULT_KS) -> DataFrame:
    """Metrics from an explicit ``qrels(query_id, doc_id, grade)`` table."""
    graded = ranked.join(qrels, ["query_id", "doc_id"], "left") \
                   .withColumn("grade", F.coalesce(F.col("grade"), F.lit(0)))
    relevant = qrels.where(F.col("grade") > 0).groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    kmax = max(ks)
    ideal = (qrels.withColumn("ideal_rank", F.row_number().over(
                 Window.partitionBy("query_id").orderBy(F.col("grade").desc(), F.col("doc_id"))))
                  .where(F.col("ideal_rank") <= kmax).select("query_id", "ideal_rank", "grade"))
    return metrics_from_parts(queries, graded, relevant, ideal, ks)


def macro_average(per_query: DataFrame) -> DataFrame:
    """Mean of every metric column over queries (one row)."""
    return per_query.agg(*[F.avg(c).alias(f"mean_{c}") for c in per_query.columns if c != "query_id"],
                         F.count(F.lit(1)).alias("n_queries"))


# ---------------------------------------------------------------------------
# Latency / load statistics
# ---------------------------------------------------------------------------

def exact_percentiles(values: DataFrame, by: str, value: str, ps: dict[str, float]) -> DataFrame:
    """Linearly interpolated percentiles per group, from counts of distinct
    values: partial counts shrink a hot group before the shuffle, and its
    running counts are a sorted, spillable window instead of one in-memory map."""
    n = values.where(F.col(value).isNotNull()).groupBy(by, F.col(value).alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    run = Window.partitionBy(by).orderBy("_v")
    n = n.withColumn("_to", F.sum("_n").over(run))
    total = n.groupBy(F.col(by).alias("_by")).agg(F.sum("_n").alias("_all"))
    n = n.join(total, F.col(by).eqNullSafe(F.col("_by")))
    at = {c: (F.col("_all") - 1) * F.lit(p) for c, p in ps.items()}
    ends = [F.min(F.when(F.col("_to") > f(x), F.col("_v"))).alias(f"_{c}{k}") for c, x in at.items() for k, f in enumerate((F.floor, F.ceil))]
    part = [F.first(x - F.floor(x)).alias(f"_{c}f") for c, x in at.items()]
    out = n.groupBy(by).agg(*ends, *part)
    return out.select(by, *[(F.col(f"_{c}0") + (F.col(f"_{c}1") - F.col(f"_{c}0")) * F.col(f"_{c}f")).alias(c) for c in ps])


def latency_summary(log: DataFrame, step_col: str = "step", status_col: str = "status",
                    latency_col: str = "latency_ms", step_seconds: float = 5.0,
                    p95_limit: float = 3000.0) -> DataFrame:
    """Per step: successes, errors, p95/p99 of successful latencies (linear
    interpolation; NULL without successes), rps = successes / step seconds,
    ``breached`` = p95 > limit, ``ramp_end`` = first breached step.

    Percentiles come from counts per distinct latency (``exact_percentiles``).
    """
    ok = F.col(status_col) == "ok"
    s = log.groupBy(step_col).agg(F.count_if(ok).alias("n_ok"), F.count_if(F.col(status_col) == "error").alias("n_error"))
    p = exact_percentiles(log.where(ok), step_col, latency_col, {"p95": 0.95, "p99": 0.99}).withColumnRenamed(step_col, "_step")
    s = s.join(p, F.col(step_col).eqNullSafe(F.col("_step")), "left").drop("_step")
    s = s.withColumn("rps", F.col("n_ok") / F.lit(float(step_seconds))) \
         .withColumn("breached", F.coalesce(F.col("p95") > p95_limit, F.lit(False)))
    ramp_end = s.where("breached").select(F.min(step_col)).scalar()
    return s.withColumn("ramp_end", ramp_end)


def latency_variability(log: DataFrame, by: str, latency_col: str = "latency_ms", max_cv: float = 0.5) -> DataFrame:
    """Per group: mean, population std, cv = std/mean, stable = cv < max_cv."""
    g = log.groupBy(by).agg(F.avg(latency_col).alias("mean"), F.stddev_pop(latency_col).alias("std"),
                            F.count(F.lit(1)).alias("n"))
    cv = F.try_divide(F.col("std"), F.col("mean"))
    return g.withColumn("cv", cv).withColumn("stable", F.coalesce(cv < max_cv, F.lit(False)))


def run_summary(log: DataFrame, by: str, ok_col: str = "ok", ts_col: str = "ts", value_col: str = "value") -> DataFrame:
    """Per group: tests, passed, failed, success_rate (% ; 0 with no tests),
    throughput (tests per second of the group's time span, NULL for a zero
    span) and growth_pct of ``value`` from first to last by time."""
    first = F.min_by(F.col(value_col), F.struct(ts_col, value_col))
    last = F.max_by(F.col(value_col), F.struct(ts_col, value_col))
    span = F.unix_micros(F.max(ts_col)) - F.unix_micros(F.min(ts_col))
    n = F.count(F.lit(1))
    passed = F.count_if(F.col(ok_col))
    return log.groupBy(by).agg(
        n.alias("tests"), passed.alias("passed"), (n - passed).alias("failed"),
        F.when(n > 0, 100.0 * passed / n).otherwise(0.0).alias("success_rate"),
        F.try_divide(n * F.lit(1e6), span).alias("throughput"),
        F.try_divide((last - first) * 100.0, first).alias("growth_pct"))


# ---------------------------------------------------------------------------
# Setup comparison and tool-call metrics
# ---------------------------------------------------------------------------

def quality_by_setup(results: DataFrame, setup: str = "setup", query: str = "query_id", rank: str = "rank",
                     relevant: str = "relevant", domain: str = "domain", min_relevant: int = 5,
                     top: int = 10) -> DataFrame:
    """Per setup: coverage = % of queries with >= ``min_relevant`` relevant
    results, diversity = mean number of distinct domains in each query's top
    ``top``. Two aggregation levels, both partial: per (setup, query), then
    per setup."""
    per_q = results.groupBy(setup, query).agg(
        F.count_if(F.col(relevant)).alias("_n_rel"),
        F.count_distinct(F.when(F.col(rank) <= top, F.col(domain))).alias("_domains"))
    return per_q.groupBy(setup).agg(
        (100.0 * F.avg((F.col("_n_rel") >= min_relevant).cast("double"))).alias("coverage_pct"),
        F.avg("_domains").alias("diversity"), F.count(F.lit(1)).alias("n_queries"))


def tool_metrics(log: DataFrame, tool: str = "tool", ok: str = "ok", latency: str = "latency_ms") -> DataFrame:
    """Per tool: calls, success rate and latency p50/p95 (exact, linear)."""
    calls = log.groupBy(tool).agg(F.count(F.lit(1)).alias("calls"), F.avg(F.col(ok).cast("double")).alias("success_rate"))
    p = exact_percentiles(log, tool, latency, {"p50_ms": 0.5, "p95_ms": 0.95}).withColumnRenamed(tool, "_tool")
    return calls.join(p, F.col(tool).eqNullSafe(F.col("_tool")), "left").drop("_tool")
