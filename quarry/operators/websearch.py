"""Web-result merging and search-log analysis.

merge_results: bag union of result lists in arrival order -> drop empty URLs
-> first arrival per normalised URL -> at most ``max_per_domain`` per domain
-> first ``max_sources`` per request. The greedy loop (URLs rejected by the
domain cap are not marked seen, but their domain stays full) accepts exactly
these rows, so three windowed ``row_number() <= n`` filters express it; each
plans a partial WindowGroupLimit, so a hot URL or domain is cut down inside
every map partition before anything is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import ABBREVIATIONS, FALLBACK_ENGINES, LAST_RESORT_ENGINE, WebConfig
from ..functions.url import normalize_url, url_domain

RESULT_SCHEMA = T.StructType([
    T.StructField("title", T.StringType()), T.StructField("url", T.StringType()),
    T.StructField("content", T.StringType()), T.StructField("engine", T.StringType()),
    T.StructField("published_date", T.StringType())])
RESPONSE_SCHEMA = T.StructType([T.StructField("results", T.ArrayType(RESULT_SCHEMA))])


# ---------------------------------------------------------------------------
# S3 / U0: landed responses -> result rows
# ---------------------------------------------------------------------------

def read_search_responses(responses: DataFrame, body_col: str = "body", max_results: int | None = None,
                          keep=("request_id", "query_pos")) -> DataFrame:
    """One row per result: ``*keep, result_pos, title, url, content, engine, published_date``.

    A body that does not parse, or has no ``results``, contributes no rows
    (the request is kept by callers through a left join if needed).
    """
    res = F.coalesce(F.from_json(F.col(body_col), RESPONSE_SCHEMA)["results"], F.array().cast(T.ArrayType(RESULT_SCHEMA)))
    if max_results is not None:
        res = F.slice(res, 1, max_results)
    return (responses.select(*keep, F.posexplode(res).alias("result_pos", "r"))
                     .select(*keep, "result_pos", "r.*"))


# ---------------------------------------------------------------------------
# W2 / K4 / P8 / F1 / F2
# ---------------------------------------------------------------------------

def with_url_keys(results: DataFrame, url_col: str = "url") -> DataFrame:
    return (results.withColumn("norm_url", normalize_url(url_col))
                   .withColumn("domain", url_domain("norm_url")))


def _with_req(df: DataFrame, request_col: str | None):
    """Single-request inputs get a constant request key (dropped again later)."""
    if request_col:
        return df, request_col
    return df.withColumn("_req", F.lit(0)), "_req"


def merge_results(results: DataFrame, max_sources: int | None = 10, max_per_domain: int = 2,
                  request_col: str | None = "request_id", arrival=("query_pos", "result_pos"),
                  url_col: str = "url") -> DataFrame:
    """Accepted results with ``norm_url``, ``domain`` and, when ``max_sources``
    is set, ``pos`` (1-based rank in arrival order)."""
    r, req = _with_req(results.where(F.coalesce(F.col(url_col), F.lit("")) != ""), request_col)
    order = [F.col(c).asc() for c in arrival]
    r = with_url_keys(r, url_col)
    first = r.withColumn("_u", F.row_number().over(Window.partitionBy(req, "norm_url").orderBy(*order))) \
             .where(F.col("_u") == 1)
    out = first.withColumn("_d", F.row_number().over(Window.partitionBy(req, "domain").orderBy(*order))) \
               .where(F.col("_d") <= max_per_domain)
    if max_sources is not None:
        out = out.withColumn("pos", F.row_number().over(Window.partitionBy(req).orderBy(*order))) \
                 .where(F.col("pos") <= max_sources)
    out = out.drop("_u", "_d")
    return out if request_col else out.drop("_req")


def dedup_stats(results: DataFrame, accepted: DataFrame, max_sources: int | None = 10,
                request_col: str | None = "request_id", arrival=("query_pos", "result_pos"),
                url_col: str = "url") -> DataFrame:
    """Per request: unique_urls, unique_domains, domain_distribution, duplicates.

    duplicates = rejected rows (URL repeat or domain cap) seen before the loop
    stopped: when ``max_sources`` was reached, only rows arriving before the
    last accepted one count. All inputs are aggregated per request first
    (partial aggregation), so the joins are between per-request rows.
    """
    res, req = _with_req(results, request_col)
    acc, _ = _with_req(accepted, request_col)
    key = F.struct(*[F.col(c) for c in arrival])
    per_dom = acc.groupBy(req, "domain").agg(F.count(F.lit(1)).alias("n"))
    summary = per_dom.groupBy(req).agg(
        F.sum("n").cast("long").alias("unique_urls"), F.count(F.lit(1)).alias("unique_domains"),
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("domain", "n")))).alias("domain_distribution"))
    cap = F.lit(max_sources if max_sources is not None else -1)
    last = acc.groupBy(req).agg(F.when(F.count(F.lit(1)) == cap, F.max(key)).alias("_stop"))
    nonempty = res.where(F.coalesce(F.col(url_col), F.lit("")) != "").select(req, key.alias("_k"))
    processed = (nonempty.join(last, req, "left")
                         .groupBy(req).agg(F.count_if(F.col("_stop").isNull() | (F.col("_k") <= F.col("_stop")))
                                           .alias("_processed")))
    out = (processed.join(summary, req, "left")
                    .select(req, F.coalesce("unique_urls", F.lit(0)).cast("long").alias("unique_urls"),
                            F.coalesce("unique_domains", F.lit(0)).cast("long").alias("unique_domains"),
                            "domain_distribution",
                            (F.col("_processed") - F.coalesce("unique_urls", F.lit(0))).cast("long").alias("duplicates")))
    return out if request_col else out.drop("_req")


# ---------------------------------------------------------------------------
# A10 / A11: client statistics, engine breakdown
# ---------------------------------------------------------------------------

def engine_breakdown(results: DataFrame, engine_col: str = "engine") -> DataFrame:
    return (results.groupBy(F.coalesce(F.col(engine_col), F.lit("unknown")).alias("engine"))
                   .agg(F.count(F.lit(1)).alias("results")))


def search_stats(search_log: DataFrame) -> DataFrame:
    """One row: total_queries, cache_hits, cache_misses, hit_rate_pct (NULL with
    no queries), total_results, simplified_queries. ``search_log`` has one
    row per request: from_cache, n_results (of the successful attempt, 0 if
    none), simplified."""
    total = F.count(F.lit(1))
    hits = F.count_if(F.col("from_cache"))
    return search_log.agg(
        total.alias("total_queries"), hits.alias("cache_hits"),
        (total - hits).alias("cache_misses"),
        F.round(F.try_divide(100.0 * hits, F.nullif(total, F.lit(0))), 6).alias("hit_rate_pct"),
        F.coalesce(F.sum(F.when(~F.col("from_cache"), F.col("n_results"))), F.lit(0)).cast("long").alias("total_results"),
        F.count_if(F.col("simplified")).alias("simplified_queries"))


# ---------------------------------------------------------------------------
# P9 / P10 / U0c: engine lists
# ---------------------------------------------------------------------------

def allowed_engines(preferred, banned) -> Column:
    """Preferred engines minus banned ones, order kept."""
    return F.filter(preferred, lambda e: ~F.array_contains(banned, e))


def fallback_engines(used, banned) -> Column:
    """First two of the safe list not used and not banned; else the last resort."""
    safe = F.array(*[F.lit(e) for e in FALLBACK_ENGINES])
    unused = F.filter(safe, lambda e: ~F.array_contains(used, e) & ~F.array_contains(banned, e))
    return F.when(F.size(unused) > 0, F.slice(unused, 1, 2)).otherwise(F.array(F.lit(LAST_RESORT_ENGINE)))


# ---------------------------------------------------------------------------
# P11: query simplification
# ---------------------------------------------------------------------------

_W = r"[\p{L}\p{N}_]"          # a word character as Python's Unicode \w sees it
_NB = rf"(?<!{_W})"              # word boundary before a word
_NA = rf"(?!{_W})"               # word boundary after a word


def simplify_query(q) -> Column:
    """Drop years 1900-2099 (whole words), expand the first abbreviation (in the
    fixed list order) present as a whole word, case-insensitively, first
    occurrence only, then squeeze whitespace."""
    from ..functions.text import collapse_ws
    s = F.regexp_replace(q if isinstance(q, Column) else F.col(q), rf"{_NB}(19|20)\p{{Nd}}{{2}}{_NA}", "")
    expr = None
    for abbr, full in ABBREVIATIONS:
        cond = s.rlike(rf"(?i){_NB}{abbr}{_NA}")
        repl = F.regexp_replace(s, rf"(?is)^(.*?){_NB}{abbr}{_NA}", rf"$1{full}")
        expr = F.when(cond, repl) if expr is None else expr.when(cond, repl)
    return collapse_ws(expr.otherwise(s))


# ---------------------------------------------------------------------------
# P12: retry plan over an attempt log
# ---------------------------------------------------------------------------

def retry_plan(attempts: DataFrame, max_retries: int = 3, banned=None) -> DataFrame:
    """For each attempt row (request_id, attempt 0-based, query, original_query,
    engines, n_results, status 'ok'|'empty'|'error'): what the next attempt
    does. Empty results -> next engines = fallback engines; on the
    second-to-last attempt the query is simplified once (if it changes);
    errors retry with the same query and engines; no next step after the
    last attempt or a success. ``suggestion`` = simplified original query
    when it differs, else NULL."""
    banned = banned if banned is not None else F.array().cast("array<string>")
    empty = F.col("status") == "empty"
    has_next = (F.col("status") != "ok") & (F.col("attempt") < max_retries - 1)
    simp = simplify_query(F.col("query"))
    do_simplify = empty & (F.col("attempt") == max_retries - 2) & (F.col("query") == F.col("original_query")) \
        & (simp != F.col("query"))
    orig_simp = simplify_query(F.col("original_query"))
    return attempts.select(
        "*",
        has_next.alias("retry"),
        F.when(has_next & empty, fallback_engines(F.col("engines"), banned))
         .when(has_next, F.col("engines")).alias("next_engines"),
        F.when(has_next & do_simplify, simp).when(has_next, F.col("query")).alias("next_query"),
        F.when(has_next, F.pow(F.lit(2), F.col("attempt")).cast("int")).alias("backoff_s"),
        F.when(orig_simp != F.col("original_query"), orig_simp).alias("suggestion"))


# ---------------------------------------------------------------------------
# P20: recency / category filter; S9: report lines
# ---------------------------------------------------------------------------

_RANGE_DAYS = {"day": 1, "week": 7, "month": 30, "year": 365}


def recency_filter(results: DataFrame, time_range: str = "any", now=None, date_col: str = "published_date",
                   category: str | None = None, category_col: str = "category") -> DataFrame:
    """Keep results published within ``time_range`` of ``now``; NULL dates are
    kept only for 'any'."""
    out = results
    if time_range != "any":
        now = now if now is not None else F.current_timestamp()
        out = out.where(F.to_timestamp(date_col) >= now - F.make_interval(days=F.lit(_RANGE_DAYS[time_range])))
    if category is not None:
        out = out.where(F.col(category_col) == category)
    return out


def report_lines(accepted: DataFrame, cfg: WebConfig = WebConfig(), request_col: str | None = "request_id") -> DataFrame:
    """Numbered report rows: pos, title, url, engine, first 150 chars of content."""
    req = [request_col] if request_col else []
    return accepted.select(*req, "pos", "title", "url", "engine",
                           F.substring("content", 1, cfg.report_chars).alias("snippet"))
