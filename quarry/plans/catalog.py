"""Registered queries: name -> callable(spark, sf_dir) -> DataFrame.

Every query reads the driver tables (whole tables, whole texts) and lets
its work grow with them. Computed columns carry the same names as the
matching SQL in ``plans/oracle.py``; doubles are rounded to 6 places on
both sides.
"""

from __future__ import annotations

from collections.abc import Callable

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import FINAL_CHANNEL_MARKER, IndexConfig, SearchConfig, WebConfig
from ..functions.text import tokens
from ..operators import cache as cache_ops
from ..operators import context as ctx
from ..operators import evaluate as ev
from ..operators import hygiene as hyg
from ..operators import indexing as idx
from ..operators import latent
from ..operators import lemma as lem
from ..operators import memory as mem
from ..operators import websearch as web
from ..operators.chunking import chunk_documents, with_chunk_ids
from ..operators.dense import dense_topk, dense_topk_ivf
from ..operators.fusion import rrf_fuse
from ..operators.neardup import semantic_dedup
from ..operators.streak import error_streak
from ..operators.impacts import pruned_topk
from ..operators.tfidf import fit_rows, fit_tfidf, pad_zero, postings_of
from ..session import cut_lineage, ensure_checkpoint_dir
from ..sources.corpus import decode_files, scan_corpus
from ..sources.tables import read_table, table_path
from ..streaming import rate as rate_ops
from ..streaming.index import start_index_stream
from ..streaming.sources import landed, landed_stream, run_to_files
from ..streaming.state import breaker_stream, error_streak_stream, first_seen_capped_stream
from .hybrid import envelope, hybrid_search, retrieve, semantic_hits, stored_index

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


# ---------------------------------------------------------------------------
# shared inputs
# ---------------------------------------------------------------------------

def corpus_chunks(spark: SparkSession, sf_dir: str, cfg: IndexConfig = IndexConfig()) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return with_chunk_ids(chunk_documents(docs, "text", ("doc_id",), cfg), ("doc_id",))


def benchmark_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole benchmark passages as query texts, keyed by item id."""
    return read_table(spark, sf_dir, "benchmark", "item_id", "text") \
        .select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


def search_index(spark: SparkSession, sf_dir: str) -> dict:
    """The stored index of the corpus that all search queries share."""
    return stored_index(spark.read.parquet(table_path(sf_dir, "documents")), lambda: corpus_chunks(spark, sf_dir))


# ---------------------------------------------------------------------------
# corpus: chunking, tf-idf
# ---------------------------------------------------------------------------

@register("chunk_documents")
def q_chunk_documents(spark, sf_dir):
    c = corpus_chunks(spark, sf_dir)
    return c.select("doc_id", F.col("chunk_index").cast("long").alias("chunk_index"), "chunk_id",
                    "chunk_text", F.length("chunk_text").cast("long").alias("n_chars"))


@register("tfidf_weights")
def q_tfidf_weights(spark, sf_dir):
    rows, _ = fit_rows(corpus_chunks(spark, sf_dir), "chunk_id", "chunk_text")
    return postings_of(rows).select("chunk_id", "term", "tf", "df", F.round("idf", 6).alias("idf"), F.round("weight", 6).alias("weight"))


@register("tfidf_topk")
def q_tfidf_topk(spark, sf_dir):
    """Block-maximum pruned search over the stored index."""
    ix = search_index(spark, sf_dir)
    hits = pruned_topk(benchmark_queries(spark, sf_dir), ix["postings"], ix["placed"], ix["term_stats"], k=SearchConfig().top_k_lexical)
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"),
                       F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# dense search, fusion, rerank: the hybrid flagship
# ---------------------------------------------------------------------------

@register("dense_topk")
def q_dense_topk(spark, sf_dir):
    """Exact cosine top-50 of every stored vector against the whole collection."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    r = dense_topk(e.withColumnRenamed("vec_id", "query_id"), e, k=SearchConfig().top_k_dense)
    return r.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                    F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


@register("dense_topk_ivf")
def q_dense_topk_ivf(spark, sf_dir):
    """The same over k-means cells that are skipped by bounds: equally exact."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    r = dense_topk_ivf(e.withColumnRenamed("vec_id", "query_id"), e, k=SearchConfig().top_k_dense)
    return r.select("query_id", "vec_id", F.col("rank").cast("long").alias("rank"),
                    F.round("score", 6).alias("score"), F.round("distance", 6).alias("distance"))


def hybrid_inputs(spark, sf_dir):
    ix = search_index(spark, sf_dir)
    return benchmark_queries(spark, sf_dir), ix["chunks"], ix["postings"], ix["term_stats"], ix["vectors"], ix["placed"]


@register("dense_chunks_topk")
def q_dense_chunks_topk(spark, sf_dir):
    """Dense retriever of the hybrid path: hashed-embedding cosine top-50 over chunks."""
    hits = semantic_hits(benchmark_queries(spark, sf_dir), search_index(spark, sf_dir)["vectors"])
    return hits.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"),
                       F.round("score", 6).alias("score"))


@register("rrf_fuse")
def q_rrf_fuse(spark, sf_dir):
    q, chunks, postings, stats, vecs, placed = hybrid_inputs(spark, sf_dir)
    cfg = SearchConfig()
    fused = rrf_fuse(retrieve(q, chunks, postings, stats, vecs, cfg, placed=placed), "chunk_id", cfg.rrf_k, cfg.fused_limit)
    return fused.select("query_id", "chunk_id", F.col("fused_rank").cast("long").alias("fused_rank"),
                        F.round("rrf_score", 6).alias("rrf_score"), "search_type",
                        F.array_join("sources", ",").alias("sources"),
                        F.col("bm25_rank").cast("long").alias("bm25_rank"),
                        F.col("semantic_rank").cast("long").alias("semantic_rank"))


def _hybrid_final(spark, sf_dir):
    q, chunks, postings, stats, vecs, placed = hybrid_inputs(spark, sf_dir)
    return hybrid_search(q, chunks, postings, stats, vecs, placed=placed)


@register("hybrid_search")
def q_hybrid_search(spark, sf_dir):
    r = _hybrid_final(spark, sf_dir)
    return r.select("query_id", F.col("final_rank").cast("long").alias("final_rank"), "chunk_id", "doc_id",
                    "search_type", F.array_join("sources", ",").alias("sources"),
                    F.round("rrf_score", 6).alias("rrf_score"), F.round("bm25_score", 6).alias("bm25_score"),
                    F.round("rerank_score_base", 6).alias("rerank_score_base"), "has_exact_match",
                    F.round("rerank_score", 6).alias("rerank_score"))


def fresh_documents(spark, sf_dir):
    """One fresh document a query: the text of the page of the same number."""
    p = ctx.page_text(read_table(spark, sf_dir, "pages", "page_id", "html"))
    q = benchmark_queries(spark, sf_dir).select("query_id")
    return (p.select(F.col("page_id").alias("query_id"), F.lit(1).alias("fresh_pos"), "text").join(q, "query_id", "left_semi"))


@register("hybrid_envelope")
def q_hybrid_envelope(spark, sf_dir):
    """Whole answers, fresh documents included; both lists are retrieved once."""
    q, chunks, postings, stats, vecs, placed = hybrid_inputs(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/hits-{uuid.uuid4().hex}"
    found = retrieve(q, chunks, postings, stats, vecs, placed=placed)
    found.write.parquet(path)
    hits = spark.read.schema(found.schema).parquet(path)
    fresh = fresh_documents(spark, sf_dir)
    final = hybrid_search(q, chunks, postings, stats, vecs, fresh=fresh, hits=hits)
    e = envelope(q, hits, final, fresh)
    shown = F.transform("results", lambda r: F.concat(r["final_rank"].cast("string"), F.lit(":"), r["search_type"]))
    return e.select("query_id", "query", "bm25_count", "semantic_count", "fresh_count", "total", "result_ids", F.array_join(shown, ",").alias("results"))


@register("rerank_fallback")
def q_rerank_fallback(spark, sf_dir):
    """Without a pair scorer the lexical score decides."""
    q, chunks, postings, stats, vecs, placed = hybrid_inputs(spark, sf_dir)
    r = hybrid_search(q, chunks, postings, stats, vecs, scorer=None, placed=placed)
    return r.select("query_id", F.col("final_rank").cast("long").alias("final_rank"), "chunk_id", "search_type", F.round("bm25_score", 6).alias("bm25_score"))


FLAGSHIP = "hybrid_search"


# ---------------------------------------------------------------------------
# web results: URL normalisation, de-dup + domain cap, page text, context
# ---------------------------------------------------------------------------



# Landed pages per search request: page_id // this is the request.
PAGES_PER_REQUEST = 20


def page_results(spark, sf_dir):
    """Pages as the landed results of many requests, arrival order = page_id."""
    p = read_table(spark, sf_dir, "pages", "page_id", "url")
    return p.withColumn("request_id", F.floor(F.col("page_id") / PAGES_PER_REQUEST).cast("long"))


@register("url_normalize")
def q_url_normalize(spark, sf_dir):
    p = web.with_url_keys(page_results(spark, sf_dir))
    return p.select("page_id", "norm_url", "domain")


@register("url_dedup_domain_cap")
def q_url_dedup_domain_cap(spark, sf_dir):
    acc = web.merge_results(page_results(spark, sf_dir), max_sources=WebConfig().max_sources, arrival=("page_id",))
    return acc.select("request_id", "page_id", "norm_url", "domain", F.col("pos").cast("long").alias("pos"))


@register("url_dedup_all")
def q_url_dedup_all(spark, sf_dir):
    acc = web.merge_results(page_results(spark, sf_dir), max_sources=None, request_col=None, arrival=("page_id",))
    return acc.select("page_id", "norm_url", "domain")


@register("dedup_stats")
def q_dedup_stats(spark, sf_dir):
    res = page_results(spark, sf_dir)
    n = WebConfig().max_sources
    acc = web.merge_results(res, max_sources=n, arrival=("page_id",))
    st = web.dedup_stats(res, acc, max_sources=n, arrival=("page_id",))
    dist = F.array_join(F.transform(F.map_entries("domain_distribution"),
                                    lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ",")
    return st.select("request_id", "unique_urls", "unique_domains", "duplicates", dist.alias("domain_distribution"))


@register("page_text")
def q_page_text(spark, sf_dir):
    p = ctx.page_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))
    return p.select("page_id", "url", "title", "text", F.length("text").cast("long").alias("n_chars"))


def _web_candidates(spark, sf_dir):
    """Candidates of each request; pages are cleaned only for those."""
    acc = web.merge_results(page_results(spark, sf_dir), max_sources=WebConfig().candidate_limit, arrival=("page_id",))
    pages = read_table(spark, sf_dir, "pages", "page_id", "url", "html")
    chosen = pages.join(acc.select("page_id"), "page_id", "left_semi")
    meta = ctx.page_text(chosen.select("page_id", "html")).select("page_id", "title", F.col("text").alias("content"))
    return ctx.candidates(acc.join(meta, "page_id", "left"), "request_id", "pos"), pages


@register("candidate_prompt")
def q_candidate_prompt(spark, sf_dir):
    cands, _ = _web_candidates(spark, sf_dir)
    return ctx.render_candidates(cands)


def model_responses(cands, conversations_df):
    """A model's answer per request: the assistant turns of the conversation of
    that number, behind the final-channel marker, with a list of chosen ids.
    Ids follow from the text's length, so some are no candidate's."""
    said = (conversations_df.where(F.col("role") == "assistant").groupBy(F.col("conv_id").alias("request_id"))
            .agg(F.min_by("text", "turn").alias("said")))
    n = F.length("said")
    picked = F.array_join(F.array(*[(F.floor(n / d) % 25).cast("string") for d in (1, 3, 7, 19)]), ", ")
    text = F.concat(F.lit("[99] thinking "), F.substring("said", 1, 40), F.lit(FINAL_CHANNEL_MARKER), F.lit("  Best: ["), picked, F.lit("] "))
    return cands.select("request_id").distinct().join(said, "request_id").select("request_id", text.alias("text"))


def _selected(spark, sf_dir):
    cands, pages = _web_candidates(spark, sf_dir)
    responses = model_responses(cands, conversations(spark, sf_dir))
    return cands, pages, responses, ctx.valid_selection(cands, responses)


@register("selection")
def q_selection(spark, sf_dir):
    """Ids chosen by the answers that are candidates, in the answers' order."""
    *_, sel = _selected(spark, sf_dir)
    return sel.select("request_id", F.col("sel_pos").cast("long").alias("sel_pos"), F.col("id").cast("long").alias("id"))


@register("web_context")
def q_web_context(spark, sf_dir):
    """Chosen candidates: page join, text extraction, numbered context."""
    cands, pages, _, sel = _selected(spark, sf_dir)
    chosen = ctx.select_results(cands, sel)
    # the page of a url is its first landing
    near = pages.join(chosen.select("url").distinct(), "url", "left_semi")
    first = near.groupBy("url").agg(F.min_by("html", "page_id").alias("html"))
    docs = ctx.extract_pages(chosen, first)
    return ctx.pack_context(docs).select("request_id", F.col("n_sources").cast("long").alias("n_sources"), "context")


@register("report")
def q_report(spark, sf_dir):
    """Report rows of each request over its accepted results."""
    acc = web.merge_results(page_results(spark, sf_dir), max_sources=WebConfig().max_sources, arrival=("page_id",))
    meta = read_table(spark, sf_dir, "pages", "page_id", "html").join(acc.select("page_id"), "page_id", "left_semi")
    meta = meta.select("page_id", ctx.html_title("html").alias("title"), ctx.html_main_text("html").alias("content"), F.lit("pages").alias("engine"))
    out = web.report_lines(acc.join(meta, "page_id"))
    return out.select("request_id", F.col("pos").cast("long").alias("pos"), "title", "url", "engine", "snippet")


# ---------------------------------------------------------------------------
# landed responses, search log, retries (derived from pages and events)
# ---------------------------------------------------------------------------


def search_bodies(spark, sf_dir):
    """One JSON body per request and query (a request has several), with the
    results that landed for it; a request whose number of pages is incomplete
    has a body that does not parse."""
    p = page_results(spark, sf_dir).withColumn("query_pos", F.floor(F.col("page_id") % PAGES_PER_REQUEST / 5).cast("int"))
    host = url_host("url")
    result = F.struct(F.concat(F.lit("page "), F.col("page_id").cast("string")).alias("title"), F.col("url").alias("url"),
                      F.concat(F.lit("about "), host).alias("content"), F.when(host.endswith(".com"), F.lit("brave")).alias("engine"),
                      F.lit(None).cast("string").alias("published_date"))
    body = F.to_json(F.struct(F.transform(F.array_sort(F.collect_list(F.struct("page_id", result.alias("r")))), lambda x: x["r"]).alias("results")))
    return (p.groupBy("request_id", "query_pos").agg(body.alias("body"), F.count(F.lit(1)).alias("n"))
             .withColumn("body", F.when(F.col("n") < 5, F.concat(F.lit("<html>"), F.col("body"))).otherwise(F.col("body"))).drop("n"))


def url_host(url):
    return F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)


@register("search_responses")
def q_search_responses(spark, sf_dir):
    """Parsed results of all bodies; a failed query keeps a row and its error."""
    bodies = search_bodies(spark, sf_dir)
    rows = web.read_search_responses(bodies, "body", max_results=4)
    out = bodies.select("request_id", "query_pos").join(rows, ["request_id", "query_pos"], "left")
    return out.select("request_id", F.col("query_pos").cast("long").alias("query_pos"), F.col("result_pos").cast("long").alias("result_pos"),
                      "title", "url", "content", "engine", F.when(F.col("result_pos").isNull(), F.lit("no results")).alias("error"))


@register("engine_breakdown")
def q_engine_breakdown(spark, sf_dir):
    rows = web.read_search_responses(search_bodies(spark, sf_dir), "body")
    return web.engine_breakdown(rows)


def search_log(spark, sf_dir):
    """events as searches: a user's search of the same kind within an hour
    before makes it a cache hit, errors find nothing, the value is the number
    of results."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    w = Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")
    gap = (F.unix_micros(F.col("ts").cast("timestamp")) - F.unix_micros(F.lag("ts").over(w).cast("timestamp"))) / 1e6
    return e.select("event_id", "user_id", "event_type", "props", F.coalesce(gap <= WebConfig().cache_ttl_seconds, F.lit(False)).alias("from_cache"),
                    F.when(F.col("event_type") == "error", 0).otherwise(F.floor("value")).cast("int").alias("n_results"),
                    (F.col("value") > 50).alias("simplified"))


@register("search_stats")
def q_search_stats(spark, sf_dir):
    return web.search_stats(search_log(spark, sf_dir))


def attempts(spark, sf_dir):
    """events as search attempts: up to three for a user's request; errors
    fail, values under 5 are empty answers."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    k = F.get_json_object("props", "$.k").cast("int")
    query = F.concat(F.lit("best RAG "), F.col("event_type"), F.when(k < 50, F.concat(F.lit(" in "), (F.lit(1990) + k).cast("string"))).otherwise(F.lit("")))
    used = F.when(k < 30, F.array(F.lit("duckduckgo"), F.lit("brave"))).when(k < 60, F.array(F.lit("qwant"))).otherwise(
        F.array(*[F.lit(x) for x in WebConfig().preferred_engines]))
    status = F.when(F.col("event_type") == "error", "error").when(F.col("value") < 5, "empty").otherwise("ok")
    attempt = (F.row_number().over(Window.partitionBy("user_id", "event_type").orderBy("ts", "event_id")) - 1) % 3
    return e.select("event_id", attempt.alias("attempt"), query.alias("query"), query.alias("original_query"), used.alias("engines"),
                    F.floor("value").cast("int").alias("n_results"), status.alias("status"))


BANNED = ("brave",)


@register("retry_plan")
def q_retry_plan(spark, sf_dir):
    """What follows each attempt; engines once without and once with a ban."""
    a = attempts(spark, sf_dir)
    banned = F.array(*[F.lit(x) for x in BANNED])
    plan = web.retry_plan(a, WebConfig().max_retries, banned)
    return plan.select("event_id", F.col("attempt").cast("long").alias("attempt"), "retry", F.array_join("next_engines", ",").alias("next_engines"), "next_query",
                       F.col("backoff_s").cast("long").alias("backoff_s"), "suggestion",
                       F.array_join(web.allowed_engines(F.col("engines"), banned), ",").alias("allowed"))


@register("recency_filter")
def q_recency_filter(spark, sf_dir):
    """Events of the last week before the newest one, of one category."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "event_type").withColumn("ts", F.col("ts").cast("timestamp"))
    now = e.select(F.max("ts")).scalar()
    return web.recency_filter(e, "week", now, "ts", "view", "event_type").select("event_id", "event_type")


@register("tool_metrics")
def q_tool_metrics(spark, sf_dir):
    e = read_table(spark, sf_dir, "events", "event_type", "value", "props")
    log = e.select(F.concat(F.lit("tool "), F.get_json_object("props", "$.k")).alias("tool"), (F.col("event_type") != "error").alias("ok"), F.col("value").alias("latency_ms"))
    m = ev.tool_metrics(log)
    return m.select("tool", "calls", F.round("success_rate", 6).alias("success_rate"), F.round("p50_ms", 6).alias("p50_ms"), F.round("p95_ms", 6).alias("p95_ms"))


@register("quality_by_setup")
def q_quality_by_setup(spark, sf_dir):
    """Setups = event types, queries = users, domains = the k of an event."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type", "value", "props")
    w = Window.partitionBy("event_type", "user_id").orderBy("ts", "event_id")
    rows = e.select(F.col("event_type").alias("setup"), F.col("user_id").alias("query_id"), F.row_number().over(w).alias("rank"),
                    (F.col("value") > 20).alias("relevant"), F.get_json_object("props", "$.k").alias("domain"))
    m = ev.quality_by_setup(rows)
    return m.select("setup", F.round("coverage_pct", 6).alias("coverage_pct"), F.round("diversity", 6).alias("diversity"), "n_queries")


@register("graded_metrics")
def q_graded_metrics(spark, sf_dir):
    """Explicit judgments with grades 0 to 3: a user's events ranked by time,
    graded by their value; what the ranking left out is judged, too."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "value")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    ranked = e.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10).select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), "rank")
    grade = F.when(F.col("value") > 60, 3).when(F.col("value") > 30, 2).when(F.col("value") > 10, 1).otherwise(0)
    qrels = e.select(F.col("user_id").alias("query_id"), F.col("event_id").alias("doc_id"), grade.alias("grade"))
    m = ev.rank_metrics(ranked.select("query_id").distinct(), ranked, qrels, METRIC_KS)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


@register("history_erased")
def q_history_erased(spark, sf_dir):
    """Conversations without those that hold a message of over 800 characters."""
    c = conversations(spark, sf_dir)
    return mem.erase_history(c, c.where(F.length("text") > 800).select("conv_id")).select("conv_id", "turn", "role")


@register("history_export")
def q_history_export(spark, sf_dir):
    """Messages of those conversations, written as JSON lines and read back."""
    c = conversations(spark, sf_dir)
    path = f"{ensure_checkpoint_dir(spark)}/history-{uuid.uuid4().hex}"
    mem.export_history(c, c.where(F.length("text") > 800).select("conv_id"), path)
    return spark.read.schema("conv_id long, turn long, role string, text string").json(path).select("conv_id", "turn", "role", F.length("text").cast("long").alias("n_chars"))


# ---------------------------------------------------------------------------
# evaluation: ranking metrics, latency and run statistics
# ---------------------------------------------------------------------------


METRIC_KS = (1, 3, 5, 10)


def _label_metrics(spark, sf_dir):
    """Dense top-10 of every vector among the others; relevant = same label
    (judged from counts, no pair table)."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding", "label")
    kmax = max(METRIC_KS)
    ranked = dense_topk(e.withColumnRenamed("vec_id", "query_id"), e, k=kmax + 1) \
        .where("query_id <> vec_id").select("query_id", F.col("vec_id").alias("doc_id"), "rank") \
        .withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("rank"))).where(F.col("rank") <= kmax)
    labels = e.select("vec_id", "label")
    qlab = labels.select(F.col("vec_id").alias("query_id"), F.col("label").alias("qlabel"))
    dlab = labels.select(F.col("vec_id").alias("doc_id"), F.col("label").alias("dlabel"))
    graded = (ranked.join(qlab, "query_id").join(dlab, "doc_id")
                    .withColumn("grade", (F.col("qlabel") == F.col("dlabel")).cast("int")))
    counts = labels.groupBy("label").agg((F.count(F.lit(1)) - 1).alias("n_relevant"))
    relevant = qlab.join(counts, qlab.qlabel == counts.label).select("query_id", "n_relevant").where("n_relevant > 0")
    ideal = relevant.select("query_id", F.explode(F.sequence(F.lit(1), F.least(F.lit(kmax), "n_relevant")))
                            .alias("ideal_rank"), F.lit(1).alias("grade"))
    return ev.metrics_from_parts(qlab.select("query_id"), graded, relevant, ideal, METRIC_KS)


@register("rank_metrics")
def q_rank_metrics(spark, sf_dir):
    m = _label_metrics(spark, sf_dir)
    return m.select("query_id", *[F.round(c, 6).alias(c) for c in m.columns if c != "query_id"])


@register("rank_metrics_summary")
def q_rank_metrics_summary(spark, sf_dir):
    m = ev.macro_average(_label_metrics(spark, sf_dir))
    return m.select(*[F.round(c, 6).alias(c) if c != "n_queries" else F.col(c) for c in m.columns])


def events_as_latency_log(spark, sf_dir):
    """events as a load log: hour index = step, error events = failures,
    value = latency."""
    ev_ = read_table(spark, sf_dir, "events", "ts", "user_id", "event_type", "value") \
        .withColumn("ts", F.col("ts").cast("timestamp"))
    return ev_.select(F.floor(F.unix_seconds("ts") / 3600).cast("long").alias("step"), "user_id", "ts",
                      F.when(F.col("event_type") == "error", "error").otherwise("ok").alias("status"),
                      F.col("value").alias("latency_ms"), "event_type")


P95_LIMIT = 80.0


@register("latency_summary")
def q_latency_summary(spark, sf_dir):
    # a limit that some hours pass and others break
    s = ev.latency_summary(events_as_latency_log(spark, sf_dir), step_seconds=3600.0, p95_limit=P95_LIMIT)
    return s.select("step", "n_ok", "n_error", F.round("p95", 6).alias("p95"), F.round("p99", 6).alias("p99"),
                    F.round("rps", 6).alias("rps"), "breached", "ramp_end")


@register("latency_variability")
def q_latency_variability(spark, sf_dir):
    v = ev.latency_variability(events_as_latency_log(spark, sf_dir), "event_type")
    return v.select("event_type", "n", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"),
                    F.round("cv", 6).alias("cv"), "stable")


@register("run_summary")
def q_run_summary(spark, sf_dir):
    log = events_as_latency_log(spark, sf_dir).withColumn("ok", F.col("status") == "ok")
    r = ev.run_summary(log, "user_id", "ok", "ts", "latency_ms")
    return r.select("user_id", "tests", "passed", "failed", F.round("success_rate", 6).alias("success_rate"),
                    F.round("throughput", 6).alias("throughput"), F.round("growth_pct", 6).alias("growth_pct"))


# ---------------------------------------------------------------------------
# outcome streams: error streak / back-off / breaker (batch form)
# ---------------------------------------------------------------------------



def outcome_log(spark, sf_dir):
    """events as request outcomes: 'error' events are failures."""
    return read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type") \
        .withColumn("is_error", F.col("event_type") == "error")


@register("error_streak")
def q_error_streak(spark, sf_dir):
    s = error_streak(outcome_log(spark, sf_dir), "user_id", ("ts", "event_id"), "is_error")
    return s.select("user_id", "event_id", "streak", F.round("delay", 6).alias("delay"),
                    "consecutive_errors", "breaker_open")


# ---------------------------------------------------------------------------
# result cache
# ---------------------------------------------------------------------------


def default_engines():
    return F.array(*[F.lit(e) for e in WebConfig().preferred_engines])


def _search_requests(spark, sf_dir):
    """events as searches: query = '<event_type> <k>', default engines; a
    successful (non-error) search writes its payload (props) to the cache."""
    e = read_table(spark, sf_dir, "events", "ts", "event_type", "props")
    return (e.withColumn("query", F.concat_ws(" ", "event_type", F.get_json_object("props", "$.k")))
             .withColumn("cache_key", cache_ops.cache_key(F.col("query"), default_engines())))


@register("cache_lookup")
def q_cache_lookup(spark, sf_dir):
    s = _search_requests(spark, sf_dir)
    writes = s.where(F.col("event_type") != "error").select("cache_key", F.col("props").alias("payload"),
                                                            F.col("ts").alias("written_at"))
    now = s.select(F.max("ts")).scalar()
    req = s.select("cache_key", "query").distinct()
    r = cache_ops.cache_lookup(req, writes, now, WebConfig().cache_ttl_seconds)
    return r.select("cache_key", "query", "hit", F.round("age_s", 6).alias("age_s"), "payload")


@register("cache_repair")
def q_cache_repair(spark, sf_dir):
    s = _search_requests(spark, sf_dir)
    cache = s.select("cache_key", F.col("props").alias("payload"), F.col("ts").alias("written_at"))
    _, report = cache_ops.cache_repair(cache_ops.current_entries(cache))
    return report


# ---------------------------------------------------------------------------
# query / response logs and conversation memory (over conversations)
# ---------------------------------------------------------------------------


def conversations(spark, sf_dir):
    return read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")


@register("query_simplify")
def q_query_simplify(spark, sf_dir):
    """User turns as search queries: simplified form and suggestion."""
    c = conversations(spark, sf_dir).where(F.col("role") == "user")
    s = web.simplify_query(F.col("text"))
    return c.select("conv_id", "turn", s.alias("simplified"),
                    F.when(s != F.col("text"), s).alias("suggestion"))


@register("response_parse")
def q_response_parse(spark, sf_dir):
    """Assistant turns as model responses: final channel and selected id list."""
    c = conversations(spark, sf_dir).where(F.col("role") == "assistant")
    fin = ctx.final_channel(F.col("text"))
    ids = ctx.parse_id_list(fin)
    return c.select("conv_id", "turn", fin.alias("final_text"),
                    F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"),
                    F.size(ids).cast("long").alias("n_ids"))


# Neighbouring conversations joined to one session, long enough for the windows to evict.
SESSION_CONVERSATIONS = 100


def sessions(spark, sf_dir):
    """Conversations of a hundred neighbouring ids in one session, turn after turn."""
    c = conversations(spark, sf_dir)
    return c.select(F.floor(F.col("conv_id") / SESSION_CONVERSATIONS).alias("session_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message"), "role", "text")


@register("working_memory")
def q_working_memory(spark, sf_dir):
    w = mem.working_memory(sessions(spark, sf_dir), conv="session_id", turn="message")
    return w.select("session_id", "message", "role", F.col("recency").cast("long").alias("recency"))


@register("token_budget")
def q_token_budget(spark, sf_dir):
    w = mem.token_budget(sessions(spark, sf_dir), conv="session_id", turn="message")
    return w.select("session_id", "message", F.round("tokens", 6).alias("tokens"),
                    F.round("running_tokens", 6).alias("running_tokens"))


@register("episodes")
def q_episodes(spark, sf_dir):
    e = mem.episodes(sessions(spark, sf_dir), conv="session_id", turn="message")
    return e.select("session_id", "episode", "n_messages", "first_turn", "last_turn", "text")


# ---------------------------------------------------------------------------
# incremental indexing
# ---------------------------------------------------------------------------



def corpus_files(spark, sf_dir):
    """documents as corpus files: path = <source>/<doc_id>.txt."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    return d.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                    idx.fingerprint(F.col("text")).alias("file_hash"), "text")


def previous_manifest(spark, sf_dir):
    """Manifest of an earlier build: the labelled documents were indexed
    before; those of quality 0 have been edited since (their stored hash is
    the one of the text without its final character)."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    j = d.join(lab, "doc_id")
    old_text = F.when(F.col("quality") == 1, F.col("text")).otherwise(F.expr("substring(text, 1, length(text) - 1)"))
    return j.select(F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
                    idx.fingerprint(old_text).alias("file_hash"))


@register("incremental_diff")
def q_incremental_diff(spark, sf_dir):
    c = idx.classify_files(corpus_files(spark, sf_dir), previous_manifest(spark, sf_dir))
    return c.select("path", "file_hash", "outcome", F.col("n_chunks").cast("long").alias("n_chunks"))


@register("index_outcomes")
def q_index_outcomes(spark, sf_dir):
    return idx.outcome_counts(idx.classify_files(corpus_files(spark, sf_dir), previous_manifest(spark, sf_dir)))


@register("consistency_check")
def q_consistency_check(spark, sf_dir):
    """Counts through the consistency rules: by language with a vector for
    every chunk, by source with vectors of the labelled documents only."""
    chunks = corpus_chunks(spark, sf_dir).select("doc_id", "chunk_id")
    docs = read_table(spark, sf_dir, "documents", "doc_id", "lang", "source")
    labelled = read_table(spark, sf_dir, "labels", "doc_id").distinct().withColumn("labelled", F.lit(1))
    rows = chunks.join(docs, "doc_id").join(labelled, "doc_id", "left")

    def counts(part, vectors):
        return rows.groupBy(part.alias("part")).agg(vectors.alias("vectors"), F.count(F.lit(1)).alias("lexical"), F.count_distinct("doc_id").alias("files"))
    return idx.consistency(counts(F.concat(F.lit("lang "), F.col("lang")), F.count(F.lit(1)))
                           .unionByName(counts(F.concat(F.lit("source "), F.col("source")), F.count("labelled"))))


@register("index_build")
def q_index_build(spark, sf_dir):
    """The corpus indexed twice: the labelled part in an earlier state, then all
    of it. Files, chunk counts and vectors of the store that results."""
    store = idx.IndexFiles(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text")
    lab = read_table(spark, sf_dir, "labels", "doc_id", "quality")
    old = d.join(lab, "doc_id").withColumn("text", F.when(F.col("quality") == 1, F.col("text")).otherwise(F.expr("substring(text, 1, length(text) - 1)")))
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("path")
    idx.build_index(spark, old.select(path, idx.fingerprint(F.col("text")).alias("file_hash"), "text"), store)
    idx.build_index(spark, corpus_files(spark, sf_dir), store)
    vectors = store.read("chunks").select("chunk_id", "path", F.col("metadata.file_type").alias("file_type")).join(store.read("vectors"), "chunk_id")
    n = vectors.groupBy("path", "file_type").agg(F.count(F.lit(1)).alias("n_vectors"))
    return store.read("manifest").join(n, "path").select("path", "file_hash", F.col("chunk_count").cast("long").alias("chunk_count"), "n_vectors", "file_type")


# ---------------------------------------------------------------------------
# text hygiene and copied-content de-duplication
# ---------------------------------------------------------------------------



@register("content_dedup")
def q_content_dedup(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return hyg.content_dedup(d).select("doc_id", "content_hash", "canonical_id", "is_duplicate")


@register("query_hygiene")
def q_query_hygiene(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    h = hyg.hygiene(d)
    return h.select("doc_id", F.col("n_chars").cast("long").alias("n_chars"),
                    F.round("n_tokens", 6).alias("n_tokens"), "too_long", "blocked", "accepted")


# ---------------------------------------------------------------------------
# lemmatisation (dictionary derived from the corpus by accent folding)
# ---------------------------------------------------------------------------



def _lemma(spark, sf_dir, mode):
    d = read_table(spark, sf_dir, "documents", "doc_id", "text")
    dic = lem.folding_dictionary(d, "doc_id", "text")
    out = lem.lemmatize(d, dic, "doc_id", "text", mode)
    return out.select("doc_id", "lemma_text", F.size("lemmas").cast("long").alias("n_lemmas"))


@register("lemma_index")
def q_lemma_index(spark, sf_dir):
    return _lemma(spark, sf_dir, "index")


@register("lemma_strict")
def q_lemma_strict(spark, sf_dir):
    return _lemma(spark, sf_dir, "strict")


# ---------------------------------------------------------------------------
# request-rate windows (the batch run of the streaming plan)
# ---------------------------------------------------------------------------



def search_events(spark, sf_dir):
    return read_table(spark, sf_dir, "events", "ts", "user_id").withColumn("ts", F.col("ts").cast("timestamp"))


@register("rate_windows")
def q_rate_windows(spark, sf_dir):
    e = search_events(spark, sf_dir)
    s = rate_ops.rate_summary(rate_ops.minute_counts(e), rate_ops.hour_counts(e))
    return s.select("user_id", "max_per_minute", "minutes_over_limit", "max_per_hour", "hours_over_limit")


def burst_events(spark, sf_dir):
    """events squeezed in time, so that limits are exceeded: a month in ten hours,
    ten users (user_id modulo 10), the events of an hour in its first ten minutes.
    Every fiftieth event arrives half of the time late."""
    e = read_table(spark, sf_dir, "events", "event_id", "ts", "user_id", "event_type")
    first, last = e.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))), F.max(F.unix_micros(F.col("ts").cast("timestamp")))).first()
    t = F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - first) / SQUEEZE)
    hour = F.floor(t / 3_600_000_000) * 3_600_000_000
    quarter = F.least(F.floor((F.unix_micros(F.col("ts").cast("timestamp")) - first) * 4 / (last - first)), F.lit(3))
    arrival = F.when(F.col("event_id") % 50 == 0, F.least(quarter + 2, F.lit(3))).otherwise(quarter)
    return e.select("event_id", (F.col("user_id") % 10).alias("user_id"), F.timestamp_micros(hour + F.floor((t - hour) / 6) + EPOCH * 1_000_000).alias("ts"),
                    F.col("event_type").isin("error", "click").alias("is_error"), arrival.cast("int").alias("arrival"))


SQUEEZE = 72
# a start that is not the epoch: a stream without rows has its watermark there
EPOCH = 1_704_067_200


@register("rate_stream")
def q_rate_stream(spark, sf_dir):
    """Hour windows of a stream that the watermark closed, and how many of their
    rows came too late for them (by user)."""
    root = landed(burst_events(spark, sf_dir).select("user_id", "ts", "arrival"), "arrival", "rate")
    hours, late = rate_ops.run_rates(landed_stream(spark, root), "rate")
    w = hours.groupBy("user_id").agg(F.count(F.lit(1)).alias("windows"), F.sum("n").alias("counted"), F.max("n").alias("max_per_hour"),
                                     F.count_if("over_limit").alias("hours_over_limit"))
    missed = late.groupBy("user_id").agg(F.count(F.lit(1)).alias("late_rows"), F.sum("hours_missed").alias("hours_missed"))
    return w.join(missed, "user_id", "left").select("user_id", "windows", "counted", "max_per_hour", "hours_over_limit",
                                                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("late_rows", "hours_missed")])


@register("breaker_stream")
def q_breaker_stream(spark, sf_dir):
    """Changes of each user's circuit breaker, errors and clicks being failures."""
    e = burst_events(spark, sf_dir).withColumn("arrival", F.lit(0))
    root = landed(e, "arrival", "breaker")
    return run_to_files(breaker_stream(landed_stream(spark, root)), "breaker").select("user_id", (F.unix_micros("at") - EPOCH * 1_000_000).alias("at_us"), "state")


@register("streak_stream")
def q_streak_stream(spark, sf_dir):
    """The error streak as a stream over events that land in four parts."""
    e = burst_events(spark, sf_dir).withColumn("arrival", F.floor(F.hour("ts") / 3).cast("int"))
    root = landed(e, "arrival", "streak")
    out = run_to_files(error_streak_stream(landed_stream(spark, root)), "streak")
    return out.select("user_id", "event_id", "streak", F.round("delay", 6).alias("delay"), "consecutive_errors")


@register("first_seen_stream")
def q_first_seen_stream(spark, sf_dir):
    """Accepted URLs of each request as a stream that forgets: a page every ten
    seconds, 20 pages a request, a horizon of ten minutes."""
    p = web.with_url_keys(page_results(spark, sf_dir)).where("norm_url <> '' AND norm_url IS NOT NULL")
    rows = p.select("request_id", F.col("page_id").alias("arrival"), "norm_url", "domain", F.timestamp_seconds(F.col("page_id") * 10 + EPOCH).alias("ts"),
                    F.floor(F.col("page_id") * 4 / (F.lit(p.agg(F.max("page_id")).first()[0]) + 1)).cast("int").alias("file"))
    root = landed(rows, "file", "pages")
    out = run_to_files(first_seen_capped_stream(landed_stream(spark, root), horizon="10 minutes"), "first-seen")
    return out.select("request_id", F.col("arrival").alias("page_id"), "norm_url", "domain")


@register("memory_recall")
def q_memory_recall(spark, sf_dir):
    """Earlier messages recalled for each conversation's newest user message
    (top-5 cosine of the default embedder, keep > 0.7, newest 3)."""
    r = mem.recall(conversations(spark, sf_dir))
    return r.select("conv_id", "q_turn", "turn", F.round("score", 6).alias("score"),
                    F.col("recall_rank").cast("long").alias("recall_rank"))


@register("semantic_dedup")
def q_semantic_dedup(spark, sf_dir):
    """Greedy keep-first near-duplicate removal over all stored vectors
    (cosine > 0.85, vector id order)."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding")
    return semantic_dedup(e, 0.85).select("vec_id", "kept", "reason")


@register("semantic_dedup_copies")
def q_semantic_dedup_copies(spark, sf_dir):
    """The same where it has something to do: every tenth vector comes again
    under a later id, every tenth with its first eight components halved, and
    every tenth as the middle of itself and the vector before."""
    e = read_table(spark, sf_dir, "embeddings", "vec_id", "embedding").withColumn("embedding", F.col("embedding").cast("array<double>"))
    kind = F.col("vec_id") % 10
    before = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    copies = e.where(kind == 0).withColumn("vec_id", F.col("vec_id") + 1_000_000_000)
    dented = e.where(kind == 1).select((F.col("vec_id") + 2_000_000_000).alias("vec_id"), F.transform("embedding", lambda x, i: F.when(i < 8, x * 0.5).otherwise(x)).alias("embedding"))
    middle = e.where(kind == 2).join(before, "vec_id").select((F.col("vec_id") + 3_000_000_000).alias("vec_id"),
                                                               F.zip_with("embedding", "other", lambda a, b: a + b * 0.5).alias("embedding"))
    return semantic_dedup(e.unionByName(copies).unionByName(dented).unionByName(middle), 0.85).select("vec_id", "kept", "reason")


# ---------------------------------------------------------------------------
# cache writes, repair and clearing; corpus files; statistics of an index
# ---------------------------------------------------------------------------


def damaged_cache(spark, sf_dir):
    """Cache entries written by all searches; what k leaves decides who lost its
    end (k % 7 = 0), has nothing but a space (k % 11 = 0) or begins with a mark."""
    s = _search_requests(spark, sf_dir)
    k = F.get_json_object("props", "$.k").cast("int")
    payload = (F.when(k % 7 == 0, F.expr("substring(props, 1, length(props) - 1)")).when(k % 11 == 0, F.lit(" "))
               .when(k % 13 == 0, F.concat(F.lit("\ufeff"), F.col("props"))).otherwise(F.col("props")))
    return s.select("cache_key", payload.alias("payload"), F.col("ts").alias("written_at"))


@register("cache_write")
def q_cache_write(spark, sf_dir):
    """The cache after a second batch of writes over a first one: searches before
    and from the middle of the time on."""
    c = damaged_cache(spark, sf_dir)
    t = F.unix_micros(F.col("written_at").cast("timestamp"))
    first, last = c.agg(F.min(t), F.max(t)).first()
    middle = (first + last) // 2
    old = cache_ops.current_entries(c.where(t < middle))
    return cache_ops.cache_put(old, c.where(t >= middle)).select("cache_key", "payload", cache_ops.payload_parses("payload").alias("parses"))


@register("cache_repair_damaged")
def q_cache_repair_damaged(spark, sf_dir):
    _, report = cache_ops.cache_repair(cache_ops.current_entries(damaged_cache(spark, sf_dir)))
    return report


@register("cache_clear")
def q_cache_clear(spark, sf_dir):
    """Entries cleared, and those of the cache that follows after the errors' writes alone."""
    cache = cache_ops.current_entries(damaged_cache(spark, sf_dir))
    empty, report = cache_ops.cache_clear(cache)
    errors = _search_requests(spark, sf_dir).where(F.col("event_type") == "error").select("cache_key", F.col("props").alias("payload"), F.col("ts").alias("written_at"))
    after = cache_ops.cache_put(empty, errors).agg(F.count(F.lit(1)).alias("entries_after"))
    return report.withColumn("entries_after", after.scalar())


FILE_BLOCK = 200


def corpus_folder(spark, sf_dir):
    d = read_table(spark, sf_dir, "documents", "doc_id", "source", "text").withColumn("block", F.floor(F.col("doc_id") / FILE_BLOCK))
    root = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    (d.repartition("source", "block").sortWithinPartitions("source", "block", "doc_id").select("source", "block", F.coalesce("text", F.lit("")).alias("text"))
      .write.partitionBy("source", "block").option("maxRecordsPerFile", 0).text(root))
    return root


@register("index_stream")
def q_index_stream(spark, sf_dir):
    """Those files indexed by the stream: chunks and vectors of each."""
    store = idx.IndexFiles(spark, f"{ensure_checkpoint_dir(spark)}/index-{uuid.uuid4().hex}")
    start_index_stream(spark, corpus_folder(spark, sf_dir), store).awaitTermination()
    vectors = store.read("chunks").select("chunk_id", "path").join(store.read("vectors"), "chunk_id").groupBy("path").agg(F.count(F.lit(1)).alias("n_vectors"))
    name = r"source=([^/]*)/block=(\d+)/"
    return store.read("manifest").join(vectors, "path").select(
        F.regexp_extract("path", name, 1).alias("source"), F.regexp_extract("path", name, 2).cast("long").alias("block"),
        F.col("chunk_count").cast("long").alias("chunk_count"), "n_vectors")


@register("corpus_files")
def q_corpus_files(spark, sf_dir):
    """Documents written as text files (one for the documents of a source in a
    block of 200 ids) and read back by the folder scan."""
    root = corpus_folder(spark, sf_dir)
    files = decode_files(scan_corpus(spark, root), root)
    name = r"source=([^/]*)/block=(\d+)/"
    return files.select(F.regexp_extract("path", name, 1).alias("source"), F.regexp_extract("path", name, 2).cast("long").alias("block"), "suffix",
                        F.col("length").cast("long").alias("n_bytes"), F.md5("text").alias("text_md5"))


@register("collection_stats")
def q_collection_stats(spark, sf_dir):
    """Statistics and reindex gate by source: labelled documents have vectors, and
    a document was indexed as many hours after 2024 began as its id says."""
    chunks = corpus_chunks(spark, sf_dir).select("doc_id").join(read_table(spark, sf_dir, "documents", "doc_id", "source"), "doc_id")
    labelled = read_table(spark, sf_dir, "labels", "doc_id").distinct()
    docs = read_table(spark, sf_dir, "documents", "doc_id", "source")
    manifest = docs.withColumn("indexed_at", F.timestamp_seconds(F.lit(EPOCH) + (F.col("doc_id") * 7919) % 1000 * 3600))
    now = manifest.agg(F.max("indexed_at")).first()[0]
    # a source with an even number was indexed long ago only
    old = manifest.where((F.regexp_extract("source", r"(\d+)$", 1).cast("int") % 2 == 1) | (F.col("indexed_at") < F.lit(now) - F.expr("INTERVAL 10 DAYS")))
    st = idx.part_stats(old, chunks, chunks.join(labelled, "doc_id", "left_semi"), "source", now)
    return st.select("name", "count", "cached_files", "bm25_docs", F.unix_seconds("last_indexed").alias("last_indexed"), "due")


@register("tfidf_topk_padded")
def q_tfidf_topk_padded(spark, sf_dir):
    """The longest word of each passage as a query: few texts have it, so answers
    are filled up with the smallest ids at score 0."""
    longest = F.array_sort(F.transform(tokens("query"), lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    q = benchmark_queries(spark, sf_dir).select("query_id", F.try_element_at(longest, F.lit(1))["t"].alias("query"))
    ix, k = search_index(spark, sf_dir), SearchConfig().top_k_lexical
    hits = pruned_topk(q, ix["postings"], ix["placed"], ix["term_stats"], k=k)
    out = pad_zero(hits, q, ix["placed"], k)
    return out.select("query_id", "chunk_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


# ---------------------------------------------------------------------------
# data that reaches the rarer outcomes of earlier queries
# ---------------------------------------------------------------------------


@register("latency_by_band")
def q_latency_by_band(spark, sf_dir):
    """Variability within bands of latency: stable but for the lowest."""
    log = events_as_latency_log(spark, sf_dir).withColumn("band", F.floor(F.col("latency_ms") / 10).cast("long"))
    v = ev.latency_variability(log, "band")
    return v.select("band", "n", F.round("mean", 6).alias("mean"), F.round("cv", 6).alias("cv"), "stable")


@register("response_ids")
def q_response_ids(spark, sf_dir):
    """Assistant turns that end in lists of ids, with and without the final channel."""
    c = conversations(spark, sf_dir).where(F.col("role") == "assistant")
    n = F.col("conv_id").cast("string")
    tail = (F.when(F.col("conv_id") % 4 == 0, F.concat(F.lit(FINAL_CHANNEL_MARKER + " pick [3, "), n, F.lit("]")))
            .when(F.col("conv_id") % 4 == 1, F.concat(F.lit(" [9] " + FINAL_CHANNEL_MARKER + " ["), n, F.lit(", 2] and [5,,6]")))
            .when(F.col("conv_id") % 4 == 2, F.lit(" [ ] [1,2] [007]")).otherwise(F.lit("")))
    fin = ctx.final_channel(F.concat("text", tail))
    ids = ctx.parse_id_list(fin)
    return c.select("conv_id", "turn", fin.alias("final_text"), F.array_join(F.transform(ids, lambda x: x.cast("string")), ",").alias("ids"),
                    F.size(ids).cast("long").alias("n_ids"))


# Letters of the documents written in Cyrillic.
CYRILLIC_FROM, CYRILLIC_TO = "abcdefghijklmnopqrstuvwxyzéäöüß", "абцдефгхийклмнопярстувшщызёжчюъ"


@register("lemma_cyrillic")
def q_lemma_cyrillic(spark, sf_dir):
    """Documents written in Cyrillic; the dictionary cuts forms of six letters and more to five."""
    d = read_table(spark, sf_dir, "documents", "doc_id", "text").withColumn("text", F.translate(F.lower("text"), CYRILLIC_FROM, CYRILLIC_TO))
    forms = lem.word_positions(d, "doc_id", "text").select("word").distinct().where("length(word) >= 6")
    dic = forms.select(F.col("word").alias("form"), F.substring("word", 1, 5).alias("lemma"))
    out = lem.lemmatize(d, dic, "doc_id", "text", "strict")
    return out.select("doc_id", F.md5("lemma_text").alias("lemma_md5"), F.size("lemmas").cast("long").alias("n_lemmas"))


# ---------------------------------------------------------------------------
# vectors trained on the corpus
# ---------------------------------------------------------------------------


def message_vectors(spark, sf_dir):
    """Term statistics and trained term vectors of the messages."""
    c = conversations(spark, sf_dir).select(F.concat_ws("#", "conv_id", "turn").alias("chunk_id"), "text")
    postings, stats = fit_tfidf(c, "chunk_id", "text")
    vectors, _ = latent.fit(postings, rank=8, rounds=2)          # which stores the postings
    return stats, cut_lineage(vectors)


@register("memory_recall_trained")
def q_memory_recall_trained(spark, sf_dir):
    """Recall with vectors trained on the messages themselves. No SQL: tests compare it with numpy."""
    stats, vectors = message_vectors(spark, sf_dir)
    r = mem.recall(conversations(spark, sf_dir), embed=latent.embedder(stats, vectors))
    return r.select("conv_id", "q_turn", "turn", F.round("score", 6).alias("score"), F.col("recall_rank").cast("long").alias("recall_rank"))
