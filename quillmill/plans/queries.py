"""Queries over the driver's tables, one for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import budget as B
from ..operators import classify as C
from ..operators import filters as P
from ..operators import graph as G
from ..operators import history as H
from ..operators import match as M
from ..operators import text as T
from ..operators import vectors as V
from ..plans import render as R
from ..session import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
BUDGET = 50_000


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def files(spark: SparkSession, d: str) -> DataFrame:
    """Files with content under clean paths."""
    return table(spark, d, "file_entries").where("content is not null").withColumn("path", S.clean_path(F.col("path")))


def events(spark: SparkSession, d: str) -> DataFrame:
    return H.once(table(spark, d, "change_events"))


# scans, filters, scalars


@query
def scan_size_filter(s, d):
    return files(s, d).where(F.octet_length("content") <= 2000).select("file_id", F.octet_length("content").cast("bigint").alias("bytes"))


@query
def decode_line_ends(s, d):
    c = F.replace(F.replace(F.col("content"), F.lit("\r\n"), F.lit("\n")), F.lit("\r"), F.lit("\n"))
    return files(s, d).select("file_id", F.md5(c).alias("md5"))


@query
def binary_detect(s, d):
    return files(s, d).select("file_id", P.is_binary(F.col("content")).alias("is_binary"))


@query
def hash_md5(s, d):
    return files(s, d).select("file_id", F.md5("content").alias("md5"), F.coalesce(F.lower("md5") == F.md5("content"), F.lit(False)).alias("agrees"))


@query
def hash_sha256_path(s, d):
    return files(s, d).select("file_id", F.sha2("path", 256).alias("path_hash"))


@query
def lang_by_extension(s, d):
    return files(s, d).select("file_id", S.language(F.col("path")).alias("language"))


@query
def parent_dir(s, d):
    return files(s, d).select("file_id", S.parent_dir(F.col("path")).alias("parent"))


@query
def top_dir(s, d):
    return files(s, d).groupBy(S.top_dir(F.col("path")).alias("top")).agg(F.count("*").alias("files"))


@query
def glob_include_exclude(s, d):
    f = files(s, d)
    p = F.col("path")
    return f.where(P.included(p, [], ["src/**", "*.py", "src/*.rs"])).select("file_id", F.lit("include").alias("rule")).union(f.where(P.included(p, ["*.json", "tests", "src/*.go"], ["*.py"])).select("file_id", F.lit("ignore").alias("rule")))


@query
def hygiene_filter(s, d):
    return files(s, d).where(P.hygienic(F.col("path"))).select("file_id", "path")


@query
def tier_classify(s, d):
    return files(s, d).select("file_id", C.tier(F.col("path")).alias("tier"))


@query
def token_estimate(s, d):
    return table(s, d, "documents").select("doc_id", S.tokens(F.col("text")).alias("tokens"))


@query
def file_cost(s, d):
    return files(s, d).select("file_id", S.file_cost(F.col("path"), F.col("content")).alias("cost"))


@query
def human_bytes(s, d):
    return files(s, d).select("file_id", S.human_bytes(F.octet_length("content")).alias("size_text"))


@query
def metadata_suffix(s, d):
    age = (F.lit(1735689600) - F.col("mtime")) / 86400
    size, time = F.octet_length("content") > 10000, (age < 30) | (age > 5 * 365)
    return files(s, d).select("file_id", F.concat_ws(" ", F.when(size, F.concat(F.lit("size="), F.octet_length("content").cast("string"))), F.when(time, F.concat(F.lit("mtime="), F.col("mtime").cast("string")))).alias("suffix"))


@query
def escape_xml(s, d):
    return table(s, d, "documents").where("text is not null").select("doc_id", F.md5(S.escape_xml(F.col("text"))).alias("md5"))


@query
def lens_priority_max(s, d):
    p = F.col("path")
    return files(s, d).select("file_id", C.lens_priority(p, "architecture").alias("architecture"), C.lens_priority(p, "debug").alias("debug"), C.lens_priority(p, "security").alias("security"))


@query
def priority_blend(s, d):
    """Static lens priority blended with the learned utility of the processed file of the same path."""
    learned = table(s, d, "processed_files").withColumn("path", S.clean_path(F.col("path"))).where("utility is not null").groupBy("repo_id", "path").agg(F.max("utility").alias("learned"))
    f = files(s, d).select("file_id", "repo_id", "path").join(learned, ["repo_id", "path"], "left")
    return f.select("file_id", C.blend(C.lens_priority(F.col("path"), "architecture"), F.col("learned")).alias("priority"))


@query
def budget_strings(s, d):
    """Budgets of vectors written as ``Nk`` and read back."""
    v = table(s, d, "budget_vectors")
    return v.select("vector_id", S.budget_tokens(F.concat(F.floor(F.col("input_budget") / 1000).cast("string"), F.lit("k"))).alias("budget"))


# sorting and budgets


def _ranked(s, d) -> DataFrame:
    f = spread(files(s, d).select("file_id", "path", "content"))
    p = F.col("path")
    return f.select("file_id", "path", C.tier(p).alias("tier"), C.tier_rank(C.tier(p)).alias("tier_rank"), (-C.lens_priority(p, "architecture")).alias("minus_priority"), S.file_cost(p, F.col("content")).alias("cost"), S.file_cost(p, T.truncate_structure(F.col("content"))).alias("reduced"), S.tokens(F.col("content")).alias("bytes_tokens"), C.structured(p, "architecture").alias("structured")).withColumn("grouped", F.when(F.col("structured"), F.col("reduced")).otherwise(F.col("cost")))


@query
def sort_topk_files(s, d):
    return files(s, d).where("mtime is not null").orderBy(F.desc("mtime"), "path", "file_id").limit(100).select("file_id", "path", "mtime")


@query
def budget_greedy_drop(s, d):
    """Files of the lens's structured groups are costed by their structure."""
    return B.greedy(_ranked(s, d), "file_id", ["tier_rank", "minus_priority", "path", "file_id"], "grouped", BUDGET).select("file_id", "cost")


@query
def budget_hybrid(s, d):
    """Files above a tenth of the budget enter reduced to their structure; others fall back to it."""
    f = _ranked(s, d).withColumn("full", F.when(F.col("grouped") > BUDGET // 10, F.col("reduced")).otherwise(F.col("grouped")))
    return B.greedy(f, "file_id", ["tier_rank", "minus_priority", "path", "file_id"], "full", BUDGET, "reduced")


@query
def budget_adaptive_drop(s, d):
    return B.adaptive_drop(_ranked(s, d), "file_id", "tier", "reduced", BUDGET)


@query
def budget_report(s, d):
    return B.report(budget_greedy_drop(s, d), BUDGET)


@query
def budget_by_tier(s, d):
    return _ranked(s, d).groupBy("tier").agg(F.count("*").alias("files"), F.sum("cost").alias("cost"), F.max("cost").alias("largest"))


@query
def attention_tiers(s, d):
    p = table(s, d, "processed_files")
    return p.groupBy(C.attention(F.coalesce("priority", F.lit(50)), F.coalesce("utility", F.lit(0.0)), F.coalesce("truncated", F.lit(False)) & (F.coalesce("priority", F.lit(50)) < 80)).alias("attention")).agg(F.count("*").alias("files"), F.sum(F.coalesce("tokens", F.lit(0))).alias("tokens"))


# rendering


@query
def render_plusminus(s, d):
    return files(s, d).select("file_id", F.md5(R.plus_minus(F.col("path"), F.col("content"))).alias("md5"))


@query
def render_xml(s, d):
    return files(s, d).select("file_id", F.md5(R.xml_entry(F.col("path"), F.col("content"))).alias("md5"))


@query
def render_markdown(s, d):
    return files(s, d).select("file_id", F.md5(R.markdown_entry(F.col("path"), F.col("content"))).alias("md5"))


# text


@query
def truncate_simple(s, d):
    return files(s, d).select("file_id", F.md5(T.truncate_simple(F.col("content"), 40)).alias("md5"))


@query
def truncate_gap(s, d):
    return files(s, d).select("file_id", F.md5(T.truncate_gap(F.col("content"), 40)).alias("md5"))


@query
def truncate_structure(s, d):
    return files(s, d).select("file_id", F.size(S.line_array(T.truncate_structure(F.col("content")))).cast("bigint").alias("kept_lines"))


@query
def truncate_smart(s, d):
    return files(s, d).select("file_id", F.size(F.filter(T.important_lines(F.col("content")), lambda x: x)).cast("bigint").alias("important"))


@query
def line_counts(s, d):
    return T.line_counts(files(s, d).withColumn("language", S.language(F.col("path"))), "file_id", "content", "language")


@query
def language_stats(s, d):
    return T.language_statistics(line_counts(s, d))


@query
def regex_symbol_extract(s, d):
    return T.symbols(files(s, d), "file_id", "content")


@query
def regex_counts(s, d):
    c = F.col("content")
    return files(s, d).select("file_id", F.regexp_count(c, F.lit("TODO|FIXME")).cast("bigint").alias("markers"), F.regexp_count(c, F.lit("https?://[a-z0-9.]+")).cast("bigint").alias("links"), F.regexp_count(c, F.lit("[0-9]+")).cast("bigint").alias("numbers"))


@query
def call_extract_distinct(s, d):
    return T.calls(files(s, d), "file_id", "content")


@query
def usages(s, d):
    return T.usages(files(s, d), "file_id", "content", "harbor", 200).select("file_id", "line_no", F.md5("line").alias("line_md5"))


# joins over calls and definitions


def _calls_in(s, d) -> DataFrame:
    return call_extract_distinct(s, d).groupBy("callee").agg(F.count("*").alias("callers"))


def _defined(s, d) -> DataFrame:
    return regex_symbol_extract(s, d).where(F.col("kind").isin("fn", "def", "func", "function")).groupBy("name").agg(F.count("*").alias("definitions"), F.min("file_id").alias("file_id"))


@query
def calls_inner_join(s, d):
    return _calls_in(s, d).join(_defined(s, d), F.col("callee") == F.col("name")).select("name", "callers", "definitions", "file_id")


@query
def calls_left_join(s, d):
    return _calls_in(s, d).join(_defined(s, d), F.col("callee") == F.col("name"), "left").groupBy(F.col("name").isNotNull().alias("resolved")).agg(F.count("*").alias("names"), F.sum("callers").alias("callers"))


@query
def external_calls_anti(s, d):
    return _calls_in(s, d).join(_defined(s, d), F.col("callee") == F.col("name"), "left_anti")


# census


def _members(s, d) -> DataFrame:
    c = table(s, d, "concepts").join(table(s, d, "file_entries").select("file_id", "repo_id"), "file_id")
    lines = F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))
    return c.select("repo_id", "file_id", "language", lines.alias("lines"), F.coalesce(F.octet_length(F.trim("documentation")) > 0, F.lit(False)).alias("documented"), F.coalesce(F.col("is_deprecated"), F.lit(False)).alias("deprecated"), F.coalesce(F.size("dependencies"), F.lit(0)).alias("deps"), "complexity_score")


def _census(c: DataFrame, *keys: str) -> DataFrame:
    g = c.groupBy(*keys).agg(F.count("*").alias("callables"), F.coalesce(F.sum("lines"), F.lit(0)).cast("bigint").alias("lines"), F.count_if("documented").alias("documented"), F.count_if("deprecated").alias("deprecated"), F.count_if(F.col("lines") > 50).alias("large"), F.coalesce(F.max("deps"), F.lit(0)).cast("bigint").alias("max_deps"))
    density, doc = F.col("callables") * 1000.0 / F.greatest(F.col("lines"), F.lit(1)), F.try_divide(F.col("documented").cast("double"), F.col("callables"))
    return g.withColumn("density", F.round(density, 4)).withColumn("doc_ratio", F.round(doc, 4))


@query
def census_per_parent(s, d):
    return _census(_members(s, d), "file_id")


@query
def census_rollup(s, d):
    """By repository and over all: ratios come from sums, not from averages."""
    c = _members(s, d).rollup("repo_id").agg(F.count("*").alias("callables"), F.sum("lines").cast("bigint").alias("lines"), F.count_if("documented").alias("documented"), F.grouping("repo_id").alias("g"))
    return c.select(F.when(F.col("g") == 0, F.col("repo_id")).otherwise(-1).alias("repo_id"), "callables", "lines", "documented", F.round(F.try_divide(F.col("documented").cast("double"), F.col("callables")), 4).alias("doc_ratio"))


@query
def census_health(s, d):
    c = _census(_members(s, d), "file_id")
    debt, volcanic = F.try_divide(F.col("deprecated").cast("double"), F.col("callables")) * 0.2, F.col("large")
    return c.select("file_id", F.round(C.health_score(debt, volcanic, F.col("doc_ratio"), F.col("density")), 4).alias("score"), C.health_rating(debt, F.lit(0), volcanic, F.col("doc_ratio"), F.col("density")).alias("rating"))


@query
def large_item_list(s, d):
    c = _members(s, d)
    return c.where("lines > 30").groupBy("repo_id").agg(F.array_join(F.transform(F.array_sort(F.collect_set("file_id")), lambda x: x.cast("string")), ",").alias("large_files"))


@query
def metric_doc_coverage(s, d):
    return _members(s, d).groupBy("language").agg(F.count("*").alias("callables"), F.round(F.avg(F.col("documented").cast("double")), 4).alias("coverage"), F.round(F.avg("deps"), 4).alias("avg_deps"))


@query
def complexity_argmax(s, d):
    c = table(s, d, "concepts").where("complexity_score is not null")
    return c.groupBy("language").agg(F.round(F.avg(F.col("complexity_score").cast("double")), 4).alias("average"), F.min_by("concept_no", F.struct(-F.col("complexity_score"), F.col("concept_no"))).alias("most_complex"))


@query
def language_shares(s, d):
    g = table(s, d, "concepts").groupBy("language").agg(F.count("*").alias("n"))
    return g.select("language", "n", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy(F.lit(1))), 4).alias("percent"))


# history


@query
def churn_per_key(s, d):
    return H.churn(events(s, d), ["repo_id", "path"]).select("repo_id", "path", "changes", "n30", "n90", "n365", "age_days", "dormant_days", "added", "removed")


@query
def churn_class(s, d):
    c = churn_per_key(s, d)
    return c.groupBy(C.churn_class(F.col("n30"), F.col("n90")).alias("churn_class"), C.age_class(F.col("age_days")).alias("age_class")).agg(F.count("*").alias("files"))


@query
def churn_dir_rollup(s, d):
    return H.dir_churn(churn_per_key(s, d).withColumn("dir", S.parent_dir(S.clean_path(F.col("path")))), "dir")


@query
def top_observers(s, d):
    return H.top_observers(events(s, d)).select("email", "changes", "first_ts", "last_ts")


@query
def top3_per_key(s, d):
    return H.top_per_key(events(s, d), ["repo_id"])


@query
def observer_counts(s, d):
    return events(s, d).groupBy("repo_id").agg(F.count_distinct(H.observer(F.col("observer_email"))).alias("observers"), F.count("*").alias("changes"))


@query
def dormant_keys(s, d):
    return churn_per_key(s, d).where("dormant_days >= 180").select("repo_id", "path", "dormant_days")


@query
def hot_keys(s, d):
    return churn_per_key(s, d).where("n90 > 3").select("repo_id", "path", "n30", "n90")


def _risk(s, d) -> DataFrame:
    debt = files(s, d).select("repo_id", "path", (F.regexp_count("content", F.lit("TODO|FIXME|no qa|XXX")) * 50.0 / F.greatest(F.octet_length("content"), F.lit(1))).alias("debt")).groupBy("repo_id", "path").agg(F.max("debt").alias("debt"))
    c = churn_per_key(s, d).withColumn("path", S.clean_path(F.col("path"))).groupBy("repo_id", "path").agg(F.sum("n365").alias("n"))
    return c.join(debt, ["repo_id", "path"], "left").withColumn("debt", F.coalesce("debt", F.lit(0.0)))


@query
def tectonic_mean(s, d):
    return _risk(s, d).withColumn("risk", F.round(H.tectonic_mean(F.col("n"), F.col("debt"), 2, 0.01), 6)).where("risk is not null").select("repo_id", "path", "risk")


@query
def tectonic_product(s, d):
    return _risk(s, d).withColumn("risk", F.round(H.tectonic_product(F.col("n"), F.col("debt") * 20), 6)).select("repo_id", F.col("risk").isNotNull().alias("risky")).groupBy("repo_id", "risky").agg(F.count("*").alias("files"))


@query
def drift_report(s, d):
    per = regex_symbol_extract(s, d).join(files(s, d).select("file_id", "repo_id", "path"), "file_id").groupBy("repo_id", "path").agg(F.count("*").alias("callables"))
    c = churn_per_key(s, d).withColumn("path", S.clean_path(F.col("path"))).groupBy("repo_id", "path").agg(F.max("age_days").alias("age_days"), F.min("dormant_days").alias("dormant_days"), F.sum("n90").alias("n90"))
    return H.drift(c.join(per, ["repo_id", "path"], "left").withColumn("callables", F.coalesce("callables", F.lit(0))))


@query
def rolling_velocity(s, d):
    daily = table(s, d, "events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    w = Window.partitionBy(F.lit(1)).orderBy("day").rowsBetween(-6, 0)  # one row a day
    return daily.select(F.col("day").cast("string").alias("day"), "n", F.round((F.last("n").over(w) - F.first("n").over(w)) / F.count("*").over(w), 6).alias("velocity"))


# vectors


def _measure(s, d, measure, largest: bool) -> DataFrame:
    e = table(s, d, "embeddings")
    near = V.nearest(e.where("vec_id % 50 = 0"), e, measure, 10, largest)
    return near.select("query", "rank", "vec_id", F.round("score", 5).alias("score"))


@query
def cosine_topk(s, d):
    return _measure(s, d, V.cosine, True).drop("vec_id")


@query
def euclid_topk(s, d):
    return _measure(s, d, V.euclid, False).drop("vec_id")


@query
def manhattan_topk(s, d):
    return _measure(s, d, V.manhattan, False).drop("vec_id")


@query
def normalize_zscore(s, d):
    return V.standardized(table(s, d, "embeddings")).select("vec_id", "dim", (F.round("z", 4) + 0.0).alias("z"))


@query
def normalize_minmax(s, d):
    return V.min_max(table(s, d, "embeddings")).select("vec_id", "dim", (F.round("x", 4) + 0.0).alias("x"))


@query
def alignment_score(s, d):
    """Every vector against the one before it."""
    e = table(s, d, "embeddings")
    first = e.select((F.col("vec_id") + 1).alias("vec_id"), F.col("embedding").alias("other"))
    return e.join(first, "vec_id").select("vec_id", F.round((V.cosine(F.col("embedding"), F.col("other")) + 1) / 2, 5).alias("alignment"))


@query
def cluster_metrics(s, d):
    m = V.cluster_metrics(table(s, d, "embeddings"), "label")
    return m.select("label", "size", *[F.round(c, 4).alias(c) for c in ("mean_distance", "max_distance", "cohesion")])


@query
def cluster_representative(s, d):
    return V.representatives(table(s, d, "embeddings"), "label").select("label", F.round("distance", 4).alias("distance"))


@query
def kmeans(s, d):
    return V.kmeans(table(s, d, "embeddings"), 5).groupBy("cluster").agg(F.count("*").alias("size"))


@query
def dbscan(s, d):
    """Customers by nation and balance: dense runs of balances inside each nation."""
    points = table(s, d, "customer").select(F.col("c_custkey").alias("vec_id"), F.array(F.col("c_acctbal") / 250, F.col("c_nationkey") * 4.0).alias("embedding"))
    return V.dbscan(points, 1.0, 4, cells=2).groupBy("cluster").agg(F.count("*").alias("size"))


# graphs


def _edges(s, d) -> DataFrame:
    """Dependencies between concepts by name inside one repository's languages."""
    c = table(s, d, "concepts").select("concept_id", F.explode("dependencies").alias("dst"))
    return c.select(F.col("concept_id").alias("src"), "dst").where("src is not null and dst is not null and src <> dst").distinct()


@query
def graph_roots(s, d):
    return G.roots(_edges(s, d))


@query
def graph_leaves(s, d):
    return G.leaves(_edges(s, d))


@query
def graph_most_called(s, d):
    return G.in_degree(_edges(s, d)).orderBy(F.desc("callers"), "id").limit(20)


@query
def graph_depth(s, d):
    e = _edges(s, d)
    return G.levels(e, G.roots(e)).groupBy("level").agg(F.count("*").alias("nodes"))


@query
def graph_components(s, d):
    return G.components(_edges(s, d)).groupBy("component").agg(F.count("*").alias("size"))


@query
def graph_toposort(s, d):
    order, _ = G.peel(_edges(s, d))
    return order.groupBy("level").agg(F.count("*").alias("nodes"))


@query
def graph_cycles(s, d):
    _, rest = G.peel(_edges(s, d))
    return rest.agg(F.count("*").alias("edges_left"), (F.count("*") > 0).alias("cyclic"))


def _hierarchy(s, d) -> DataFrame:
    r = table(s, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey")).alias("id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("name"))
    n = table(s, d, "nation").select(F.concat(F.lit("n"), F.col("n_nationkey")).alias("id"), F.concat(F.lit("r"), F.col("n_regionkey")).alias("parent_id"), F.col("n_name").alias("name"))
    c = table(s, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey")).alias("id"), F.concat(F.lit("n"), F.col("c_nationkey")).alias("parent_id"), F.col("c_name").alias("name"))
    return r.unionByName(n).unionByName(c)


@query
def hierarchy_path(s, d):
    return G.ancestors(_hierarchy(s, d))


@query
def hierarchy_children(s, d):
    h = _hierarchy(s, d)
    return h.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"), F.min("name").alias("first_child"))


@query
def hierarchy_siblings(s, d):
    n = table(s, d, "nation")
    sizes = n.groupBy("n_regionkey").agg((F.count("*") - 1).alias("siblings"))
    return n.join(sizes, "n_regionkey").select("n_nationkey", "siblings")


# concepts and intents


def _concepts(s, d) -> DataFrame:
    c = table(s, d, "concepts")
    return c.withColumn("concept", C.concept(F.col("name"), F.lit("function"), F.col("documentation"), F.col("visibility"))).withColumn("lines", F.greatest(F.col("end_line") - F.col("start_line") + 1, F.lit(0))).withColumn("score", F.round(C.relevance(F.col("concept"), F.col("documentation"), F.col("visibility"), F.col("lines"), F.col("name")), 4))


@query
def concept_infer(s, d):
    return _concepts(s, d).select("concept_no", "concept")


@query
def relevance_score(s, d):
    return _concepts(s, d).select("concept_no", "score")


@query
def reading_decision(s, d):
    return _concepts(s, d).groupBy(C.reading_decision(F.col("score")).alias("decision")).agg(F.count("*").alias("n"), F.sum(F.greatest(F.ceil(F.col("lines") / 20) + F.col("documentation").isNotNull().cast("int"), F.lit(1))).cast("bigint").alias("minutes"))


@query
def explore_plan(s, d):
    return _concepts(s, d).where("score >= 0.4").orderBy(F.desc("score"), "concept_no").limit(50).select("concept_no", "name", "score")


@query
def lang_balanced_top(s, d):
    top = _concepts(s, d).orderBy(F.desc("score"), "concept_no").limit(30)
    w = Window.partitionBy("language").orderBy(F.desc("score"), "concept_no")
    return top.withColumn("r", F.row_number().over(w)).where("r <= 8").select("concept_no", "language", F.col("r").alias("rank"))


@query
def noise_filter(s, d):
    c = table(s, d, "concepts")
    return c.where(~F.rlike(F.lower("name"), F.lit("test|mock|debug|trace")) & ~F.coalesce("is_deprecated", F.lit(False))).groupBy("language").agg(F.count("*").alias("n"))


@query
def name_normalize(s, d):
    return table(s, d, "concepts").select("concept_no", S.normal_name(F.col("name")).alias("normal"))


@query
def equivalence_classes(s, d):
    return M.equal_names(table(s, d, "concepts"))


@query
def equivalents_theta(s, d):
    return M.similar(table(s, d, "concepts"), 0.7)


@query
def group_namer(s, d):
    """Dominant concept of a file if it has at least 40 percent, else the file's directory."""
    c = _concepts(s, d).groupBy("file_id", "concept").agg(F.count("*").alias("n"))
    best = c.groupBy("file_id").agg(F.sum("n").alias("total"), F.min_by("concept", F.struct(-F.col("n"), F.col("concept"))).alias("concept"), F.max("n").alias("n"))
    return best.join(table(s, d, "file_entries").select("file_id", S.top_dir(S.clean_path(F.col("path"))).alias("dir")), "file_id").select("file_id", F.when(F.col("n") * 100 >= 40 * F.col("total"), F.col("concept")).otherwise(F.col("dir")).alias("group_name"))


# sets, state folds


@query
def union_last_wins(s, d):
    """Processed files over file entries, the later source winning for a repository and path."""
    a = files(s, d).groupBy("repo_id", "path").agg(F.max("file_id").alias("id")).withColumn("source", F.lit(0))
    b = table(s, d, "processed_files").withColumn("path", S.clean_path(F.col("path"))).groupBy("repo_id", "path").agg(F.max("proc_id").alias("id")).withColumn("source", F.lit(1))
    return a.unionByName(b).groupBy("repo_id", "path").agg(F.max_by("id", "source").alias("id"), F.max("source").alias("source"))


@query
def set_diff_quality(s, d):
    """Retrieval quality of the earlier extractor: functions it lists against functions found in the text."""
    a = regex_symbol_extract(s, d).where(F.col("kind").isin("fn", "def", "func", "function")).select("file_id", "name").distinct().withColumn("a", F.lit(1))
    b = table(s, d, "concepts").where("name is not null").select("file_id", "name").distinct().withColumn("b", F.lit(1))
    both = a.join(b, ["file_id", "name"], "full").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("matched"), F.count_if(F.col("b").isNull()).alias("missed"), F.count_if(F.col("a").isNull()).alias("extra"))
    return both.select("matched", "missed", "extra", F.round(F.try_divide(F.col("matched"), F.col("matched") + F.col("extra")), 6).alias("precision"), F.round(F.try_divide(F.col("matched"), F.col("matched") + F.col("missed")), 6).alias("recall"))


@query
def faded_patterns(s, d):
    return table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n")).where("n >= 5").select("user_id", "event_type", "n")


@query
def last_50(s, d):
    w = Window.partitionBy("user_id").orderBy(F.desc("ts"), F.desc("event_id"))
    return table(s, d, "events").withColumn("r", F.row_number().over(w)).where("r <= 50").select("user_id", "event_id", F.col("r").alias("rank"))


@query
def event_windows(s, d):
    e = table(s, d, "events")
    return e.groupBy(F.window("ts", "1 day").alias("w"), "event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total")).select(F.date_format("w.start", "yyyy-MM-dd").alias("day"), "event_type", "n", "total")


@query
def ema_utility(s, d):
    from ..streaming.state import ema_batch

    e = table(s, d, "events").where("value is not null").select(F.col("user_id").cast("string").alias("path"), F.least(F.greatest(F.col("value") / 100, F.lit(0.0)), F.lit(1.0)).alias("utility"), F.struct("ts", "event_id").alias("seq"))
    return ema_batch(e).select("path", F.round("score", 5).alias("score"), "reports")


# parsers and plugins


@query
def ast_declarations(s, d):
    from ..operators.syntax_tree import declarations

    return declarations(files(s, d)).select("file_id", "decl_id", "parent_id", "depth", "kind", "name", "start_line", "end_line")


@query
def skeleton(s, d):
    from ..operators.syntax_tree import compression

    return compression(files(s, d).withColumn("language", S.language(F.col("path"))))


@query
def plugin_metric(s, d):
    from ..operators.plugins import standard

    return standard().run(files(s, d)).where("value is not null").groupBy("plugin").agg(F.count("*").alias("files"), F.max("value").alias("most"))


@query
def plugin_tags(s, d):
    from ..operators.plugins import standard

    return standard().run(files(s, d)).where("tag is not null").groupBy("tag").agg(F.count("*").alias("files"))


@query
def import_modules(s, d):
    return T.imports(files(s, d), "file_id", "content").groupBy("module").agg(F.count("*").alias("files"))


@query
def graph_scc(s, d):
    return G.strongly_connected(_edges(s, d)).groupBy("component").agg(F.count("*").alias("size")).where("size > 1")


@query
def zoom_symbol(s, d):
    """Point query: the file and lines of a symbol, with eight lines of context."""
    sy = regex_symbol_extract(s, d)
    first = sy.groupBy("name").agg(F.min_by(F.struct("file_id", "line_no"), F.struct("file_id", "line_no")).alias("at"), F.count("*").alias("places"))
    f = files(s, d).select("file_id", "path", S.line_array(F.col("content")).alias("lines"))
    return first.select("name", "places", "at.*").join(f, "file_id").select("name", "places", "file_id", "line_no", F.md5(F.array_join(F.slice("lines", F.col("line_no"), 8), "\n")).alias("excerpt_md5"))


@query
def nation_rollup(s, d):
    """Hierarchy sums: orders by region and nation, with subtotals."""
    c = table(s, d, "customer").join(table(s, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(table(s, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    o = table(s, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("orders"))
    return c.join(o, F.col("c_custkey") == F.col("o_custkey")).rollup("r_name", "n_name").agg(F.sum("orders").alias("orders")).select("r_name", "n_name", "orders")


@query
def symbol_vectors(s, d):
    """Feature vectors of all concepts, as (concept, position, value) of the positions that are not zero."""
    from ..operators.features import vector

    c = table(s, d, "concepts")
    v = vector(F.col("name"), F.lit("function"), F.lit(""), F.col("documentation"), F.lit(0), F.greatest(F.col("end_line") - F.col("start_line"), F.lit(0)), F.coalesce(F.size("dependencies"), F.lit(0)))
    return c.select("concept_no", F.posexplode(v).alias("position", "value")).where("value <> 0").select("concept_no", "position", F.round("value", 6).alias("value"))
