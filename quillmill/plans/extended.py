"""Further queries: budget strategies, lenses and intents, history by directory, graphs, clusters, text, state."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import budget as B
from ..operators import classify as C
from ..operators import filters as P
from ..operators import graph as G
from ..operators import history as H
from ..operators import semantic as X
from ..operators import shell
from ..operators import text as T
from ..operators import vectors as V
from ..plans import render as R
from ..session import shared_folder, table
from ..streaming import state
from .queries import BUDGET, _calls_in, _concepts, _edges, _ranked, churn_per_key, events, files, query, regex_symbol_extract

# budgets and lenses


@query
def lens_apply(s, d):
    """Files each lens keeps by its patterns, with the order it asks for."""
    f = files(s, d).select("file_id", "path", "mtime")
    out = None
    for lens, rule in C.LENS_RULES.items():
        part = f.where(C.lens_keeps(F.col("path"), lens)).select(F.lit(lens).alias("lens"), "file_id", F.lit(rule["truncate"]).alias("truncate"), F.lit(" ".join(rule["sort"])).alias("order"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def lens_structured(s, d):
    return files(s, d).select("file_id", C.structured(F.col("path"), "architecture").alias("structured"))


@query
def whitelist_strict(s, d):
    return files(s, d).where(P.whitelisted(F.col("path"), ["*.py", "**/config/*.js", "Cargo.toml"])).select("file_id")


@query
def budget_truncate(s, d):
    """Files in full while they fit, else reduced to their structure while that fits."""
    return B.greedy(_ranked(s, d), "file_id", ["tier_rank", "minus_priority", "path", "file_id"], "grouped", BUDGET, "reduced")


@query
def budget_raw(s, d):
    """The core's greedy form: tier and priority decide, the cost is the content's alone."""
    f = _ranked(s, d).withColumn("raw", F.col("bytes_tokens"))
    return B.greedy(f, "file_id", ["tier_rank", "minus_priority", "file_id"], "raw", BUDGET).select("file_id", "cost")


@query
def budget_adaptive_upgrade(s, d):
    """Twenty thousand tokens more than all skeletons need: the files made full with them."""
    f = _ranked(s, d)
    spare = f.agg(F.coalesce(F.sum("reduced"), F.lit(0))).first()[0] + 20_000
    return B.adaptive(f, "file_id", "tier", "reduced", "cost", spare).where("level = 'full'").select("file_id", "level")


@query
def budget_applied(s, d):
    """Tokens of each level once the allocation is applied to contents."""
    f = _ranked(s, d)
    levels = B.adaptive(f, "file_id", "tier", "reduced", "cost", BUDGET)
    body = files(s, d).select("file_id", "content", T.truncate_structure(F.col("content")).alias("small"))
    return B.applied(body, levels, "file_id", "content", "small").groupBy("level").agg(F.count("*").alias("files"), F.sum(S.tokens(F.col("content"))).alias("tokens"))


@query
def sort_files(s, d):
    """Ranks of a repository's files by name and by both instants, paths and ids breaking ties."""
    f = files(s, d).where("mtime is not null and ctime is not null")
    by = lambda *order: F.row_number().over(Window.partitionBy("repo_id").orderBy(*order))
    return f.select("file_id", by("path", "file_id").alias("by_name"), by(F.desc("mtime"), "path", "file_id").alias("by_mtime"), by("ctime", "path", "file_id").alias("by_ctime"))


# labels and scalars


@query
def extension_labels(s, d):
    e = S.extension(F.col("path"))
    return files(s, d).select("file_id", S.by_map(e, S.FENCE_BY_EXTENSION, "").alias("fence"), S.by_map(e, S.GRAMMAR_BY_EXTENSION, "unknown").alias("grammar"))


@query
def formats(s, d):
    f = files(s, d)
    return f.select("file_id", S.thousands(F.octet_length("content")).alias("bytes_text"), S.qualified_name(S.parent_dir(F.col("path")), F.regexp_extract("path", "([^/]*)$", 1)).alias("qualified"), S.path_from(F.col("path"), "src").alias("below_src"), S.contained(F.col("path")).alias("contained"), S.safe_path(F.col("path")).alias("safe"))


@query
def compact_times(s, d):
    e = H.with_now(events(s, d))
    return e.select("event_no", S.compact_time(F.col("ts"), F.col("as_of")).alias("age"))


@query
def input_type(s, d):
    n = F.col("files")
    g = files(s, d).groupBy("repo_id").agg(F.count("*").alias("files"))
    return g.select("repo_id", "files", F.when(n == 1, "file").when(n < 50, "small").when(n > 500, "large").otherwise("medium").alias("input_type"))


@query
def repo_languages(s, d):
    """First and second language of every repository by its files."""
    n = files(s, d).groupBy("repo_id", S.language(F.col("path")).alias("language")).agg(F.count("*").alias("n"))
    w = Window.partitionBy("repo_id").orderBy(F.desc("n"), "language")  # one row a language
    r = n.withColumn("r", F.row_number().over(w)).where("r <= 2")
    return r.groupBy("repo_id").agg(F.max(F.when(F.col("r") == 1, F.col("language"))).alias("first"), F.max(F.when(F.col("r") == 2, F.col("language"))).alias("second"))


@query
def language_index(s, d):
    """Symbols by language and kind."""
    sy = regex_symbol_extract(s, d).join(files(s, d).select("file_id", S.language(F.col("path")).alias("language")), "file_id")
    return sy.groupBy("language", "kind").agg(F.count("*").alias("n"))


# intents


@query
def intent_scores(s, d):
    c = _concepts(s, d)
    score = lambda intent: F.round(C.relevance(F.col("concept"), F.col("documentation"), F.col("visibility"), F.col("lines"), F.col("name"), intent), 4).alias(intent)
    return c.select("concept_no", *[score(i) for i in C.INTENTS])


@query
def intent_decisions(s, d):
    """Decisions for every intent by relevance, complexity and how often a concept is used."""
    c = _concepts(s, d)
    used = _edges(s, d).groupBy(F.col("dst").alias("name")).agg(F.count("*").alias("uses"))
    c = c.join(used, "name", "left").withColumn("centrality", F.least(F.coalesce("uses", F.lit(0)) / 10.0, F.lit(1.0))).withColumn("complexity", F.coalesce(F.col("complexity_score").cast("double") / 20.0, F.lit(0.0)))
    out = None
    for intent in C.INTENTS:
        score = F.round(C.relevance(F.col("concept"), F.col("documentation"), F.col("visibility"), F.col("lines"), F.col("name"), intent), 4)
        part = c.withColumn("score", score).groupBy(F.lit(intent).alias("intent"), C.intent_decision(F.col("score"), F.col("complexity"), F.col("centrality"), intent).alias("decision")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def intent_score(s, d):
    """Scores by universal type for a reader at home in Python, half at home in Rust."""
    c = _concepts(s, d).withColumn("kind", X.universal_type(F.col("concept")))
    familiar = F.when(F.col("language") == "python", 1.0).when(F.col("language") == "rust", 0.5).otherwise(0.0)
    return c.select("concept_no", "kind", *[F.round(X.intent_score(F.col("kind"), i, familiar), 4).alias(i) for i in X.INTENT_TYPES])


@query
def type_similarities(s, d):
    """Pairs of concept types that occur, with their similarity and how many concepts each has."""
    n = _concepts(s, d).groupBy(X.universal_type(F.col("concept")).alias("kind")).agg(F.count("*").alias("n"))
    a, b = n.select(F.col("kind").alias("a"), F.col("n").alias("na")), n.select(F.col("kind").alias("b"), F.col("n").alias("nb"))
    return a.join(b, F.col("a") <= F.col("b")).select("a", "b", "na", "nb", X.type_similarity(F.col("a"), F.col("b")).alias("similarity"))


@query
def explore_time(s, d):
    """The business-logic plan: at most 25 elements in 30 minutes."""
    c = _concepts(s, d).where("score >= 0.3").withColumn("minutes", F.greatest(F.ceil(F.col("lines") / 20) + F.col("documentation").isNotNull().cast("int"), F.lit(1)).cast("bigint"))
    return X.time_plan(c, 30, [F.desc("score"), F.col("concept_no")], 25).select("rank", "concept_no", "decision")


@query
def group_brightest(s, d):
    return X.brightest(_concepts(s, d).where("file_id is not null"), "file_id", "score").where("is_brightest").select("file_id", "concept_no")


@query
def group_statistics(s, d):
    return X.group_stats(_concepts(s, d).where("file_id is not null"), "file_id", "score", "concept").select("file_id", "size", F.round(F.col("mean_score") * F.col("size"), 4).alias("total_score"), "top_score", "dominant")


@query
def next_step(s, d):
    """What to read next in every file: by its best symbol and how alike its scores are."""
    g = _concepts(s, d).where("file_id is not null").groupBy("file_id").agg(F.max("score").alias("top"), (1 - (F.max("score") - F.min("score"))).alias("cohesion"))
    action, priority = X.next_step(F.col("top"), F.round("cohesion", 4))
    return g.select("file_id", action.alias("action"), priority.alias("priority"))


@query
def canonical_names(s, d):
    return X.canonical_names(_concepts(s, d).where("file_id is not null"), "file_id").select("file_id", "canonical", "members")


@query
def name_patterns(s, d):
    return X.common_pattern(_concepts(s, d).where("file_id is not null"), "file_id")


@query
def bright_items(s, d):
    p = table(s, d, "processed_files").where("utility is not null")
    return p.groupBy(C.brightness(F.col("utility")).alias("brightness")).agg(F.count("*").alias("n"), F.count_if(F.col("utility") >= 0.8).alias("bright"))


# text


@query
def truncate_markdown(s, d):
    return files(s, d).where(F.lower("path").endswith(".md")).select("file_id", F.md5(T.truncate_markdown(F.col("content"), 12, F.col("path"))).alias("md5"))


@query
def truncate_smart_text(s, d):
    return files(s, d).select("file_id", F.md5(T.truncate_smart(F.col("content"), 70)).alias("md5"))


@query
def signature_counts(s, d):
    return T.signature_counts(files(s, d), "file_id", "content", S.extension(F.col("path")))


@query
def truncation_statistics(s, d):
    """What truncation by structure saves in each language."""
    f = files(s, d).select(S.language(F.col("path")).alias("language"), S.tokens(F.col("content")).alias("full"), S.tokens(T.truncate_structure(F.col("content"))).alias("small"))
    return f.groupBy("language").agg(F.count("*").alias("files"), F.sum("full").alias("full_tokens"), F.sum("small").alias("kept_tokens"), F.round(F.try_divide(100.0 * F.sum(F.col("full") - F.col("small")), F.sum("full")), 4).alias("saved_percent"))


@query
def doc_comments(s, d):
    return T.doc_before(files(s, d), "file_id", "content")


@query
def parameter_counts(s, d):
    return T.parameters(files(s, d), "file_id", "content")


@query
def metric_avg_params(s, d):
    p = T.parameters(files(s, d), "file_id", "content").groupBy("file_id").agg(F.count("*").alias("callables"), F.sum("n_params").alias("params"), F.count_if(F.col("n_params") > 5).alias("heavy"))
    return p.select("file_id", "callables", "heavy", F.round(F.col("params") / F.col("callables"), 4).alias("avg_params"))


@query
def decorator_categories(s, d):
    py = files(s, d).where(F.lower("path").endswith(".py"))
    return T.decorators(py, "file_id", "content").groupBy("category").agg(F.count("*").alias("n"), F.count_distinct("decorator").alias("decorators"))


@query
def task_markers(s, d):
    return T.markers(files(s, d), "file_id", "content")


@query
def shell_pattern_scores(s, d):
    sh = files(s, d).where(F.lower("path").endswith(".sh"))
    return sh.select("file_id", shell.dialect(F.col("content")).alias("dialect"), shell.primary(F.col("content")).alias("primary"), F.posexplode(shell.vector(F.col("content"))).alias("position", "confidence")).where("confidence > 0")


@query
def pattern_set(s, d):
    """How many files hold each pattern of a set, and how often it occurs."""
    patterns = {"url": r"https?://[a-z0-9.]+", "number": r"[0-9]+", "todo": r"TODO|FIXME", "quoted": r'"[^"\n]*"', "call": r"[A-Za-z_]\w*\("}
    hits = F.explode(F.array(*[F.struct(F.lit(k).alias("pattern"), F.regexp_count("content", F.lit(v)).cast("bigint").alias("n")) for k, v in patterns.items()]))
    return files(s, d).select(hits.alias("h")).where("h.n > 0").groupBy("h.pattern").agg(F.count("*").alias("files"), F.sum("h.n").alias("matches"))


@query
def regex_rewrites(s, d):
    """Replace, split and captures of expressions."""
    c = F.col("content")
    return files(s, d).select("file_id", F.md5(F.regexp_replace(c, r"[0-9]+", "#")).alias("replaced"), F.size(F.split(c, r"[;,]")).cast("bigint").alias("pieces"), F.regexp_extract(c, r"([a-z_]+)\(([a-z_]+)", 1).alias("caller"), F.regexp_extract(c, r"([a-z_]+)\(([a-z_]+)", 2).alias("argument"))


# history


def _file_history(s, d) -> DataFrame:
    """Churn of every file with its callables and the share of marked lines as its debt."""
    per = regex_symbol_extract(s, d).join(files(s, d).select("file_id", "repo_id", "path"), "file_id").groupBy("repo_id", "path").agg(F.count("*").alias("callables"))
    debt = files(s, d).select("repo_id", "path", (F.size(F.filter(S.line_array(F.col("content")), lambda x: F.rlike(x, F.lit("TODO|FIXME|XXX")))) / F.size(S.line_array(F.col("content")))).alias("debt")).groupBy("repo_id", "path").agg(F.max("debt").alias("debt"))
    c = churn_per_key(s, d).withColumn("path", S.clean_path(F.col("path"))).groupBy("repo_id", "path").agg(F.sum("n30").alias("n30"), F.sum("n90").alias("n90"), F.max("age_days").alias("age_days"), F.min("dormant_days").alias("dormant_days"))
    return c.join(per, ["repo_id", "path"], "left").join(debt, ["repo_id", "path"], "left").withColumn("callables", F.coalesce("callables", F.lit(0))).withColumn("debt", F.coalesce("debt", F.lit(0.0)))


@query
def geological_summary(s, d):
    return H.geology(_file_history(s, d))


@query
def ancient_files(s, d):
    return H.ancient_files(_file_history(s, d), days=365).select("repo_id", "path", "dormant_days", "callables", "is_core")


@query
def risk_ranking(s, d):
    """Files under stress by the reference's limits, most at risk first."""
    r = _file_history(s, d).withColumn("risk", F.round(H.tectonic_mean(F.col("n90"), F.col("debt")), 6))
    return r.where("risk is not null").orderBy(F.desc("risk"), "repo_id", "path").select("repo_id", "path", "risk")


@query
def drift_by_dir(s, d):
    f = _file_history(s, d).where("callables > 0").withColumn("dir", S.top_dir(F.col("path")))
    return H.dir_drift(f, "dir")


@query
def drift_class(s, d):
    f = _file_history(s, d)
    per = f.groupBy("repo_id").agg(F.sum("callables").alias("total"), F.coalesce(F.sum(F.when(F.col("dormant_days") < 180, F.col("callables"))), F.lit(0)).alias("moved"))
    rate = F.try_divide(F.col("moved") * 100.0, F.col("total")) * 365.0 / 180
    return per.select("repo_id", F.round(rate, 4).alias("drift_per_year"), C.drift_class(rate).alias("drift"))


@query
def age_class(s, d):
    return churn_per_key(s, d).groupBy("repo_id", C.age_class(F.col("age_days")).alias("age_class")).agg(F.count("*").alias("files"))


# vectors and clusters


@query
def silhouette_by_label(s, d):
    v = V.silhouettes(table(s, d, "embeddings"), "label")
    return v.select("vec_id", "label", *[F.round(c, 4).alias(c) for c in ("a", "b", "silhouette")])


@query
def components_by_similarity(s, d):
    """Vectors alike in their first three positions."""
    e = table(s, d, "embeddings").withColumn("embedding", F.slice("embedding", 1, 3))
    c = V.similar_components(e, 0.99, cells=3)
    return c.groupBy("component").agg(F.count("*").alias("size"))


@query
def class_cohesion(s, d):
    return X.class_cohesion(table(s, d, "embeddings"), "label").select("label", "members", F.round("cohesion", 5).alias("cohesion"))


@query
def vector_fit(s, d):
    """Vectors clamped and brought to 48 and 80 positions, by what is left of them."""
    e = table(s, d, "embeddings")
    total = lambda v: F.round(F.aggregate(v, F.lit(0.0), lambda a, x: a + x), 4)
    return e.select("vec_id", total(V.fitted(F.col("embedding"), 48)).alias("short"), total(V.fitted(F.col("embedding"), 80)).alias("long"), F.size(V.fitted(F.col("embedding"), 80)).alias("size"), V.vector_similarity(F.col("embedding"), V.fitted(F.col("embedding"), 48)).alias("other_size"))


@query
def weighted_vectors(s, d):
    """Positions scaled by label: the first eight of even labels count double."""
    e = table(s, d, "embeddings")
    w = e.select("label").distinct().where("label % 2 = 0").select("label", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("dim")).withColumn("weight", F.lit(2.0))
    return V.weighted(e, w, "label").groupBy("vec_id").agg(F.round(F.sum("x"), 4).alias("total"))


@query
def best_partner(s, d):
    """The most alike vector of every query."""
    e = table(s, d, "embeddings")
    near = V.nearest(e.where("vec_id % 50 = 0"), e, V.cosine, 3, True)
    return X.best_match(near, "query", "vec_id", "score").select("query", F.round("score", 5).alias("score"))


# graphs


@query
def graph_neighbors(s, d):
    n = G.neighbors(_edges(s, d))
    return n.select("id", F.array_join("callers", ",").alias("callers"), F.array_join("callees", ",").alias("callees"))


@query
def graph_reachable(s, d):
    """What the least root reaches."""
    e = _edges(s, d)
    return G.reachable(e, G.roots(e).orderBy("id").limit(1))


@query
def graph_shortest_path(s, d):
    """From the least root of the deepest reach to the least of the nodes farthest from all roots."""
    e = _edges(s, d)
    far = G.levels(e, G.roots(e)).orderBy(F.desc("level"), "id").first()
    back = G.levels(e.select(F.col("dst").alias("src"), F.col("src").alias("dst")), s.createDataFrame([(far["id"],)], "id string")).join(G.roots(e), "id").orderBy("level", "id").first() if far else None
    return G.shortest_path(e, back["id"] if back else "", far["id"] if far else "").groupBy("step").agg(F.count("*").alias("nodes"))


@query
def graph_metadata(s, d):
    return G.metadata(_edges(s, d))


@query
def graph_without(s, d):
    """Edges left when the five nodes of most callers are removed."""
    e = _edges(s, d)
    gone = G.in_degree(e).orderBy(F.desc("callers"), "id").limit(5).select("id")
    return G.without(e, gone).agg(F.count("*").alias("edges"), F.count_distinct("src").alias("sources"))


@query
def call_graph(s, d):
    """Edges between files: to the file that defines a called name, else to an external node."""
    c = T.calls(files(s, d), "file_id", "content").select(F.col("file_id").cast("string").alias("src"), "callee")
    defined = regex_symbol_extract(s, d).where(F.col("kind").isin("fn", "def", "func", "function")).select(F.col("file_id").cast("string").alias("id"), "name").distinct()
    nodes, edges = G.call_edges(c, defined)
    kinds = nodes.groupBy("id").agg(F.min("kind").alias("kind"))
    return edges.join(kinds, F.col("dst") == F.col("id")).groupBy("kind").agg(F.count("*").alias("edges"), F.count_distinct("dst").alias("nodes"))


@query
def breadcrumb(s, d):
    """Paths of a hierarchy as steps from the root."""
    from .queries import _hierarchy

    return G.ancestors(_hierarchy(s, d)).select("id", F.concat_ws(" > ", F.split("path", "/")).alias("crumbs"), (F.col("depth") + 1).alias("steps"))


# state and streams


def _user_actions(s, d) -> DataFrame:
    """Events as actions of a history: views are recorded, errors undo, purchases redo."""
    e = table(s, d, "events")
    kinds = F.when(F.pmod("event_id", F.lit(5)) == 3, "undo").when(F.pmod("event_id", F.lit(7)) == 5, "redo").otherwise("record")
    return e.select("user_id", F.struct("ts", "event_id").alias("seq"), kinds.alias("action"), F.col("event_id").alias("item"))


@query
def undo_redo(s, d):
    """Where every user's history of at most 50 items stands after all actions."""
    h = state.undo_redo(_user_actions(s, d), "user_id")
    return h.select("user_id", "at", F.size("items").alias("size"), F.get("items", F.col("at")).alias("current"))


@query
def marked_paths(s, d):
    e = table(s, d, "events").select(F.col("user_id").cast("string").alias("path"), F.when(F.col("event_type") == "view", "view").otherwise("mark").alias("kind"), (F.col("value") / 100).alias("utility"), F.struct("ts", "event_id").alias("seq"))
    return state.marks(e).select("path", F.round("utility", 6).alias("utility"), "views")


@query
def stream_windows(s, d):
    """The daily windows as a stream, run to its end."""
    e = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d).withColumn("ts", F.col("ts").cast("timestamp"))
    out = state.to_end(state.windows_stream(e, late="60 days"), shared_folder(s))
    return out.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", "n", F.round("total", 2).alias("total"))


@query
def stream_faded(s, d):
    """Counts of ignored patterns as a stream, run to its end."""
    e = s.readStream.schema(table(s, d, "events").schema).option("pathGlobFilter", "events.parquet").parquet(d)
    return state.to_end(state.ignored_stream(e.select(F.col("event_type").alias("pattern"))), shared_folder(s))


@query
def retrieval_quality(s, d):
    """Precision, recall and F1 of the earlier extractor in every language."""
    from ..functions.scalars import language

    f = files(s, d).select("file_id", language(F.col("path")).alias("language"))
    a = regex_symbol_extract(s, d).where(F.col("kind").isin("fn", "def", "func", "function")).select("file_id", "name").distinct().withColumn("a", F.lit(1))
    b = table(s, d, "concepts").where("name is not null").select("file_id", "name").distinct().withColumn("b", F.lit(1))
    n = a.join(b, ["file_id", "name"], "full").join(f, "file_id").groupBy("language").agg(F.count_if(F.col("a").isNotNull() & F.col("b").isNotNull()).alias("hit"), F.count_if(F.col("a").isNotNull()).alias("wanted"), F.count_if(F.col("b").isNotNull()).alias("given"))
    return n.select("language", F.round(F.try_divide("hit", "given"), 6).alias("precision"), F.round(F.try_divide("hit", "wanted"), 6).alias("recall"), F.round(F.try_divide(2 * F.col("hit"), F.col("given") + F.col("wanted")), 6).alias("f1"))


@query
def edge_endpoints(s, d):
    """Edges with the language of the concept they begin at and, where it is known, of the one they name."""
    c = table(s, d, "concepts")
    e = c.select("concept_no", F.col("language").alias("from_language"), F.explode("dependencies").alias("name"))
    to = c.where("name is not null").groupBy("name").agg(F.min("language").alias("to_language"))
    return e.join(to, "name", "left").groupBy("from_language", F.coalesce("to_language", F.lit("external")).alias("to_language")).agg(F.count("*").alias("edges"))


@query
def calls_by_name(s, d):
    """Names by how many files call them, the most called first."""
    return _calls_in(s, d).orderBy(F.desc("callers"), "callee").limit(100)


# core layouts and predicates


def _processed(s, d) -> DataFrame:
    return table(s, d, "processed_files").where("content is not null")


@query
def render_core_plusminus(s, d):
    p = _processed(s, d)
    return p.select("proc_id", F.md5(R.core_plus_minus(F.col("path"), F.col("content"), F.col("md5"), F.col("compression_level"), F.col("original_tokens"))).alias("digest"))


@query
def render_core_xml(s, d):
    p = _processed(s, d)
    return p.select("proc_id", F.md5(R.core_xml(F.col("path"), F.col("content"), F.col("md5"), F.col("language"), F.col("compression_level"), F.col("original_tokens"), F.lit(None).cast("double"))).alias("digest"))


@query
def render_core_markdown(s, d):
    p = _processed(s, d)
    return p.select("proc_id", F.md5(R.core_markdown(F.col("path"), F.col("content"), F.col("compression_level"), F.col("original_tokens"))).alias("digest"))


@query
def path_predicates(s, d):
    p = F.col("path")
    return files(s, d).select("file_id", P.is_source(p).alias("is_source"), P.is_test(p).alias("is_test"), P.explorable(p, 3).alias("explorable"))


@query
def noise_by_intent(s, d):
    """Concepts that are no noise for each intent and relevant enough."""
    c, out = _concepts(s, d).where("name is not null"), None
    for intent, (_, _, least) in P.NOISE.items():
        score = F.round(C.relevance(F.col("concept"), F.col("documentation"), F.col("visibility"), F.col("lines"), F.col("name"), intent), 4)
        part = c.where(P.quiet(F.col("name"), F.col("concept"), intent) & (score >= least)).groupBy(F.lit(intent).alias("intent")).agg(F.count("*").alias("n"))
        out = part if out is None else out.unionByName(part)
    return out


@query
def concept_filters(s, d):
    """Concepts by language, type and name together."""
    c = _concepts(s, d).where(F.col("language").isin("python", "rust") & F.col("concept").isin("calculation", "validation", "decision") & F.contains(F.lower("name"), F.lit("e")))
    return c.select("concept_no", "language", "concept")


@query
def intent_pipeline(s, d):
    """The debugging pipeline in full: noise out, scored, the best thirty, each with its decision."""
    rule = C.INTENTS["debugging"]
    c = _concepts(s, d).where("name is not null")
    c = c.withColumn("score", F.round(C.relevance(F.col("concept"), F.col("documentation"), F.col("visibility"), F.col("lines"), F.col("name"), "debugging"), 4))
    kept = c.where(P.quiet(F.col("name"), F.col("concept"), "debugging") & (F.col("score") >= rule["least"])).orderBy(F.desc("score"), "concept_no").limit(rule["most"])
    return kept.select("concept_no", "concept", "score", C.intent_decision(F.col("score"), F.lit(0.0), F.lit(0.0), "debugging").alias("decision"))
