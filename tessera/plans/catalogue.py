"""The registered queries of the analytics engine over the driver's tables, and the same in DuckDB SQL.

Stand-ins: ``documents`` are chunks, ``events`` a commit log, ``conversations`` notes, ``lineitem`` the import graph
(consecutive returned lines of an order point from part to part).
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.text import advanced_relevance, js_imports, python_imports, readable_size, simple_relevance, tokens
from tessera.operators import graph, history, incremental, notes, retrieval, stats
from tessera.operators.cells import CellIndex
from tessera.operators.chunks import chunk_texts
from tessera.operators.complexity import function_complexity
from tessera.operators.contain import held_strings
from tessera.operators.latent import LatentModel
from tessera.operators.segments import SegmentedIndex
from tessera.sources import files as files_source
from tessera.sources import manifests, repository
from tessera.sources.shared import shared_dir, stored

QUERY = "the and of"
QUERIES = [(1, "the and of"), (2, "exception error handling that"), (3, "test with das der")]
SELF = 7
TOP = 10
#: Tasks a core that small rows are dealt to before large texts are made of them.
SPREAD = 4


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _index(spark, d) -> retrieval.Bm25Index:
    return retrieval.Bm25Index.build(_t(spark, d, "documents"), "doc_id", "text")


def _asked(spark, rows=((1, QUERY),)) -> DataFrame:
    return spark.createDataFrame(list(rows), "query_id long, query string")


def _vector_query(spark, d) -> DataFrame:
    return _t(spark, d, "embeddings").filter(F.col("vec_id") == SELF).select(F.lit(1).cast("long").alias("query_id"), F.col("embedding").alias("vector"))


_BM25_SQL = r"""
tok AS (SELECT doc_id AS id, list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '') AS words FROM documents),
dl AS (SELECT id, len(words) AS dl FROM tok),
corpus AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
post AS (SELECT id, term, count(*) AS tf FROM (SELECT id, unnest(words) AS term FROM tok) GROUP BY id, term),
raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM post, corpus GROUP BY term),
mean AS (SELECT avg(raw) AS mean_idf FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw, mean),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(list_filter(string_split_regex(lower(query), '\s+'), lambda x: x <> '')) AS term FROM asked) GROUP BY query_id, term),
scored AS (
  SELECT query_id, id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
  FROM qt JOIN post USING (term) JOIN idf USING (term) JOIN dl USING (id), corpus GROUP BY query_id, id),
kranked AS (SELECT query_id, id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM scored)"""
_ONE = f"asked AS (SELECT 1 AS query_id, '{QUERY}' AS query)"
_THREE = "asked AS (SELECT * FROM (VALUES " + ", ".join(f"({i}, '{q}')" for i, q in QUERIES) + ") v(query_id, query))"
_VECTOR_SQL = f"""
q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = {SELF}),
dist AS (SELECT vec_id AS id, label, round(1 - list_dot_product(embedding::DOUBLE[], v) / (sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) * sqrt(list_dot_product(v, v))), 6) AS distance FROM embeddings, q),
vranked AS (SELECT id, distance, row_number() OVER (ORDER BY distance, id) AS rank FROM dist)"""


def _hybrid_sql(n: int, many: int) -> str:
    return f"""{_ONE}, {_BM25_SQL}, {_VECTOR_SQL},
k AS (SELECT id, rank AS k_rank FROM kranked WHERE rank <= {many} AND score > 0),
v AS (SELECT id, rank AS v_rank, distance FROM vranked WHERE rank <= {many}),
fused AS (SELECT coalesce(v.id, k.id) AS id, distance, v_rank, k_rank, round(coalesce(1.0 / (60 + v_rank), 0) + coalesce(1.0 / (60 + k_rank), 0), 8) AS score FROM v FULL JOIN k ON v.id = k.id),
hits AS (SELECT * FROM (SELECT id, score, distance, row_number() OVER (ORDER BY score DESC, v_rank NULLS LAST, k_rank NULLS LAST) AS rank FROM fused) WHERE rank <= {n})"""


def bm25_topk(spark, d):
    return _index(spark, d).search(_asked(spark), TOP).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score")


def bm25_segments(spark, d):
    """Three changes end at the documents as they are: other texts first, then the right ones and some more, which go again."""
    docs = _t(spark, d, "documents").select("doc_id", "text")
    index = SegmentedIndex(spark, f"{shared_dir(spark)}/bm25-{uuid.uuid4().hex}", "long")
    odd = F.col("doc_id") % 2 == 1
    other = docs.select("doc_id", F.when(odd, F.concat_ws(" ", F.lit("the and of"), F.reverse("text"))).otherwise(F.col("text")).alias("text"))
    extra = docs.filter(odd).select((-1 - F.col("doc_id")).alias("doc_id"), "text")
    index.change(other, id_col="doc_id")
    index.change(docs.filter(odd).unionByName(extra), id_col="doc_id")
    index.compact()
    index.vacuum()
    index.change(removed=extra.select("doc_id"))
    found = stored(index.search(_asked(spark, QUERIES), 5), "found")
    index.clear()
    return found.select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score")


def bm25_term_stats(spark, d):
    return _index(spark, d).term_stats.select("term", "df", F.round("idf", 6).alias("idf"))


def _knn(vectors, spark, d, n=TOP):
    return retrieval.cosine_neighbours(vectors, _vector_query(spark, d), n)


def vector_knn(spark, d):
    return _knn(_t(spark, d, "embeddings"), spark, d).select(F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "distance")


def vector_knn_filtered(spark, d):
    return _knn(_t(spark, d, "embeddings").filter("label = 3"), spark, d).select(F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "distance")


def vector_cells(spark, d):
    """Neighbours of every fiftieth vector by the stored index, which got a third of its rows, and other vectors for some, by changes."""
    rows = _t(spark, d, "embeddings").select("vec_id", "embedding", "label")
    index = CellIndex(spark, f"{shared_dir(spark)}/cells-{uuid.uuid4().hex}", keep="label int")
    third = F.col("vec_id") % 3 == 0
    index.build(rows.withColumn("embedding", F.when(F.col("vec_id") % 3 == 1, F.reverse("embedding")).otherwise(F.col("embedding"))).filter(~third))
    index.change(rows.filter(F.col("vec_id") % 3 == 1).unionByName(rows.filter(third)))
    asked = rows.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    near = stored(index.search(asked, 5, exact=True), "near").withColumn("side", F.lit("all"))
    some = stored(index.search(asked, 5, where=F.col("label") == 3, exact=True), "near").withColumn("side", F.lit("label 3"))
    return near.unionByName(some).select("side", "query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("vec_id"), "distance")


def _hits(spark, d, n=TOP):
    return retrieval.hybrid(_index(spark, d), _t(spark, d, "embeddings"), _asked(spark), _vector_query(spark, d), n)


def rrf_hybrid(spark, d):
    return _hits(spark, d).select(F.col("rank").cast("long").alias("rank"), "id", "score", "distance")


def _rows(spark, d, n=TOP):
    return retrieval.search_rows(_hits(spark, d, n), _t(spark, d, "documents").select(F.col("doc_id").alias("id"), "source"))


def hybrid_summary(spark, d):
    out = retrieval.summary(_rows(spark, d), _t(spark, d, "documents").count())
    return out.select("n_results", "n_files", "avg_distance", "confidence", "coverage", F.size("suggestions").cast("long").alias("n_suggestions"))


def advanced_search(spark, d):
    kept = retrieval.keep_results(_rows(spark, d, 2 * TOP), TOP, exclude_dirs=["src0", "src1/"], min_relevance=0.3)
    return kept.select(F.col("rank").cast("long").alias("rank"), "id", "source", "advanced_relevance")


def multi_query_retrieval(spark, d):
    return _index(spark, d).search(_asked(spark, QUERIES), 5).select("query_id", F.col("rank").cast("long").alias("rank"), F.col("id").alias("doc_id"), "score")


def latent_topics(spark, d):
    """Vectors without an outside encoder: each document's strongest direction, counted by language."""
    docs = _t(spark, d, "documents")
    vectors = docs.select("lang", LatentModel.fit(docs, directions=16).vectors(F.col("text")).alias("v"))
    size = F.transform("v", lambda x: F.abs(x))
    strongest = F.when(F.array_max(size) > 0, F.array_position(size, F.array_max(size)))
    return vectors.select("lang", strongest.alias("direction")).groupBy("lang", "direction").agg(F.count("*").alias("n"))


def _steps(line):
    """Edges that the lines of whole orders make, repeated ones among them."""
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    both = line.select("l_returnflag", F.col("l_partkey").alias("src"), F.lead("l_partkey").over(w).alias("dst"), F.lead("l_returnflag").over(w).alias("next"))
    return both.filter("l_returnflag = 'R' and next = 'R'").select("src", "dst")


def _edges(spark, d):
    return graph.distinct_edges(_steps(_t(spark, d, "lineitem")))


def _graph(spark, d):
    """The edges as a table of their own, for the queries that read them again and again."""
    return stored(_edges(spark, d), "edges")


def _repository(spark, d):
    """The conversations as a repository: a branch for each, a commit for each turn, which writes the speaker's file in a folder of the conversation."""

    def branch(key, rows):
        out, files, parent = [], {}, []
        add = lambda kind, content: out.append((repository.object_name(kind, content), kind, content)) or out[-1][0]
        for r in rows.sort_values(["turn", "role", "text"]).itertuples():
            files[r.role] = add("blob", r.text.encode())
            folder = add("tree", repository.tree_content([("100644", f"{name}.txt", blob) for name, blob in files.items()]))
            tree = add("tree", repository.tree_content([(repository.FOLDER_MODE, str(key[0]), folder)]))
            parent = [add("commit", repository.commit_content(tree, parent, r.role, 1_700_000_000 + 60 * int(r.turn), f"conversation {key[0]} turn {r.turn}\n"))]
        return pd.DataFrame(out, columns=["id", "kind", "content"])

    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    made = rows.groupBy("conv_id").applyInPandas(branch, "id string, kind string, content binary")
    at = f"{shared_dir(spark)}/repository-{uuid.uuid4().hex}"
    repository.write_packs(made, at)
    found = repository.objects(spark, repository.Repository(at, at, None, "unknown"))
    return stored(repository.all_commits(found), "commits"), repository.all_trees(found)


def repository_commits(spark, d):
    """Packs that tasks wrote, read back by the data source: the log by author and day."""
    log = _repository(spark, d)[0]
    rest = F.count_if(F.size("parents") == 1).alias("with_parent")
    return log.groupBy("message", "author", F.unix_seconds("date").alias("seconds")).agg(F.count("*").alias("n"), rest)


def repository_changes(spark, d):
    """What each commit of these branches changed, by tree joins."""
    log, trees = _repository(spark, d)
    files = repository.changed_paths(log, log, stored(trees, "trees"))
    return log.join(files, "hash").select("message", "path", "status")


_EDGES_SQL = """edges AS (
  SELECT DISTINCT src, dst FROM (
    SELECT l_partkey AS src, l_returnflag AS f, lead(l_partkey) OVER w AS dst, lead(l_returnflag) OVER w AS g FROM lineitem
    WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate))
  WHERE f = 'R' AND g = 'R' AND dst IS NOT NULL AND src <> dst)"""


def _start(edges):
    return edges.agg(F.min("src").alias("node"))


def graph_edges(spark, d):
    return _edges(spark, d)


def _reached(spark, d, direction):
    edges = _graph(spark, d)
    return graph.reach(edges, _start(edges), 3, direction).select("node", F.col("depth").cast("long").alias("depth"))


def graph_downstream(spark, d):
    return _reached(spark, d, "downstream")


def graph_upstream(spark, d):
    return _reached(spark, d, "upstream")


def _reach_sql(a, b, limit):
    return f"""WITH RECURSIVE {_EDGES_SQL}, s AS (SELECT min(src) AS node FROM edges),
r AS (SELECT node, 0 AS depth FROM s UNION SELECT e.{b}, r.depth + 1 FROM r JOIN edges e ON e.{a} = r.node WHERE r.depth < {limit})
SELECT node, CAST(min(depth) AS BIGINT) AS depth FROM r GROUP BY node HAVING min(depth) > 0"""


def search_with_neighbours(spark, d):
    """The five best documents as nodes of the graph, and what is one step up or down from them, the first 20 by id.

    The search runs once. An edge at a hit comes from an order with a line of it, so only the lines of such orders are sorted.
    """
    best = stored(_hits(spark, d, 5).select(F.col("id").alias("node")), "best")
    line = _t(spark, d, "lineitem")
    orders = stored(line.join(best, F.col("l_partkey") == F.col("node"), "left_semi").select("l_orderkey").distinct(), "orders")
    return graph.neighbours(_steps(line.join(orders, "l_orderkey", "left_semi")), best).orderBy("node").limit(20)


def graph_shortest_path(spark, d):
    edges = _graph(spark, d)
    start = _start(edges).first().node
    ends = graph.reach(edges, _start(edges), 4).filter("depth = 4").agg(F.min("node").alias("n")).first().n
    found = graph.shortest_path(edges, start, ends if ends is not None else start, 10)
    return found.select(F.element_at("path", 1).alias("from_node"), F.element_at("path", -1).alias("to_node"), F.col("length").cast("long").alias("length"), F.array_join(F.transform("path", lambda x: x.cast("string")), ",").alias("path"))


def graph_closure_impact(spark, d):
    """Impact of the ten most imported parts over the whole graph."""
    edges = _graph(spark, d)
    starts = graph.imported_by(edges).orderBy(F.desc("importers"), "node").limit(10).select("node")
    return graph.change_impact(edges, starts)


def graph_impact_of_all(spark, d):
    """Impact of every part over the whole graph, by strong components and what lies between them."""
    return graph.impact_of_all(_graph(spark, d))


def graph_strong_components(spark, d):
    """How many parts each cycle of the graph holds."""
    return graph.strong_components(_graph(spark, d)).groupBy("component").agg(F.count("*").alias("size"), F.min("node").alias("smallest"))


def graph_cluster_jaccard(spark, d):
    return graph.clusters(_edges(spark, d), 0.3)


def graph_imported_by(spark, d):
    return graph.imported_by(_edges(spark, d)).withColumn("level", graph.relation_level(F.col("importers")))


def name_containment_join(spark, d):
    """Parts by the first words of part names that their names hold: how many parts hold each such word."""
    parts = _t(spark, d, "part")
    words = parts.select(F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("name")).distinct()
    return held_strings(parts, "p_partkey", F.lower("p_name"), words).groupBy(F.col("string").alias("name")).agg(F.count("*").alias("n"))


def line_scan_tags(spark, d):
    """Lines that name a licence, by language and in all."""
    rows = _t(spark, d, "documents").select("lang", F.explode(F.split("text", "\n")).alias("line"))
    hit = rows.select("lang", F.regexp_extract("line", r"(?i)\b(licensed|copyright|warranty)\b", 1).alias("tag")).filter("tag <> ''").withColumn("tag", F.lower("tag"))
    return hit.groupingSets([[F.col("lang"), F.col("tag")], [F.col("tag")], []], F.col("lang"), F.col("tag")).agg(F.count("*").alias("n"))


def section_carry_forward(spark, d):
    """The last role other than the assistant's, carried down the turns of each conversation."""
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    rows = _t(spark, d, "conversations")
    return rows.select("conv_id", "turn", F.last(F.when(F.col("role") != "assistant", F.col("role")), ignorenulls=True).over(w).alias("section"))


def group_counts_topk(spark, d):
    return stats.counts(_t(spark, d, "documents"), "source", top=TOP)


def idiom_counts(spark, d):
    table = {"lists": [[" | "]], "shouting": [["!! "]], "apache": [["Licensed", "Apache"]], "address": [["@"]], "assignment": [[" = "], [":="]]}
    return stats.idioms(_t(spark, d, "documents"), table, top=5)


def conditional_counts(spark, d):
    docs = _t(spark, d, "documents")
    return docs.agg(*[F.count_if(F.col("lang") == c).alias(f"n_{c}") for c in ("en", "de", "fr", "es")], F.count_if((F.col("n_chars") > 1500) & (F.col("lang") == "en")).alias("long_en"))


def numeric_summary_by_key(spark, d):
    docs = _t(spark, d, "documents")
    return docs.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("total"), F.round(F.avg("n_chars"), 4).alias("average"), F.count_if(F.col("n_chars") > 5000).alias("over"))


def _log(spark, d):
    e = _t(spark, d, "events")
    return e.select(F.col("event_id").cast("string").alias("hash"), F.substring(F.col("event_id").cast("string"), 1, 7).alias("short_hash"), F.col("event_type").alias("message"), F.col("user_id").alias("author"), F.col("ts").alias("date"), "event_id")


def _now(log):
    return log.agg(F.max("date").alias("now")).first().now


def author_stats(spark, d):
    log = _log(spark, d)
    return history.author_stats(log.filter(F.col("date") >= history.days_before(_now(log), 7)))


def recent_activity(spark, d):
    log = _log(spark, d).drop("hash").withColumn("hash", F.col("event_id"))
    return history.recent(log, 200, history.days_before(_now(log), 1)).select("event_id", "author", "message")


def latest_per_key(spark, d):
    log = _log(spark, d).drop("hash").withColumn("hash", F.col("event_id"))
    files = log.select("hash", F.concat(F.lit("user"), F.col("author").cast("string")).alias("path"))
    return history.latest_per_path(log, files, history.days_before(_now(log), 7)).select("path", F.col("hash").alias("event_id"), "message")


def json_map_stats(spark, d):
    props = _t(spark, d, "events").select("event_type", F.explode(F.from_json("props", "map<string,string>")).alias("key", "value"))
    return props.groupBy("event_type", "key").agg(F.count("*").alias("n"), F.countDistinct("value").alias("n_values"))


def html_extract(spark, d):
    pages = _t(spark, d, "pages")
    return pages.select("page_id", F.regexp_extract("html", r"<title>([^<]*)</title>", 1).alias("title"), F.size(F.regexp_extract_all("html", F.lit(r'href="([^"]*)"'), F.lit(1))).cast("long").alias("links"))


def _snapshots(spark, d):
    """The highest value of each user as a stamp: as of the last day, and as stored before it."""
    log = _t(spark, d, "events").select(F.col("user_id").alias("path"), F.col("value").alias("mtime"), "ts")
    cut = history.days_before(_now(log.withColumnRenamed("ts", "date")), 1)
    highest = lambda df: df.groupBy("path").agg(F.max("mtime").alias("mtime"))
    return highest(log.filter(F.col("ts") >= cut)), highest(log.filter(F.col("ts") < cut))


_SNAPSHOT_SQL = """m AS (SELECT max(ts) - INTERVAL 1 DAY AS cut FROM events),
cur AS (SELECT user_id AS path, max(value) AS mtime FROM events, m WHERE ts >= cut GROUP BY 1), old AS (SELECT user_id AS path, max(value) AS mtime FROM events, m WHERE ts < cut GROUP BY 1)"""


def changed_rows(spark, d):
    return incremental.changed(*_snapshots(spark, d))


def deleted_rows(spark, d):
    return incremental.deleted(*_snapshots(spark, d)).select("path")


def incremental_equals_full(spark, d):
    """Replacing the users that were active in the last day in the log of before gives the full log: differing rows."""
    full = _t(spark, d, "events").select(F.col("user_id").alias("source"), "event_id", "ts", "value")
    cut = history.days_before(_now(full.withColumnRenamed("ts", "date")), 1)
    active = full.filter(F.col("ts") >= cut).select("source").distinct()
    built = incremental.replaced(full.filter(F.col("ts") < cut), full.join(active, "source", "left_semi"), full.limit(0))
    return built.exceptAll(full).unionAll(full.exceptAll(built)).agg(F.count("*").alias("differences"))


def note_dedupe(spark, d):
    c = _t(spark, d, "conversations").select(F.col("role").alias("section"), F.col("text").alias("content"), "turn")
    return notes.new_entries(c.filter("turn < 2"), c.filter("turn >= 2")).groupBy("section").agg(F.count("*").alias("n"))


def new_entries_not_in_notes(spark, d):
    e = _t(spark, d, "events").select("event_id")
    return notes.unmentioned(e, _t(spark, d, "documents"), "event_id").agg(F.count("*").alias("n"))


def top_terms_by_language(spark, d):
    docs = _t(spark, d, "documents").select("lang", F.explode(tokens(F.col("text"))).alias("term"))
    counted = docs.groupBy("lang", "term").agg(F.count("*").alias("n"))
    return retrieval.top(counted, 5, F.desc("n"), F.col("term"), by="lang").select("lang", "term", "n", F.col("rank").cast("long").alias("rank"))


def relevance_columns(spark, d):
    return _knn(_t(spark, d, "embeddings"), spark, d, 30).select(F.col("id").alias("vec_id"), simple_relevance(F.col("distance")).cast("long").alias("relevance"), F.round(advanced_relevance(F.col("distance")), 6).alias("advanced"))


def chunk_fixed(spark, d):
    return chunk_texts(_t(spark, d, "documents").select(F.col("doc_id").cast("string").alias("path"), F.col("text").alias("content"))).select("source", "chunk_index", F.length("text").alias("n_chars"), F.xxhash64("text").alias("hash"))


def complexity_python(spark, d):
    """Complexity of a function made for each part, with a branch for each unit of its size: two languages."""
    parts = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), (F.col("p_size") % 9).cast("int").alias("n"))
    python = F.concat(F.lit("def f"), "k", F.lit("(x):\n    pass\n"), F.repeat(F.lit("    if x:\n        pass\n"), F.col("n")))
    script = F.concat(F.lit("// if\nfunction f"), "k", F.lit("(x) {\n"), F.repeat(F.lit('  if (x) { y("if"); }\n'), F.col("n")), F.lit("}\n"))
    files = [parts.select(F.concat("k", F.lit(ext)).alias("path"), code.alias("content")) for ext, code in ((".py", python), (".ts", script))]
    return function_complexity(files[0].unionByName(files[1]))


def definition_chunks(spark, d):
    """Chunks of files made for each part in four languages, with braces, keywords and quotes in nested literals."""
    k, n = F.col("p_partkey").cast("string"), (F.col("p_size") % 9 + 1).cast("int")
    # A few row groups hold all parts; the texts made of them are worth many tasks.
    parts = _t(spark, d, "part").select("p_partkey", "p_size").repartition(SPREAD * spark.sparkContext.defaultParallelism)
    methods = F.concat_ws("", F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.lit("  m"), i.cast("string"), F.lit('() { return /[}"]/.test(`${ { a: "}" } }{`); }\n'))))
    texts = {
        "js": F.concat(F.lit("const t"), k, F.lit(" = `a ${ [1].map((x) => { return `}{`; }) } {`;\nclass C"), k, F.lit(" {\n"), methods, F.lit("}\n")),
        "go": F.concat(F.lit("package p\nfunc F"), k, F.lit("(a interface{}) map[string]struct{} { s := `}{`; return nil }\n")),
        "rb": F.concat(F.lit("class C"), k, F.lit("\n  X = <<~A\n    def no\n  A\nend\ndef f"), k, F.lit('(a) = "#{a ? "end" : "}"}"\n')),
        "py": F.concat(F.lit("import os\n@a\ndef f"), k, F.lit('():\n    return "def no():"\n')),
    }
    files = F.explode(F.array(*[F.struct(F.concat(k, F.lit("." + e)).alias("path"), t.alias("content")) for e, t in texts.items()])).alias("f")
    return chunk_texts(parts.select(files).select("f.*")).select("source", "symbol_type", "symbol_name", "class_name", "line_start", "line_end", "text")


def naming_styles(spark, d):
    """Style of part names with blanks as underscores: one row of counts."""
    return stats.naming_style(_t(spark, d, "part").select(F.replace("p_name", F.lit(" "), F.lit("_")).alias("path")))


def memory_batches(spark, d):
    """Batches of 20,000 characters of the documents of each source, in order of doc_id."""
    docs = _t(spark, d, "documents").select(F.col("source").alias("part"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"))
    return incremental.batch_numbers(docs, "size", 20_000).select("part", "seq", F.col("batch_no").cast("long").alias("batch_no"))


def memory_batches_one_part(spark, d):
    """Batches of 50,000 characters of all documents as one part, in order of doc_id, numbered in 32 slabs."""
    docs = _t(spark, d, "documents").select(F.lit("all").alias("part"), F.col("doc_id").alias("seq"), F.col("n_chars").alias("size"))
    return incremental.batch_numbers(docs, "size", 50_000, slabs=32).select("seq", F.col("batch_no").cast("long").alias("batch_no"))


def log_take_while(spark, d):
    """The log by event_id up to the first event of the last two days."""
    log = _t(spark, d, "events")
    cut = _now(log.withColumnRenamed("ts", "date"))
    late = log.withColumn("back", -F.unix_micros(F.col("ts").cast("timestamp")))
    return history.take_while(late, "event_id", "back", -F.unix_micros(history.days_before(cut, 2))).select("event_id")


def directory_tree(spark, d):
    """Documents as files source/lang/id.txt: the first 100 entries two levels deep."""
    files = _t(spark, d, "documents").select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("path"), F.col("n_chars").alias("size"), F.lit(0).alias("mtime"))
    return files_source.directory_listing(files, "", 2, 100).select("parent", "name", "is_dir", "size")


def keyword_lines(spark, d):
    texts = _t(spark, d, "documents").select(F.col("doc_id").alias("doc"), "text")
    return notes.keyword_lines(texts, "apache").select("doc", "seq", "line")


def note_sections(spark, d):
    """Conversations as notes: each turn's role as a header over its text; characters of each section."""
    turns = _t(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    docs = turns.select(F.col("conv_id").alias("doc"), F.array_join(F.transform("t", lambda x: F.concat(F.lit("## "), x["role"], F.lit("\n"), F.replace(x["text"], F.lit("\n"), F.lit(" ")))), "\n").alias("text"))
    return notes.sections(docs).select(F.col("doc").alias("conv_id"), "section", F.length("content").cast("long").alias("n"))


def id_set_operations(spark, d):
    """Documents with a label or a vector, with both, and with neither."""
    docs, labels, vectors = (_t(spark, d, t).select(F.col(c).alias("id")).distinct() for t, c in (("documents", "doc_id"), ("labels", "doc_id"), ("embeddings", "vec_id")))
    parts = {"union": labels.union(vectors).distinct(), "both": labels.intersect(vectors), "neither": docs.subtract(labels.union(vectors)), "bag": labels.unionAll(vectors)}
    out = None
    for name, df in parts.items():
        one = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("op"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def readable_sizes(spark, d):
    return _t(spark, d, "documents").select("doc_id", readable_size(F.col("n_chars")).alias("size"))


def hit_rates(spark, d):
    """Clicks as hits against all other events of a user, in percent."""
    e = _t(spark, d, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "click").alias("h"), F.count_if(F.col("event_type") != "click").alias("m"))
    return e.select("user_id", F.round(stats.hit_rate(F.col("h"), F.col("m")), 6).alias("rate"))


def commit_messages(spark, d):
    log = _log(spark, d).drop("hash").withColumn("hash", F.col("event_id"))
    return history.mentioning(log, "PURCHASE", 50, history.days_before(_now(log), 30)).select("event_id", "message")


def grouped_messages(spark, d):
    log = _log(spark, d).drop("hash").withColumn("hash", F.col("event_id"))
    return history.by_author(log, 5).select("author", "n", F.array_join("messages", ",").alias("messages"), F.col("more").cast("long").alias("more"))


def _nations(spark, d, template, joint="\n"):
    """One text of a line for each nation, in order of its key: ``template`` makes the line."""
    listed = F.array_sort(F.collect_list(F.struct("n_nationkey", template.alias("line"))))  # 25 nations at every scale
    return _t(spark, d, "nation").agg(F.array_join(F.transform(listed, lambda x: x["line"]), joint).alias("text"))


def version_classes(spark, d):
    """Dependency entries read from manifests of all five kinds, made of the nations."""
    name, number = F.lower("n_name"), F.col("n_nationkey").cast("string")
    text = lambda path, lines, head="", tail="", joint="\n": _nations(spark, d, lines, joint).select(F.lit(path).alias("path"), F.concat(F.lit(head), "text", F.lit(tail)).alias("text"))
    files = [
        text("pyproject.toml", F.concat(F.lit('  "'), F.replace(name, F.lit(" "), F.lit("-")), F.lit(">="), number, F.lit('",')), "[project]\ndependencies = [\n", "\n]\n"),
        text("requirements.txt", F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("=="), number), "# all\n-r other\n"),
        text("package.json", F.concat(F.lit('"'), name, F.lit('": "^'), number, F.lit('"')), '{"dependencies": {', '}, "peerDependencies": {"t": "*"}}', ", "),
        text("go.mod", F.concat(F.lit("\tx/"), F.replace(name, F.lit(" "), F.lit("-")), F.lit(" v"), number), "module m\nrequire (\n", "\n)\n"),
        text("Cargo.toml", F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit(' = "'), number, F.lit('"')), "[dependencies]\n", '\n[x]\ny = "2"\n'),
    ]
    every = files[0]
    for one in files[1:]:
        every = every.unionByName(one)
    deps = manifests.all_dependencies(every)
    return deps.groupBy("manifest", "scope").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.concat("name", F.lit(":"), "version"))), ",").alias("entries"))


def imports_and_tags(spark, d):
    """Imports of two languages and marked lines, from a text made for each part."""
    part = _t(spark, d, "part").select(F.col("p_partkey").cast("string").alias("k"), F.lower(F.split_part("p_name", F.lit(" "), F.lit(1))).alias("w"))
    py = part.select(F.concat("k", F.lit(".py")).alias("path"), F.concat(F.lit("import "), "w", F.lit(".y\nfrom z"), "k", F.lit(" import w\n# TODO: see "), "w").alias("text"))
    ts = part.select(F.concat("k", F.lit(".ts")).alias("path"), F.concat(F.lit("import {q} from './"), "w", F.lit("';\nrequire('r')\n// fixme "), "k").alias("text"))
    files = py.unionByName(ts)
    found = files.select("path", F.when(F.col("path").endswith(".py"), python_imports(F.col("text"))).otherwise(js_imports(F.col("text"))).alias("i"))
    tagged = stats.tagged_lines(files).select("path", F.lit("tag").alias("kind"), F.concat_ws(":", "tag", "text").alias("value"))
    return found.select("path", F.lit("import").alias("kind"), F.explode("i").alias("value")).unionByName(tagged)


def tag_counts_by_file(spark, d):
    """Marked lines made of the events, by tag, by file (a user) and in all."""
    mark = F.element_at(F.array(*[F.lit(x) for x in ("TODO", "FIXME", "note", "plain")]), (F.col("event_id") % 4 + 1).cast("int"))
    files = _t(spark, d, "events").select(F.concat(F.lit("user"), F.col("user_id").cast("string")).alias("path"), F.concat(F.lit("x = 1  # "), mark, F.lit(": "), "event_type", F.lit("\n// bug ")).alias("text"))
    return stats.tag_counts(stats.tagged_lines(files))


def tests_of_parts(spark, d):
    """Files whose name holds test or spec and a part's brand."""
    part = _t(spark, d, "part")
    name = F.when(F.col("p_partkey") % 3 == 0, F.lit("Test_")).when(F.col("p_partkey") % 3 == 1, F.lit("spec.")).otherwise(F.lit("plain_"))
    files = part.select(F.concat(F.lit("dir/"), name, F.replace("p_brand", F.lit("#"), F.lit("-")), F.lit("."), F.col("p_partkey").cast("string")).alias("path"))
    names = part.select(F.replace("p_brand", F.lit("#"), F.lit("-")).alias("name"))
    return graph.related_tests(names, files)


def coverage_pages(spark, d):
    """The percentage that a report made of each page names."""
    span = F.concat(F.lit('<span class="pc_cov">'), (F.col("page_id") % 101).cast("string"), F.lit("%</span>"))
    pages = _t(spark, d, "pages").select(F.col("page_id").cast("string").alias("path"), F.concat(F.col("html"), F.when(F.col("page_id") % 2 == 0, span).otherwise(F.lit(""))).alias("text"))
    return files_source.coverage_percent(pages).select("path", F.col("percent").cast("long").alias("percent"))


def _versions(spark, d):
    version = F.element_at(F.array(*[F.lit(x) for x in ("==1", ">=2", ">", "", "~3", "^4", "5")]), (F.col("p_partkey") % 7 + 1).cast("int"))
    return _t(spark, d, "part").select(F.lower("p_name").alias("name"), F.lit("prod").alias("scope"), version.alias("version"), "p_partkey")


def dependency_classes(spark, d):
    """Parts as dependencies: pinned, ranged and unpinned."""
    return stats.version_classes(_versions(spark, d))


def dependency_strategy(spark, d):
    """Parts as prod entries, every third as a dev entry too, with the version of the next part."""
    prod = _versions(spark, d).select(F.col("p_partkey").cast("string").alias("name"), "scope", "version")
    later = _versions(spark, d).filter("p_partkey % 3 = 0").select((F.col("p_partkey") - 1).cast("string").alias("name"), F.lit("dev").alias("scope"), "version")
    return stats.version_strategy(prod.unionByName(later))


def complexity_totals(spark, d):
    """Line items as functions of the files that their orders are; the language by the ship mode."""
    line = _t(spark, d, "lineitem")
    rows = line.select(F.concat(F.col("l_orderkey").cast("string"), F.lit("."), "l_returnflag").alias("path"), F.col("l_returnflag").alias("language"), F.lit("f").alias("name"), F.col("l_linenumber").alias("line_start"), F.col("l_quantity").cast("long").alias("complexity"))
    out = stats.complexity_summary(rows)
    return out.withColumn("languages", F.array_join(F.transform(F.array_sort(F.map_entries("languages")), lambda x: F.concat_ws(":", x["key"], x["value"].cast("string"))), ","))


def import_edges(spark, d):
    """The graph of the parts again, read from texts that import one another."""
    edges = _edges(spark, d).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"))
    lines = edges.groupBy("src").agg(F.array_join(F.array_sort(F.collect_list(F.concat(F.lit("import p"), "dst"))), "\n").alias("text"))
    nodes = edges.select("src").union(edges.select("dst")).distinct()
    files = nodes.join(lines, "src", "left").select(F.concat(F.lit("p"), "src", F.lit(".py")).alias("path"), F.lit(".py").alias("ext"), F.coalesce("text", F.lit("")).alias("text"))
    return files_source.import_graph(files)


_Q: list[tuple[Callable, str | None]] = [
    (bm25_topk, f"WITH {_ONE}, {_BM25_SQL} SELECT query_id, rank, id AS doc_id, score FROM kranked WHERE rank <= {TOP} AND score > 0"),
    (bm25_segments, f"WITH {_THREE}, {_BM25_SQL} SELECT query_id::BIGINT AS query_id, rank, id AS doc_id, score FROM kranked WHERE rank <= 5 AND score > 0"),
    (bm25_term_stats, r"""WITH w AS MATERIALIZED (SELECT list_distinct(list_filter(string_split_regex(lower(coalesce(text, '')), '\s+'), lambda x: x <> '')) AS words FROM documents),
tok AS MATERIALIZED (SELECT unnest(words) AS term FROM w), d AS MATERIALIZED (SELECT term, count(*) AS df FROM tok GROUP BY term),
r AS MATERIALIZED (SELECT term, df, ln((SELECT count(*) FROM documents) - df + 0.5) - ln(df + 0.5) AS raw FROM d), m AS MATERIALIZED (SELECT avg(raw) AS mean_idf FROM r)
SELECT term, df::BIGINT AS df, round(CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END, 6)::DOUBLE AS idf FROM r, m"""),
    (vector_knn, f"WITH {_VECTOR_SQL} SELECT rank, id AS vec_id, distance FROM vranked WHERE rank <= {TOP}"),
    (vector_knn_filtered, f"WITH {_VECTOR_SQL} SELECT row_number() OVER (ORDER BY distance, id) AS rank, id AS vec_id, distance FROM dist WHERE label = 3 ORDER BY 1 LIMIT {TOP}"),
    (vector_cells, """WITH e AS (SELECT vec_id, label, embedding::DOUBLE[] AS v, sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) AS norm FROM embeddings),
p AS MATERIALIZED (SELECT q.vec_id AS query_id, e.vec_id, e.label, round(1 - list_dot_product(e.v, q.v) / (e.norm * q.norm), 6) + 0.0::DOUBLE AS distance FROM e JOIN e q ON q.vec_id % 50 = 0),
s AS (SELECT 'all' AS side, query_id, vec_id, distance FROM p UNION ALL SELECT 'label 3', query_id, vec_id, distance FROM p WHERE label = 3),
r AS (SELECT *, row_number() OVER (PARTITION BY side, query_id ORDER BY distance, vec_id) AS rank FROM s)
SELECT side, query_id, rank, vec_id, distance FROM r WHERE rank <= 5"""),
    (rrf_hybrid, f"WITH {_hybrid_sql(TOP, 30)} SELECT rank, id, score, distance FROM hits"),
    (hybrid_summary, f"""WITH {_hybrid_sql(TOP, 30)}, r AS (SELECT count(*) AS n_results, count(DISTINCT source) AS n_files, round(avg(coalesce(distance, 0)), 6) AS avg_distance FROM hits JOIN documents ON doc_id = id),
c AS (SELECT *, greatest(0.0, least(1.0, round(1 - avg_distance, 6)))::DOUBLE AS confidence, CASE WHEN (SELECT count(*) FROM documents) > 100 THEN 'full' ELSE 'partial' END AS coverage FROM r)
SELECT *, ((confidence < 0.5)::INT + (n_files < 3)::INT + (coverage = 'partial')::INT)::BIGINT AS n_suggestions FROM c"""),
    (advanced_search, f"""WITH {_hybrid_sql(2 * TOP, 50)}, r AS (SELECT rank AS first_rank, id, source, round(greatest(0, 1 - coalesce(distance, 0) / 2), 6) AS advanced_relevance FROM hits JOIN documents ON doc_id = id)
SELECT row_number() OVER (ORDER BY first_rank) AS rank, id, source, advanced_relevance FROM r WHERE advanced_relevance >= 0.3 AND source NOT IN ('src0', 'src1') ORDER BY 1 LIMIT {TOP}"""),
    (multi_query_retrieval, f"WITH {_THREE}, {_BM25_SQL} SELECT query_id::BIGINT AS query_id, rank, id AS doc_id, score FROM kranked WHERE rank <= 5 AND score > 0"),
    (graph_edges, f"WITH {_EDGES_SQL} SELECT src, dst FROM edges"),
    (graph_downstream, _reach_sql("src", "dst", 3)),
    (graph_upstream, _reach_sql("dst", "src", 3)),
    (search_with_neighbours, f"""WITH {_hybrid_sql(5, 15)}, {_EDGES_SQL}, n AS (SELECT dst AS node FROM edges JOIN hits ON src = id UNION SELECT src FROM edges JOIN hits ON dst = id)
SELECT node FROM n WHERE node NOT IN (SELECT id FROM hits) ORDER BY node LIMIT 20"""),
    (graph_shortest_path, f"""WITH RECURSIVE {_EDGES_SQL}, s AS (SELECT min(src) AS node FROM edges),
r AS (SELECT node, 0 AS depth, [node] AS path FROM s UNION ALL SELECT e.dst, r.depth + 1, list_append(r.path, e.dst) FROM r JOIN edges e ON e.src = r.node WHERE r.depth < 4 AND NOT list_contains(r.path, e.dst)),
m AS (SELECT node, min(depth) AS depth FROM r GROUP BY node), t AS (SELECT min(node) AS node FROM m WHERE depth = 4)
SELECT (SELECT node FROM s) AS from_node, t.node AS to_node, 4::BIGINT AS length, (SELECT array_to_string(list_transform(min(path), lambda x: x::VARCHAR), ',') FROM r WHERE r.node = t.node AND r.depth = 4) AS path FROM t"""),
    (graph_closure_impact, f"""WITH RECURSIVE {_EDGES_SQL}, d AS (SELECT dst, count(DISTINCT src) AS direct FROM edges GROUP BY dst), s AS (SELECT dst AS node FROM d ORDER BY direct DESC, dst LIMIT 10),
r AS (SELECT node AS origin, node FROM s UNION SELECT r.origin, e.src FROM r JOIN edges e ON e.dst = r.node),
c AS (SELECT origin, count(*) AS total FROM r WHERE node <> origin GROUP BY origin)
SELECT s.node, coalesce(direct, 0) AS direct, coalesce(total, 0) AS total, CASE WHEN coalesce(total, 0) >= 10 THEN 'CRITICAL' WHEN total >= 5 THEN 'HIGH' WHEN total >= 2 THEN 'MEDIUM' WHEN total >= 1 THEN 'LOW' ELSE 'MINIMAL' END AS level
FROM s LEFT JOIN c ON origin = s.node LEFT JOIN d ON d.dst = s.node"""),
    (graph_impact_of_all, f"""WITH RECURSIVE {_EDGES_SQL}, d AS (SELECT dst, count(*) AS direct FROM edges GROUP BY dst), s AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
r AS (SELECT node AS origin, node FROM s UNION SELECT r.origin, e.src FROM r JOIN edges e ON e.dst = r.node),
c AS (SELECT origin, count(*) - 1 AS total FROM r GROUP BY origin)
SELECT s.node, coalesce(direct, 0) AS direct, total, CASE WHEN total >= 10 THEN 'CRITICAL' WHEN total >= 5 THEN 'HIGH' WHEN total >= 2 THEN 'MEDIUM' WHEN total >= 1 THEN 'LOW' ELSE 'MINIMAL' END AS level
FROM s JOIN c ON origin = s.node LEFT JOIN d ON d.dst = s.node"""),
    (graph_strong_components, f"""WITH RECURSIVE {_EDGES_SQL}, s AS (SELECT src AS node FROM edges UNION SELECT dst FROM edges),
r AS (SELECT node AS origin, node FROM s UNION SELECT r.origin, e.src FROM r JOIN edges e ON e.dst = r.node),
m AS (SELECT x.origin AS node, max(x.node) AS component FROM r x JOIN r y ON x.origin = y.node AND x.node = y.origin GROUP BY x.origin)
SELECT component, count(*) AS size, min(node) AS smallest FROM m GROUP BY component"""),
    (graph_cluster_jaccard, f"""WITH {_EDGES_SQL}, b AS (SELECT src AS node, dst AS via FROM edges UNION SELECT dst, src FROM edges), z AS (SELECT node, count(*) AS n FROM b GROUP BY node),
p AS (SELECT x.node, y.node AS other, count(*) AS i FROM b x JOIN b y USING (via) WHERE x.node <> y.node GROUP BY 1, 2)
SELECT p.node, other, round(i / (a.n + c.n - i), 6) AS similarity FROM p JOIN z a ON a.node = p.node JOIN z c ON c.node = other WHERE round(i / (a.n + c.n - i), 6) >= 0.3"""),
    (graph_imported_by, f"WITH {_EDGES_SQL} SELECT dst AS node, count(DISTINCT src) AS importers, CASE WHEN count(DISTINCT src) >= 5 THEN 'HIGH' WHEN count(DISTINCT src) >= 2 THEN 'MEDIUM' ELSE 'LOW' END AS level FROM edges GROUP BY dst"),
    (name_containment_join, "WITH w AS (SELECT DISTINCT lower(split_part(p_name, ' ', 1)) AS name FROM part) SELECT name, count(*) AS n FROM part JOIN w ON contains(lower(p_name), name) WHERE name <> '' GROUP BY name"),
    (line_scan_tags, r"""WITH l AS (SELECT lang, unnest(string_split(text, chr(10))) AS line FROM documents), t AS (SELECT lang, lower(regexp_extract(line, '(?i)\b(licensed|copyright|warranty)\b', 1)) AS tag FROM l)
SELECT lang, tag, count(*) AS n FROM t WHERE tag <> '' GROUP BY GROUPING SETS ((lang, tag), (tag), ())"""),
    (section_carry_forward, "SELECT conv_id, turn, last_value(CASE WHEN role <> 'assistant' THEN role END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM conversations"),
    (group_counts_topk, f"SELECT source, count(*) AS n FROM documents GROUP BY source ORDER BY n DESC, source LIMIT {TOP}"),
    (idiom_counts, """WITH f AS (SELECT unnest([CASE WHEN contains(text, ' | ') THEN 'lists' END, CASE WHEN contains(text, '!! ') THEN 'shouting' END, CASE WHEN contains(text, 'Licensed') AND contains(text, 'Apache') THEN 'apache' END,
CASE WHEN contains(text, '@') THEN 'address' END, CASE WHEN contains(text, ' = ') OR contains(text, ':=') THEN 'assignment' END]) AS idiom FROM documents)
SELECT idiom, count(*) AS n FROM f WHERE idiom IS NOT NULL GROUP BY idiom ORDER BY n DESC, idiom LIMIT 5"""),
    (conditional_counts, "SELECT " + ", ".join(f"count(*) FILTER (lang = '{c}') AS n_{c}" for c in ("en", "de", "fr", "es")) + ", count(*) FILTER (n_chars > 1500 AND lang = 'en') AS long_en FROM documents"),
    (numeric_summary_by_key, "SELECT lang, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS total, round(avg(n_chars), 4) AS average, count(*) FILTER (n_chars > 5000) AS over FROM documents GROUP BY lang"),
    (author_stats, "SELECT user_id AS author, count(*) AS n FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY GROUP BY user_id"),
    (recent_activity, "SELECT event_id, user_id AS author, event_type AS message FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 200) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 1 DAY"),
    (latest_per_key, """WITH n AS (SELECT * FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 200) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAY),
r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM n)
SELECT 'user' || user_id AS path, event_id, event_type AS message FROM r WHERE k = 1 ORDER BY ts DESC, path LIMIT 50"""),
    (json_map_stats, """WITH p AS (SELECT event_type, unnest(json_keys(props)) AS key, props FROM events)
SELECT event_type, key, count(*) AS n, count(DISTINCT json_extract_string(props, '$.' || key)) AS n_values FROM p GROUP BY 1, 2"""),
    (html_extract, """SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, CAST(len(regexp_extract_all(html, 'href="([^"]*)"', 1)) AS BIGINT) AS links FROM pages"""),
    (changed_rows, f"WITH {_SNAPSHOT_SQL} SELECT cur.path, cur.mtime FROM cur LEFT JOIN old USING (path) WHERE old.mtime IS NULL OR cur.mtime > old.mtime"),
    (deleted_rows, f"WITH {_SNAPSHOT_SQL} SELECT path FROM old WHERE path NOT IN (SELECT path FROM cur)"),
    (incremental_equals_full, "SELECT 0::BIGINT AS differences"),
    (note_dedupe, """WITH c AS (SELECT role AS section, trim(text, ' ') AS content, turn FROM conversations WHERE trim(text, ' ') <> '')
SELECT section, count(*) AS n FROM (SELECT DISTINCT section, content FROM c WHERE turn >= 2 AND (section, content) NOT IN (SELECT section, content FROM c WHERE turn < 2)) GROUP BY section"""),
    (new_entries_not_in_notes, r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(text, '[0-9A-Za-z_\pL\pN]*[0-9][0-9A-Za-z_\pL\pN]*')) AS w FROM documents),
m AS (SELECT DISTINCT event_id FROM events JOIN w ON contains(w, event_id::VARCHAR)) SELECT count(*) AS n FROM events WHERE event_id NOT IN (SELECT event_id FROM m)"""),
    (top_terms_by_language, r"""WITH t AS (SELECT lang, unnest(string_split_regex(lower(text), '\s+')) AS term FROM documents), c AS (SELECT lang, term, count(*) AS n FROM t WHERE term <> '' GROUP BY 1, 2)
SELECT * FROM (SELECT lang, term, n, row_number() OVER (PARTITION BY lang ORDER BY n DESC, term) AS rank FROM c) WHERE rank <= 5"""),
    (relevance_columns, f"WITH {_VECTOR_SQL} SELECT id AS vec_id, greatest(0, trunc((1 - distance) * 100)::BIGINT) AS relevance, round(greatest(0, 1 - distance / 2), 6) AS advanced FROM vranked WHERE rank <= 30"),
    (naming_styles, """WITH n AS (SELECT regexp_replace(regexp_extract(replace(p_name, ' ', '_'), '[^/]*$'), '(.)\\.[^.]*$', '\\1') AS s FROM part),
k AS (SELECT CASE WHEN contains(s, '_') AND regexp_matches(s, '^[\\p{Ll}]') THEN 'snake' WHEN regexp_matches(s, '^[\\p{Ll}].*[\\p{Lu}]') THEN 'camel' WHEN contains(s, '-') THEN 'kebab' END AS k FROM n),
c AS (SELECT count(*) FILTER (k = 'snake') AS snake, count(*) FILTER (k = 'camel') AS camel, count(*) FILTER (k = 'kebab') AS kebab FROM k)
SELECT *, CASE WHEN snake + camel + kebab = 0 THEN 'unknown' WHEN snake > camel AND snake > kebab THEN 'snake_case' WHEN camel > snake AND camel > kebab THEN 'camelCase' WHEN kebab > 0 THEN 'kebab-case' ELSE 'mixed' END AS style FROM c""".replace("\\\\", "\\")),
    (memory_batches, """WITH RECURSIVE o AS (SELECT source AS part, doc_id AS seq, n_chars AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS k FROM documents),
r AS (SELECT part, seq, k, size AS used, 0::BIGINT AS batch_no FROM o WHERE k = 1
UNION ALL SELECT o.part, o.seq, o.k, CASE WHEN r.used > 0 AND r.used + o.size > 20000 THEN o.size ELSE r.used + o.size END, r.batch_no + CASE WHEN r.used > 0 AND r.used + o.size > 20000 THEN 1 ELSE 0 END FROM r JOIN o ON o.part = r.part AND o.k = r.k + 1)
SELECT part, seq, batch_no FROM r"""),
    (memory_batches_one_part, """WITH RECURSIVE o AS MATERIALIZED (SELECT doc_id AS seq, n_chars AS size, row_number() OVER (ORDER BY doc_id, n_chars) AS k FROM documents),
r AS (SELECT seq, k, size AS used, 0::BIGINT AS batch_no FROM o WHERE k = 1
UNION ALL SELECT o.seq, o.k, CASE WHEN r.used > 0 AND r.used + o.size > 50000 THEN o.size ELSE r.used + o.size END, r.batch_no + CASE WHEN r.used > 0 AND r.used + o.size > 50000 THEN 1 ELSE 0 END FROM r JOIN o ON o.k = r.k + 1)
SELECT seq, batch_no FROM r"""),
    (log_take_while, """WITH c AS (SELECT max(ts) - INTERVAL 2 DAY AS cut FROM events), s AS (SELECT min(event_id) AS stop FROM events, c WHERE ts > cut)
SELECT event_id FROM events, s WHERE stop IS NULL OR event_id < stop"""),
    (directory_tree, """WITH f AS (SELECT source, lang, n_chars FROM documents), e AS (
SELECT '' AS parent, source AS name, true AS is_dir, n_chars FROM f UNION ALL SELECT source, lang, true, n_chars FROM f)
SELECT parent, name, is_dir, CAST(sum(n_chars) AS BIGINT) AS size FROM e GROUP BY 1, 2, 3 ORDER BY parent, is_dir DESC, lower(name) LIMIT 100"""),
    (keyword_lines, """WITH l AS (SELECT doc_id AS doc, string_split(text, chr(10)) AS x FROM documents), u AS (SELECT doc, unnest(range(len(x))) AS seq, unnest(x) AS line FROM l)
SELECT doc, seq, line FROM u WHERE trim(line, ' ') <> '' AND contains(lower(line), 'apache')"""),
    (note_sections, """WITH t AS (SELECT conv_id, role AS section, turn, replace(text, chr(10), ' ') AS text FROM conversations)
SELECT conv_id, section, CAST(length(trim(string_agg(text, chr(10) ORDER BY turn), ' ')) AS BIGINT) AS n FROM t GROUP BY conv_id, section"""),
    (id_set_operations, """WITH l AS (SELECT DISTINCT doc_id AS id FROM labels), v AS (SELECT DISTINCT vec_id AS id FROM embeddings), d AS (SELECT DISTINCT doc_id AS id FROM documents)
SELECT 'union' AS op, count(*) AS n FROM (SELECT id FROM l UNION SELECT id FROM v) UNION ALL SELECT 'both', count(*) FROM (SELECT id FROM l INTERSECT SELECT id FROM v)
UNION ALL SELECT 'neither', count(*) FROM (SELECT id FROM d EXCEPT (SELECT id FROM l UNION SELECT id FROM v)) UNION ALL SELECT 'bag', count(*) FROM (SELECT id FROM l UNION ALL SELECT id FROM v)"""),
    (readable_sizes, """SELECT doc_id, CASE WHEN n_chars < 1024 THEN n_chars || 'B' WHEN n_chars < 1048576 THEN printf('%.1fKB', round(n_chars / 1024, 1)) ELSE printf('%.1fMB', round(n_chars / 1048576, 1)) END AS size FROM documents"""),
    (hit_rates, "SELECT user_id, round(100.0 * count(*) FILTER (event_type = 'click') / count(*), 6)::DOUBLE AS rate FROM events GROUP BY user_id"),
    (commit_messages, """SELECT event_id, event_type AS message FROM (SELECT * FROM events ORDER BY ts DESC, event_id LIMIT 50) WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 30 DAY AND contains(lower(event_type), 'purchase')
ORDER BY ts DESC, event_id LIMIT 5"""),
    (grouped_messages, """WITH r AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id AS author, any_value(n) AS n, string_agg(event_type, ',' ORDER BY k) FILTER (k <= 5) AS messages, greatest(0, any_value(n) - 5)::BIGINT AS more FROM r GROUP BY user_id"""),
    (version_classes, """WITH n AS (SELECT lower(n_name) AS w, replace(lower(n_name), ' ', '-') AS s, n_nationkey::VARCHAR AS k FROM nation), e AS (
SELECT 'pyproject.toml' AS manifest, 'prod' AS scope, s || ':>=' || k AS e FROM n UNION ALL SELECT 'requirements.txt', 'prod', s || ':==' || k FROM n UNION ALL SELECT 'package.json', 'prod', w || ':^' || k FROM n
UNION ALL SELECT 'package.json', 'peer', 't:*' UNION ALL SELECT 'go.mod', 'prod', 'x/' || s || ':v' || k FROM n UNION ALL SELECT 'Cargo.toml', 'prod', s || ':' || k FROM n)
SELECT manifest, scope, count(*) AS n, string_agg(e, ',' ORDER BY e) AS entries FROM e GROUP BY 1, 2"""),
    (imports_and_tags, """WITH p AS (SELECT p_partkey::VARCHAR AS k, lower(split_part(p_name, ' ', 1)) AS w FROM part)
SELECT k || '.py' AS path, 'import' AS kind, w AS value FROM p UNION ALL SELECT k || '.py', 'import', 'z' || k FROM p UNION ALL SELECT k || '.py', 'tag', 'TODO:see ' || w FROM p
UNION ALL SELECT k || '.ts', 'import', './' || w FROM p UNION ALL SELECT k || '.ts', 'import', 'r' FROM p UNION ALL SELECT k || '.ts', 'tag', 'FIXME:' || k FROM p"""),
    (tag_counts_by_file, """WITH f AS (SELECT 'user' || user_id AS path, unnest([CASE event_id % 4 WHEN 0 THEN 'TODO' WHEN 1 THEN 'FIXME' WHEN 2 THEN 'NOTE' END, 'BUG']) AS tag FROM events)
SELECT tag, path, count(*) AS n FROM f WHERE tag IS NOT NULL GROUP BY GROUPING SETS ((tag), (path), ())"""),
    (tests_of_parts, """WITH f AS (SELECT 'dir/' || CASE p_partkey % 3 WHEN 0 THEN 'Test_' WHEN 1 THEN 'spec.' ELSE 'plain_' END || replace(p_brand, '#', '-') || '.' || p_partkey AS path FROM part),
n AS (SELECT DISTINCT lower(replace(p_brand, '#', '-')) AS name FROM part)
SELECT name, path FROM f JOIN n ON contains(lower(split_part(path, '/', 2)), name) WHERE contains(lower(split_part(path, '/', 2)), 'test') OR contains(lower(split_part(path, '/', 2)), 'spec')"""),
    (coverage_pages, "SELECT page_id::VARCHAR AS path, CASE WHEN page_id % 2 = 0 THEN page_id % 101 END AS percent FROM pages"),
    (dependency_classes, """WITH v AS (SELECT ['==1', '>=2', '>', '', '~3', '^4', '5'][p_partkey % 7 + 1] AS v FROM part)
SELECT count(*) AS total, count(*) FILTER (starts_with(v, '==')) AS pinned, count(*) FILTER (v <> '' AND NOT starts_with(v, '==') AND v NOT IN ('>', '>=')) AS ranged, count(*) FILTER (v = '' OR starts_with(v, '>')) AS unpinned FROM v"""),
    (dependency_strategy, """WITH v AS (SELECT p_partkey AS k, ['==1', '>=2', '>', '', '~3', '^4', '5'][p_partkey % 7 + 1] AS v FROM part), d AS (SELECT k - 1 AS k, v FROM v WHERE k % 3 = 0),
c AS (SELECT coalesce(d.v, v.v) AS v FROM v FULL JOIN d USING (k))
SELECT count(*) FILTER (starts_with(v, '^')) AS caret, count(*) FILTER (starts_with(v, '~')) AS tilde, count(*) FILTER (regexp_matches(v, '^[0-9]')) AS exact FROM c"""),
    (complexity_totals, """WITH f AS (SELECT l_orderkey || '.' || l_returnflag AS path, l_returnflag AS language, CAST(trunc(l_quantity) AS BIGINT) AS c FROM lineitem),
e AS (SELECT language, count(DISTINCT path) AS files, count(*) AS functions, sum(c) AS total, count(*) FILTER (c > 10) AS complex FROM f GROUP BY language)
SELECT CAST(sum(files) AS BIGINT) AS files, CAST(sum(functions) AS BIGINT) AS functions, CAST(sum(total) AS BIGINT) AS total, round(sum(total) / sum(functions), 2) AS average, CAST(sum(complex) AS BIGINT) AS complex,
string_agg(language || ':' || files, ',' ORDER BY language) AS languages FROM e"""),
    (import_edges, f"WITH {_EDGES_SQL} SELECT 'p' || src || '.py' AS src, 'p' || dst || '.py' AS dst FROM edges"),
    (complexity_python, """WITH p AS (SELECT p_partkey::VARCHAR AS k, CAST(p_size % 9 AS INTEGER) AS n FROM part)
SELECT k || '.py' AS path, 'python' AS language, 'f' || k AS name, 1::INTEGER AS line_start, (n + 1)::INTEGER AS complexity FROM p UNION ALL SELECT k || '.ts', 'typescript', 'f' || k, 2::INTEGER, (n + 1)::INTEGER FROM p"""),
    (repository_commits, """WITH c AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(role, ''), coalesce(text, '')) AS k FROM conversations)
SELECT 'conversation ' || conv_id || ' turn ' || turn AS message, coalesce(role, '') AS author, CAST(1700000000 + 60 * turn AS BIGINT) AS seconds, count(*) AS n, count(*) FILTER (k > 1) AS with_parent FROM c GROUP BY 1, 2, 3"""),
    (repository_changes, """WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
l AS (SELECT *, lag(text) OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS before, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn, text) AS k FROM c)
SELECT 'conversation ' || conv_id || ' turn ' || turn AS message, conv_id || '/' || role || '.txt' AS path, CASE WHEN k = 1 THEN 'A' ELSE 'M' END AS status FROM l WHERE k = 1 OR before <> text"""),
    (definition_chunks, """WITH p AS (SELECT p_partkey::VARCHAR AS k, CAST(p_size % 9 + 1 AS INTEGER) AS n FROM part), m AS (SELECT k, unnest(range(1, n + 1))::INTEGER AS i FROM p),
c(source, symbol_type, symbol_name, class_name, line_start, line_end, text) AS (
SELECT k || '.js', 'function', 't' || k, '', 1, 1, 'const t' || k || ' = `a ${ [1].map((x) => { return `}{`; }) } {`;' FROM p
UNION ALL SELECT k || '.js', 'method', 'm' || i, 'C' || k, 2 + i, 2 + i, '# Class: C' || k || chr(10) || 'm' || i || '() { return /[}"]/.test(`${ { a: "}" } }{`); }' FROM m
UNION ALL SELECT k || '.go', 'function', 'F' || k, '', 2, 2, 'func F' || k || '(a interface{}) map[string]struct{} { s := `}{`; return nil }' FROM p
UNION ALL SELECT k || '.go', 'module', 'module_level', '', 1, 3, 'package p' FROM p
UNION ALL SELECT k || '.rb', 'function', 'C' || k, '', 1, 5, 'class C' || k || chr(10) || '  X = <<~A' || chr(10) || '    def no' || chr(10) || '  A' || chr(10) || 'end' FROM p
UNION ALL SELECT k || '.rb', 'function', 'f' || k, '', 6, 6, 'def f' || k || '(a) = "#{a ? "end" : "}"}"' FROM p
UNION ALL SELECT k || '.py', 'function', 'f' || k, '', 2, 4, '@a' || chr(10) || 'def f' || k || '():' || chr(10) || '    return "def no():"' FROM p
UNION ALL SELECT k || '.py', 'module', 'module_level', '', 1, 5, 'import os' FROM p)
SELECT source, symbol_type, symbol_name, class_name, line_start::INTEGER AS line_start, line_end::INTEGER AS line_end, text FROM c"""),
    (chunk_fixed, None),
    (latent_topics, None),
]


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f, _ in _Q}


def oracle_sql() -> dict[str, str]:
    return {f.__name__: sql for f, sql in _Q if sql}
