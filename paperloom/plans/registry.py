"""The engine's named queries and their oracle SQL.

The test tables have no titles or authors, so columns stand in: a chunk is a row of ``documents``, its title the first
line, its abstract characters 61 to 360, its author-like field ``source``; ``part`` and ``orders`` lend years.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import extract
from ..functions import text as tx
from ..operators import api, catalog, chunking, dedup, embedding, filters, search
from ..operators.index import KeywordIndex
from ..session import shared_folder

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
QUERY = "the thing of and"
Q_SQL = "'the thing of and'"
TAGS = {"energy": ["ther", "energy"], "motion": ["tion"], "colour": ["rouge", "blau"]}
INSTRUMENTS = {"alpha": r"\bThe\b", "beta": r"\b[A-Z]nd\b"}


def query(sql: str | None = None):
    """Register a query by its function's name, with its oracle."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def documents(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "documents").select("*", F.substring_index("text", "\n", 1).alias("title"), F.substring("text", 61, 300).alias("abstract"))


WS, NOT_WS = tx.WS, tx.NOT_WS
_INDEXES: dict[tuple, KeywordIndex] = {}


def index(spark: SparkSession, d: str) -> KeywordIndex:
    """The keyword index of a folder's documents, built at the first query and again when the table has changed."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{d}/documents.parquet")
    changed = path.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(path).getModificationTime()
    key = (spark.sparkContext.applicationId, d, changed)
    if key not in _INDEXES:
        _INDEXES[key] = KeywordIndex.build(read(spark, d, "documents"), shared_folder(spark, "keyword-index"))
    return _INDEXES[key]


TOKENS = f"list_filter(regexp_split_to_array(lower(text), '{WS}+'), lambda x: x <> '')"
BM25 = f"""
toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM toks) GROUP BY term),
idf0 AS (SELECT term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM df, corpus),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25e0 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
asked AS (SELECT term, count(*) AS times FROM (SELECT unnest(string_split({Q_SQL}, ' ')) AS term) GROUP BY term),
tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
hits AS (SELECT doc_id, sum(times * idf * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))) AS s FROM tf JOIN idf USING (term) JOIN asked USING (term), corpus GROUP BY doc_id),
bm25 AS (SELECT doc_id, round(coalesce(s, 0e0), 6) AS score FROM toks LEFT JOIN hits USING (doc_id))
"""
DENSE = """
qv AS (SELECT embedding AS v FROM embeddings WHERE vec_id = 0),
dense AS (SELECT vec_id AS doc_id, round((1 + list_cosine_similarity(embedding::DOUBLE[], v::DOUBLE[])) / 2, 6) AS score FROM embeddings, qv)
"""
LEGS = """
d20 AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 20),
s20 AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 20)
"""


def query_vector(spark, d, ids=(0,)):
    return read(spark, d, "embeddings").where(F.col("vec_id").isin(*ids)).select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def dense_scores(spark, d):
    return search.dense(read(spark, d, "embeddings"), query_vector(spark, d)).drop("query_id")


def legs(spark, d, k=20):
    return search.dense_best(read(spark, d, "embeddings"), query_vector(spark, d), k).drop("query_id"), search.ranked(index(spark, d).best(QUERY, k), k)


@query(f"WITH {BM25} SELECT * FROM bm25")
def bm25_scores(spark, d):
    return index(spark, d).all_scores(QUERY)


@query(f"WITH {BM25} SELECT * FROM bm25 ORDER BY score DESC, doc_id LIMIT 10")
def bm25_topk(spark, d):
    return index(spark, d).best(QUERY, 10)


@query(f"WITH {DENSE} SELECT * FROM dense ORDER BY score DESC, doc_id LIMIT 10")
def dense_topk(spark, d):
    return search.dense_best(read(spark, d, "embeddings"), query_vector(spark, d), 10).select("doc_id", "score")


@query("""SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round((1 + list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS score
FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 1, 2) QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY score DESC, e.vec_id) <= 5""")
def dense_topk_multi(spark, d):
    return search.dense_best(read(spark, d, "embeddings"), query_vector(spark, d, (0, 1, 2)), 5).drop("rank")


RRF = f"""WITH {BM25}, {DENSE}, {LEGS}, parts AS (SELECT doc_id, %s / (60 + rank) AS p FROM d20 UNION ALL SELECT doc_id, %s / (60 + rank) FROM s20),
fused AS (SELECT doc_id, round(sum(p), 9) AS rrf FROM parts GROUP BY doc_id) """


@query(RRF % ("0.7e0", "0.3e0") + "SELECT f.doc_id, rrf, source, n_chars FROM (SELECT * FROM fused ORDER BY rrf DESC, doc_id LIMIT 10) f LEFT JOIN documents USING (doc_id)")
def hybrid_rrf(spark, d):
    a, b = legs(spark, d)
    best = search.rrf({"dense": a, "sparse": b}, 10, {"dense": 0.7, "sparse": 0.3})
    # ten ranked ids are a bounded side
    meta = documents(spark, d).join(F.broadcast(best.select("doc_id")), "doc_id", "left_semi").select("doc_id", "source", "n_chars")
    return best.join(meta, "doc_id", "left")


@query(RRF % ("1e0", "1e0") + "SELECT * FROM fused ORDER BY rrf DESC, doc_id LIMIT 10")
def rrf_equal_weights(spark, d):
    a, b = legs(spark, d)
    return search.rrf({"dense": a, "sparse": b}, 10)


@query(RRF % ("0.7e0", "0.3e0") + "SELECT doc_id, round(rrf / max(rrf) OVER (), 6) AS rrf FROM fused ORDER BY rrf DESC, doc_id LIMIT 10")
def rrf_normalized(spark, d):
    a, b = legs(spark, d)
    return search.rrf({"dense": a, "sparse": b}, 10, {"dense": 0.7, "sparse": 0.3}, normalize=True)


@query(f"""WITH {BM25}, {DENSE}, {LEGS}, l20 AS (SELECT doc_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS rank FROM documents QUALIFY rank <= 20),
parts AS (SELECT doc_id, 0.5e0 / (60 + rank) AS p FROM d20 UNION ALL SELECT doc_id, 0.3e0 / (60 + rank) FROM s20 UNION ALL SELECT doc_id, 1e0 / (60 + rank) FROM l20)
SELECT doc_id, round(sum(p), 9) AS rrf FROM parts GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 10""")
def rrf_three_systems(spark, d):
    a, b = legs(spark, d)
    by_length = search.ranked(read(spark, d, "documents").select("doc_id", F.col("n_chars").alias("score")), 20)
    return search.rrf({"dense": a, "sparse": b, "length": by_length}, 10, {"dense": 0.5, "sparse": 0.3})


@query(f"""WITH {BM25}, {DENSE}, {LEGS}, x AS (SELECT min(score) AS lo, max(score) AS hi FROM s20),
parts AS (SELECT doc_id, score * 0.5e0 AS p FROM d20 UNION ALL SELECT doc_id, (score - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END) * 0.5e0 FROM s20, x)
SELECT doc_id, round(sum(p), 6) AS score FROM parts GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 10""")
def hybrid_alpha(spark, d):
    a, b = legs(spark, d)
    return search.blend(a, b, 0.5, 10)


BATCH = (("0", "the thing of and"), ("1", "the the und"), ("2", " "), ("3", "that"))
_BATCH_SQL = ", ".join(f"({i}, '{q}')" for i, q in BATCH)
BATCH_LEGS = f"""
toks AS (SELECT doc_id, {TOKENS} AS t FROM documents),
corpus AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM toks),
df AS (SELECT term, count(*) AS df FROM (SELECT unnest(list_distinct(t)) AS term FROM toks) GROUP BY term),
idf0 AS (SELECT term, ln(n - df + 0.5e0) - ln(df + 0.5e0) AS idf FROM df, corpus),
idf AS (SELECT term, CASE WHEN idf < 0 THEN 0.25e0 * (SELECT avg(idf) FROM idf0) ELSE idf END AS idf FROM idf0),
asked AS (SELECT query_id, term, count(*) AS times FROM (SELECT query_id, unnest(string_split(q, ' ')) AS term FROM (VALUES {_BATCH_SQL}) v(query_id, q)) WHERE term <> '' GROUP BY ALL),
tf AS (SELECT doc_id, len(t) AS dl, term, count(*) AS f FROM (SELECT doc_id, t, unnest(t) AS term FROM toks) WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
sparse AS (SELECT query_id, doc_id, round(sum(times * idf * f * 2.5e0 / (f + 1.5e0 * (0.25e0 + 0.75e0 * dl / avgdl))), 6) AS score FROM tf JOIN idf USING (term) JOIN asked USING (term), corpus GROUP BY ALL),
dense AS (SELECT q.vec_id AS query_id, e.vec_id AS doc_id, round((1 + list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])) / 2, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id IN (0, 1, 3)),
d20 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM dense QUALIFY rank <= 20),
s20 AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM sparse QUALIFY rank <= 20)"""


def batch(spark, d):
    vectors = read(spark, d, "embeddings").where("vec_id < 4").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    return spark.createDataFrame([(int(i), q) for i, q in BATCH], "query_id long, query string").join(vectors, "query_id")


def engine(spark, d):
    return api.SearchEngine(documents(spark, d), read(spark, d, "embeddings"), index(spark, d))


@query(f"""WITH {BATCH_LEGS}, f AS (SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (SELECT query_id, doc_id, 0.7e0 / (60 + rank) AS p FROM d20 UNION ALL SELECT query_id, doc_id, 0.3e0 / (60 + rank) FROM s20) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM f QUALIFY rank <= 10""")
def search_batch(spark, d):
    return engine(spark, d).search(batch(spark, d))


@query(f"""WITH {BATCH_LEGS}, x AS (SELECT query_id, min(score) AS lo, max(score) AS hi FROM s20 GROUP BY 1),
f AS (SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (SELECT query_id, doc_id, score * 0.4e0 AS p FROM d20 UNION ALL SELECT query_id, doc_id, (score - lo) / (CASE WHEN hi > lo THEN hi - lo ELSE 1e0 END) * 0.6e0 FROM s20 JOIN x USING (query_id)) GROUP BY ALL)
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM f QUALIFY rank <= 10""")
def search_batch_alpha(spark, d):
    return engine(spark, d).search(batch(spark, d), api.Options(alpha=0.4, use_rrf=False))


@query(f"""WITH {BATCH_LEGS} SELECT s.query_id, (row_number() OVER (PARTITION BY s.query_id ORDER BY s.score DESC, s.doc_id))::INT AS rank, s.doc_id, s.score, lang, source, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt
FROM sparse s JOIN documents USING (doc_id) WHERE lang = 'en' AND contains(text, 'th') QUALIFY rank <= 10""")
def search_results(spark, d):
    e = engine(spark, d)
    hits = e.search(batch(spark, d), api.Options(mode="sparse", filters='{"lang": "en"}', text_filter={"$contains": "th"}))
    return e.results(hits, ["lang", "source"])


@query(f"""WITH {BATCH_LEGS.replace("<= 20", "<= 100")}, f AS (SELECT query_id, doc_id, round(sum(p), 9) AS score FROM (SELECT query_id, doc_id, 0.7e0 / (60 + rank) AS p FROM d20 UNION ALL SELECT query_id, doc_id, 0.3e0 / (60 + rank) FROM s20) GROUP BY ALL),
c AS (SELECT query_id, doc_id FROM f QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) <= 50),
w AS (SELECT query_id, list_filter(list_distinct(string_split(q, ' ')), lambda x: x <> '') AS w FROM (VALUES {_BATCH_SQL}) v(query_id, q)),
r AS (SELECT query_id, doc_id, round(coalesce(len(list_intersect(w, {TOKENS})) / len(w)::DOUBLE * CASE WHEN list_bool_or(list_transform(w, lambda x: contains(lower(split_part(text, chr(10), 1)), x))) THEN 2e0 ELSE 1e0 END
* CASE WHEN list_bool_or(list_transform(w, lambda x: contains(lower(substr(text, 61, 300)), x))) THEN 1.5e0 ELSE 1e0 END, 0e0), 6) AS score FROM c JOIN w USING (query_id) LEFT JOIN documents USING (doc_id))
SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank, score FROM r QUALIFY rank <= 10""")
def search_rerank_boost(spark, d):
    """Fifty hybrid candidates of each query, by the share of its terms that they have, boosted by title and abstract."""
    return engine(spark, d).search_reranked(batch(spark, d), boost=True)


def _filtered(name, tree, where):
    def f(spark, d):
        return read(spark, d, "documents").where(filters.text_filter(tree, F.col("text"))).select("doc_id")

    f.__name__ = name
    query(f"SELECT doc_id FROM documents WHERE {where}")(f)


_filtered("filter_contains", {"$contains": "tion"}, "contains(text, 'tion')")
_filtered("filter_not_contains", {"$not_contains": "tion"}, "NOT contains(text, 'tion')")
_filtered("filter_regex", {"$regex": "[0-9]+[.][0-9]+"}, "regexp_matches(text, '[0-9]+[.][0-9]+')")
_filtered("filter_exact", filters.simple_filter("the", "exact"), "text = 'the'")
_filtered("filter_and_or", {"$or": [filters.simple_filter("the", combine_with=["of"]), {"$regex": "^É"}]}, "(contains(text, 'the') AND contains(text, 'of')) OR regexp_matches(text, '^É')")


@query("SELECT doc_id, lang, n_chars FROM documents WHERE lang IN ('en', 'de') AND n_chars >= 500 AND NOT source = 'src0'")
def metadata_filter(spark, d):
    tree = {"$and": [{"lang": {"$in": ["en", "de"]}}, {"n_chars": {"$gte": 500}}, {"source": {"$ne": "src0"}}]}
    return read(spark, d, "documents").where(filters.metadata_filter(tree)).select("doc_id", "lang", "n_chars")


@query(f"""WITH {BM25} SELECT b.doc_id, score, CASE WHEN length(text) > 300 THEN substr(text, 1, 300) || '...' ELSE text END AS excerpt
FROM bm25 b JOIN documents USING (doc_id) WHERE contains(text, 'tion') ORDER BY score DESC, b.doc_id LIMIT 10""")
def fulltext_search(spark, d):
    docs = documents(spark, d)
    hits = index(spark, d).best(QUERY, 10, docs.where(F.contains("text", F.lit("tion"))))
    return docs.join(F.broadcast(hits), "doc_id").select("doc_id", "score", tx.excerpt(F.col("text")).alias("excerpt"))


@query(f"""WITH {BM25}, {DENSE}, ok AS (SELECT doc_id FROM documents WHERE lang = 'en'),
d20 AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM dense SEMI JOIN ok USING (doc_id) QUALIFY rank <= 20),
s20 AS (SELECT *, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 SEMI JOIN ok USING (doc_id) QUALIFY rank <= 20),
parts AS (SELECT doc_id, 0.7e0 / (60 + rank) AS p FROM d20 UNION ALL SELECT doc_id, 0.3e0 / (60 + rank) FROM s20)
SELECT doc_id, round(sum(p), 9) AS rrf FROM parts GROUP BY doc_id ORDER BY rrf DESC, doc_id LIMIT 10""")
def filtered_hybrid(spark, d):
    docs = documents(spark, d)
    a = search.ranked(dense_scores(spark, d).join(docs.where("lang = 'en'").select("doc_id"), "doc_id", "left_semi"), 20)
    b = search.ranked(index(spark, d).best(QUERY, 20, docs.where("lang = 'en'")), 20)
    return search.rrf({"dense": a, "sparse": b}, 10, {"dense": 0.7, "sparse": 0.3})


@query(f"""WITH {BM25}, b AS (SELECT doc_id, round(score * CASE WHEN list_bool_or([contains(lower(split_part(text, chr(10), 1)), w) FOR w IN string_split({Q_SQL}, ' ')]) THEN 2.0e0 ELSE 1e0 END
* CASE WHEN list_bool_or([contains(lower(substr(text, 61, 300)), w) FOR w IN string_split({Q_SQL}, ' ')]) THEN 1.5e0 ELSE 1e0 END, 6) AS score FROM bm25 JOIN documents USING (doc_id))
SELECT * FROM b ORDER BY score DESC, doc_id LIMIT 10""")
def metadata_boost(spark, d):
    docs = documents(spark, d)
    hits = index(spark, d).all_scores(QUERY).join(docs.select("doc_id", "title", "abstract"), "doc_id")
    return search.top(search.metadata_boost(hits, QUERY), 10).select("doc_id", "score")


OVERLAP = f"round(len(list_intersect(list_distinct(string_split({Q_SQL}, ' ')), {TOKENS})) / 4e0, 6)"


@query(f"SELECT doc_id, {OVERLAP} AS score FROM documents ORDER BY score DESC, doc_id LIMIT 10")
def rerank_overlap(spark, d):
    return search.top(documents(spark, d).select("doc_id", search.overlap_score(F.col("text"), QUERY).alias("score")), 10)


@query(RRF.replace("<= 20", "<= 100") % ("0.7e0", "0.3e0") + f", c AS (SELECT doc_id, rrf FROM fused ORDER BY rrf DESC, doc_id LIMIT 50) SELECT doc_id, coalesce({OVERLAP}, 0e0) AS score FROM c LEFT JOIN documents USING (doc_id) ORDER BY score DESC, doc_id LIMIT 10")
def search_with_rerank(spark, d):
    docs = documents(spark, d)
    a, b = legs(spark, d, 100)
    best = search.rrf({"dense": a, "sparse": b}, 50, {"dense": 0.7, "sparse": 0.3})
    scored = docs.join(F.broadcast(best.select("doc_id")), "doc_id").select("doc_id", search.overlap_score(F.col("text"), QUERY).alias("s"))
    return search.top(best.select("doc_id").join(scored, "doc_id", "left").select("doc_id", F.coalesce("s", F.lit(0.0)).alias("score")), 10)


@query("SELECT doc_id, source FROM documents WHERE contains(lower(source), 'src1') ORDER BY source DESC, lower(source), doc_id LIMIT 20 OFFSET 5")
def author_search_page(spark, d):
    return read(spark, d, "documents").where(F.contains(F.lower("source"), F.lit("src1"))).orderBy(F.desc("source"), F.lower("source"), "doc_id").offset(5).limit(20).select("doc_id", "source")


@query("SELECT count(*) AS n, count_if(source <> 'src0')::BIGINT AS known, round(100e0 * count_if(source <> 'src0') / greatest(count(*), 1), 1) AS percent FROM documents")
def author_quality_stats(spark, d):
    known = F.count_if(F.col("source") != "src0")
    return read(spark, d, "documents").agg(F.count("*").alias("n"), known.alias("known"), F.round(100.0 * known / F.greatest(F.count("*"), F.lit(1)), 1).alias("percent"))


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) = 1995 ORDER BY o_orderkey LIMIT 50")
def year_search(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")).where("y = 1995").orderBy("o_orderkey").limit(50)


@query("SELECT o_orderkey, year(o_orderdate)::INT AS y FROM orders WHERE year(o_orderdate) BETWEEN 1994 AND 1995 ORDER BY o_orderkey LIMIT 50 OFFSET 10")
def year_range_search(spark, d):
    return read(spark, d, "orders").select("o_orderkey", F.year("o_orderdate").alias("y")).where("y BETWEEN 1994 AND 1995").orderBy("o_orderkey").offset(10).limit(50)


@query("SELECT min(doc_id) AS doc_id, split_part(text, chr(10), 1) AS title FROM documents GROUP BY 2 ORDER BY doc_id LIMIT 50")
def list_papers_page(spark, d):
    return documents(spark, d).groupBy("title").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id").limit(50).select("doc_id", "title")


@query("SELECT doc_id, lang, source, n_chars FROM documents WHERE doc_id = 17")
def get_metadata(spark, d):
    return read(spark, d, "documents").where("doc_id = 17").select("doc_id", "lang", "source", "n_chars")


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS sources, min(length(text)) AS shortest, max(length(text)) AS longest, (sum(length(text)) // count(*))::BIGINT AS mean FROM documents")
def collection_stats(spark, d):
    n = F.length("text")
    return read(spark, d, "documents").agg(F.count("*").alias("chunks"), F.countDistinct("source").alias("sources"), F.min(n).cast("long").alias("shortest"), F.max(n).cast("long").alias("longest"), F.expr("sum(length(text)) div count(*)").alias("mean"))


@query("SELECT source, count(*) AS n, max(n_chars) AS longest FROM documents GROUP BY source")
def chunks_per_doc(spark, d):
    return read(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.max("n_chars").alias("longest"))


def _projected(name, column, sql, table="documents", key="doc_id"):
    def f(spark, d):
        base = documents(spark, d) if table == "documents" else read(spark, d, table)
        return base.select(key, column().alias("v"))

    f.__name__ = name
    query(f"SELECT {key}, {sql} AS v FROM {table}" if sql else None)(f)


#: Word ends for an engine without look-arounds.
EDGE, EDGE_AFTER = r"(^|[^\p{L}\p{M}\p{N}\p{Pc}])", r"($|[^\p{L}\p{M}\p{N}\p{Pc}])"
TITLE = "split_part(text, chr(10), 1)"
NORM = f"array_to_string(list_filter(regexp_split_to_array(regexp_replace(lower({TITLE}), '[!-/:-@\\[-`{{-~]', ' ', 'g'), '{WS}+'), lambda x: x NOT IN ('', 'a', 'an', 'the')), ' ')"
STRIPPED = f"regexp_replace(text, '^{WS}+|{WS}+$', '', 'g')"
_projected("normalized_title", lambda: tx.normalized_title(F.col("title")), NORM)
_projected("title_hash", lambda: tx.title_hash(tx.normalized_title(F.col("title"))), f"substr(sha256({NORM}), 1, 16)")
_projected("item_key", lambda: tx.item_key(F.col("url")), "upper(substr(sha256(url), 1, 8))", "pages", "page_id")
_projected("citation_key", lambda: tx.citation_key(F.array("c_name"), F.lit(1999)), "regexp_replace(list_last(string_split(c_name, ' ')), '[^A-Za-z0-9]', '', 'g') || '1999'", "customer", "c_custkey")
_projected("extract_year", lambda: tx.filename_year(F.col("url")), "CASE WHEN TRY_CAST(regexp_extract(regexp_extract(url, '[^/]*$'), '([0-9]{4})', 1) AS INT) BETWEEN 1950 AND 2050 THEN TRY_CAST(regexp_extract(regexp_extract(url, '[^/]*$'), '([0-9]{4})', 1) AS INT) END", "pages", "page_id")
_projected("truncate_prompt", lambda: tx.truncate(F.col("text"), 200), f"CASE WHEN length({STRIPPED}) <= 200 THEN {STRIPPED} ELSE regexp_replace(substr({STRIPPED}, 1, 200), ' [^ ]*$', '') || '...' END")
_projected("token_count", lambda: tx.token_count(F.col("text")), f"floor(len({TOKENS}) * 1.3e0)::INT")
_projected("chunk_estimate", lambda: tx.chunk_estimate(F.col("text")), "CASE WHEN length(text) = 0 THEN 0 ELSE greatest(1, floor(length(text) / 4e0 / 924)::INT + 1) END")
_projected("clean_text", lambda: tx.clean(F.col("text")), f"regexp_replace(regexp_replace(regexp_replace(text, '{WS}+', ' ', 'g'), '[*_`]', '', 'g'), '^{WS}+|{WS}+$', '', 'g')")
_projected("tags", lambda: F.array_join(tx.tags(F.col("text"), TAGS), ","), "array_to_string(list_filter([CASE WHEN contains(lower(text), 'rouge') OR contains(lower(text), 'blau') THEN 'colour' END, CASE WHEN contains(lower(text), 'ther') OR contains(lower(text), 'energy') THEN 'energy' END, CASE WHEN contains(lower(text), 'tion') THEN 'motion' END], lambda x: x IS NOT NULL), ',')")
_projected("instruments", lambda: F.array_join(tx.instruments(F.col("text"), INSTRUMENTS), ","), f"array_to_string(list_filter([CASE WHEN regexp_matches(text, '{EDGE}The{EDGE_AFTER}') THEN 'alpha' END, CASE WHEN regexp_matches(text, '{EDGE}[A-Z]nd{EDGE_AFTER}') THEN 'beta' END], lambda x: x IS NOT NULL), ',')")
_projected("extract_authors", lambda: F.array_join(tx.author_list(F.col("title")), "|"), None)
_projected("extract_title", lambda: tx.pdf_title(F.col("text")), None)
# every third text begins with a DOI; the others may hold one of their own, which the same patterns find
_projected("extract_doi", lambda: tx.doi(F.concat(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("doi: 10.1234/x"), F.col("doc_id").cast("string"), F.lit(".\n"))).otherwise(""), F.col("text"))), "CASE WHEN doc_id % 3 = 0 THEN '10.1234/x' || doc_id ELSE regexp_replace(nullif(regexp_extract(substr(text, 1, 2000), '(^|[^0-9A-Za-z_])(10[.][0-9]{4,}/[^ \t\n]+)', 2), ''), '[.,;)\\]]+$', '') END")
_projected("chunk_paper", lambda: F.concat_ws("|", tx.paper_of_chunk(F.concat("source", F.lit("_chunk_"), F.col("doc_id").cast("string"))), tx.paper_of_part(F.concat("lang", F.lit("-"), "source", F.lit("-1"))), tx.three_places(F.col("n_chars") / 8)), "source || '|' || lang || '|' || printf('%.3f', n_chars / 8.0::DOUBLE)")
_projected("pdf_date_year", lambda: tx.pdf_date_year(F.concat(F.lit("D:"), F.year("o_orderdate").cast("string"), F.lit("0101"))), "year(o_orderdate)::INT", "orders", "o_orderkey")
_projected("embedding_text", lambda: F.concat_ws("\n\n", F.concat(F.lit("Title: "), "title"), F.concat(F.lit("Keywords: "), F.array_join(F.sort_array(F.array_union(F.array("lang", "source"), F.array("lang"))), ", ")), F.concat(F.lit("Content: "), "text")), f"'Title: ' || {TITLE} || chr(10) || chr(10) || 'Keywords: ' || array_to_string(list_sort(list_distinct([lang, source])), ', ') || chr(10) || chr(10) || 'Content: ' || text")


# The tables' texts have no such lines, so a heading made of their columns stands before each.
HEAD = "'Authors: ' || source || ' and ' || lang || chr(10) || 'Journal: Journal of ' || source || ' Studies, vol. 1' || chr(10) || 'Year: ' || (1940 + doc_id % 120) || chr(10) || 'Abstract' || chr(10) || 'On ' || source || ' and the many things that were found there, in ' || lang || ' or not.' || chr(10) || 'Keywords: ' || lang || '; ' || source || ';; a b' || chr(10) || '1. Introduction' || chr(10)"


def headed(spark, d):
    return read(spark, d, "documents").select("doc_id", "source", "lang", F.expr(f"{HEAD.replace('chr(10)', 'char(10)')} || text").alias("text"))


def _extracted(name, column, sql):
    def f(spark, d):
        return headed(spark, d).select("doc_id", column(F.col("text")).alias("v"))

    f.__name__ = name
    query(f"SELECT doc_id, {sql} AS v FROM documents")(f)


_extracted("page_authors", lambda c: F.array_join(extract.page_authors(c), "|"), "source || '|' || lang")
_extracted("extract_journal", extract.page_journal, "'Journal of ' || source || ' Studies'")
_extracted("extract_abstract", extract.page_abstract, "CASE WHEN length('On ' || source || ' and the many things that were found there, in ' || lang || ' or not.') > 50 THEN 'On ' || source || ' and the many things that were found there, in ' || lang || ' or not.' END")
_extracted("extract_keywords", lambda c: F.array_join(extract.page_keywords(c), "|"), "lang || '|' || source || '|a b'")
_extracted("markdown_year", lambda c: extract.markdown_year(c, F.lit("x/y.md")), "CASE WHEN 1940 + doc_id % 120 BETWEEN 1950 AND 2050 THEN (1940 + doc_id % 120)::INT END")
_extracted("markdown_authors", lambda c: F.array_join(extract.markdown_authors(c), "|"), "source || ' and ' || lang")
_extracted("markdown_journal", extract.markdown_journal, "'Journal of ' || source || ' Studies, vol. 1'")
_projected("validate_doi", lambda: tx.valid_doi(F.concat(F.lit("10."), (F.col("doc_id") * 37).cast("string"), F.lit("/"), F.col("lang"))), "CASE WHEN length((doc_id * 37)::VARCHAR) >= 4 THEN '10.' || (doc_id * 37) || '/' || lang END")
_projected("parse_authors", lambda: F.array_join(tx.pdf_authors(F.concat_ws(" and ", "source", "lang")), "|"), "source || '|' || lang")


@query("SELECT doc_id, 'Title: ' || lang || chr(10) || chr(10) || 'Authors: ' || source || '; ' || lang || chr(10) || chr(10) || 'Published in: ' || source || ' (' || (2000 + doc_id % 9) || ')' || chr(10) || chr(10) || 'Keywords: ' || array_to_string(list_sort(list_distinct([lang, source, 'x'])), ', ') || chr(10) || chr(10) || 'Content: ' || text AS v FROM documents WHERE text <> ''")
def embedding_text_of_records(spark, d):
    f = {"title": F.col("lang"), "authors": F.array("source", "lang"), "abstract": F.lit(""), "publication": F.col("source"), "year": 2000 + F.col("doc_id") % 9, "keywords": F.array("lang", "source"), "tags": F.array(F.lit("x"), F.col("lang"))}
    return read(spark, d, "documents").where("text <> ''").select("doc_id", extract.embedding_text(f, F.col("text")).alias("v"))


@query("SELECT doc_id::VARCHAR AS item_key, '' AS filename, '' AS file_type, coalesce(nullif(split_part(text, chr(10), 1), ''), 'Unknown') AS title, lang || ', ' || source AS authors, CASE WHEN doc_id % 3 = 0 THEN 'Unknown' ELSE (2000 + doc_id % 20)::VARCHAR END AS year, '' AS doi, '' AS citation_key, source AS publication, substr(text, 61, 300) AS abstract, '' AS keywords, '' AS tags, '' AS collections, CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END AS has_fulltext, '' AS fulltext_source, 'False' AS is_scanned, n_chars::VARCHAR AS page_count, '' AS date_added, '2024-01-02T03:04:05' AS date_modified FROM documents")
def metadata_strings(spark, d):
    rows = documents(spark, d).select(F.col("doc_id").alias("item_key"), "title", F.array("lang", "source").alias("authors"), F.when(F.col("doc_id") % 3 != 0, 2000 + F.col("doc_id") % 20).alias("year"), F.col("source").alias("publication"), "abstract", (F.col("n_chars") > 1000).alias("has_fulltext"), F.col("n_chars").alias("page_count"), F.lit("2024-01-02 03:04:05").cast("timestamp").alias("date_modified"))
    return rows.select(extract.metadata_strings(dict(rows.dtypes), {c: F.col(c) for c in rows.columns}))


@query("SELECT doc_id, coalesce(nullif(split_part(text, chr(10), 1), ''), 'Unknown') AS title, coalesce(source, 'Unknown') AS authors, 'Unknown' AS year, coalesce(lang, '') AS language, CASE WHEN n_chars > 1000 THEN 'True' ELSE 'False' END AS has_fulltext FROM documents")
def metadata_projection(spark, d):
    return documents(spark, d).select("doc_id", F.coalesce(tx.nonempty(F.col("title")), F.lit("Unknown")).alias("title"), F.coalesce("source", F.lit("Unknown")).alias("authors"), F.lit("Unknown").alias("year"), F.coalesce("lang", F.lit("")).alias("language"), F.when(F.col("n_chars") > 1000, "True").otherwise("False").alias("has_fulltext"))


@query(f"""WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(text, '{WS}+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, w, unnest(range(0, greatest(len(w) - 11, 0) + 1, 90)) AS start FROM w WHERE len(w) > 0)
SELECT doc_id, format('{{}}_{{:03d}}', doc_id, start // 90) AS chunk_id, (start // 90)::INT AS chunk_index, start > 0 AS has_overlap, array_to_string(w[start + 1 : start + 100], ' ') AS text FROM s""")
def word_window_chunks(spark, d):
    return chunking.word_windows(read(spark, d, "documents"))


@query(None)
def section_chunks(spark, d):
    return chunking.sections(read(spark, d, "documents"), separator="\n")


@query(f"SELECT doc_id, len(string_split(regexp_replace(text, '([.!?]){WS}+', '\\1' || chr(1), 'g'), chr(1)))::INT AS n FROM documents")
def sentence_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(F.split("text", f"(?<=[.!?]){WS}+")).alias("n"))


@query("SELECT doc_id, len(string_split(text, chr(10)))::INT AS n FROM documents")
def paragraph_split(spark, d):
    return read(spark, d, "documents").select("doc_id", F.size(F.split("text", "\n")).alias("n"))


@query(None)
def recursive_chunks(spark, d):
    return chunking.recursive(read(spark, d, "documents"))


@query(None)
def packed_sentences(spark, d):
    return chunking.sentences(read(spark, d, "documents"))


@query(None)
def packed_paragraphs(spark, d):
    return chunking.paragraphs(read(spark, d, "documents"), 200)


@query(None)
def document_chunks(spark, d):
    return chunking.document_chunks(read(spark, d, "documents"), ["lang", "source"])


@query("SELECT doc_id, doc_id || '_mm_' || i AS chunk_id, i::INT AS chunk_index, lang AS text, (i * 2 + 1)::INT AS image_page, 'uri' || i AS image, TRUE AS is_multimodal FROM documents, (SELECT unnest(range(3)) AS i) WHERE i < doc_id % 5")
def multimodal_chunks(spark, d):
    images = F.transform(F.sequence(F.lit(0), F.lit(4)), lambda i: F.struct((i * 2).cast("int").alias("page"), F.concat(F.lit("uri"), i.cast("string")).alias("uri")))
    docs = read(spark, d, "documents").select("doc_id", F.col("lang").alias("text"), F.slice(images, F.lit(1), (F.col("doc_id") % 5).cast("int")).alias("images"))
    return chunking.image_chunks(docs, [])


@query("SELECT count(*) AS chunks, count(DISTINCT source) AS documents, round(count(*) / count(DISTINCT source)::DOUBLE, 1) AS mean FROM documents")
def chunk_stats(spark, d):
    n, k = F.count("*"), F.countDistinct("source")
    return read(spark, d, "documents").agg(n.alias("chunks"), k.alias("documents"), F.round(n / k, 1).alias("mean"))


@query(None)
def markdown_chunks(spark, d):
    return chunking.sized(chunking.markdown(read(spark, d, "documents").withColumn("text", F.concat(F.lit("# "), F.col("text")))), 200)


@query(f"""WITH t AS (SELECT doc_id, unnest({TOKENS}) AS term FROM documents),
c AS (SELECT doc_id, ('0x' || substr(md5(term), 1, 8))::BIGINT % 64 AS bucket, count(*) AS c FROM t GROUP BY ALL)
SELECT doc_id, bucket, round(c / sqrt(sum(c * c) OVER (PARTITION BY doc_id)), 6) AS value FROM c""")
def hash_embedding(spark, d):
    return search.hash_embedding(read(spark, d, "documents"))


_BUCKETS = f"SELECT conv_id, turn, ('0x' || substr(md5(term), 1, 8))::BIGINT % CASE WHEN role = 'user' THEN 32 ELSE 64 END AS bucket, count(*) AS c FROM (SELECT conv_id, turn, role, unnest({TOKENS}) AS term FROM conversations) GROUP BY conv_id, turn, role, bucket"


@query(f"""WITH b AS ({_BUCKETS}), v AS (SELECT conv_id, turn, bucket, c / sqrt(sum(c * c) OVER (PARTITION BY conv_id, turn)) AS x FROM b)
SELECT conv_id, turn, CASE WHEN role = 'user' THEN 'multimodal' ELSE 'text' END AS route, CASE WHEN role = 'user' THEN 32 ELSE 64 END::INT AS dims, (SELECT arg_max(bucket, x * 1000 - bucket / 1000.0) FROM v WHERE v.conv_id = c.conv_id AND v.turn = c.turn)::INT AS top_bucket
FROM conversations c WHERE regexp_matches(text, '{NOT_WS}')""")
def embed_routing(spark, d):
    """Turns of one kind go to another model; the vector's length and largest bucket tell which."""
    rows = read(spark, d, "conversations").where(F.col("text").rlike(NOT_WS)).withColumn("mm", F.col("role") == "user")
    got = rows.select("conv_id", "turn", "mm", embedding.routed(F.col("text"), F.col("mm"), embedding.HashEmbedder(64), embedding.HashEmbedder(32)).alias("v"))
    return got.select("conv_id", "turn", F.when(F.col("mm"), "multimodal").otherwise("text").alias("route"), F.size("v").alias("dims"), (F.array_position("v", F.array_max("v")) - 1).cast("int").alias("top_bucket"))


@query(None)
def ann_topk(spark, d):
    """The ten nearest of three vectors from the nearest lists; recall is measured in the tests."""
    vectors = read(spark, d, "embeddings")
    stored = embedding.VectorIndex.build(vectors, shared_folder(spark, "vector-index"))
    asked = [(r["vec_id"], list(r["embedding"])) for r in vectors.where("vec_id IN (0, 1, 2)").orderBy("vec_id").collect()]
    return stored.search(asked, 10)


@query("SELECT sha256(text) AS key, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def exact_duplicates(spark, d):
    return catalog.exact_groups(read(spark, d, "documents").select("doc_id", F.sha2("text", 256).alias("key")), "key", "doc_id")


@query(f"SELECT {NORM} AS title, min(doc_id) AS first_id, count(*) AS n FROM documents GROUP BY 1 HAVING count(*) > 1")
def title_groups(spark, d):
    docs = documents(spark, d).select("doc_id", tx.normalized_title(F.col("title")).alias("title"))
    return catalog.exact_groups(docs, "title", "doc_id")


@query("SELECT doc_id, source, n_chars FROM documents QUALIFY row_number() OVER (PARTITION BY sha256(split_part(text, chr(10), 1)) ORDER BY n_chars DESC, doc_id) = 1")
def best_version(spark, d):
    return catalog.best_version(documents(spark, d), "title", [F.desc("n_chars"), "doc_id"]).select("doc_id", "source", "n_chars")


@query(None)
def fuzzy_title_pairs(spark, d):
    titles = documents(spark, d).select("doc_id", tx.normalized_title(F.col("title")).alias("title"))
    return dedup.fuzzy_pairs(titles)


def records(spark, d):
    """Documents as records: a DOI that some share, a publication, a year and full text made of their columns."""
    doi = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("10.1234/"), (F.col("doc_id") % 35).cast("string")))
    return documents(spark, d).select("doc_id", "title", "abstract", doi.alias("doi"), F.when(F.col("lang") == "en", F.col("source")).alias("publication"), (2000 + F.col("doc_id") % 20).cast("int").alias("year"), (F.col("n_chars") > 1000).alias("has_fulltext"))


DOIS = "CASE WHEN doc_id % 5 = 0 THEN '10.1234/' || (doc_id % 35) END"


@query(f"SELECT doi, array_to_string(list_sort(list(doc_id)), ',') AS ids, count(*) AS n FROM (SELECT doc_id, {DOIS} AS doi FROM documents) WHERE doi IS NOT NULL GROUP BY doi HAVING count(*) > 1")
def doi_groups(spark, d):
    return dedup.doi_groups(records(spark, d)).withColumn("ids", F.array_join(F.col("ids").cast("array<string>"), ","))


@query(None)
def dedup_documents(spark, d):
    """Winners and duplicates by DOI and similar titles; titles over 300 characters stand for no title."""
    docs = records(spark, d).withColumn("title", F.when(F.length("title") <= 300, F.col("title")))
    unique, lost = dedup.deduplicate(docs)
    return unique.select("doc_id", F.lit(None).cast("long").alias("winner"), F.lit("kept").alias("reason")).unionByName(lost.withColumnRenamed("id", "doc_id"))


@query(f"""WITH r AS (SELECT doc_id, {DOIS} AS doi, CASE WHEN lang = 'en' THEN source END AS publication, n_chars > 1000 AS ft, 2000 + doc_id % 20 AS y, length(substr(text, 61, 300)) AS la FROM documents)
SELECT doi, doc_id FROM r WHERE doi IS NOT NULL QUALIFY row_number() OVER (PARTITION BY doi ORDER BY publication IS NOT NULL AND publication <> '' DESC, ft DESC, y DESC, la DESC, doc_id) = 1""")
def best_version_by_criteria(spark, d):
    docs = records(spark, d).where("doi IS NOT NULL")
    return catalog.best_version(docs, "doi", [*dedup.priority(docs.columns), "doc_id"]).select("doi", "doc_id")


def _events(spark, d):
    e = read(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("first"), F.max("ts").alias("mtime")).withColumnRenamed("user_id", "path")
    return e, e.where(F.col("path") % 2 == 0).select("path", F.when(F.col("path") % 4 == 0, F.col("mtime")).otherwise(F.col("first")).alias("mtime"))


SCAN = "e AS (SELECT user_id AS path, min(ts) AS first, max(ts) AS mtime FROM events GROUP BY 1), s AS (SELECT path, CASE WHEN path % 4 = 0 THEN mtime ELSE first END AS mtime FROM e WHERE path % 2 = 0)"


@query(f"WITH {SCAN} SELECT path FROM e ANTI JOIN s ON e.path = s.path AND e.mtime <= s.mtime")
def incremental_new(spark, d):
    scan, state = _events(spark, d)
    return catalog.to_index(scan, state).select("path")


@query(f"WITH {SCAN} SELECT e.path, CASE WHEN s.path IS NULL THEN 'added' ELSE 'updated' END AS change FROM e LEFT JOIN s USING (path)")
def classify_added_updated(spark, d):
    scan, state = _events(spark, d)
    return catalog.classify(scan, state).select("path", "change")


@query(f"WITH {SCAN} SELECT path, CASE WHEN path % 3 = 0 THEN mtime ELSE (SELECT mtime FROM s WHERE s.path = e.path) END AS mtime FROM e WHERE path % 3 = 0 OR path % 2 = 0")
def state_upsert(spark, d):
    """A third of the scan is written; rows of the state that it doesn't hold stay."""
    scan, state = _events(spark, d)
    return catalog.upsert(state, scan.where("path % 3 = 0").select("path", "mtime"), "path")


@query("SELECT count(*) AS seen, count_if(event_type = 'purchase')::BIGINT AS indexed, count_if(value IS NULL)::BIGINT AS failed, max(ts) AS last FROM events")
def index_statistics(spark, d):
    return read(spark, d, "events").agg(F.count("*").alias("seen"), F.count_if(F.col("event_type") == "purchase").alias("indexed"), F.count_if(F.col("value").isNull()).alias("failed"), F.max("ts").alias("last"))


@query("SELECT user_id, count(DISTINCT event_type) AS kinds FROM events GROUP BY user_id HAVING count(*) > 1")
def duplicate_map(spark, d):
    return read(spark, d, "events").groupBy("user_id").agg(F.size(F.collect_set("event_type")).cast("long").alias("kinds"), F.count("*").alias("n")).where("n > 1").drop("n")


@query("SELECT doc_id FROM documents SEMI JOIN (SELECT unnest([1, 2, 3, 5000000]) AS doc_id) USING (doc_id) WHERE doc_id NOT IN (2)")
def sync_retry(spark, d):
    failed = spark.range(1).select(F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3, 5000000)))).alias("doc_id"))
    done = spark.range(2, 3).withColumnRenamed("id", "doc_id")
    return read(spark, d, "documents").select("doc_id").join(failed, "doc_id", "left_semi").join(done, "doc_id", "left_anti")


PACK = f"""WITH {BM25}, h AS (SELECT doc_id, score, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM bm25 QUALIFY rank <= 5),
p AS (SELECT rank, doc_id, CASE WHEN length({STRIPPED}) <= 500 THEN {STRIPPED} ELSE regexp_replace(substr({STRIPPED}, 1, 500), ' [^ ]*$', '') || '...' END AS passage FROM h JOIN documents USING (doc_id)),
k AS (SELECT *, coalesce(sum(length(passage)) OVER (ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM p WHERE passage <> ''),
kept AS (SELECT row_number() OVER (ORDER BY rank)::INT AS label, doc_id, passage FROM k WHERE b < 2500) """


def _packed(spark, d):
    docs = documents(spark, d)
    hits = search.ranked(index(spark, d).best(QUERY, 5), 5)
    return catalog.pack_context(docs.select("doc_id", "text").join(F.broadcast(hits), "doc_id"), 2500, api.passage_limit(2500, 5)).select("label", "doc_id", "passage")


@query(PACK + "SELECT * FROM kept")
def rag_pack(spark, d):
    return _packed(spark, d)


@query(PACK + "SELECT string_agg('[' || label || '] ' || passage, chr(10) ORDER BY label) AS prompt FROM kept")
def rag_prompt(spark, d):
    lines = F.sort_array(F.collect_list(F.struct("label", F.concat(F.lit("["), F.col("label").cast("string"), F.lit("] "), "passage").alias("line"))))
    return _packed(spark, d).agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("prompt"))
