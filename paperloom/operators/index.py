"""A stored keyword index: postings by term bucket, document lengths and term weights, built once and read by any query.

A search reads the buckets of its terms and no others, so its cost follows the postings it needs and not the corpus.
Postings are appended; the term weights, which every new document changes a little, are written anew under a newer
number, and readers take the newest.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import tokens
from .search import B, EPSILON, K1, top

#: Queries of one batch; their terms are a bounded, broadcast side.
MOST_QUERIES = 10_000


class KeywordIndex:
    """An index in a folder that all nodes share; ``buckets`` is fixed when it is built."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self._corpus: dict | None = None
        self._frames: dict[str, DataFrame] = {}

    def _read(self, name: str) -> DataFrame:
        """A part of the index; its files are listed once, until something is written."""
        if name not in self._frames:
            self._frames[name] = self.spark.read.parquet(f"{self.folder}/{name}")
        return self._frames[name]

    def _bucket(self, term: str, buckets: int) -> Column:
        return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")

    @classmethod
    def build(cls, docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = 64) -> KeywordIndex:
        """Index a collection; a null text has no terms. Each id is indexed once, by its first text in order."""
        made = cls(docs.sparkSession, folder)
        made._add(docs, id_col, text_col, buckets)
        made.refresh(buckets)
        return made

    def _add(self, docs: DataFrame, id_col: str, text_col: str, buckets: int) -> None:
        one = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("doc_id is not null")
        words = one.groupBy("doc_id").agg(F.min("t").alias("t")).select("doc_id", tokens(F.col("t")).alias("w"))
        words.select("doc_id", F.size("w").alias("dl")).write.mode("append").parquet(f"{self.folder}/documents")
        counted = words.select("doc_id", F.size("w").alias("dl"), F.explode("w").alias("term")).groupBy("doc_id", "dl", "term").agg(F.count("*").cast("int").alias("f"))
        # a frequent term's bucket is dealt over several tasks, and so files, by document
        dealt = counted.withColumn("bucket", self._bucket("term", buckets)).repartition("bucket", F.pmod(F.xxhash64("doc_id"), F.lit(4)))
        dealt.sortWithinPartitions("bucket", "term").write.mode("append").partitionBy("bucket").parquet(f"{self.folder}/postings")
        self._frames.clear()

    def append(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> int:
        """Index documents whose id is new; their number. Term weights are renewed at once, so none is ever stale."""
        new = docs.join(self._read("documents").select(F.col("doc_id").alias("_known")), F.col(id_col) == F.col("_known"), "left_anti")
        n, buckets = new.select(id_col).distinct().count(), self.corpus["buckets"]
        if n:
            self._add(new, id_col, text_col, buckets)
            self.refresh(buckets)
        return n

    def _versions(self) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/corpus")
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(path)] if fs.exists(path) else []
        return sorted(int(n) for n in names if n.isdigit())

    def refresh(self, buckets: int) -> None:
        """Write the term weights and the corpus row anew; the corpus row comes last and makes a version count."""
        number = max(self._versions(), default=0) + 1
        n, avgdl = self._read("documents").agg(F.count("*"), F.avg("dl")).first()
        postings = self.spark.read.schema("doc_id long, dl int, term string, f int, bucket int").parquet(f"{self.folder}/postings") if n and avgdl else None
        if postings is None:
            counts = self.spark.createDataFrame([], "term string, bucket int, df long")
        else:
            counts = postings.groupBy("term", "bucket").agg(F.count("*").alias("df"))
        counts.withColumn("idf", F.log(n - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).write.mode("overwrite").partitionBy("bucket").parquet(f"{self.folder}/terms/{number}")
        mean = self._read(f"terms/{number}").agg(F.avg("idf")).first()[0] if postings is not None else None
        self.spark.createDataFrame([(n, avgdl, mean, buckets, number)], "n long, avgdl double, mean_idf double, buckets int, number int").coalesce(1).write.mode("overwrite").parquet(f"{self.folder}/corpus/{number}")
        self._corpus = None

    @property
    def corpus(self) -> dict:
        """Number of documents, their mean length, the mean weight of a term, and the number of buckets."""
        if self._corpus is None:
            self._corpus = self._read(f"corpus/{max(self._versions())}").first().asDict()
        return self._corpus

    def documents(self) -> DataFrame:
        return self._read("documents")

    def scores(self, queries: DataFrame, among: DataFrame | None = None) -> DataFrame:
        """``query_id, doc_id, score``: BM25-Okapi of the documents that hold a term of a query (``query_id, query``).

        A blank query finds nothing. among: the ids that count, in ``doc_id``; weights are still the whole corpus's.
        """
        words = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
        c = self.corpus
        asked = words.withColumn("bucket", self._bucket("term", c["buckets"]))
        n, wanted = asked.agg(F.countDistinct("query_id"), F.collect_set("bucket")).first()
        if n > MOST_QUERIES:
            raise ValueError(f"at most {MOST_QUERIES} queries at a time")
        if not wanted or c["mean_idf"] is None:
            return self.spark.createDataFrame([], "doc_id long, score double").join(queries.select("query_id").limit(0)).select("query_id", "doc_id", "score")
        weight = F.when(F.col("idf") < 0, EPSILON * c["mean_idf"]).otherwise(F.col("idf"))
        terms = self._read(f"terms/{c['number']}").where(F.col("bucket").isin(wanted)).join(F.broadcast(asked.drop("bucket")), "term").select("query_id", "term", (F.col("times") * weight).alias("weight"))
        hits = self._read("postings").where(F.col("bucket").isin(wanted)).join(F.broadcast(terms), "term")
        if among is not None:
            hits = hits.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
        part = F.col("weight") * F.col("f") * (K1 + 1) / (F.col("f") + K1 * (1 - B + B * F.col("dl") / c["avgdl"]))
        return hits.groupBy("query_id", "doc_id").agg(F.round(F.sum(part), 6).alias("score"))

    def one(self, query: str) -> DataFrame:
        """A single query as a batch."""
        return self.spark.createDataFrame([(0, query)], "query_id long, query string")

    def best(self, query: str, k: int, among: DataFrame | None = None) -> DataFrame:
        """``doc_id, score``: the best k for one query; documents without a term of it follow, at 0, in order of ids.

        Of the first 2 k ids at least k are no hits where there are fewer than k hits, so these fill the rest.
        """
        hits = top(self.scores(self.one(query), among).drop("query_id"), k)
        if not query.strip():
            return hits
        known = self.documents().select("doc_id")
        if among is not None:
            known = known.join(among.select("doc_id").distinct(), "doc_id", "left_semi")
        rest = known.orderBy("doc_id").limit(2 * k).join(F.broadcast(hits.select("doc_id")), "doc_id", "left_anti").select("doc_id", F.lit(0.0).alias("score"))
        return top(hits.unionByName(rest), k)

    def all_scores(self, query: str) -> DataFrame:
        """``doc_id, score`` of every document."""
        hits = self.scores(self.one(query)).drop("query_id")
        return self.documents().select("doc_id").join(hits, "doc_id", "left").select("doc_id", F.coalesce("score", F.lit(0.0)).alias("score"))
