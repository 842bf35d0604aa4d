"""File sources, stored collections and streaming ingest on small fixtures."""

import os
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from paperloom.operators import embedding, workflow
from paperloom.sources import collections, files
from paperloom.streaming import ingest


def put(root, name, data):
    path = root / name
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_bytes(data)


def test_library_scan(spark, tmp_path):
    assert files.library(spark, str(tmp_path / "none")).count() == 0
    for name in ("a/1.pdf", "b/2.pdf", "b/c/3.pdf", "4.pdf", "a/5.md"):
        put(tmp_path, name, b"\xffx" if name == "a/5.md" else b"%PDF")
    names = lambda df: [os.path.basename(r.path) for r in df.orderBy("path").collect()]
    assert names(files.library(spark, str(tmp_path))) == ["1.pdf", "2.pdf"]
    assert names(files.library(spark, str(tmp_path), limit=1)) == ["1.pdf"]
    assert names(files.library(spark, str(tmp_path), ("pdf", "md"))) == ["1.pdf", "5.md", "2.pdf"]
    assert files.library(spark, str(tmp_path), ("md",), content=True).select(files.file_text(F.col("content"))).first()[0] == "�x"


def test_pages_and_images(spark):
    rows = [(1, ["x" * 101, " ", "y"], ["o", "p", "q"]), (2, ["x" * 100, "", None], ["o" * 100, "p", " "])]
    df = spark.createDataFrame(rows, "id int, pages array<string>, ocr array<string>")
    got = df.orderBy("id").select(files.is_scanned(F.col("pages")), files.join_pages(F.col("pages")), files.join_pages(F.col("pages"), F.col("ocr"))).collect()
    assert [tuple(r) for r in got] == [(False, "x" * 101 + "\n\ny", "x" * 101 + "\n\ny"), (True, "x" * 100, "x" * 100 + "\n\np")]
    images = [("f", 1, i, 100 if i else 99, 100, "png", b"ab") for i in range(8)] + [("f", 2, 0, 100, 99, "png", b"ab")]
    got = files.page_images(spark.createDataFrame(images, "path string, page int, idx int, width int, height int, ext string, data binary")).orderBy("idx").collect()
    assert [r.idx for r in got] == [1, 2, 3, 4, 5] and got[0].uri == "data:image/png;base64,YWI="


def test_collection(spark, tmp_path):
    store = collections.Store(spark, str(tmp_path / "store"))
    assert store.names() == []
    c = store.get_or_create("papers", "id string, text string", "id", space="cosine")
    c.upsert(spark.createDataFrame([("a", "one"), ("b", " ")], "id string, text string"))
    c.upsert(spark.createDataFrame([("a", None)], "id string, text string"))
    c.add_missing(spark.createDataFrame([("a", "late"), ("d", "four")], "id string, text string"))
    assert {tuple(r) for r in c.read().collect()} == {("a", None), ("b", " "), ("d", "four")}
    assert [r.id for r in c.searchable().collect()] == ["d"]
    assert c.lookup("a").first().text is None and c.lookup("z").count() == 0
    assert [r.id for r in c.sample(2).collect()] == ["a", "b"]
    assert store.get_or_create("papers", "id string", "id", space="other").stats() == {"name": "papers", "count": 3, "key": "id", "space": "cosine"}
    assert c.compact("small")._versions().count() == 3
    c.backup(str(tmp_path / "copy"))
    assert spark.read.parquet(str(tmp_path / "copy")).count() == 3
    assert store.names() == ["papers", "small"] and store.drop("small") and not store.drop("small")


def test_mirror(spark, tmp_path):
    store = collections.Store(spark, str(tmp_path / "store"))
    local, cloud = (store.get_or_create(n, "id string, text string", "id") for n in ("here", "there"))
    mirror = collections.Mirror(local, cloud)
    one = spark.createDataFrame([("a", "one")], "id string, text string")
    assert mirror.add(one) and mirror.stats()["failures"] == 0
    whole, cloud.upsert = cloud.upsert, lambda *_: 1 / 0
    assert not mirror.add(spark.createDataFrame([("b", "two"), ("c", "three")], "id string, text string"))
    assert mirror.stats() == {"failures": 1, "failed_chunks": 2, "last_error": "division by zero"}
    cloud.upsert = whole
    assert mirror.retry() == 2 and mirror.stats()["failures"] == 0
    assert {r.id for r in cloud.read().collect()} == {"a", "b", "c"}
    assert mirror.source("cloud") is cloud and mirror.source("x") is local and collections.Mirror(local, None).source("cloud") is local


def test_ingest(spark, tmp_path):
    root = tmp_path / "library"
    store = collections.Store(spark, str(tmp_path / "store"))
    c = store.get_or_create("files", "path string, mtime timestamp, text string", "path")
    put(root, "a/1.md", b"# One")
    for n in (1, 2):
        stream = files.library_stream(spark, str(root))
        query = ingest.ingest(stream, c, str(tmp_path / "checkpoint"), "mtime", ingest.documents)
        query.awaitTermination(60)
        assert query.exception() is None and c.read().count() == n
        put(root, "b/2.md", b"# Two")
    assert {r.text for r in c.read().collect()} == {"# One", "# Two"}


def test_ingest_under_a_new_checkpoint(spark, tmp_path):
    root, store = tmp_path / "library", collections.Store(spark, str(tmp_path / "store"))
    c = store.get_or_create("files", "path string, mtime timestamp, text string", "path")
    for n, name in enumerate(("one", "two")):
        put(root, "a/1.md", name.encode())
        put(root, f"a/{n + 5}.md", b"other")
        query = ingest.ingest(files.library_stream(spark, str(root)), c, str(tmp_path / f"checkpoint{n}"), "mtime", ingest.documents)
        query.awaitTermination(60)
        assert query.exception() is None
        assert {r.text for r in c.read().where("path like '%/1.md'").collect()} == {name}


# workers can't import this module
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Fails at first; gives each text's length."""

    def __init__(self, failures):
        self.failures = failures

    def encode(self, texts):
        import numpy as np

        self.failures -= 1
        if self.failures >= 0:
            raise OSError("busy")
        return np.array([[float(len(t))] for t in texts])


def test_models(spark, monkeypatch):
    waits = []
    assert embedding.with_retries(Flaky(2).encode, ["abc"], sleep=waits.append)[0][0] == 3 and waits == [1.0, 2.0]
    assert embedding.query_vector(Flaky(1), "x") == [] and embedding.query_vector(Flaky(0), "x") == [1.0]
    monkeypatch.delenv("NO_SUCH_KEY", raising=False)
    makers = {"far": ("NO_SUCH_KEY", lambda: 1), "near": (None, lambda: 2)}
    assert embedding.choose(makers) == 2
    for f in (lambda: embedding.choose(makers, "far"), lambda: embedding.choose({"far": makers["far"]})):
        with pytest.raises(ValueError):
            f()
    df = spark.createDataFrame([(i, 0, "w" * i if i % 4 else None, i % 2 == 0) for i in range(9)], "doc_id long, chunk_index int, text string, mm boolean").coalesce(1)
    got = df.select("doc_id", embedding.embed(F.col("text"), Flaky(0)).alias("v"), embedding.routed(F.col("text"), F.col("mm"), Flaky(0), embedding.HashEmbedder(8)).alias("r")).collect()
    assert [r.v for r in got] == [[float(i)] if i % 4 else None for i in range(9)]
    assert [len(r.r) if r.r else None for r in got] == [None if not i % 4 else 8 if i % 2 == 0 else 1 for i in range(9)]
    groups = embedding.embed_groups(df, embedding.HashEmbedder(8)).collect()
    assert sorted(r.doc_id for r in groups) == list(range(9)) and all(len(r.vector) == 8 for r in groups)
    pairs = spark.createDataFrame([(0, "a b", 1, 0.1, "a"), (0, "a b", 2, 0.2, "b a"), (0, "a b", 3, 0.3, None)], "query_id long, query string, doc_id long, score double, text string").coalesce(1)
    assert [r.doc_id for r in embedding.rerank(pairs, embedding.OverlapScorer(), 2).orderBy("rank").collect()] == [2, 1]
    assert [r.doc_id for r in embedding.rerank(pairs, Flaky(0), 3).orderBy("rank").collect()] == [3, 2, 1]


def test_vector_index_recall(spark, tmp_path):
    import numpy as np

    r = np.random.default_rng(7)
    vectors = r.normal(size=(3000, 32))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")
    index = embedding.VectorIndex.build(df, str(tmp_path / "vectors"), sample=1000)
    assert index.spark.read.parquet(index.folder + "/vectors").count() == 3000
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    asked = [(i, vectors[i].tolist()) for i in range(0, 3000, 100)]
    found = {}
    for row in index.search(asked, 10, probes=16).collect():
        found.setdefault(row.query_id, set()).add(row.doc_id)
    hits = sum(len(found[i] & set(np.argsort(-(unit @ unit[i]))[:10].tolist())) for i, _ in asked)
    assert hits >= 0.9 * 10 * len(asked) and all(len(x) == 10 for x in found.values())


PAPER = "# {title}\n\n**Authors:** Ann Bee, Cy Dee\n**DOI:** https://doi.org/10.1/{doi}\nPublished: 2019\n\n## Abstract\n\nOn ice.\n\n## Introduction\n\n{body}\n"


def test_index_library(spark, tmp_path):
    root, store = tmp_path / "library", collections.Store(spark, str(tmp_path / "store"))
    body = "Snow melts early on dark ice and the season grows longer every year. " * 60
    for name, title, doi in (("a/1.md", "Glacier albedo", "x"), ("b/2.md", "Another name", "x"), ("c/3.md", "Soot on snow", "y"), ("d/4.md", "The soot on snow", "z")):
        put(root, name, PAPER.format(title=title, doi=doi, body=body).encode())
        # of equal versions the one changed last wins, so the files are of one time and the first path does
        os.utime(root / name, (1_700_000_000, 1_700_000_000))
    put(root, "e/5.md", b" \n")
    scan = lambda: files.library(spark, str(root), ("md",), content=True).select("path", "mtime", files.file_text(F.col("content")).alias("text"))
    run = lambda **how: workflow.index_library(store, "papers", scan(), embedding.HashEmbedder(16), limit=100, overlap=10, tag_words={"ice": ["snow"]}, **how)
    first = run()
    assert (first.seen, first.skipped, first.duplicates, first.indexed, first.failed) == (5, 0, 2, 2, 1) and first.chunks > 10 and len(first.errors) == 1
    chunks = workflow.chunk_collection(store, "papers").read()
    one = chunks.where("chunk_index = 0").orderBy("title").collect()
    assert [(r.title, r.authors, r.year, r.tags, len(r.vector)) for r in one] == [("Glacier albedo", "Ann Bee, Cy Dee", "2019", "ice", 16), ("Soot on snow", "Ann Bee, Cy Dee", "2019", "ice", 16)]
    assert chunks.count() == first.chunks and one[0].text.startswith("Title: Glacier albedo")
    again = run()
    assert (again.seen, again.skipped, again.indexed, again.failed, again.chunks) == (5, 4, 0, 1, 0)
    put(root, "f/6.md", PAPER.format(title="A third one", doi="y", body=body).encode())
    put(root, "g/7.md", PAPER.format(title="New work", doi="w", body=body).encode())
    more = run()
    assert (more.skipped, more.duplicates, more.indexed) == (4, 1, 1)
    state = workflow.State(store, "papers")
    assert state.stats()["indexed"] == 6 and store.names() == ["papers", "papers_duplicates", "papers_state"]
    state.remove(state.read().where("path like '%/7.md'"))
    assert run().indexed == 1 and run(force=True).indexed == 3
    state.clear()
    assert state.stats()["indexed"] == 0
    from paperloom.__main__ import main

    there = ["--store", str(tmp_path / "store")]
    assert main([*there, "--name", "cli", "index", str(root)])["indexed"] == 3
    assert main([*there, "--name", "cli", "search", "albedo", "--top-k", "1"])[0]["title"] == "Glacier albedo"
    assert main([*there, "--name", "cli", "stats"])["indexed"] == 6
