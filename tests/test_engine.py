"""Every query with oracle SQL against DuckDB at the smallest scale, and functions on small fixtures."""

import difflib
import os
import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from paperloom.functions import extract
from paperloom.functions import text as tx
from paperloom.operators import api, chunking, dedup, filters, search
from paperloom.operators.index import KeywordIndex
from paperloom.plans import registry

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    # an integer column with nulls comes as floats from one engine and as integers from the other
    plain = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(str([plain(v) for v in row]) for row in df.where(df.notna(), None).values.tolist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(DATA):
        con.sql(f"create view {f.removesuffix('.parquet')} as select * from '{DATA}/{f}'")
    return con


@needs_data
@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, duck, name):
    got = registry.QUERIES[name](spark, DATA).toPandas()
    if name in registry.ORACLES:
        assert rows(got) == rows(duck.sql(registry.ORACLES[name]).df())


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"c {kind}").select(column.alias("v")).first()["v"]


@pytest.mark.parametrize(("f", "given", "expected"), [
    (tx.normalized_title, "The Art, of: A  Test", "art of test"),
    (tx.doi, "DOI: 10.1038/nature12373", "10.1038/nature12373"),
    (tx.doi, "The DOI is 10.1038/nature12373.", "10.1038/nature12373"),
    (tx.doi, "https://doi.org/10.1234/example", "10.1234/example"),
    (tx.first_year, "Published in 2023", 2023),
    (tx.first_year, "In the year 1850", None),
    (tx.author_list, "John Smith, and Jane Doe et al.", ["John Smith", "Jane Doe"]),
    (tx.pdf_authors, "John Smith and Jane Doe", ["John Smith", "Jane Doe"]),
    (tx.pdf_title, "x\nDeep Learning For Glacier Monitoring\n", "Deep Learning For Glacier Monitoring"),
    (tx.pdf_title, "", None),
    (tx.pdf_date_year, "D:20210304", 2021),
    (tx.markdown_title, "# Test Paper\n\nSome", "Test Paper"),
    (tx.markdown_abstract, "## Abstract\n\nShort.\n\n## Introduction", "Short."),
    (tx.clean, " a *b*\n c ", "a b c"),
    (lambda c: tx.truncate(c, 8), "one two three", "one two..."),
    (tx.valid_doi, "11.1/x", None),
])
def test_function(spark, f, given, expected):
    assert one(spark, f(F.col("c")), given) == expected


def test_recursive_splitter_keeps_limits_and_text():
    text = "\n\n".join(" ".join(f"w{i}" for i in range(k, k + 90)) + "." for k in range(0, 900, 90))
    parts = chunking.split_recursively(text, 60, 0)
    assert all(chunking.count_tokens(p) <= 60 for p in parts)
    assert " ".join(parts).split() == text.split()
    assert len(chunking.split_recursively("word " * 2000, 100)) > 1
    assert chunking.split_recursively("  ", 10) == []


def test_paragraph_and_sentence_packers(spark):
    long = " ".join(f"s{i} a b c d e f g." for i in range(60))
    text = "one two\n\n\n\nthree four\n\n" + long + "\n\nlast"
    parts = chunking.split_paragraphs(text, 20)
    assert parts[0] == "one two\n\nthree four" and parts[-1] == "last" and all(chunking.count_tokens(p) <= 20 for p in parts)
    assert " ".join(parts).split() == text.split()
    assert chunking.split_sentences("x " * 100, 13) == ["x " * 9 + "x"] * 10 and chunking.split_paragraphs("", 5) == []
    df = spark.createDataFrame([(1, "# A\n" + long + "\n## B\nshort"), (2, None)], "doc_id long, text string")
    got = chunking.sized(chunking.markdown(df), 40).orderBy("doc_id", "chunk_num").collect()
    assert [r["chunk_num"] for r in got] == list(range(len(got))) and {r["section"] for r in got} == {"A", "B"} and len(got) > 5
    chunks = chunking.document_chunks(df, [], 100, 10)
    images = chunking.image_chunks(spark.createDataFrame([(1, "t", [(0, "u")])], "doc_id long, text string, images array<struct<page int, uri string>>"), [])
    rows = chunking.all_chunks(chunks, images).collect()
    assert {r["chunk_id"] for r in rows if r["is_multimodal"]} == {"1_mm_0"} and {r["total_chunks"] for r in rows if not r["is_multimodal"]} == {chunks.count()}


@pytest.mark.parametrize(("f", "given", "expected"), [
    (extract.page_authors, "Title\nAuthor: Ann Bee, Cy Dee\nx", ["Ann Bee", "Cy Dee"]),
    (extract.page_authors, "Title\nBy Ann Bee and Cy Dee\n", ["Ann Bee", "Cy Dee"]),
    (extract.page_authors, "Title\nAnn Bee and Cy Dee\n", ["Ann Bee", "Cy Dee"]),
    (extract.page_authors, "nothing here", []),
    (extract.page_journal, "Journal: Short\nPublished in Journal of Glaciology, 2020", "Journal of Glaciology"),
    (extract.page_abstract, "T\nAbstract\nThis is an abstract that goes on for\n more than fifty characters.\nIntroduction\nx", "This is an abstract that goes on for more than fifty characters."),
    (extract.page_abstract, "Abstract\ntoo short\nIntroduction", None),
    (extract.page_abstract, "Abstract\n" + "abcd " * 300 + "\n1. x", "abcd " * 199 + "abcd..."),
    (extract.page_keywords, "Keywords: ice, snow;\nalbedo\n1. Introduction", ["ice, snow", "albedo"]),
    (extract.page_keywords, "Key words: ice to snow\nIntroduction", ["ice", "snow"]),
    (extract.native_keywords, "a; b,c ,", ["a", "b", "c"]),
    (extract.markdown_authors, "# T\n**Authors:** Ann Bee, Cy Dee et al.\n", ["Ann Bee", "Cy Dee"]),
    (extract.markdown_doi, "**DOI:** https://doi.org/10.1/a(b)", "https://doi.org/10.1/a(b)"),
    (lambda c: extract.markdown_year(c, F.lit("2011/paper_1999.md")), "no date", 1999),
    (lambda c: extract.markdown_year(c, F.lit("x")), "Published: May 2003", 2003),
    (lambda c: tx.uri_bytes(tx.data_uri(c.cast("binary"), "png")).cast("string"), "a,b", "a,b"),
    (tx.uri_bytes, "http://a,b", None),
    (tx.paper_of_chunk, "a_chunk_b_chunk_12", "a_chunk_b"),
    (tx.paper_of_chunk, "a_b", "a_b"),
    (tx.paper_of_part, "k-1-2", "k"),
    (lambda c: tx.three_places(c.cast("double")), "0.12345", "0.123"),
    (tx.tokens, "A\u00a0b\u2003C\x1cd", ["a", "b", "c", "d"]),
    (lambda c: tx.instruments(c, {"m": r"\bMERIS\b"}), "äMERIS MERIS.", ["m"]),
    (lambda c: tx.instruments(c, {"m": r"\bMERIS\b"}), "äMERIS MERISé", []),
])
def test_extraction(spark, f, given, expected):
    assert one(spark, f(F.col("c")), given) == expected


def test_fuzzy_pairs_match_difflib(spark):
    titles = ["deep learning for glaciers", "deep learning for glacier", "deep learning of glaciers", "other thing", "other things", ""]
    df = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    got = {(r["a"], r["b"]) for r in dedup.fuzzy_pairs(df).collect()}
    want = {(i, j) for i in range(5) for j in range(i + 1, 5) if difflib.SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.9}
    assert got == want


def test_fuzzy_title_pairs_compare_whole_titles(spark, tmp_path):
    # pairs of rare characters, as difflib skips frequent ones in titles of 200 and more
    head = "".join(chr(0x4E00 + k) for k in range(210))
    titles = [head, head + "x", head + "".join(chr(0x6E00 + k) for k in range(150)), head[:-1] + "y"]
    spark.createDataFrame(list(enumerate(titles)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r["a"], r["b"], r["ratio"]) for r in registry.QUERIES["fuzzy_title_pairs"](spark, str(tmp_path)).collect()}
    ratio = lambda i, j: round(difflib.SequenceMatcher(None, titles[i], titles[j]).ratio(), 6)
    assert got == {(i, j, ratio(i, j)) for i in range(4) for j in range(i + 1, 4) if ratio(i, j) >= 0.9} and len(got) == 3


def test_bm25_with_repeated_and_missing_terms(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c c"), (3, "")], "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in search.bm25(df, "c zz c").collect()}
    assert got[1] == got[3] == 0.0 and got[2] > 0


def test_filters(spark):
    df = spark.createDataFrame([(1, "ab"), (2, "b"), (3, None)], "i int, text string")
    tree = filters.simple_filter("a", combine_with=["b"], mode="and")
    assert [r["i"] for r in df.where(filters.text_filter(tree, F.col("text"))).collect()] == [1]
    with pytest.raises(ValueError):
        filters.text_filter({"$no": 1}, F.col("text"))


def test_fuzzy_pairs_over_many_blocks(spark):
    r = random.Random(4)
    base = ["".join(r.choices("abcdefgh ", k=r.randint(8, 60))).strip() for _ in range(40)]
    titles = sorted({*base, *("".join(c for c in t if r.random() > 0.05) for t in base for _ in range(3))} - {""})
    df = spark.createDataFrame(list(enumerate(titles)), "doc_id long, title string")
    want = {(i, j) for i in range(len(titles)) for j in range(i + 1, len(titles)) if difflib.SequenceMatcher(None, titles[i], titles[j]).ratio() >= 0.9}
    for block in (512, 7):
        got = [(r["a"], r["b"]) for r in dedup.fuzzy_pairs(df, block=block).collect()]
        assert set(got) == want and len(got) == len(want) > 20


def test_compared_titles_match_difflib_around_its_rule_for_frequent_characters():
    import pandas as pd

    r = random.Random(5)
    kinds = ["abcdefgh ", "etaoin " * 30 + "qwxyzbc1234", "".join(chr(0x4E00 + k) for k in range(300))]
    base = ["".join(r.choices(kinds[k % 3], k=n)) for k in range(9) for n in (3, 20, 150, 196, 205, 420)]
    titles = sorted({*base, *("".join(r.choice(t) if r.random() < p else c for c in t) for t in base for p in (0.01, 0.05, 0.1)), *("".join(t[k : k + 9] + "#" for k in range(0, len(t), 9)) for t in base)})
    r.shuffle(titles)
    rows = pd.DataFrame({"id": range(len(titles)), "t": titles, "side": [k % 2 == 0 for k in range(len(titles))]})
    ratio = lambda i, j: difflib.SequenceMatcher(None, titles[i], titles[j]).ratio()
    near = lambda i, j: 0.9 * max(len(titles[i]), len(titles[j])) <= 1.1 * min(len(titles[i]), len(titles[j]))
    want = {(i, j, round(x, 6)) for i in range(len(titles)) for j in range(i + 1, len(titles)) if near(i, j) and (x := ratio(i, j)) >= 0.9}
    assert set(dedup.compared(rows, False, 0.9, False).itertuples(index=False, name=None)) == want and len(want) > 50
    assert set(dedup.compared(rows, True, 0.9, False).itertuples(index=False, name=None)) == {x for x in want if (x[0] - x[1]) % 2}
    few = set(dedup.compared(rows, False, 0.9, True).itertuples(index=False, name=None))

    def groups(pairs):
        label = list(range(len(titles)))
        for a, b, _ in pairs:
            label = [label[a] if x == label[b] else x for x in label]
        return {frozenset(k for k, x in enumerate(label) if x == y) for y in label}

    assert few <= want and groups(few) == groups(want)


def test_many_titles_are_compared_in_little_time():
    import time

    import pandas as pd

    r = random.Random(6)
    parts = ["".join(r.choices("etaoinshrdlucmfw ", k=3)) for _ in range(400)]
    titles = sorted({"".join(r.choices(parts, k=50)) for _ in range(3000)})
    titles.append(titles[7][:-2] + "xy")
    began = time.process_time()
    # 4.5 million pairs
    got = dedup.compared(pd.DataFrame({"id": range(len(titles)), "t": titles, "side": False}), False, 0.9, False)
    assert (7, len(titles) - 1) in set(zip(got["a"], got["b"])) and time.process_time() - began < 10


def test_titles_of_one_length_and_alphabet_are_told_apart_in_little_time():
    import time

    import pandas as pd

    r = random.Random(7)
    parts = ["".join(r.choices("etaoinshrdlucmfw ", k=3)) for _ in range(400)]
    titles = sorted({"".join(r.choices(parts, k=40)) for _ in range(12000)})
    titles.append(titles[7][:-2] + "xy")
    rows = pd.DataFrame({"id": range(len(titles)), "t": titles, "side": False})
    began = time.process_time()
    # 72 million pairs
    got = dedup.compared(rows, False, 0.9, True)
    assert (7, len(titles) - 1) in set(zip(got["a"], got["b"])) and time.process_time() - began < 8


def test_edges_connect_a_group_of_near_copies_without_all_its_pairs(spark):
    titles = ["glacier albedo feedback and soot on snow " + chr(97 + k) for k in range(1, 26)]
    df = spark.createDataFrame([(k, t, None) for k, t in enumerate(titles)], "doc_id long, title string, doi string")
    got = dedup.edges(df).collect()
    assert len(got) == len(titles) - 1 and {r["a"] for r in got} | {r["b"] for r in got} == set(range(len(titles)))
    assert dedup.fuzzy_pairs(df).count() == len(titles) * (len(titles) - 1) // 2


def test_deduplicate_by_doi_and_title(spark):
    rows = [
        (1, "Glacier albedo feedback", "10.1/a", None, False, 2001, "x", 1), (2, "Something else", "10.1/a", "Nature", False, 1999, None, 1),
        (3, "The glacier, albedo feedback!", None, None, True, 2001, "x", 1), (4, "Another paper on soot", "", "J", True, 2000, "long abstract", 1),
        (5, "Another paper on soots", None, "J", True, 2000, "short", 2), (6, None, None, None, False, None, None, 1), (7, "", "", None, False, None, None, 1),
        # a chain: the ends are not similar to each other
        (10, "a" * 20 + "b" * 20, None, None, False, 2000, "", 1), (11, "a" * 20 + "b" * 24, None, None, False, 2001, "", 1), (12, "a" * 20 + "b" * 29, None, None, False, 2000, "", 1),
    ]
    df = spark.createDataFrame(rows, "doc_id long, title string, doi string, publication string, has_fulltext boolean, year int, abstract string, mtime long")
    unique, lost = dedup.deduplicate(df)
    assert {r["doc_id"] for r in unique.collect()} == {2, 4, 6, 7, 11} and unique.columns == df.columns
    assert {tuple(r) for r in lost.collect()} == {(1, 2, "doi"), (3, 2, "title"), (5, 4, "title"), (10, 11, "title"), (12, 11, "title")}
    assert {(r["doi"], tuple(r["ids"])) for r in dedup.doi_groups(df).collect()} == {("10.1/a", (1, 2))}
    assert {tuple(r["ids"]) for r in dedup.title_groups(df).collect()} == {(1, 3), (4, 5), (10, 11, 12)}
    assert dedup.deduplicate(df.limit(0))[0].count() == 0


def test_keyword_index(spark, tmp_path):
    rows = [(1, "a b the"), (2, "b c c the"), (3, ""), (4, None), (5, "the the the d e")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    index = KeywordIndex.build(df, str(tmp_path / "index"), buckets=8)
    for q in ("c zz c", "the b", "d", "e"):
        want = {r["doc_id"]: r["score"] for r in search.bm25(df.fillna(""), q).collect()}
        assert {r["doc_id"]: r["score"] for r in index.all_scores(q).collect()} == want
        assert [r["doc_id"] for r in index.best(q, 4).collect()] == sorted(want, key=lambda i: (-want[i], i))[:4]
    assert index.best(" ", 3).count() == 0 and search.bm25(df, " ").count() == 0
    asked = index.scores(index.one("c"))
    assert {r["doc_id"] for r in asked.collect()} == {2}
    plan = asked._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*bucket", plan)
    assert index.append(spark.createDataFrame([(2, "again"), (6, "c new")], "doc_id long, text string")) == 1
    both = spark.createDataFrame([*((i, t or "") for i, t in rows), (6, "c new")], "doc_id long, text string")
    assert {r["doc_id"]: r["score"] for r in index.all_scores("c the").collect()} == {r["doc_id"]: r["score"] for r in search.bm25(both, "c the").collect()}
    empty = KeywordIndex.build(df.limit(0), str(tmp_path / "none"))
    assert empty.best("a", 3).count() == 0


def test_search_options_and_pages(spark):
    for wrong in ({"top_k": 0}, {"alpha": 2.0}, {"filters": "{"}, {"filters": "[1]"}):
        with pytest.raises(ValueError):
            api.Options(**wrong)
    assert api.Options(filters=" ").filters is None and api.Options(filters='{"a": 1}').filters == {"a": 1}
    rows, info = api.page(spark.range(7), ["id"], limit=3, offset=5)
    assert [r["id"] for r in rows.collect()] == [5, 6] and info == {"total_results": 7, "offset": 5, "limit": 3, "returned": 2, "has_more": False}
    assert api.page(spark.range(7), ["id"], limit=0, offset=-1)[1] == {"total_results": 7, "offset": 0, "limit": 1, "returned": 1, "has_more": True}
    assert [api.passage_limit(*x) for x in ((0, 3), (4000, 3), (100, 3), (9000, 2))] == [1500, 1333, 256, 1500]


def test_dense_best_equals_plain_numpy(spark):
    import numpy as np

    r = np.random.default_rng(3)
    v = r.normal(size=(200, 8))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(500, None), (501, [0.0] * 8), (502, v[7].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    asked = spark.createDataFrame([("a", v[7].tolist()), ("b", v[9].tolist())], "query_id string, vector array<double>")
    got = search.dense_best(df, asked, 6).orderBy("query_id", "rank").collect()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    for name, at in (("a", 7), ("b", 9)):
        score = {i: round(float(1 + unit[i] @ unit[at]) / 2, 6) for i in range(200)}
        score[502] = score[7]
        want = sorted(score, key=lambda i: (-score[i], i))[:6]
        assert [(x["doc_id"], x["rank"]) for x in got if x["query_id"] == name] == [(i, k + 1) for k, i in enumerate(want)]
        assert all(abs(x["score"] - score[x["doc_id"]]) < 2e-6 for x in got if x["query_id"] == name)
    assert search.dense_best(df.limit(0), asked, 3).count() == 0 and search.dense_best(df, asked.limit(0), 3).count() == 0


def test_reranked_search_keeps_candidates_without_a_document(spark, tmp_path):
    docs = spark.createDataFrame([(1, "ice and snow", "Ice", ""), (2, "snow", "Soot", "on ice"), (3, "rain", "", None)], "doc_id long, text string, title string, abstract string")
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (9, [1.0, 0.05])], "vec_id long, embedding array<double>")
    e = api.SearchEngine(docs, vectors, KeywordIndex.build(docs, str(tmp_path / "index"), buckets=4))
    asked = spark.createDataFrame([(0, "ice snow", [1.0, 0.0]), (1, "  ", [1.0, 0.0])], "query_id long, query string, vector array<double>")
    got = [(r["query_id"], r["doc_id"], r["score"]) for r in e.search_reranked(asked, api.Options(top_k=3), boost=True).orderBy("rank").collect()]
    assert got == [(0, 1, 2.0), (0, 2, 0.75), (0, 9, 0.0)]
    only = e.search(asked, api.Options(filters={"doc_id": {"$ne": 1}}, text_filter='{"$contains": "snow"}')).collect()
    assert [r["doc_id"] for r in only] == [2]
    hits = e.results(e.search(asked, api.Options(mode="dense", top_k=2)), ["title"]).orderBy("rank").collect()
    assert [(r["doc_id"], r["title"], r["excerpt"]) for r in hits] == [(1, "Ice", "ice and snow"), (9, None, None)]
