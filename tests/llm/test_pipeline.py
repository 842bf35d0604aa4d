"""The pipeline's stages against an independent implementation, and their columns, decisions and the rows of run()."""

import collections
import os
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

import corpus_pipeline
from paperloom.llm import common, jaccard, pii, quality

DATA = "/root/testdata/sf0.001"
needs_data = pytest.mark.skipif(not os.path.isdir(DATA), reason="test tables are not here")


def plain_quality(rows, labels):
    """Ids that plain numpy's quadratic discriminant accepts; only the statistics are the operator's."""
    compress = quality.compressor()
    x = {i: np.array(quality.statistics(t, compress)) for i, t in rows}
    train = {c: np.array([x[i] for i, y in labels.items() if y == c and i in x and zlib.crc32(str(i).encode()) % 5]) for c in (0, 1)}
    n = {c: len(v) for c, v in train.items()}
    cov = {c: np.cov(v.T, bias=True) for c, v in train.items()}
    pooled = np.diag(np.diag((n[0] * cov[0] + n[1] * cov[1]) / (n[0] + n[1])) + 1e-4)

    def log_density(c, v):
        s, d = 0.9 * cov[c] + 0.1 * pooled, v - train[c].mean(axis=0)
        return -0.5 * d @ np.linalg.solve(s, d) - 0.5 * np.linalg.slogdet(s)[1] + np.log(n[c])

    return [i for i, _ in rows if 1 / (1 + np.exp(np.clip(log_density(0, x[i]) - log_density(1, x[i]), -60, 60))) >= 0.3]


def plain_first_of_groups(rows):
    """The smallest id of each component at 0.8 of five-word shingles, by comparing all pairs."""
    sets = {}
    for i, t in rows:
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    group = {i: {i} for i in sets}
    for a in sets:
        for b in sets:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]) > 0 and group[a] is not group[b]:
                group[a] |= group[b]
                for k in group[a]:
                    group[k] = group[a]
    return {i for i in sets if i == min(group[i])}


def plain_strip(rows):
    words = {i: (t or "").split() for i, t in rows}
    seen = collections.Counter(tuple(w[k : k + 35]) for w in words.values() for k in range(len(w) - 34))
    out = {}
    for i, t in rows:
        w = words[i]
        gone = {j for k in range(len(w) - 34) if seen[tuple(w[k : k + 35])] > 1 for j in range(k, k + 35)}
        out[i] = " ".join(x for k, x in enumerate(w) if k not in gone) if gone else t
    return out


def corpus():
    """Good and bad texts, exact and near copies, a shared passage, personal data, nulls, empties, repeats, a long text."""
    random.seed(21)
    words = [f"{a}{b}" for a in ("river", "house", "stone", "light", "garden", "winter") for b in ("", "s", "ly", "ing", "ed", "er")]
    prose = lambda n: " ".join(random.choice(words) + random.choice(["", "", "", ",", "."]) for _ in range(n))
    good = [prose(random.randint(40, 200)) for _ in range(90)]
    bad = [" ".join(random.choice(["BUY", "$$$", "#1", "CLICK", "!!!"]) for _ in range(random.randint(30, 150))) for _ in range(60)]
    passage = prose(60)
    good[3] += " " + passage
    good[4] = passage + " " + good[4]
    good[5] += " write to jane.doe@example.com or jane (at) example (dot) org or 10.0.0.1 now"
    labels = {i: 1 for i in range(90)} | {90 + i: 0 for i in range(60)}
    rows = list(enumerate(good + bad))
    near = good[7].split()
    near[len(near) // 2] = "changed"
    rows += [(200, good[6]), (201, " ".join(near)), (202, None), (203, ""), (204, prose(30_000)), (-9, good[8])]
    return rows, labels


def test_run_equals_an_independent_implementation(spark, tmp_path):
    rows, labels = corpus()
    names = "doc_id long, text string, lang string, source string, n_chars long, _p string, _places string, _stay long, _at string"
    extra = lambda i: ("en", "s", -1, f"p{i}", f"q{i}", i, None)
    table = [(i, t, *extra(i)) for i, t in rows] + [(10, rows[10][1], *extra(10))]  # a repeated row
    spark.createDataFrame(table, names).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([*labels.items(), (1, None), (None, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    kept = set(plain_quality(rows, labels))
    assert {90, 100, 149}.isdisjoint(kept) and {0, 10, 50} <= kept
    first = plain_first_of_groups([(i, t) for i, t in rows if i in kept])
    assert {200, 201, 8}.isdisjoint(first) and {6, 7, -9} <= first
    stripped = plain_strip([(i, t) for i, t in rows if i in first])
    assert "jane.doe@example.com" in stripped[5] and len(stripped[3].split()) == len(dict(rows)[3].split()) - 60
    clean = {i: t if t is None else t.replace("jane.doe@example.com", "<email>").replace("jane (at) example (dot) org", "<email>").replace("10.0.0.1", "<ip>") for i, t in stripped.items()}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = str(tmp_path / name)
        stage(spark, docs, str(tmp_path)).write.parquet(path)
        docs = spark.read.parquet(path)
        assert docs.columns == [c.split()[0] for c in names.split(", ")]
    got = docs.collect()
    assert {r["doc_id"]: r["text"] for r in got} == clean and len(got) == len(clean)
    assert all(tuple(r)[2:4] + tuple(r)[5:] == extra(r["doc_id"])[:2] + extra(r["doc_id"])[3:] for r in got)

    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*library.encode(t or "", add_special_tokens=False).ids, 2] for i, t in clean.items()}
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    by_sequence = collections.defaultdict(list)
    for r in pieces:
        own = ids[r["doc_id"]]
        part = own[r["start"] : r["start"] + r["length"]]
        assert r["doc_tokens"] == len(own) and len(part) == r["length"] and zlib.crc32(np.array(part, "<u4").tobytes()) == r["ids_crc32"]
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    assert collections.Counter({i: len(x) for i, x in ids.items()}) == sum((collections.Counter({r["doc_id"]: r["length"]}) for r in pieces), collections.Counter())
    for parts in by_sequence.values():
        ends = [0, *np.cumsum([n for _, n in sorted(parts)]).tolist()]
        assert [o for o, _ in sorted(parts)] == ends[:-1] and ends[-1] <= 4096


def test_run_on_an_empty_table_and_scratch_space(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    df = spark.range(10)
    with common.scratch():
        made = common.saved(df)
        file = made._jdf.queryExecution().logical().rdd().getCheckpointFile().get()
        assert os.path.isdir(file.removeprefix("file:"))
    assert not os.path.isdir(file.removeprefix("file:"))


@needs_data
def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    good = corpus_pipeline.good_quality(spark, docs, DATA).cache()
    assert good.columns == docs.columns
    assert {r["doc_id"] for r in good.collect()} == {r["doc_id"] for r in quality.score(docs, labels).collect() if r["predicted"]}
    one = corpus_pipeline.one_of_each_group(spark, good, DATA).cache()
    groups = {r["doc_id"]: r["component_id"] for r in jaccard.join_components(good, size=5, percent=80).collect()}
    assert sorted(r["doc_id"] for r in one.collect()) == sorted(set(groups.values()))
    stripped = corpus_pipeline.without_repeated_passages(spark, one, DATA).cache()
    assert stripped.count() == one.count() and stripped.columns == docs.columns
    clean = corpus_pipeline.without_personal_data(spark, stripped, DATA).cache()
    for a, b in zip(stripped.orderBy("doc_id").collect(), clean.orderBy("doc_id").collect()):
        assert b["text"] == pii.redacted(a["text"], sorted(sum(pii.find(a["text"]), []))) and b["n_chars"] == len(b["text"])
    want = {r["doc_id"] for r in clean.collect()}
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == want


def test_repeated_and_null_rows(spark):
    docs = spark.createDataFrame([(1, "a b c d e f", "en", "s", 11), (1, "a b c d e f", "en", "s", 11), (2, "A b c d e f", "en", "s", 11), (None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(str(r["doc_id"]) for r in jaccard.keep_one(docs).collect()) == ["1", "None"]
