"""The pipeline's near-duplicate stage against plain loops, and what its packing stage reads at once."""

import random
import time

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from chronoflux.llm import common, packing, shingles


def sets(text):
    w = (text or "").lower().split()
    return {" ".join(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def planted():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    line = [word() for _ in range(30)]  # common, but no reason to link
    out = []
    for _ in range(12):
        base = [word() for _ in range(150)] + line
        out.append(base)
        for edits in (1, 1, 2, 3, 3, 4, 5, 6, 9):
            own = list(base)
            for at in r.sample(range(len(own)), edits):
                own[at] = word()
            out.append(own)
    out += [[word() for _ in range(20)] + line for _ in range(10)] + [["Of", "two"], ["of", "two"], ["three"]]
    r.shuffle(out)
    return [(i, " ".join(w)) for i, w in enumerate(out)] + [(900, ""), (901, None)]


@pytest.mark.parametrize("cut", [1024, 3])
def test_near_duplicates_of_every_similarity_from_the_rule(spark, monkeypatch, cut):
    monkeypatch.setattr(shingles, "CUT", cut)
    rows = planted()
    own = [sets(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    seen = []
    for a in range(len(rows)):
        for b in range(a):
            j = len(own[a] & own[b]) / len(own[a] | own[b]) if own[a] | own[b] else 1.0
            seen.append(j)
            if j >= 0.8:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sum(0.8 <= j < 0.9 for j in seen) > 10 and sum(0.9 <= j < 1 for j in seen) > 10 and sum(0.6 < j < 0.8 for j in seen) > 10
    want = sorted(rows[k][0] for k in range(len(rows)) if find(k) == k)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect()) == want


def test_one_id_with_several_texts(spark):
    text = [" ".join(f"{c}{k}" for k in range(40)) for c in "abcd"]
    rows = [(1, text[0], 1), (1, text[1], 2), (1, text[1], 3), (2, text[1], 4), (2, text[2], 5), (3, text[3], 6), (3, text[3] + " more", 7), (None, "no id", 8)]
    got = corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame(rows, "doc_id long, text string, n int"), "").collect()
    found = sorted((r["doc_id"], r["text"]) for r in got)
    assert len(got) == 4 and found[:3] == [(1, text[0]), (1, text[1]), (2, text[2])] and found[3][0] == 3
    assert corpus_pipeline.near_duplicate_stage(spark, spark.createDataFrame([], "doc_id long, text string"), "").collect() == []


STAGE = dict(corpus_pipeline.STAGES)
AWKWARD = "doc_id long, text string, lang string, source string, n_chars int, quality int, toxic string, _row string, _id int, x double, row string, copy string, component int, doc_tokens long"


def awkward(spark):
    r = random.Random(4)
    long = " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(30_000))
    texts = [None, "", " \n", "one", long, long + " more", "a" * 5000, "write ann@isle.example now"]
    rows = [(i, t, "en" if i % 2 else None, f"s{i % 3}" if i % 4 else None, len(t or ""), 1, "x", "r", i, 0.5, "w", "c", 7, 3) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[3], (None, "no id", *rows[3][2:])], AWKWARD)


@pytest.fixture
def folder(spark, tmp_path):
    spark.createDataFrame([(4, 1, 0, "t"), (6, 0, 0, "t"), (None, 1, 1, "t"), (3, 0, None, "t"), (3, 1, 1, "t")], "doc_id long, quality int, toxic int, text string").write.parquet(f"{tmp_path}/labels.parquet")
    return str(tmp_path)


@pytest.mark.parametrize("name", STAGE)
def test_stages_on_awkward_tables(spark, folder, name):
    docs = awkward(spark)
    got = STAGE[name](spark, docs, folder)
    if name != "packing":
        assert got.columns == docs.columns
    ids = sorted(r["doc_id"] for r in got.select("doc_id").collect())
    if name == "near duplicates":
        assert ids == [0, 3, 4, 6, 7]
    elif name == "personal data":
        assert ids == [0, 1, 2, 3, 3, 4, 5, 6, 7] and "@" not in {r["doc_id"]: r["text"] for r in got.collect()}[7]
    elif name == "packing":
        assert set(ids) == set(range(8))
    else:
        assert set(ids) <= set(range(8))
    assert STAGE[name](spark, docs.limit(0), folder).collect() == []


def test_whole_pipeline_on_a_small_corpus(spark, folder):
    """Copies and near copies go, personal data goes, every token of what is kept is packed once."""
    rows = [(i, t, "en", f"s{i % 3}", len(t or "")) for i, t in planted()] + [(2000, "call +1 (736) 555-2678 or " + planted()[0][1], "en", "s1", 9)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{folder}/documents.parquet")
    got = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in got}) < 60 and all(r["length"].bit_count() == 1 and r["offset"] == 0 for r in got)
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    assert all(sum(x["length"] for x in own) == own[0]["doc_tokens"] for own in by.values())
    assert len({r["sequence_id"] for r in got}) == len(got)


@pytest.mark.parametrize("limit", ["10000", "0", "100"])
def test_packing_stage_reads_few_rows_at_once(spark, monkeypatch, limit):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], ["n"])

    monkeypatch.setattr(packing, "pack", lambda docs: docs.select("id").mapInArrow(sizes, "n long"))
    spark.conf.set(name, limit)
    try:
        found = [x["n"] for x in corpus_pipeline.packing_stage(spark, spark.range(0, 3000, 1, 1), "").collect()]
        assert spark.conf.get(name) == limit
    finally:
        spark.conf.set(name, before)
    assert sum(found) == 3000 and max(found) == (100 if limit == "100" else packing.ROWS)


def test_packing_stage_returns_all_pieces(spark):
    docs = spark.createDataFrame([(i, " ".join(["w"] * i) if i % 7 else None) for i in range(1500)], "doc_id long, text string").coalesce(1)
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "offset"]
    rows = lambda df: sorted(tuple(x) for x in df.select(columns).collect())
    got = corpus_pipeline.packing_stage(spark, docs, "")
    assert rows(got) == rows(packing.pack(docs)) and got.select("sequence_id").distinct().count() == got.count()


def test_scratch_tables_leave_no_shuffle_files(spark):
    manager = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def files():
        found = manager.getAllFiles()
        return {found.apply(i).getName() for i in range(found.size()) if found.apply(i).getName().startswith("shuffle_")}

    before = files()
    rows = spark.range(3000).repartition(3).groupBy((F.col("id") % 10).alias("k")).count().join(spark.range(100).withColumnRenamed("id", "k").repartition(5), "k")
    table = common.written(rows, "counts")
    until = time.time() + 20
    while files() - before and time.time() < until:  # they go a moment later
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == rows.count() == 10


@pytest.mark.parametrize("cut", [1 << 18, 5000])
def test_only_texts_that_may_be_alike_are_compared(spark, monkeypatch, cut):
    """Long near copies are linked however their groups are cut; long texts that share a line are told apart by sketches."""
    monkeypatch.setattr(shingles, "SHINGLES", cut, raising=False)
    r, tables, written = random.Random(5), {"close": []}, common.written
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    lines, rows = [[word() for _ in range(40)] for _ in range(6)], []
    for k in range(12):
        rows.append((k, " ".join([word() for _ in range(3000)] + lines[k // 2])))
    words = [word() for _ in range(1500)]
    for k in range(20):
        own = list(words)
        for at in r.sample(range(1500), k):
            own[at] = word()
        rows.append((100 + k, " ".join(own)))

    def table(df, name):
        out = written(df, name)
        tables.setdefault(name, []).append(out)
        return out

    monkeypatch.setattr(common, "written", table)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = {x["doc_id"]: x["component"] for x in shingles.near_duplicates(docs).collect()}
    own = {i: sets(t) for i, t in rows}
    assert all(len(own[100] & own[i]) / len(own[100] | own[i]) >= 0.8 for i in range(100, 120))
    assert len({found[i] for i in range(100, 120)}) == 1 and len(set(found.values())) == 13
    unlike = tables["nodes"][0].where("doc_id < 100").select(F.col("node").alias("a"))
    assert not any(x.join(unlike, "a").count() for x in tables["close"])


def test_what_two_sets_share_at_most_is_bounded_by_their_sketches():
    r = np.random.default_rng(4)
    for n, m, shared in ((40, 45, 40), (500, 560, 490), (511, 513, 20), (3000, 3300, 10), (3000, 3700, 2900), (20_000, 20_000, 0)):
        x = np.unique(r.integers(-(1 << 62), 1 << 62, n + m))
        one, other = np.sort(x[:n]), np.sort(np.concatenate([x[:shared], x[n : n + m - shared]]))
        most = shingles._most(*[pa.array([shingles._sketch(s)], pa.binary()) for s in (one, other)])[0]
        assert len(np.intersect1d(one, other)) <= most <= min(len(one), len(other))
        if n >= 500 and shared < n / 2:  # unrelated sets of any length are told apart
            assert most * 1.8 < 0.8 * (len(one) + len(other))
    every = pa.array([shingles._sketch(np.arange(400, dtype=np.int64) << 20)], pa.binary())
    assert shingles._most(every, every)[0] >= 400
