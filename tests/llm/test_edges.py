"""Every operator on awkward tables: nulls, empty and long texts, repeats, clashing columns, no rows."""

import pytest

from chronoflux.llm import ann, bwt, knn, lm, mixing, packing, pii, quality, simhash, substring

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, copy string, row string, h string"
LONG = " ".join(f"w{i % 97}x{i % 13}" for i in range(3000))
ROWS = [
    (1, None, None, None, None, "c", "r", "h"),
    (2, "", "en", "s1", 0, None, None, None),
    (3, " \t\n", "en", "s1", 3, "c", "r", "h"),
    (4, "one", "en", "s1", 3, "c", "r", "h"),
    (5, LONG, "en", "s2", len(LONG), "c", "r", "h"),
    (6, LONG, "en", "s2", len(LONG), "c", "r", "h"),
    (6, LONG, "en", "s2", len(LONG), "c", "r", "h"),
    (7, "a" * 3000, "de", None, 3000, "c", "r", "h"),
    (8, "mail a@b.c, a@b.c_d@e.f or 1.2.3.4.5.6.7.8 and +1 (736) 555-2678, 4111 1111-1111 1111", "de", "s3", 90, "c", "r", "h"),
    (None, "no id", "en", "s1", 5, "c", "r", "h"),
]
LABELS = "doc_id long, quality int, toxic int, text string"
OPERATORS = {
    "mixing": mixing.mix,
    "pii": pii.report,
    "sanitised": pii.sanitised,
    "simhash": simhash.near_duplicates,
    "lm": lambda d: lm.score(d, samples=1, frequent=20),
    "substring": substring.dedup,
    "packing": packing.pack,
    "bwt": bwt.dedup,
    "quality": lambda d: quality.scored(d, d.sparkSession.createDataFrame([(5, 1, 0, "x"), (7, 0, None, "x"), (4, 0, 0, "y"), (None, 1, 1, "z")], LABELS), sample=20),
}
#: Rows that an operator leaves out, or that depend on more than the row count.
OTHER = {"mixing", "packing"}


@pytest.mark.parametrize("name", OPERATORS)
def test_awkward_rows(spark, name):
    got = OPERATORS[name](spark.createDataFrame(ROWS, SCHEMA)).collect()
    assert all(r["doc_id"] is not None for r in got)
    if name not in OTHER:
        assert sorted(r["doc_id"] for r in got) == [1, 2, 3, 4, 5, 6, 6, 7, 8]


@pytest.mark.parametrize("name", OPERATORS)
def test_no_rows(spark, name):
    assert OPERATORS[name](spark.createDataFrame([], SCHEMA)).collect() == []


VECTORS = "vec_id long, embedding array<float>, cell int, v string, score double"


@pytest.mark.parametrize("search", [knn.top_k, ann.search])
def test_vectors(spark, search):
    rows = [(0, [1.0, 0.5]), (1, [1.0, 0.5]), (2, [0.9, 0.5]), (3, [0.0, 0.0]), (4, None), (5, [None, 1.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (None, [1.0, 1.0]), (8, [-1.0, 0.25])]
    got = search(spark.createDataFrame([(i, v, 1, "x", 0.0) for i, v in rows], VECTORS)).collect()
    want = [0, 1, 2, 8] if search is ann.search else [0, 1, 2, 3, 8]
    assert sorted(r["vec_id"] for r in got) == want[1:]
    assert {r["query_id"] for r in got} == {0}
    assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"])][0] == 1
    assert search(spark.createDataFrame([], VECTORS)).collect() == []


def test_pii_spans_are_those_of_the_plain_patterns(spark):
    import re

    text = ROWS[8][1]
    got = {r["doc_id"]: r for r in pii.report(spark.createDataFrame(ROWS, SCHEMA)).collect()}[8]
    email = [f"email:{m.start()}:{m.end()}" for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    assert [s for s in got["spans"].split(",") if s.startswith("email")] == email
    assert (got["n_email"], got["n_ip"], got["n_card"], got["n_phone"]) == (len(email), 2, 1, 1) == (3, 2, 1, 1)
    clean = {r["doc_id"]: r["text"] for r in pii.sanitised(spark.createDataFrame(ROWS, SCHEMA)).collect()}[8]
    assert "555" not in clean and "4111" not in clean and "@" not in clean
