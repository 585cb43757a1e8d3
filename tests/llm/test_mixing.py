"""Budgets against a plain tree, weights of zero, and the SQL of the query."""

import duckdb
import pytest

from chronoflux.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string"


def rows():
    out = []
    for i in range(400):
        source = f"s{(i * 7 + i // 9) % 11}"
        out.append((i, " ".join(["w"] * (i * 13 % 37)), ["en", "de", None][i % 3], source if i % 17 else None))
    return [*out, (5, "again a repeated id", "en", "s1"), (6, None, "en", "s2")]


def quotas(leaves, budget, weights, depth=0):
    """Plain recursion: {leaf path: room} and a budget for the subtree."""
    kids = {}
    for path, room in leaves.items():
        kids.setdefault(path[: depth + 1], {})[path] = room
    room = {k: sum(v.values()) for k, v in kids.items()}
    weight = {k: weights.get(k, 1.0) for k in kids}
    left, open_, share = min(budget, sum(room.values())), {k for k in kids if weight[k] > 0 and room[k] > 0}, {k: 0 for k in kids}
    while open_:
        total = sum(weight[k] for k in open_)
        full = {k for k in open_ if room[k] / weight[k] * total <= left + 1e-9}
        if not full:
            for k in open_:
                share[k] = left * weight[k] / total
            break
        k = min(full, key=lambda x: room[x] / weight[x])
        share[k], left = room[k], left - room[k]
        open_.remove(k)
    out = {}
    for k, v in kids.items():
        out.update({p: share[k] for p in v} if depth == 2 else quotas(v, share[k], weights, depth + 1))
    return out


@pytest.mark.parametrize("weights", [{}, {("d0",): 0.0}, {("d1", "de"): 0.0, ("d2",): 3.0, ("d2", "en"): 0.5}, {("d0", "en", "s4"): 0.0, ("d3", "en", "s3"): 5.0}])
@pytest.mark.parametrize(("share", "epochs"), [(0.6, 2), (0.9, 1)])
def test_budgets(spark, weights, share, epochs):
    docs = spark.createDataFrame(rows(), SCHEMA)
    leaves = mixing.sized(docs).groupBy(*mixing.LEVELS).sum("tokens").withColumnRenamed("sum(tokens)", "tokens")
    total = int(share * leaves.groupBy().sum("tokens").first()[0])
    room = {}
    for r in leaves.collect():
        path = (r["domain"], r["lang"], r["source"])
        room[path] = 0 if any(weights.get(path[: n + 1], 1.0) == 0 for n in range(3)) else r["tokens"] * epochs
    want = quotas(room, total, weights)
    got = {(r["domain"], r["lang"], r["source"]): r["quota"] for r in mixing.budgets(leaves, total, weights, epochs).collect()}
    assert got.keys() == want.keys() and sum(got.values()) == min(total, sum(room.values()))
    assert all(abs(got[k] - want[k]) <= 3 and (got[k] == 0 or room[k] > 0) for k in want)  # whole tokens at three levels


def test_zero_weight_gives_no_document(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    zero = {r["doc_id"] for r in mixing.sized(docs).where("domain = 'd0'").collect()}
    chosen = {r["doc_id"] for r in mixing.mix(docs, weights={("d0",): 0.0}).collect()}
    other = {r["doc_id"] for r in mixing.sized(docs).where("domain <> 'd0'").collect()}
    assert chosen and not (chosen & (zero - other))
    with pytest.raises(ValueError):
        mixing.mix(docs, weights={("d0",): -1.0})


def test_sql_gives_the_same_rows(spark, tmp_path):
    docs = spark.createDataFrame([r for r in rows() if r[0] != 5 or "again" not in r[1]], SCHEMA).repartition(2)
    got = mixing.mix(docs)
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    found = con.execute(mixing.ORACLE)
    names = [d[0] for d in found.description]
    assert sorted(tuple(r[n] for n in names) for r in got.collect()) == sorted(found.fetchall())
