"""Prefix trie of conversations, shared prefixes screened by a count-min sketch."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, variants

#: Conversations of one hundred share first turns, ``crc32 % HEADS`` of them at most.
FAMILY, HEADS = 100, 6
#: Rows of counters, log2 of the least and the most counters of a row, and counters a merged piece holds.
DEPTH, LEAST_BITS, MOST_BITS, PIECE = 4, 14, 22, 1 << 16
#: Characters of joined ids that one row carries.
CHUNK = 1 << 16
#: A prefix: its four sums and its depth.
KEY = ["k1", "k2", "depth"]


def turns(df: DataFrame) -> DataFrame:
    """``(conv, part, i, before, mark, chars)``: numbered turns, dealt by range so that a long conversation is many parts.

    ``i`` counts within the part and ``before`` the turns of earlier parts.  ``mark``
    is the MD5 of role and text; texts go no further than this.
    """
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    rows = df.select(F.col("conv_id").cast("long").alias("conv"), F.col("turn"), F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)).alias("mark"), F.length(text).cast("long").alias("chars")).where("conv IS NOT NULL")
    rows = common.written(rows, "marks")
    order = [F.col("turn").asc_nulls_first(), F.col("mark")]
    dealt = rows.withColumn("salt", F.monotonically_increasing_id()).repartitionByRange("conv", *order, "salt").withColumn("part", F.spark_partition_id())
    dealt = common.written(dealt.drop("salt"), "dealt").withColumn("i", F.row_number().over(Window.partitionBy("conv", "part").orderBy(*order)).cast("long")).drop("turn")
    cells = dealt.groupBy("conv", "part").agg(F.count("*").alias("n"))  # a row per part and conversation in it
    cells = cells.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return dealt.join(cells.drop("n"), ["conv", "part"])


def rebuilt(df: DataFrame) -> DataFrame:
    """``(conv, part, depth, size, mark, chars)``: the turns of every rebuilt conversation; ``part`` -1 holds those of its family's first."""
    own = common.written(turns(df), "turns")
    heads = own.where((F.col("conv") % FAMILY == 0) & (F.col("before") + F.col("i") < HEADS))
    heads = heads.groupBy(F.col("conv").alias("first")).agg(F.sort_array(F.collect_list(F.struct((F.col("before") + F.col("i")).alias("depth"), "mark", "chars"))).alias("heads"))
    cells = own.groupBy("conv", "part").agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy("conv"))
    cells = cells.select("conv", "part", total.alias("total"), (F.col("part") == F.min("part").over(Window.partitionBy("conv"))).alias("opens"))
    cells = cells.withColumn("first", F.col("conv") - F.col("conv") % FAMILY).join(heads, "first", "left")
    skipped = F.pmod(F.crc32(F.col("conv").cast("string")), F.lit(HEADS))
    cells = cells.withColumn("h", skipped).withColumn("heads", F.when(F.col("h") > 0, F.slice(F.coalesce("heads", F.expr("array()")), F.lit(1), F.greatest(F.col("h"), F.lit(1)).cast("int"))))
    cells = cells.withColumn("taken", F.coalesce(F.size("heads"), F.lit(0))).withColumn("taken", F.greatest("taken", F.lit(0)).cast("long"))
    cells = common.written(cells.withColumn("size", F.col("taken") + F.greatest(F.col("total") - F.col("h"), F.lit(0))), "cells")
    root = cells.where("opens").select("conv", F.lit(-1).alias("part"), F.lit(0).cast("long").alias("depth"), "size", F.lit("").alias("mark"), F.lit(0).cast("long").alias("chars"))
    head = cells.where("opens AND taken > 0").select("conv", F.lit(-1).alias("part"), "size", F.inline("heads")).select(*root.columns)
    tail = own.join(cells.select("conv", "part", "h", "taken", "size"), ["conv", "part"]).withColumn("at", F.col("before") + F.col("i")).where("at > h")
    return root.unionByName(head).unionByName(tail.select("conv", "part", (F.col("at") - F.col("h") + F.col("taken")).alias("depth"), "size", "mark", "chars"))


def running(rows: DataFrame, columns: list[str], back: bool = False) -> DataFrame:
    """Sums of ``columns`` over a conversation up to each row (``back``: from each row on), by parts and then by cells of them."""
    order = F.col("depth").desc() if back else F.col("depth").asc()
    inner = Window.partitionBy("conv", "part").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cells = rows.groupBy("conv", "part").agg(*[F.sum(c).alias(f"{c}_all") for c in columns])
    earlier = Window.partitionBy("conv").orderBy(F.col("part").desc() if back else F.col("part").asc()).rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("conv", "part", *[F.coalesce(F.sum(f"{c}_all").over(earlier), F.lit(0)).alias(f"{c}_all") for c in columns])
    rows = rows.select("*", *[F.sum(c).over(inner).alias(f"{c}_run") for c in columns]).join(cells, ["conv", "part"])
    return rows.select(*[c for c in rows.columns if c not in {*columns, *(f"{x}_run" for x in columns), *(f"{x}_all" for x in columns)}], *[(F.col(f"{c}_run") + F.col(f"{c}_all")).alias(c) for c in columns])


def prefixes(df: DataFrame) -> DataFrame:
    """``(conv, part, depth, size, chars, k1, k2)``: a row per prefix; the key is 128 bits.

    Turns are hashed with their place to four numbers of 32 bits; their sums over a
    prefix, modulo 2^32, name it.  Sums add up over parts, so no conversation has to
    be in one place.
    """
    rows = rebuilt(df)
    one, two = F.xxhash64("mark", "depth"), F.xxhash64(F.lit("other"), "depth", "mark")
    low, high = (lambda x: x.bitwiseAND(0xFFFFFFFF)), (lambda x: F.shiftrightunsigned(x, 32))
    zero = F.lit(0).cast("long")
    rows = rows.select("*", *[F.when(F.col("depth") == 0, zero).otherwise(part(x)).alias(c) for c, part, x in (("x1", low, one), ("x2", high, one), ("x3", low, two), ("x4", high, two))]).drop("mark")
    rows = running(rows, ["x1", "x2", "x3", "x4"])
    word = lambda a, b: F.shiftleft(F.col(a).bitwiseAND(0xFFFFFFFF), 32).bitwiseOR(F.col(b).bitwiseAND(0xFFFFFFFF))
    return rows.select("conv", "part", "depth", "size", "chars", word("x1", "x2").alias("k1"), word("x3", "x4").alias("k2"))


def places(k1: np.ndarray, k2: np.ndarray, bits: int) -> np.ndarray:
    """Counters of each prefix, one in every row of the sketch."""
    a, b = k1.view(np.uint64), k2.view(np.uint64) | np.uint64(1)
    return np.stack([((a + np.uint64(r) * b) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - bits)).astype(np.int64) + (r << bits) for r in range(DEPTH)])


def sketch(rows: DataFrame, bits: int) -> np.ndarray:
    """Count-min sketch of all prefixes, counters ending at two: ``DEPTH`` rows of 2^bits bytes, whatever the input."""
    size = DEPTH << bits

    def packed(counter: np.ndarray) -> pa.RecordBatch:
        at = [k for k in range(0, size, PIECE) if counter[k : k + PIECE].any()]
        return pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array([zlib.compress(counter[k : k + PIECE].tobytes(), 1) for k in at], pa.binary())], ["piece", "counters"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = np.zeros(size, np.uint8)
        for batch in batches:
            for row in places(batch.column(0).to_numpy(), batch.column(1).to_numpy(), bits):
                at, n = np.unique(row, return_counts=True)
                counter[at] = np.minimum(counter[at] + np.minimum(n, 2), 2)
        yield packed(counter)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[int, np.ndarray] = {}
        for batch in batches:
            for k, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                new = np.frombuffer(zlib.decompress(raw), np.uint8)
                pieces[k] = np.minimum(pieces[k] + new, 2).astype(np.uint8) if k in pieces else new
        for k, counters in pieces.items():
            yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([zlib.compress(counters.tobytes(), 1)], pa.binary())], ["piece", "counters"])

    out = np.zeros(size, np.uint8)
    schema = "piece long, counters binary"
    for row in rows.select("k1", "k2").mapInArrow(count, schema).repartition("piece").mapInArrow(merge, schema).collect():  # size / PIECE rows
        new = np.frombuffer(zlib.decompress(row["counters"]), np.uint8)
        out[row["piece"] : row["piece"] + len(new)] = new
    return out


def screened(rows: DataFrame) -> DataFrame:
    """``rows`` with ``lone``: whether the sketch proves that no other conversation starts so."""
    n = rows.count()
    bits = min(MOST_BITS, max(LEAST_BITS, (4 * n).bit_length()))
    counter = rows.sparkSession.sparkContext.broadcast(sketch(rows, bits))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = counter.value[places(batch.column("k1").to_numpy(), batch.column("k2").to_numpy(), bits)].min(0, initial=2)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(low == 1)], [*batch.schema.names, "lone"])

    rows = common.written(rows.mapInArrow(look, "conv long, part int, depth long, size long, chars long, k1 long, k2 long, lone boolean"), "screened")
    first = F.max("lone").over(Window.partitionBy("conv", "part").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0))  # what follows a singleton is one
    return rows.withColumn("lone", first)


def ends(shared: DataFrame) -> DataFrame:
    """``(*KEY, ends)``: SHA-256 of the comma-joined ids of the conversations that end at each shared prefix.

    Ids are put in order by range over all tasks and joined to pieces there; the
    pieces of a prefix then pass one hash in order, as SHA-256 has to, a batch at a time.
    """
    ended = shared.where("depth = size").select(*KEY, "conv")
    ranged = ended.repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = [c.to_numpy() for c in batch.columns]
            new = np.any([np.diff(k) != 0 for k in keys[:3]], axis=0)
            at = np.concatenate([[0], np.flatnonzero(new) + 1, [batch.num_rows]])
            cut = np.concatenate([np.arange(s, e, CHUNK // 16) for s, e in zip(at[:-1], at[1:], strict=True)])
            text = [",".join(map(str, keys[3][s:e].tolist())) for s, e in zip(cut, [*cut[1:], batch.num_rows], strict=True)]
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(cut)) for c in batch.columns), pa.array(text)], [*KEY, "conv", "ids"])

    pieces = ranged.mapInArrow(joined, "k1 long, k2 long, depth long, conv long, ids string")

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest = None, None
        for batch in batches:
            out = []
            for *own, _, ids in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if own != key:
                    if digest is not None:
                        out.append((*key, digest.hexdigest()))
                    key, digest = own, hashlib.sha256(ids.encode())
                else:
                    digest.update(b"," + ids.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out, strict=True)], [*KEY, "ends"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*key, digest.hexdigest())], [*KEY, "ends"])

    return pieces.repartition(*KEY).sortWithinPartitions(*KEY, "conv").mapInArrow(hashed, "k1 long, k2 long, depth long, ends string")


def trie(df: DataFrame) -> DataFrame:
    """One row per node of the trie of all rebuilt conversations; columns as in ``op13_prefix_trie``.

    Every prefix gets a key of 128 bits, and a count-min sketch of all keys tells
    which may be shared.  The rest is emitted where it is: a prefix of one
    conversation, and all that follows it.  What may be shared is grouped by key.  A
    conversation is the smallest member of its prefixes from some depth on, so
    figures of a subtree are sums of its members' figures from there: one more
    grouping gives them, without a round per level.  Prefixes of over a thousandth of
    all rows are looked up by broadcast, and long conversations are worked on by part.

    Null roles and texts are empty; turns of one number go by the MD5 of role and
    text; repeated rows are turns each; rows without a conv_id are left out; a
    conversation may have no turn of its own left.  No rows give no nodes.
    """
    rows = common.written(screened(common.written(prefixes(df), "prefixes")), "rows")
    shared, lone = rows.where("NOT lone"), rows.where("lone")
    grouped = common.written(shared.groupBy(*KEY).agg(F.count("*").alias("n"), F.min("conv").alias("least"), F.sum((F.col("depth") == F.col("size")).cast("long")).alias("ended")), "shared")
    met = common.written(common.looked_up(shared, grouped, KEY, "n"), "met")
    own = F.col("least") == F.col("conv")
    leads = met.groupBy("conv").agg(F.min(F.when(own, F.col("depth"))).alias("a"), F.max(F.when(~own, F.struct("depth", "least"))).alias("above"), F.max(own & (F.col("depth") == F.col("size")) & (F.col("ended") == F.col("n"))).alias("leaf"))
    tails = lone.groupBy("conv").agg(F.min("depth").alias("b"), F.max(F.col("depth") == F.col("size")).alias("tail"))
    chains = leads.join(tails, "conv", "left").select("conv", F.coalesce(F.least("a", "b"), F.lit((1 << 62))).alias("from"), F.col("above.least").alias("above"), (F.col("leaf") | F.coalesce("tail", F.lit(False))).cast("long").alias("leaf"))
    chains = common.written(chains, "chains")
    sums = running(met.select("conv", "part", "depth", F.when(own, (F.col("n") - 1) * F.col("chars")).otherwise(0).alias("saved")), ["saved"], back=True)
    cells = met.groupBy("conv", "part").agg(F.count("*").alias("rows")).drop("rows").join(chains, "conv")
    member = met.join(sums, ["conv", "part", "depth"]).join(cells, ["conv", "part"])
    child = ((F.col("depth") < F.col("size")) & (F.col("depth") + 1 >= F.col("from"))).cast("long")
    parent = F.when(own, F.when(F.col("depth") == 0, None).when(F.col("depth") > F.col("from"), F.col("conv")).otherwise(F.col("above")))
    nodes = member.groupBy(*KEY).agg(F.min("conv").alias("conv_id"), F.max(parent).alias("parent_conv_id"), F.count("*").alias("n_convs"), F.sum(child).alias("n_children"), F.sum("leaf").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    none = F.sha2(F.lit(""), 256)
    nodes = nodes.join(ends(shared), KEY, "left").select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", F.coalesce("ends", none).alias("ends_sha256"))
    first = chains.select("conv", F.col("from").alias("depth"), "above")
    alone = lone.join(first, ["conv", "depth"], "left")
    one = F.lit(1).cast("long")
    alone = alone.select(F.col("conv").alias("conv_id"), "depth", F.when(F.col("depth") > 0, F.coalesce("above", "conv")).alias("parent_conv_id"), one.alias("n_convs"), (F.col("depth") < F.col("size")).cast("long").alias("n_children"), one.alias("n_leaves"), (one - 1).alias("saved_tokens"), F.when(F.col("depth") == F.col("size"), F.sha2(F.col("conv").cast("string"), 256)).otherwise(none).alias("ends_sha256"))
    return nodes.unionByName(alone)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nodes of the trie of ``conversations``: ``conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256``."""
    return trie(common.table(spark, sf_dir, "conversations"))


ORACLE = f"""WITH RECURSIVE {variants.CRC32},
t AS MATERIALIZED (SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(concat(length(coalesce(role, '')), ':', coalesce(role, ''), coalesce(text, '')))) AS i FROM conversations WHERE conv_id IS NOT NULL),
c AS MATERIALIZED (SELECT c, {variants.crc32_sql("c::VARCHAR")} % 6 AS h FROM (SELECT DISTINCT c FROM t), steps),
heads AS MATERIALIZED (SELECT c.c, t.i AS d, role, text FROM c JOIN t ON t.c = c.c - c.c % 100 AND t.i <= c.h),
taken AS (SELECT c, count(*) AS n FROM heads GROUP BY c),
turns AS (SELECT * FROM heads UNION ALL SELECT t.c, t.i - c.h + coalesce(taken.n, 0), role, text FROM t JOIN c USING (c) LEFT JOIN taken USING (c) WHERE t.i > c.h),
seqs AS MATERIALIZED (SELECT c.c, coalesce(list({{'r': role, 't': text}} ORDER BY d) FILTER (d IS NOT NULL), []) AS s FROM c LEFT JOIN turns USING (c) GROUP BY c.c),
pre AS MATERIALIZED (SELECT c, len(s) AS size, unnest(range(len(s) + 1)) AS d, s FROM seqs),
nodes AS MATERIALIZED (SELECT min(c) AS c, d, s[:d] AS p, count(*) AS n, CASE WHEN d = 0 THEN 0 ELSE length(max(s[d].t)) END AS chars, sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (size = d), '')) AS ends FROM pre GROUP BY d, s[:d]),
kids AS MATERIALIZED (SELECT p.c, p.d, count(k.c) AS n FROM nodes p LEFT JOIN nodes k ON k.d = p.d + 1 AND k.p[:p.d] = p.p GROUP BY p.c, p.d),
below AS (SELECT p.c, p.d, count(*) FILTER (kids.n = 0) AS leaves, sum((k.n - 1) * k.chars) AS saved FROM nodes p JOIN nodes k ON k.d >= p.d AND k.p[:p.d] = p.p JOIN kids ON kids.c = k.c AND kids.d = k.d GROUP BY p.c, p.d)
SELECT n.c AS conv_id, n.d AS depth, up.c AS parent_conv_id, n.n AS n_convs, kids.n AS n_children, leaves AS n_leaves, saved::BIGINT AS saved_tokens, n.ends AS ends_sha256
FROM nodes n JOIN kids ON kids.c = n.c AND kids.d = n.d JOIN below ON below.c = n.c AND below.d = n.d LEFT JOIN nodes up ON up.d = n.d - 1 AND up.p = n.p[:n.d - 1]"""
