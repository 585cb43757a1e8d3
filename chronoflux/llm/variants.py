"""Spelling variants: words one edit apart, by blocked Gram matrices of letter counts."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Letters of a word, its shortest length and how often it has to occur.
LETTERS, LEAST, TWICE = r"A-Za-zÀ-ÿ", 7, 2
#: One in ``EVERY`` runs (by crc32) loses a letter.
EVERY = 31
#: A form is at least ``MORE`` times as frequent as its word.
MORE = 10
#: Words of a block and words compared with it that meet in one product.
ROWS, ASKED = 2048, 4096
#: Letters a-z, then those from U+00C0 to U+00FF.
WIDTH = 26 + 64


def words(df: DataFrame) -> DataFrame:
    """``(word, n)``: the counted words of ``doc_id, text``, all by SQL functions and one pre-aggregated shuffle."""
    rows = df.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL")
    runs = rows.select("doc_id", F.explode(F.regexp_extract_all("text", F.lit(f"[{LETTERS}]{{{LEAST},}}"), F.lit(0))).alias("run"))
    runs = runs.select("doc_id", F.translate("run", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz").alias("run"))
    runs = runs.withColumn("h", F.crc32(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.col("run"))))
    at = F.pmod(F.col("h"), F.length("run").cast("long")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % EVERY == 0, cut).otherwise(F.col("run"))
    return runs.select(word.alias("word")).where(F.length("word") >= LEAST).groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= TWICE)


def letters(column: pa.Array, length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    return np.array(column.to_pylist(), dtype=f"U{length}").view(np.uint32).reshape(len(column), length)


def counts(points: np.ndarray, kind: type = np.float32) -> np.ndarray:
    """Letter counts, a row for each word."""
    at = np.where(points < 128, points - 97, points - 0xC0 + 26).astype(np.int64)
    return np.bincount((at + np.arange(len(points))[:, None] * WIDTH).ravel(), minlength=len(points) * WIDTH).reshape(len(points), WIDTH).astype(kind)


def one_edit(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which rows of ``a`` are one edit from those of ``b``, of the same length or one more."""
    if a.shape[1] == b.shape[1]:
        return (a != b).sum(1) == 1
    head = np.logical_and.accumulate(a == b[:, :-1], axis=1).sum(1)
    tail = np.logical_and.accumulate((a == b[:, 1:])[:, ::-1], axis=1).sum(1)
    return head + tail >= a.shape[1]


def near_in_block(home: pa.Array, asked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Places of (home, asked) one edit apart; asked words are as long as the home words or one shorter.

    The squared distance of letter counts comes from one product of two count
    matrices; an edit moves it by one or two, so what is at most two is compared
    letter by letter.
    """
    size = len(home[0].as_py())
    own = letters(home, size)
    kind = np.float32 if size < 1000 else np.float64  # whole numbers stay exact
    h = counts(own, kind)
    found = []
    lengths = np.array([len(w) for w in asked.to_pylist()])
    for n in (size - 1, size):
        rows = np.flatnonzero(lengths == n)
        if not len(rows):
            continue
        other = letters(asked.take(pa.array(rows)), n)
        g = counts(other, kind)
        i, j = np.nonzero((h * h).sum(1)[:, None] - 2 * h @ g.T + (g * g).sum(1)[None, :] <= 2)
        step = max(1, (1 << 21) // size)
        for at in range(0, len(i), step):
            x, y = i[at : at + step], j[at : at + step]
            ok = one_edit(other[y], own[x])
            found.append((x[ok], rows[y[ok]]))
    if not found:
        return np.empty(0, int), np.empty(0, int)
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def near(counted: DataFrame, groups: int = 6) -> DataFrame:
    """``(a, a_n, b, b_n)``: every pair of words exactly one edit apart, once.

    A block holds words of one length and of one number of letters in each of
    ``groups`` classes of the alphabet (code point modulo ``groups``).  One edit adds
    one to a class, or moves one from a class to another, so a block meets itself,
    the blocks of one letter less and those with one letter in another class; of two
    such blocks one is sent to the other.  Blocks beyond ``ROWS`` words are cut by
    hash, and so are the words sent to them: no product is unbounded.
    """
    alphabet = [chr(c) for c in [*range(97, 123), *range(0xC0, 0x100)]]
    classes = [F.length("word") - F.length(F.translate("word", "".join(c for c in alphabet if ord(c) % groups == k), "")) for k in range(groups)]
    counted = counted.withColumn("block", F.concat_ws(",", *[c.cast("string") for c in classes]))
    sizes = common.written(counted.groupBy("block").agg(F.count("*").alias("n")), "blocks")

    def meets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple[str, str, int]] = []
            for block, n in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                s = [int(x) for x in block.split(",")]
                moves = [s, *([x + (k == i) for k, x in enumerate(s)] for i in range(groups))]
                moves += [[x + (k == i) - (k == j) for k, x in enumerate(s)] for j in range(groups) if s[j] for i in range(j)]
                out += [(block, ",".join(map(str, m)), n) for m in moves]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], t) for k, t in enumerate((pa.string(), pa.string(), pa.int64()))], ["block", "cell", "n"])

    sent = sizes.mapInArrow(meets, "block string, cell string, n long")
    cells = sent.groupBy("cell").agg(F.sum("n").alias("q")).join(sizes.select(F.col("block").alias("cell"), "n"), "cell")
    cells = cells.select("cell", F.ceil(F.col("n") / ROWS).cast("int").alias("rb"), F.ceil(F.col("q") / ASKED).cast("int").alias("qb"))
    plan = common.written(sent.drop("n").join(cells, "cell").groupBy("block").agg(F.collect_list(F.struct("cell", "rb", "qb")).alias("to")), "meets")  # at most 1 + groups + groups squared
    rows = counted.join(plan, "block").select("word", "n", "block", F.explode("to").alias("to")).select("word", "n", "block", "to.*")

    def dealt(df: DataFrame, own: str, other: str, kind: Column) -> DataFrame:
        df = df.withColumn("own", F.pmod(F.xxhash64("word"), F.col(own)).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        r, q = ("own", "other") if own == "rb" else ("other", "own")
        return df.select(F.xxhash64("cell", r, q).alias("group"), kind.alias("kind"), "word", "n")

    home = dealt(rows.where("cell = block"), "rb", "qb", F.lit(0))
    both = home.unionByName(dealt(rows, "qb", "rb", F.when(F.col("cell") == F.col("block"), 2).otherwise(1)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in common.whole_groups(batches, 0):
            group, kind = part.column(0).to_numpy(), part.column(1).to_numpy()
            word, n = part.column(2).combine_chunks(), part.column(3).to_numpy()
            at = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
            out = []
            for s, e in zip(at[:-1], at[1:], strict=True):
                r, q = s + np.flatnonzero(kind[s:e] == 0), s + np.flatnonzero(kind[s:e])
                if len(q) and len(r):
                    i, j = near_in_block(word.take(pa.array(r)), word.take(pa.array(q)))
                    out.append((r[i], q[j]))
            if out:
                i, j = (np.concatenate(x) for x in zip(*out, strict=True))
                a, b = word.take(pa.array(i)), word.take(pa.array(j))
                once = (kind[j] == 1) | pc.less(b, a).to_numpy(zero_copy_only=False)  # words of one block meet both ways
                yield pa.RecordBatch.from_arrays([a, pa.array(n[i]), b, pa.array(n[j])], ["a", "a_n", "b", "b_n"]).filter(pa.array(once))

    return common.sorted_groups(both, "group").mapInArrow(run, "a string, a_n long, b string, b_n long")


def followed(links: DataFrame) -> DataFrame:
    """``(word, root)``: from each ``word`` of ``links(word, form)`` along forms to the last.

    Each round doubles the steps made.  A form is ``MORE`` times as frequent as its
    word, so a chain is no longer than the decimals of the greatest count.
    """
    reached = common.written(links.select("word", F.col("form").alias("root"), F.lit(True).alias("moved")), "roots")
    while reached.where("moved").head(1):
        onward = reached.select(F.col("word").alias("root"), F.col("root").alias("next"))
        reached = common.written(reached.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
    return reached.select("word", "root")


def variants(df: DataFrame, groups: int = 6) -> DataFrame:
    """Each counted word of ``doc_id, text``: ``(word, form, root, n, n_near, form_n)``.

    Runs of letters (A-Z lowered) of at least seven code points, one in 31 of them
    short of a letter, that occur twice or more are words.  Words one inserted,
    deleted or replaced letter apart are near.  The form is the near word of largest
    n, ties to the smaller in code-point order, if ten times as frequent; the root is
    the end of the chain of forms, the word itself if it has none.

    Null texts hold no words and rows without a doc_id take no part; repeated rows
    count each; a text may be one run of any length.  No words give no rows.
    """
    counted = common.written(words(df), "words")
    pairs = near(counted, groups)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("b_n").alias("a_n"), F.col("a").alias("b"), F.col("a_n").alias("b_n")))
    best = both.groupBy(F.col("a").alias("word")).agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("b_n")).alias("n"), F.col("b").alias("word"))).alias("best"))
    found = counted.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(-F.col("best.n") >= F.col("n") * MORE, F.struct(F.col("best.word").alias("form"), (-F.col("best.n")).alias("n"))).alias("best"))
    found = common.written(found.select("word", F.col("best.form").alias("form"), "n", "n_near", F.col("best.n").alias("form_n")), "forms")
    root = followed(found.where("form IS NOT NULL"))
    return found.join(root, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of ``documents`` with the frequent word each is a variant of."""
    return variants(common.table(spark, sf_dir, "documents"))


#: CRC-32 of bytes as a macro of the reflected polynomial 0xEDB88320, bit by bit for each entry of its table.
CRC32 = """
steps AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t FROM (SELECT unnest(range(256)) AS i))"""


def crc32_sql(text: str, steps: str = "t") -> str:
    """DuckDB's CRC-32 of a text of code points below U+0800; needs ``CRC32``'s ``steps``."""
    octets = f"flatten(list_transform(string_split({text}, ''), lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 | (unicode(c) >> 6))::BIGINT, (128 | (unicode(c) & 63))::BIGINT] END))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, k: xor(c >> 8, {steps}[(xor(c, k) & 255) + 1])))"


ORACLE = rf"""WITH RECURSIVE {CRC32},
runs AS (SELECT doc_id, translate(unnest(regexp_extract_all(text, '[A-Za-z\x{{00C0}}-\x{{00FF}}]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run FROM documents WHERE doc_id IS NOT NULL),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 7 GROUP BY ALL),
hashed AS (SELECT counted.*, {crc32_sql("concat(doc_id, ':', run)")} AS h FROM counted, steps),
cut AS (SELECT CASE WHEN h % 31 = 0 THEN concat(run[:(h % length(run))::INT], run[(h % length(run))::INT + 2:]) ELSE run END AS word, n FROM hashed),
words AS MATERIALIZED (SELECT word, sum(n)::BIGINT AS n FROM cut WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
holes AS (SELECT word, n, i, concat(word[:i - 1], word[i + 1:]) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
pairs AS MATERIALIZED (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM holes a JOIN holes b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT h.word, w.word, w.n FROM holes h JOIN words w ON w.word = h.rest
  UNION SELECT w.word, h.word, h.n FROM holes h JOIN words w ON w.word = h.rest),
best AS (SELECT word, count(*) AS n_near, arg_min(other, (-other_n, other)) AS form, max(other_n) AS form_n FROM pairs GROUP BY word),
formed AS MATERIALIZED (SELECT w.word, CASE WHEN form_n >= 10 * n THEN form END AS form, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 10 * n THEN form_n END AS form_n FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS here, 0 AS step FROM formed UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN formed f ON f.word = c.here WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(here, step) AS root FROM chain GROUP BY word)
SELECT f.word, form, root, n, n_near, form_n FROM formed f JOIN roots USING (word)"""
