"""Quality classifier by co-training."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Buckets of hashed text features.
BUCKETS = 1 << 18
#: A text feature is used if this many training documents have it.
LEAST_DOCUMENTS = 5
LANGS, SOURCES = 8, 32


def text_view(text: Column) -> Column:
    """Hashed distinct features of the content: words in lower case and runs of marks."""
    found = F.concat(F.regexp_extract_all(F.lower(text), F.lit(r"\p{L}+"), F.lit(0)), F.regexp_extract_all(text, F.lit(r"[^\p{L}\p{N}\s]{1,8}"), F.lit(0)))
    return F.transform(F.array_distinct(found), lambda t: F.pmod(F.xxhash64(t), F.lit(BUCKETS)).cast("int"))


def page_view(text: Column, lang: Column, source: Column) -> Column:
    """Metadata of the page: language, source, size and layout, as numbers; no word of it."""
    n = F.greatest(F.length(text), F.lit(1))
    share = lambda p: F.regexp_count(text, F.lit(p)) / n
    words = F.greatest(F.regexp_count(text, F.lit(r"\S+")), F.lit(1))
    lines = F.filter(F.split(text, "\n"), lambda x: x != "")
    numbers = [F.log1p(F.length(text)), share(r"\p{Lu}") * 5, share(r"[^\p{L}\p{N}\s]") * 5, share(r"[0-9]") * 5, n / words / 10, F.size(lines) / words * 5, F.size(F.array_distinct(lines)) / F.greatest(F.size(lines), F.lit(1))]
    one_hot = lambda c, k: [(F.pmod(F.xxhash64(c), F.lit(k)) == i).cast("double") for i in range(k)]
    return F.array(*[F.coalesce(x.cast("double"), F.lit(0.0)) for x in [*numbers, *one_hot(lang, LANGS), *one_hot(source, SOURCES)]])


def _own(docs: DataFrame) -> DataFrame:
    """``(_row, _id, _t, _p)``: the whole row, its doc_id and both views; no name can clash."""
    given = lambda c: F.col(f"_row.`{c}`") if c in docs.columns else F.lit(None).cast("string")
    text = F.coalesce(given("text").cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("_row")).where("_row.doc_id IS NOT NULL")
    return rows.select("_row", F.col("_row.doc_id").cast("long").alias("_id"), text_view(text).alias("_t"), page_view(text, given("lang"), given("source")).alias("_p"))


class View:
    """Logistic regression over one view, fitted on a bounded sample."""

    def __init__(self, sparse: bool) -> None:
        self.sparse = sparse

    def margin(self, x: object) -> np.ndarray:
        if self.sparse:
            ids, off = x
            if not len(off) - 1:
                return np.empty(0)
            total = np.concatenate([[0.0], np.cumsum(self.w[ids])])
            return self.b + (total[off[1:]] - total[off[:-1]]) / np.sqrt(np.maximum(np.diff(off), 1))
        return self.b + ((x - self.mean) / self.scale) @ self.w

    def fit(self, x: object, y: np.ndarray, rounds: int = 80, penalty: float = 1e-4, balanced: bool = True) -> View:
        """Full batches with adaptive steps; ``balanced``: both classes weigh the same."""
        n = len(y)
        weight = np.where(y > 0, 0.5 / max(y.mean(), 1e-3), 0.5 / max(1 - y.mean(), 1e-3)) / n if balanced else np.full(n, 1 / n)
        if self.sparse:
            ids, off = x
            size = np.sqrt(np.maximum(np.diff(off), 1))
            row = np.repeat(np.arange(n), np.diff(off))
            gain = self.log_ratio(ids, y[row], y)
            grad = lambda r: np.bincount(ids, (r / size)[row], BUCKETS) * gain
            self.w = np.zeros(BUCKETS)
        else:
            self.mean, self.scale = x.mean(0), x.std(0) + 1e-3
            grad = lambda r: ((x - self.mean) / self.scale).T @ r
            self.w = np.zeros(x.shape[1])
        free, self.b, m, v, step = self.w, 0.0, 0.0, 0.0, 0.25 if self.sparse else 0.1
        for t in range(1, rounds + 1):
            r = (1 / (1 + np.exp(-np.clip(self.margin(x), -30, 30))) - y) * weight
            g = np.concatenate([grad(r) + penalty * free / 10, [r.sum()]])
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            move = step * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
            free, self.b = free - move[:-1], self.b - move[-1]
            self.w = free * gain if self.sparse else free
        return self

    @staticmethod
    def log_ratio(ids: np.ndarray, labels: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Scale of each text feature: how much likelier one class is to have it than the other.

        Words common to both classes get almost none, so a few telling words are not
        lost among hundreds of others; those of fewer than ``LEAST_DOCUMENTS`` get none.
        """
        has, yes = np.bincount(ids, minlength=BUCKETS), np.bincount(ids, labels, BUCKETS)
        ratio = np.log((yes + 0.5) / (y.sum() + 1)) - np.log((has - yes + 0.5) / (len(y) - y.sum() + 1))
        return np.where(has >= LEAST_DOCUMENTS, np.abs(ratio), 0.0)


def _take(x: object, keep: np.ndarray, sparse: bool) -> object:
    if not sparse:
        return x[keep]
    ids, off = x
    lengths = np.diff(off)[keep]
    return ids[common.spread(off[:-1][keep], lengths)], np.concatenate([[0], np.cumsum(lengths)])


def _join(a: object, b: object, sparse: bool) -> object:
    if not sparse:
        return np.concatenate([a, b])
    return np.concatenate([a[0], b[0]]), np.concatenate([a[1], a[1][-1] + b[1][1:]])


class Scorer:
    """Both views of one target and the calibration that combines them."""

    def __init__(self, text: View, page: View, mix: View) -> None:
        self.text, self.page, self.mix = text, page, mix

    def margins(self, text: object, page: np.ndarray) -> np.ndarray:
        return np.column_stack([self.text.margin(text), self.page.margin(page)])

    def probability(self, text: object, page: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.mix.margin(self.margins(text, page)), -30, 30)))


def co_train(text: object, page: np.ndarray, y: np.ndarray, more_text: object, more_page: np.ndarray, rounds: int, sure: float) -> Scorer:
    """Two classifiers teach each other.

    Each round both views are fitted and label the unlabelled sample; what one is
    ``sure`` of joins the other's training set.  A fifth of the labelled rows is
    held back, and a logistic regression on both margins there calibrates and
    combines the views.
    """
    held = np.arange(len(y)) % 5 == 4
    if min((y[held] == 1).sum(), (y[held] == 0).sum()) < 3:
        held[:] = False
    fit = ~held
    views = {True: View(True), False: View(False)}
    x = {True: _take(text, fit, True), False: page[fit]}
    more = {True: more_text, False: more_page}
    pseudo: dict[bool, tuple[np.ndarray, np.ndarray]] = {s: (np.empty(0, int), np.empty(0)) for s in views}
    for r in range(rounds + 1):
        for s, view in views.items():
            ids, labels = pseudo[s]
            view.fit(_join(x[s], _take(more[s], ids, s), s) if len(ids) else x[s], np.concatenate([y[fit], labels]))
        if r < rounds and len(more_page):
            for s in views:
                p = 1 / (1 + np.exp(-np.clip(views[not s].margin(more[not s]), -30, 30)))
                ids = np.flatnonzero((p >= sure) | (p <= 1 - sure))
                pseudo[s] = ids, (p[ids] >= 0.5).astype(float)
    scorer = Scorer(views[True], views[False], View(False))
    on = held if held.any() else fit
    scorer.mix.fit(scorer.margins(_take(text, on, True), page[on]), y[on], 300, balanced=False)
    return scorer


def train(docs: DataFrame, labels: DataFrame, targets: tuple[str, ...] = ("quality", "toxic"), sample: int = 6000, rounds: int = 2, sure: float = 0.97) -> dict[str, Scorer]:
    """Fit a scorer per target on at most ``sample`` labelled and as many unlabelled documents.

    The samples are the least hashes of doc_id, fetched in one scan, so the same rows
    give the same model; of several labels of a document the least counts.  A target
    with one class only has no scorer.
    """
    known = labels.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(*[F.min(F.col(t).cast("double")).alias(f"_{t}") for t in targets])
    known = known.orderBy(F.xxhash64("_id"), "_id").limit(sample)
    others = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("_id")).distinct().orderBy(F.xxhash64("_id", F.lit(1)), "_id").limit(sample)
    wanted = known.withColumn("_known", F.lit(True)).unionByName(others, allowMissingColumns=True).groupBy("_id").agg(F.max("_known").alias("_known"), *[F.max(f"_{t}").alias(f"_{t}") for t in targets])
    chosen = docs.select(F.struct("*").alias("_row")).join(F.broadcast(wanted.select("_id")), F.col("_row.doc_id").cast("long") == F.col("_id"), "left_semi").select("_row.*")  # features of the sample only
    got = _own(chosen).join(F.broadcast(wanted), "_id").select("_id", "_t", "_p", "_known", *[f"_{t}" for t in targets]).dropDuplicates(["_id"]).orderBy("_id").toArrow()  # 2 * ``sample`` rows
    t, p = common.flat(got.column("_t")), _dense(common.flat(got.column("_p"))[0])
    labelled = got.column("_known").fill_null(False).to_numpy()
    mixed = np.random.default_rng(1).permutation(np.flatnonzero(labelled))
    more = np.flatnonzero(~labelled)
    out = {}
    for target in targets:
        y = got.column(f"_{target}").to_numpy()[mixed].astype(float)
        own, y = mixed[~np.isnan(y)], (y[~np.isnan(y)] > 0.5).astype(float)
        if len(np.unique(y)) == 2:
            out[target] = co_train(_take(t, own, True), p[own], y, _take(t, more, True), p[more], rounds, sure)
    return out


def _lists(s: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([np.empty(0, np.int64), *s]).astype(np.int64), np.concatenate([[0], np.cumsum([len(x) for x in s], dtype=np.int64)])


def _dense(values: np.ndarray) -> np.ndarray:
    return values.reshape(-1, 7 + LANGS + SOURCES)


def _scores(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """``(_row, _s)``: each row, and its scores ``quality, text, page, toxic``."""
    models = train(docs, labels, **options)

    def score(text: pd.Series, page: pd.Series) -> pd.DataFrame:
        t, p = _lists(text), _dense(np.concatenate([np.empty(0), *page]))
        out = {"quality": np.ones(len(page)), "text": np.ones(len(page)), "page": np.ones(len(page)), "toxic": np.zeros(len(page))}
        if (m := models.get("quality")) is not None:
            out["quality"] = m.probability(t, p)
            out["text"], out["page"] = (1 / (1 + np.exp(-np.clip(m.margins(t, p).T, -30, 30))))
        if (m := models.get("toxic")) is not None:
            out["toxic"] = m.probability(t, p)
        return pd.DataFrame(out)

    score.__annotations__ = {"text": pd.Series, "page": pd.Series, "return": pd.DataFrame}
    udf = F.pandas_udf(score, "quality double, text double, page double, toxic double")
    return _own(docs).select("_row", udf("_t", "_p").alias("_s"))


def scored(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """``docs`` with ``quality_score``, ``text_score``, ``page_score`` and ``toxic_score``.

    One pass over all documents, whole texts.  Null and empty texts are scored like
    any other, by what features they have; repeated rows alike; rows without a doc_id
    are left out; without usable labels every quality score is 1 and every toxic
    score 0; columns of these four names are replaced, others kept, whatever they are.
    """
    names = {f"{k}_score": k for k in ("quality", "text", "page", "toxic")}
    kept = [F.col(f"_row.`{c}`").alias(c) for c in docs.columns if c not in names]
    return _scores(docs, labels, **options).select(*kept, *[F.col(f"_s.{k}").alias(n) for n, k in names.items()])


def kept(docs: DataFrame, labels: DataFrame, **options: object) -> DataFrame:
    """The rows of ``docs``, as they are, that are accepted."""
    return _scores(docs, labels, **options).where(accepted(quality=F.col("_s.quality"), toxic=F.col("_s.toxic"))).select("_row.*")


def accepted(least: float = 0.5, most_toxic: float = 0.5, quality: Column | None = None, toxic: Column | None = None) -> Column:
    good, bad = F.col("quality_score") if quality is None else quality, F.col("toxic_score") if toxic is None else toxic
    return (good >= least) & (bad < most_toxic)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    found = scored(docs, common.table(spark, sf_dir, "labels"))
    return found.select("doc_id", "quality_score", "text_score", "page_score", "toxic_score", accepted().alias("keep"))
