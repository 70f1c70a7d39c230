"""Toxicity by class-conditional Kneser-Ney models.

Each class has a character model of order 6 over lower-cased words, interpolated with
continuation counts that both classes share. What a word adds is its log-likelihood
under the toxic model less that under the ordinary one. Two things follow from sharing
the backoff: rare forms of an expression are judged by the stem that they have in
common, and where a class has not seen a character after its context, the shared factor
cancels and only the two classes' backoff masses remain. So a model is two
tables: a ratio per seen 6-gram and one per context.

A text's score compares length-normalised log-likelihoods. The toxic hypothesis is that a small
share of a text's words, ``MIXED``, comes from the toxic model and the rest from the ordinary one, so
a word of log-ratio r adds log(1 - MIXED + MIXED * e^r), where r counts up to ``CAP``, and the sum is
divided by the text's words (``FLOOR`` more, so that a word or two decide nothing). That one number
decides; a logistic curve of it, fitted on labelled rows that the counts did not see, gives the
scale of a probability and the place where it crosses a half.

The fit is on all labelled rows, which Spark joins as their sizes ask for; to labels goes what is needed of a text, its
different words or its ratio, and where both sides are shuffled a Bloom filter leaves documents without a label behind. A word
counts once per document, so that one repetitive text is no evidence; documents per word are counted in Spark before words are
spelt out into characters. Continuation counts, totals and backoff masses of every order are
Spark groupings over all 6-grams of those rows. Both tables go to the executors whole, as
sorted arrays of 28 bytes a 6-gram and of 24 a context; they grow with the different 6-grams of the labelled texts.
Scoring covers every whole text.

Defined results
- null, empty or wordless texts: ratio 0, and the score that it gets;
- labels for unknown documents, null labels and repeated labels: unknown and null ones are
  ignored, repeats count as often as they occur;
- no labelled row of either class: every score is 0;
- empty table: empty result; other columns pass through unread, but for one of the name that the
  caller gives the score, which is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.tables import materialize

ORDER = 6
DISCOUNT = 0.95
MIXED, CAP, FLOOR = 0.003, 4.0, 40
#: For the join of labels: Spark's filter by the other side's keys, whatever the sizes; 4 MB, one wrong key in 25 at 5 million labels.
FILTERED = {"enabled": "true", "applicationSideScanSizeThreshold": "0", "creationSideThreshold": "10g", "expectedNumItems": "4000000", "numBits": str(1 << 25)}
_WORD = re.compile(r"[^\W\d_]+")
_BEGIN, _END = "\x02" * (ORDER - 1), "\x03"


def words_of(text: str | None) -> list[str]:
    """The lower-cased words of a text, for counting and scoring alike."""
    return _WORD.findall(text.lower()) if text else []


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the doc_id as text, modulo ``folds``."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % folds).cast("int")


def _sorted_table(rows: DataFrame, key: str, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys, ratios) of rows (``key``, ratio), ascending by key."""
    got = rows.select(key, F.col("ratio").cast("float").alias("ratio")).toArrow()
    parts = [np.array(c.to_pylist(), dtype=f"U{length}") for c in got.column(key).chunks]
    keys = np.concatenate(parts) if parts else np.empty(0, dtype=f"U{length}")
    order = np.argsort(keys)
    return keys[order], got.column("ratio").to_numpy()[order]


def _find(held: tuple[np.ndarray, np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found, ratio) of each wanted key; the ratio is 0 where the key is absent."""
    keys, ratios = held
    if not len(keys):
        return np.zeros(len(wanted), dtype=bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    found = keys[at] == wanted
    return found, np.where(found, ratios[at], 0.0)


@dataclass
class KneserNey:
    """The two tables of a fitted pair of models, sorted by key, and the slope and place of the final scale."""

    grams: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, dtype=f"U{ORDER}"), np.empty(0)))
    contexts: tuple[np.ndarray, np.ndarray] = field(default_factory=lambda: (np.empty(0, dtype=f"U{ORDER - 1}"), np.empty(0)))
    scale: tuple[float, float] | None = None

    def words(self, words: list[str]) -> list[float]:
        """What each word adds: the ratios of its 6-grams, or of their contexts where a 6-gram was not seen."""
        if not words:
            return []
        each: list[str] = []
        for w in words:
            padded = _BEGIN + w + _END
            each += [padded[i : i + ORDER] for i in range(len(w) + 1)]
        grams = np.array(each, dtype=f"U{ORDER}")
        found, ratios = _find(self.grams, grams)
        ratios[~found] = _find(self.contexts, grams[~found].astype(f"U{ORDER - 1}"))[1]
        starts = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        return np.add.reduceat(ratios, starts).tolist()

    def ratio(self, text: str | None, memo: dict[str, float]) -> float:
        """The text's log-likelihood ratio per word; ``memo`` remembers what words add."""
        said = words_of(text)
        if len(memo) > 300_000:
            memo.clear()
        new = list({w for w in said if w not in memo})
        if new:
            memo.update(zip(new, np.log1p(MIXED * np.expm1(np.minimum(self.words(new), CAP))).tolist(), strict=True))
        return sum(map(memo.__getitem__, said)) / (len(said) + FLOOR)

    def score(self, ratios: np.ndarray) -> np.ndarray:
        """Probabilities of ratios; 0 without a fit."""
        if self.scale is None:
            return np.zeros(len(ratios))
        slope, place = self.scale
        return 1 / (1 + np.exp(-np.clip(slope * (ratios - place), -40, 40)))


def different_words(text: Column) -> Column:
    """Each text's different words, a space between them."""

    @F.pandas_udf("string")
    def different(text: pd.Series) -> pd.Series:
        return pd.Series([" ".join(dict.fromkeys(words_of(t))) for t in text], dtype=object)

    return different(text)


def gram_counts(rows: DataFrame) -> DataFrame:
    """(gram, n_toxic, n_ordinary) of rows (words, label): documents per word are counted first, then words are spelt out."""
    # a condition on the words themselves would be moved before the join, and have them made twice
    words = rows.select(F.explode(F.split("words", " ")).alias("w"), "label").where("w != ''")
    counted = words.groupBy("w").agg(F.sum(F.when(F.col("label") == 1, 1).otherwise(0)).alias("t"), F.sum(F.when(F.col("label") == 1, 0).otherwise(1)).alias("o"))
    padded = F.concat(F.lit(_BEGIN), "w", F.lit(_END))
    spelt = counted.select(padded.alias("p"), "t", "o").select(F.explode(F.transform(F.sequence(F.lit(1), F.char_length("p") - (ORDER - 1)), lambda i: F.substr(F.col("p"), i, F.lit(ORDER)))).alias("gram"), "t", "o")
    return spelt.groupBy("gram").agg(F.sum("t").alias("n_toxic"), F.sum("o").alias("n_ordinary"))


def _levels(grams: DataFrame) -> list[DataFrame]:
    """Shared continuation counts of orders 1 to ORDER - 1: (gram, n, total, types).

    ``n`` counts the different characters before ``gram``, ``total`` sums n over all that has
    gram's context, and ``types`` counts it. A context has a row per letter at most.
    """
    levels, types = [], grams
    for order in range(ORDER - 1, 0, -1):
        shorter = types.select(F.substring("gram", 2, order).alias("gram")).groupBy("gram").agg(F.count("*").alias("n"))
        context = Window.partitionBy(F.substring("gram", 1, order - 1))
        types = materialize(shorter.select("gram", "n", F.sum("n").over(context).alias("total"), F.count("*").over(context).alias("types")), "continuations")
        levels.append(types)
    return levels[::-1]


def gram_ratios(grams: DataFrame, discount: float = DISCOUNT) -> tuple[DataFrame, DataFrame]:
    """(gram, ratio) and (context, ratio) of interpolated Kneser-Ney probabilities from (gram, n_toxic, n_ordinary).

    Every count is over all of ``grams``, rare and frequent.
    """
    d, low = F.lit(float(discount)), None
    for order, level in enumerate(_levels(grams), 1):
        if low is None:
            level = level.withColumn("lower", 1 / (F.col("types") + 1))  # the types of the empty context are the letters
        else:
            level = level.withColumn("_rest", F.substring("gram", 2, order - 1)).join(low.select(F.col("gram").alias("_rest"), F.col("p").alias("lower")), "_rest")
        low = level.select("gram", ((F.greatest(F.col("n") - d, F.lit(0.0)) + d * F.col("types") * F.col("lower")) / F.col("total")).alias("p"))
    h = Window.partitionBy("context")
    seen = grams.withColumn("context", F.substring("gram", 1, ORDER - 1))
    for c, n in (("t", "n_toxic"), ("o", "n_ordinary")):
        seen = seen.withColumn(f"{c}_n", F.sum(n).over(h)).withColumn(f"{c}_types", F.sum((F.col(n) > 0).cast("bigint")).over(h))
    for c in ("t", "o"):
        seen = seen.withColumn(f"{c}_mass", F.when(F.col(f"{c}_n") > 0, F.least(F.lit(1.0), d * F.col(f"{c}_types") / F.col(f"{c}_n"))).otherwise(1.0))
    seen = materialize(seen, "masses")
    full = seen.withColumn("_rest", F.substring("gram", 2, ORDER - 1)).join(low.select(F.col("gram").alias("_rest"), F.greatest("p", F.lit(1e-12)).alias("low")), "_rest")

    def interpolated(c: str, n: str) -> Column:
        return F.when(F.col(f"{c}_n") > 0, F.greatest(F.col(n) - d, F.lit(0.0)) / F.col(f"{c}_n")).otherwise(0.0) + F.col(f"{c}_mass") * F.col("low")

    ratios = full.select("gram", F.log(interpolated("t", "n_toxic") / interpolated("o", "n_ordinary")).alias("ratio"))
    return ratios, seen.select("context", F.log(F.col("t_mass") / F.col("o_mass")).alias("ratio")).distinct()


def fit_counts(grams: DataFrame, discount: float = DISCOUNT) -> KneserNey:
    """The model of all rows (gram, n_toxic, n_ordinary)."""
    ratios, contexts = gram_ratios(grams, discount)
    return KneserNey(_sorted_table(ratios, "gram", ORDER), _sorted_table(contexts, "context", ORDER - 1))


def _curve(model: KneserNey, centre: float, spread: float, sums: Callable[[np.ndarray], tuple], ridge: float) -> None:
    """Newton's steps for the logistic curve; ``sums`` gives those of v, v x, v x^2, g and g x at some weights. The slope is never negative."""
    w = np.zeros(2)
    for _ in range(60):
        v, vx, vxx, g, gx = sums(w)
        step = np.linalg.solve(np.array([[v, vx], [vx, vxx]]) + ridge * np.eye(2), np.array([g, gx]) + ridge * w)
        w -= np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    slope = max(w[1], 1e-6)
    model.scale = (float(slope / spread), float(centre - w[0] / slope * spread))


def fit_scale(model: KneserNey, ratios: np.ndarray, labels: np.ndarray, ridge: float = 1e-3) -> None:
    """The logistic curve of the ratio by Newton's steps."""
    model.scale = None
    if not len(ratios) or labels.min() == labels.max():
        return
    centre, spread = ratios.mean(), ratios.std() + 1e-9
    x = (ratios - centre) / spread

    def sums(w: np.ndarray) -> tuple:
        p = 1 / (1 + np.exp(-np.clip(w[0] + w[1] * x, -40, 40)))
        v, g = p * (1 - p), p - labels
        return v.sum(), (v * x).sum(), (v * x * x).sum(), g.sum(), (g * x).sum()

    _curve(model, centre, spread, sums, ridge)


def fit_scale_rows(model: KneserNey, rows: DataFrame, ridge: float = 1e-3) -> None:
    """As ``fit_scale``, over all rows (r, label): a step is one sum over them, of which five numbers come back."""
    model.scale = None
    known = rows.agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), F.avg("r").alias("centre"), F.stddev_pop("r").alias("spread")).first()
    if not known["n"] or known["least"] == known["most"]:
        return
    centre, spread = known["centre"], known["spread"] + 1e-9

    def sums(w: np.ndarray) -> tuple:
        x = (F.col("r") - centre) / spread
        p = 1 / (1 + F.exp(-F.greatest(F.lit(-40.0), F.least(F.lit(40.0), F.lit(float(w[0])) + F.lit(float(w[1])) * x))))
        each = rows.select(x.alias("x"), (p * (1 - p)).alias("v"), (p - F.col("label")).alias("g"))
        v, g, x = F.col("v"), F.col("g"), F.col("x")
        return tuple(each.agg(F.sum(v), F.sum(v * x), F.sum(v * x * x), F.sum(g), F.sum(g * x)).first())

    _curve(model, centre, spread, sums, ridge)


def _ratio_udf(spark: SparkSession, model: KneserNey):
    held = spark.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    @F.pandas_udf("double")
    def ratio(text: pd.Series) -> pd.Series:
        return pd.Series([held.value.ratio(t, memo) for t in text], dtype=float)

    return ratio


def labelled(docs: DataFrame, marked: DataFrame, told: Column) -> DataFrame:
    """(``told``, label) of all rows of ``docs`` that ``marked`` (_id, label) labels, as often as it does; ``told`` moves, not the text."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("text").cast("string").alias("text")).select("_id", told)
    return rows.join(marked.select("_id", "label"), "_id").drop("_id")


@contextmanager
def _filtered(spark: SparkSession) -> Iterator[None]:
    """The settings of FILTERED for what is computed meanwhile; the session's own come back."""
    own = {f"spark.sql.optimizer.runtime.bloomFilter.{k}": v for k, v in FILTERED.items()}
    before = {k: spark.conf.get(k) for k in own}
    try:
        for k, v in own.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held_out: int = 0, scale_fold: int = 1) -> KneserNey:
    """Fit on all labelled rows (doc_id, toxic) outside fold ``held_out``; fold ``scale_fold`` sets the scale."""
    spark = docs.sparkSession
    marked = labels.select(F.col("doc_id").cast("bigint").alias("_id"), F.col("toxic").cast("int").alias("label")).where("label is not null and _id is not null")
    marked = marked.withColumn("fold", fold_of(F.col("_id"), folds)).where(F.col("fold") != held_out)
    words = different_words(F.col("text")).alias("words")
    with _filtered(spark):
        grams = materialize(gram_counts(labelled(docs, marked.where(F.col("fold") != scale_fold), words)), "grams")
    both = grams.agg(F.max("n_toxic").alias("t"), F.max("n_ordinary").alias("o")).first()
    if not both["t"] or not both["o"]:
        return KneserNey()
    model = fit_counts(grams)
    ratio = _ratio_udf(spark, model)("text").alias("r")
    with _filtered(spark):
        scaled = materialize(labelled(docs, marked.where(F.col("fold") == scale_fold), ratio), "scale")
    fit_scale_rows(model, scaled)
    return model


def score(docs: DataFrame, model: KneserNey, name: str = "score") -> DataFrame:
    """``docs`` with the probability ``name`` of being toxic; a narrow pass."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    memo: dict[str, float] = {}

    @F.pandas_udf("double")
    def toxic(text: pd.Series) -> pd.Series:
        m = held.value
        return pd.Series(m.score(np.array([m.ratio(t, memo) for t in text], dtype=float)))

    return docs.withColumn(name, toxic(F.col("text").cast("string")))
