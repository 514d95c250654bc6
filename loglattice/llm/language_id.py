"""Language identification in two steps: the family first, then the language within it.

Families are groups of languages.  A linear model picks the family; inside it one linear support
vector machine per pair of languages votes, and the most votes win, then the larger margins.
Features are hashed character n-grams of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loglattice.llm import common as c
from loglattice.llm.registry import query

BUCKETS = 1 << 13
PART = 1 << 20  # code points of a text looked at together
SAMPLE_EACH = 400  # labelled texts per language that the models are fitted on: the smallest hashes
EPOCHS, PENALTY = 30, 1e-4
UNKNOWN = "und"
# fixed values: related languages by their usual codes; a language not listed is its own family
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "is"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca"),
    "slavic": ("ru", "uk", "be", "pl", "cs", "sk", "bg", "sr", "hr", "sl"),
}
LETTER = regex.compile(r"\p{L}")
NOT_LETTERS = regex.compile(r"[^\p{L}]+")


def family_of(lang: str) -> str:
    return next((name for name, members in FAMILIES.items() if lang in members), lang)


def features(text: str) -> np.ndarray:
    """Relative weight of each hashed run of one to four code points of the lower-cased letters,
    square-rooted and of unit length.  A long text is taken in parts that share three code points,
    so each run is counted once, wherever the parts end."""
    counts = np.zeros(BUCKETS)
    letters = f" {NOT_LETTERS.sub(' ', text.lower())} "
    for at in range(0, len(letters), PART):
        own = min(PART, len(letters) - at)  # runs are counted in the part they start in
        points = np.frombuffer(letters[at : at + PART + 3].encode("utf-32-le", "surrogatepass"), np.uint32)
        h = np.zeros(len(points), np.uint32)
        for n in range(1, 5):
            if len(points) < n:
                break
            h = h[: len(points) - n + 1] * np.uint32(0x01000193) + points[n - 1 :] * np.uint32(0x9E3779B1) + np.uint32(n)
            mixed = h[:own] ^ (h[:own] >> np.uint32(15))
            mixed = mixed * np.uint32(0x85EBCA6B)
            counts += np.bincount(mixed >> np.uint32(32 - 13), minlength=BUCKETS)
    counts = np.sqrt(counts)
    length = np.sqrt(counts @ counts)
    return (counts / length if length else counts).astype(np.float32)


def linear_svm(x: np.ndarray, positive: np.ndarray) -> np.ndarray:
    """Weights (the last is the bias) of a hinge-loss machine, by stochastic sub-gradients in a
    fixed order, averaged over the second half; both classes weigh the same."""
    rng = np.random.default_rng(7)
    rows = np.hstack([x, np.ones((len(x), 1), np.float32)]).astype(np.float64)
    sign = np.where(positive, 1.0, -1.0)
    share = np.where(positive, 0.5 / max(1, positive.sum()), 0.5 / max(1, (~positive).sum())) * len(x)
    w, kept, t = np.zeros(rows.shape[1]), np.zeros(rows.shape[1]), 0
    for epoch in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            t += 1
            rate = 1 / (PENALTY * (t + 1000))
            inside = sign[i] * (rows[i] @ w) < 1
            w *= 1 - rate * PENALTY
            if inside:
                w += min(rate, 1.0) * share[i] * sign[i] * rows[i]
        if epoch >= EPOCHS // 2:
            kept += w
    return kept / (EPOCHS - EPOCHS // 2)


@dataclass
class Model:
    families: list[str]
    family_weights: np.ndarray  # one row per family
    languages: dict[str, list[str]]
    weights: dict[str, np.ndarray]  # per family, one row per pair of languages, the first against the second

    @staticmethod
    def pick(names: list[str], weights: np.ndarray, x: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        margins = weights @ x
        best = int(np.argmax(margins))  # the first of equals
        odds = np.exp(2 * np.clip(margins - margins[best], -50, 0))
        return names[best], float(odds[best] / odds.sum())

    @staticmethod
    def vote(names: list[str], weights: np.ndarray, x: np.ndarray) -> tuple[str, float]:
        if len(names) == 1:
            return names[0], 1.0
        first, second = np.triu_indices(len(names), 1)
        margins = weights @ x
        votes = np.bincount(np.where(margins >= 0, first, second), minlength=len(names))
        sums = np.bincount(first, margins, len(names)) - np.bincount(second, margins, len(names))
        best = int(np.lexsort((np.arange(len(names)), -sums, -votes))[0])
        odds = np.exp(2 * np.clip((sums - sums.max()) / (len(names) - 1), -50, 0))
        return names[best], float(odds[best] / odds.sum())

    def predict(self, text: str | None) -> tuple[str, float]:
        """Language and a score in [0, 1]; ``und`` and 0 if there is no letter (or no model)."""
        if not text or not self.families or not LETTER.search(text):
            return UNKNOWN, 0.0
        x = np.append(features(text).astype(np.float64), 1.0)
        family, first = self.pick(self.families, self.family_weights, x)
        lang, second = self.vote(self.languages[family], self.weights[family], x)
        return lang, first * second


def fit(found: list[tuple[str, np.ndarray]]) -> Model:
    """Fit from a bounded list of labels and the features of their texts."""
    x = np.array([v for _, v in found]) if found else np.zeros((0, BUCKETS), np.float32)
    lang = np.array([name for name, _ in found], object)
    family = np.array([family_of(v) for v in lang], object)
    families = sorted(set(family))
    members = {f: sorted(set(lang[family == f])) for f in families}

    def machines(x: np.ndarray, own: np.ndarray, names: list[str]) -> np.ndarray:
        if len(names) < 2:
            return np.zeros((len(names), BUCKETS + 1))
        return np.array([linear_svm(x, own == name) for name in names])

    def pairs(names: list[str]) -> np.ndarray:
        own = []
        for i, j in zip(*np.triu_indices(len(names), 1)):
            both = (lang == names[i]) | (lang == names[j])
            own.append(linear_svm(x[both], lang[both] == names[i]))
        return np.array(own).reshape(-1, BUCKETS + 1)

    return Model(families, machines(x, family, families), members, {f: pairs(members[f]) for f in families})


def sample(labelled: DataFrame) -> list[tuple[str, np.ndarray]]:
    """Language and features of ``SAMPLE_EACH`` different texts of every language, those whose hash
    is smallest: bounded, and the same however the rows lie.  Copies count as one text.

    One pass picks the hashes of all languages (each task hands on at most ``SAMPLE_EACH`` a
    language), another reads the texts that have them and turns each into its features, so no
    text travels to the driver."""
    has_letters = F.col("text").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")
    found = labelled.where(has_letters).select("lang", F.xxhash64("text").alias("_h"), "text")
    nearest = Window.partitionBy("lang").orderBy("_h")
    ranked = found.select("lang", "_h").distinct().withColumn("_r", F.row_number().over(nearest))
    picked = c.stored(ranked.where(F.col("_r") <= SAMPLE_EACH).drop("_r"), "picked")

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, h, text in zip(*batch.columns):
                x = c.squeezed([features(text.as_py())])
                yield pa.RecordBatch.from_arrays([pa.array([lang.as_py()]), pa.array([h.as_py()]), pa.array([x])], ["lang", "h", "x"])

    texts = found.join(F.broadcast(picked), ["lang", "_h"]).groupBy("lang", "_h").agg(F.min("text").alias("text"))
    rows = texts.mapInArrow(weigh, "lang string, h long, x binary").collect()  # SAMPLE_EACH a language
    return [(r["lang"], c.unsqueezed(r["x"])[0]) for r in sorted(rows, key=lambda r: (r["lang"], r["h"]))]


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` (own columns of these names are dropped).

    Null, empty and letterless texts give ``und`` with score 0; equal margins go to the first
    language by name; every row is judged by its whole text alone, so repeated rows get the same
    answer.  An empty table gives an empty one.
    """
    base = docs.drop("lang_pred", "score")
    schema = T.StructType([*base.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    shared = c.whole(docs.sparkSession, model)  # bounded: languages x BUCKETS numbers

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = c.arrived(shared)
        for batch in batches:
            found = [own.predict(t.as_py()) for t in batch.column(batch.schema.get_field_index("text"))]
            extra = [pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], [*batch.schema.names, "lang_pred", "score"])

    return base.mapInArrow(judge, schema)


def trained(labelled: DataFrame) -> Model:
    return fit(sample(labelled))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = c.table(spark, folder, "documents").select("doc_id", "text", "lang")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = trained(docs.where(~held))
    found = identified(docs.select("doc_id", "text", held.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
