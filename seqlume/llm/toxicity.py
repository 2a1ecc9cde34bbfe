"""Toxicity scores from boosted trees over a few dense features, with isotonic calibration.

Features are column expressions over the whole text: densities of a lexicon (fixed words and words learned from the
training rows), how often such a word stands within a few words of a second person, obfuscated spellings, capitals,
punctuation and stretched letters. Trees are fitted on one part of the labelled sample and an isotonic curve maps
their scores to probabilities on the other; a thousandth of the raw score breaks ties of the curve's steps.

Fitting uses at most `max_rows` labelled rows, chosen by hash of their id; everything else covers all rows.

Edge cases: a null text is an empty one and gets a score; very long texts are measured whole; equal texts get equal
scores, and repeated rows stay; of learned words that are equally frequent the first in the alphabet is taken; null
labels are not used; repeated labels count as toxic if one of them is; without rows of both classes every score is the share of toxic rows (0 without any); an empty
table gives an empty result; only the named columns are read.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Insults.
LEXICON = (
    "idiot idiots stupid moron morons loser losers trash scum pathetic worthless disgusting clown clowns dumb dumbass "
    "jerk fool fools ugly garbage filthy vermin coward imbecile cretin bastard bitch whore slut fuck fucking shit "
    "crap asshole retard retarded kill die hate"
).split()
#: Second persons of English, French, German and Spanish.
SECOND_PERSON = "you your yours you're youre yourself u tu te toi vous votre du dich dir dein ihr tú usted ustedes".split()

FEATURES = ["lexicon", "lexicon_log", "learned", "learned_log", "near_you", "obfuscated", "capitals", "caps_words", "exclaims", "questions", "marks", "stretched"]


def _any(words) -> str:
    return "|".join(sorted({w.replace("\\", "") for w in words}, key=lambda w: (-len(w), w)))


def features(docs: DataFrame, learned: list[str]) -> DataFrame:
    """Rows (all columns of docs, features). docs has a column text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    count = lambda c, pattern: F.regexp_count(c, F.lit(pattern)).cast("double")
    low = F.col("_low")
    start, end = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
    lexicon = f"{start}(?:{_any(LEXICON)}){end}"
    both = f"(?:{_any([*LEXICON, *learned])})"
    second = f"(?:{_any(SECOND_PERSON)})"
    gap = r"(?:[^\p{L}\p{N}]+[\p{L}\p{N}']+){0,3}?[^\p{L}\p{N}]+"
    near = f"{start}(?:{second}{gap}{both}|{both}{gap}{second}){end}"
    plain = F.translate(F.regexp_replace(low, r"(?<=\p{L})[*._-](?=\p{L})", ""), "013457@$!", "oieastasi")
    share = lambda c, n: c / F.greatest(n, F.lit(1.0))
    words, chars = F.col("_words"), F.col("_chars")
    base = docs.withColumns({"_low": F.lower(text), "_chars": F.char_length(text).cast("double")})
    base = base.withColumns(
        {
            "_words": count(low, r"[^\x20\x09-\x0D]+"),
            "_lexicon": count(low, lexicon),
            "_learned": count(low, f"{start}(?:{_any(learned)}){end}") if learned else F.lit(0.0),
            "_spelled": count(plain, lexicon),
        }
    )
    made: dict[str, Column] = {
        "lexicon": share(F.col("_lexicon"), words),
        "lexicon_log": F.log1p("_lexicon"),
        "learned": share(F.col("_learned"), words),
        "learned_log": F.log1p("_learned"),
        "near_you": F.when(F.col("_lexicon") + F.col("_learned") > 0, share(count(low, near), words)).otherwise(F.lit(0.0)),
        "obfuscated": share(F.greatest(F.col("_spelled") - F.col("_lexicon"), F.lit(0.0)), words),
        "capitals": share(count(text, r"\p{Lu}"), chars),
        "caps_words": share(count(text, r"(?<!\p{L})\p{Lu}{2,}(?!\p{L})"), words),
        "exclaims": share(count(text, "!"), words),
        "questions": share(count(text, r"\?"), words),
        "marks": share(count(text, r"[\p{Punct}]"), chars),
        "stretched": share(count(low, r"(\p{L})\1\1"), words),
    }
    return base.withColumns(made).drop("_low", "_chars", "_words", "_lexicon", "_learned", "_spelled")


def learn_words(train: DataFrame, most: int = 40, least_rows: int = 5, odds: float = 2.5) -> list[str]:
    """Words of plain letters that stand in toxic rows with smoothed log odds of `odds` or more; at most `most`."""
    words = F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit(r"(?<![\p{L}\p{N}])(\p{L}{3,20})(?![\p{L}\p{N}])"), 1))
    total = train.agg(F.sum("toxic").alias("t"), F.count("*").alias("n")).first()
    toxic, clean = float(total["t"] or 0), float(total["n"] - (total["t"] or 0))
    if not toxic or not clean:
        return []
    each = train.select("toxic", F.explode(words).alias("w")).groupBy("w").agg(F.sum("toxic").alias("t"), F.count("*").alias("n"))
    ratio = F.log(((F.col("t") + 0.5) / (toxic + 1)) / ((F.col("n") - F.col("t") + 0.5) / (clean + 1)))
    best = each.where(F.col("t") >= least_rows).withColumn("odds", ratio).where(F.col("odds") >= odds)
    return [r["w"] for r in best.orderBy(F.desc("t"), "w").limit(most).collect()]


@dataclass
class Model:
    prior: float
    learned: list[str]
    trees: GBTClassificationModel | None = None
    curve: IsotonicRegressionModel | None = None

    def score(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
        """Rows (doc_id, score) for every row of docs."""
        rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
        if self.trees is None:
            return rows.select("doc_id", F.lit(self.prior).alias("score"))
        got = _raw(features(rows, self.learned).drop("text"), self.trees)
        got = self.curve.transform(got)
        mixed = F.lit(0.999) * F.least(F.greatest(F.col("calibrated"), F.lit(0.0)), F.lit(1.0)) + F.lit(0.001) * F.col("raw")
        return got.select("doc_id", mixed.alias("score"))


def _raw(rows: DataFrame, trees: GBTClassificationModel) -> DataFrame:
    keep = [c for c in rows.columns if c not in FEATURES]
    got = trees.transform(VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows))
    return got.select(*keep, vector_to_array("probability")[1].alias("raw"))


def fit(docs: DataFrame, labels: DataFrame, max_rows: int = 12_000, trees: int = 20, depth: int = 3, seed: int = 7) -> Model:
    """labels: (doc_id, toxic); rows to learn from. Uses at most max_rows labelled rows, by hash of the id."""
    wanted = labels.where("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    docs = docs.select("doc_id", "text")
    sample = common.staged(docs.join(F.broadcast(wanted), "doc_id").repartition(8, "doc_id").sortWithinPartitions("doc_id", "text"), "toxicity-sample")
    share = sample.agg(F.avg("toxic").alias("p")).first()["p"]
    fitting = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(4)) != 0
    if share is None or share in (0.0, 1.0):
        return Model(float(share or 0.0), [])
    learned = learn_words(sample.where(fitting))
    rows = common.staged(features(sample, learned).drop("text").withColumn("fitting", fitting), "toxicity-features")
    seen = {r["fitting"]: r for r in rows.groupBy("fitting").agg(F.min("toxic").alias("a"), F.max("toxic").alias("b")).collect()}
    if any(k not in seen or seen[k]["a"] == seen[k]["b"] for k in (True, False)):
        rows = rows.withColumn("fitting", F.lit(True)).unionByName(rows.withColumn("fitting", F.lit(False)))  # too few rows to hold any back
    vectors = VectorAssembler(inputCols=FEATURES, outputCol="x").transform(rows.where("fitting")).select("x", F.col("toxic").cast("double").alias("label"))
    booster = GBTClassifier(featuresCol="x", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed, maxMemoryInMB=64)
    model = booster.fit(vectors.coalesce(2))
    held = _raw(rows.where("not fitting").select("toxic", *FEATURES), model).select("raw", F.col("toxic").cast("double").alias("label"))
    curve = IsotonicRegression(featuresCol="raw", labelCol="label", predictionCol="calibrated").fit(held.coalesce(1))
    return Model(float(share), learned, model, curve)
