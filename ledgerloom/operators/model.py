"""Category and subcategory classifiers in a Spark ML pipeline.

Nine text columns become TF-IDF blocks of word and word-pair counts, each block of unit length; the nine
pattern counts follow as they are. Terms are hashed, so there is no vocabulary to collect on the driver and no
term is left out; terms that share a bucket count as one. One pass fits the inverse document frequencies of all blocks together.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import cached_property

from pyspark.ml import PipelineModel
from pyspark.ml.feature import (
    IDF,
    ElementwiseProduct,
    HashingTF,
    IndexToString,
    Normalizer,
    StringIndexer,
    VectorAssembler,
)
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.staging import bound
from ..session import reliable_checkpoint
from . import forest, reports, rules
from .common import spread

TARGETS = ["category", "subcategory"]


@dataclass
class Settings:
    """Sizes of the model."""

    trees: int = 100
    depth: int = 30
    seed: int = 42
    as_of: str = "1970-01-01 00:00:00"
    # hash table size per text column; the date columns have few distinct terms
    sizes: dict[str, int] = field(
        default_factory=lambda: {
            "vendor": 4096, "vendor_cleaned": 4096, "cleaned_metaphone": 4096, "template_used": 512, "account": 4096,
            "day": 128, "month": 64, "year": 128, "day_name": 64,
        }
    )


@dataclass
class Trained:
    model: PipelineModel
    scored: DataFrame  # the held-out rows, scored whenever they are read
    settings: Settings

    @cached_property
    def predictions(self) -> DataFrame:
        """The scored held-out rows as a table, because reports read them several times; written when first asked for."""
        return reliable_checkpoint(self.scored, "predictions")

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def accuracy(self) -> DataFrame:
        """Accuracy per target on the held-out rows."""
        parts = [
            reports.classification_accuracy(self.predictions, t, f"predicted_{t}").withColumn("target", F.lit(t))
            for t in TARGETS
        ]
        return parts[0].unionByName(parts[1])

    def report(self, target: str = "category") -> DataFrame:
        return reports.classification_report(self.predictions, target, f"predicted_{target}")


def terms(value: Column) -> Column:
    """Words of two or more characters and their neighbouring pairs."""
    words = F.regexp_extract_all(F.lower(value), F.lit(r"(?U)\b\w\w+\b"), F.lit(0))

    def with_pairs(words: Column) -> Column:
        pairs = F.transform(words, lambda word, i: F.concat(word, F.lit(" "), F.get(words, i + 1)))  # NULL at the last word
        return F.concat(words, F.filter(pairs, lambda pair: pair.isNotNull()))

    return bound(words, with_pairs)  # named outright, the words would be searched for again at each word


def with_terms(features: DataFrame) -> DataFrame:
    """Term arrays next to the feature columns."""
    return features.withColumns({f"{name}_terms": terms(F.col(name)) for name in rules.FEATURE_TEXT})


def _hashers(settings: Settings) -> list[HashingTF]:
    return [
        HashingTF(inputCol=f"{name}_terms", outputCol=f"{name}_counts", numFeatures=settings.sizes[name])
        for name in rules.FEATURE_TEXT
    ]


def count_terms(features: DataFrame, settings: Settings) -> DataFrame:
    """The terms counted by hash: the first stages of ``fit_features``."""
    return PipelineModel(_hashers(settings)).transform(features)


def fit_features(features: DataFrame, settings: Settings, counted: DataFrame | None = None) -> PipelineModel:
    """Fitted feature stages. Frequencies are smoothed and raised by one, so a term in every row still counts.
    ``counted`` are the features with their terms counted, where there is a table of them."""
    hashers = _hashers(settings)
    joined = VectorAssembler(inputCols=[f"{n}_counts" for n in rules.FEATURE_TEXT], outputCol="_all")
    counted = count_terms(features, settings) if counted is None else counted
    weights = IDF(inputCol="_all", outputCol="_w").fit(joined.transform(counted).select("_all")).idf.toArray() + 1.0
    stages, at = list(hashers), 0
    for name in rules.FEATURE_TEXT:
        size = settings.sizes[name]
        block = Vectors.dense(weights[at : at + size])
        at += size
        stages.append(ElementwiseProduct(scalingVec=block, inputCol=f"{name}_counts", outputCol=f"{name}_weighted"))
        stages.append(Normalizer(p=2.0, inputCol=f"{name}_weighted", outputCol=f"{name}_unit"))
    units = [f"{name}_unit" for name in rules.FEATURE_TEXT]
    stages.append(VectorAssembler(inputCols=units + text.VENDOR_FLAGS, outputCol="features"))
    return PipelineModel(stages)


def _keep(df: DataFrame) -> list[str]:
    wanted = ["transaction_id", "user_id", *TARGETS, "sample_weight", "is_user_corrected", "amount"]
    return [c for c in wanted if c in df.columns]


def feature_frame(df: DataFrame, settings: Settings) -> DataFrame:
    return with_terms(rules.feature_rows(df, settings.as_of, keep=_keep(df)))


def fit(train: DataFrame, test: DataFrame, settings: Settings | None = None) -> Trained:
    """Fit both targets with sample weights and score ``test``."""
    settings = settings or Settings()
    # a row without a label counts as not yet categorized, as it does everywhere else
    train = train.withColumns({t: F.coalesce(F.col(t), F.lit(rules.UNCATEGORIZED)) for t in TARGETS})
    rows = feature_frame(spread(train), settings)
    # rows enter the samples by a hash of what they are, so that two runs grow the same trees
    draw = F.xxhash64(*[c for c in ("transaction_id", "user_id") if c in rows.columns], *rules.FEATURE_TEXT)
    # frequencies and vectors read the terms, and the forests read the vectors many times, so both are written once
    numbers = [*[f"{n}_counts" for n in rules.FEATURE_TEXT], *text.VENDOR_FLAGS]
    counted = reliable_checkpoint(count_terms(rows, settings).select(*numbers, *TARGETS, "sample_weight", draw.alias("_draw")), "terms")
    prepared = fit_features(rows, settings, counted)
    weighted = PipelineModel(prepared.stages[len(rules.FEATURE_TEXT) :]).transform(counted)
    vectors = reliable_checkpoint(weighted.select("features", *TARGETS, "sample_weight", "_draw"), "vectors")
    indexes = {t: StringIndexer(inputCol=t, outputCol=f"{t}_index", handleInvalid="error").fit(vectors) for t in TARGETS}
    numbered = PipelineModel(list(indexes.values())).transform(vectors)
    size = sum(settings.sizes[n] for n in rules.FEATURE_TEXT) + len(text.VENDOR_FLAGS)
    grown = forest.fit(
        numbered, {f"{t}_index": len(i.labels) for t, i in indexes.items()}, "sample_weight", F.col("_draw"),
        settings.trees, settings.depth, settings.seed, size,
    )
    stages = [prepared, grown]
    for target, index in indexes.items():
        stages.append(IndexToString(inputCol=f"{target}_prediction", outputCol=f"predicted_{target}", labels=index.labels))
    fitted = PipelineModel(stages)
    return Trained(fitted, _predict(fitted, spread(test), settings), settings)


def _predict(fitted: PipelineModel, df: DataFrame, settings: Settings) -> DataFrame:
    scored = fitted.transform(feature_frame(df, settings))
    return scored.select(
        *_keep(df),
        *[f"predicted_{t}" for t in TARGETS],
        F.array_max("category_probability").alias("confidence"),
    )


def score(fitted: PipelineModel, df: DataFrame, model_version: str, settings: Settings | None = None) -> DataFrame:
    """Append category, subcategory, confidence, source and model_version to each row; no row is moved. Rows
    that fail the scoring gate get the default prediction; confidence is the highest class probability."""
    settings = settings or Settings()
    answered = ("category", "subcategory", "confidence", "source", "model_version")
    kept = [c for c in df.columns if c not in answered]
    packed = df.withColumns({"_row": F.struct(*kept), "_ok": rules.is_scorable(df)})
    scored = fitted.transform(with_terms(rules.feature_rows(packed, settings.as_of, keep=["_row", "_ok"])))
    answers = {
        "category": F.col("predicted_category"),
        "subcategory": F.col("predicted_subcategory"),
        "confidence": F.array_max("category_probability"),
        "model_version": F.lit(model_version),
        "source": F.lit("model"),
    }
    out = scored.select("_row.*", *[F.when(F.col("_ok"), c).alias(n) for n, c in answers.items()])
    return rules.fill_default_prediction(out)


def score_distinct(fitted: PipelineModel, df: DataFrame, model_version: str, settings: Settings | None = None) -> DataFrame:
    """Score one row per (vendor, amount, template) and copy the result to the others. Rows of one key may
    differ in date and account, which are features too; use ``score`` when that matters."""
    answered = ["category", "subcategory", "confidence", "source", "model_version"]
    description = F.col("description") if "description" in df.columns else F.lit(None).cast("string")
    keyed = df.drop(*answered).withColumn(
        "_key", text.score_key(F.col("vendor"), description, F.col("amount"), F.col("template_used"))
    )
    rest = [c for c in keyed.columns if c != "_key"]
    first = spread(keyed, "_key").groupBy("_key").agg(F.min_by(F.struct(*rest), F.col("transaction_id")).alias("r")).select("_key", "r.*")
    answers = score(fitted, first, model_version, settings).select("_key", *answered)
    return keyed.join(answers, "_key", "left").drop("_key")
