"""The corpus pipeline: five stages, each over all that the one before kept.

``STAGES`` lists them; each takes (spark, docs, sf_dir) and returns a table that is written as Parquet and read again as
the next stage's docs. All but the last return the columns of ``documents``. Rows keep their columns and values, except
for the text that suffix-array removal shortens and ``n_chars`` with it. Tables without rows pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import jaccard, language, mixing, packing, queries, suffixes
from ledgerloom.session import reliable_checkpoint, work_path

ORACLE_SQL = None  # learned languages, suffix sorting and tokenizer ids are beyond SQL

NEAR_WORDS, NEAR_PERCENT = 5, 80  # of the near-duplicate stage: five-word shingles, similarity 0.8
REMEMBERED = 100_000  # units of text in the packing stage, whose workers still hold memory of the stages before


def _keyed(docs: DataFrame) -> DataFrame:
    """``row`` with all columns and a ``key`` that only rows of equal doc_id and text share; no name of the input can clash.

    The key is a 64-bit hash if no two rows that differ have the same one, which is counted, and a longer one otherwise.
    """
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\u0001null")) for c in ("doc_id", "text")]
    exact, key = F.sha2(F.concat_ws("\u0000", *parts), 256), F.xxhash64(*parts)
    shared = docs.groupBy(key.alias("key")).agg(F.min(exact).alias("low"), F.max(exact).alias("high")).where("low <> high")
    return docs.select(F.struct(*docs.columns).alias("row"), (exact if shared.limit(1).count() else key).alias("key"))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is recognised. Prototypes are learned from the labelled documents of op7's folds.

    Rejected: null texts and texts without letters, op7's ``und``. There is no least cosine: that of a text with only
    unseen trigrams is noise, so a limit would drop such texts by chance.
    ``lang`` stays as it is. Rows with equal doc_id and text have equal decisions. Without labelled documents there are no
    languages to recognise, and all go. Only the keys of rejected documents are moved, as long as they are few.
    """
    queries.bounded_batches(spark)
    prototypes = language.learn_prototypes(docs.where(~language.held_out(3, 1)))
    keyed = _keyed(docs)
    found = language.predict_languages(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), prototypes)
    rejected = found.where(F.col("lang_pred") == language.UNKNOWN).select(F.col("doc_id").alias("key")).distinct()
    return keyed.join(reliable_checkpoint(rejected, "rejected"), "key", "left_anti").select("row.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of linked texts: that with the smallest doc_id, null last, and of those the smallest key.

    Groups are formed by text: rows that share a doc_id but not a text are different documents, and rows without a doc_id
    are compared like all others. Of rows equal in both, one stays, the first by a hash of all its values. Texts
    without words link with nothing and stay. Only keys are moved, as long as the documents that go are few.
    """
    queries.bounded_batches(spark)
    keyed = _keyed(docs)
    joined = jaccard.similarity_join(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text")), words=NEAR_WORDS, percent=NEAR_PERCENT)
    groups = reliable_checkpoint(joined.select(F.col("doc_id").alias("key"), F.col("component_id").alias("group")).distinct(), "groups")
    several = groups.where("key <> group").select("group").distinct()
    linked = groups.join(several, "group").join(keyed.select("key", F.col("row.doc_id").alias("id")), "key")
    first = linked.groupBy("group").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "key")).alias("first")).select(F.col("first.key").alias("key"))
    gone = reliable_checkpoint(linked.select("key").distinct().join(first, "key", "left_anti"), "gone")
    twice = reliable_checkpoint(keyed.groupBy("key").count().where("count > 1").select("key"), "twice")
    left = keyed.join(gone, "key", "left_anti")
    first = F.min_by("row", F.sha2(F.to_json("row"), 256)).alias("row")
    repeated = left.join(twice, "key", "left_semi").groupBy("key").agg(first)
    return left.join(twice, "key", "left_anti").select("row").unionByName(repeated.select("row")).select("row.*")


def remove_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the byte strings of 200 bytes that also start elsewhere; a document that loses all of its text goes.

    ``n_chars`` follows a shortened text. Documents that had no text before stay as they are. Only the texts of documents
    that lose something are moved, as long as their keys are few enough to be sent to the tasks.
    """
    queries.bounded_batches(spark)
    keyed = _keyed(docs)
    cut = suffixes.remove_repeats(keyed.select(F.col("key").alias("doc_id"), F.col("row.text").alias("text"))).where("n_removed > 0")
    changed = reliable_checkpoint(cut.select(F.col("doc_id").alias("key"), F.col("kept_text").alias("left_over")).dropDuplicates(["key"]), "changed")
    keys = reliable_checkpoint(changed.select("key"), "keys")
    shorter = keyed.join(keys, "key", "left_semi").join(changed, "key").where("trim(left_over) <> ''")
    new = {"text": F.col("left_over")}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.char_length("left_over").cast(docs.schema["n_chars"].dataType)
    shorter = shorter.select(*[new.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
    return keyed.join(keys, "key", "left_anti").select("row.*").unionByName(shorter)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, which may be never or twice."""
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences, as op10 gives them."""
    queries.bounded_batches(spark)
    return packing.pack(docs, remembered=REMEMBERED)


STAGES = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("repeats", remove_repeats),
    ("mix", mix_sources),
    ("pack", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``; each one's rows are written to the shared work folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = work_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
