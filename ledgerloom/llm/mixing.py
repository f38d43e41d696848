"""Mixing sources to target weights by Pareto order sampling.

Each source gets a target in words. Within a source, a document is expected ``copies`` times: in proportion to
``size ** 0.25``, so that long documents are favoured a little, and never more than ``max_copies`` times. The whole
part of that number is certain. The fraction is an inclusion probability: documents are ranked by the odds of a
random number over the odds of their probability, and the ranking is cut where the words still missing are reached.

Everything is DataFrame code. No source is ranked in one task: ranks are counted in 4,096 ranges, and only the range
in which the cut falls is put in order.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import reliable_checkpoint

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3.0, 1.0, 2.0)
RANGES = 4096


def word_count(text: Column) -> Column:
    """Number of words of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def uniform(key: Column) -> Column:
    """A repeatable number in (0, 1) for each key: 52 bits of its MD5. A null key counts as the empty text."""
    digits = F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("")).cast("binary")), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / float(2**52)


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """Words wanted of each source, from a table with ``source`` and ``source_size``, one row a source.

    Sources take the weights in turn, in code point order, null last. A target stops at ``max_copies`` times the
    source's size; the excess goes to the others by weight. The level at which that ends is found in one ordered
    pass: sources that stop first have the smallest size for their weight.
    """
    turn = F.pmod(F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1, F.lit(len(weights)))
    cap = F.col("source_size") * float(max_copies)
    by_cap = Window.orderBy("_full_at", F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    onwards = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    levels = (
        sizes.withColumn("_weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn + 1).cast("int")))
        .withColumn("_full_at", cap / F.col("_weight"))
        .withColumn("_budget", F.sum("source_size").over(everything) * share)
        .withColumn(
            "_level",
            (F.col("_budget") - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / F.sum("_weight").over(onwards),
        )
        .withColumn("_level", F.max(F.when(F.col("_level") <= F.col("_full_at"), F.col("_level"))).over(everything))
    )
    target = F.coalesce(F.least(cap, F.col("_level") * F.col("_weight")), cap)
    return levels.select("source", "source_size", target.alias("target"))


def _key(source: Column) -> Column:
    """A text that is never null, for joins."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("null"))


def pareto_mix(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, max_copies: int = 2) -> DataFrame:
    """``doc_id, source, size`` plus ``source_size, target, copies, taken`` for each row of a table that has the first three.

    ``copies`` is how often the mix takes the document, ``taken`` the words that makes. Documents without words are
    never taken. Equal ranks are ordered by doc_id; rows that are equal in all columns may change places, which gives
    the same rows. An empty table gives an empty one; other columns of the input are not read.
    """
    rows = sized.select("doc_id", "source", F.col("size").cast("long").alias("size")).withColumn("_s", _key(F.col("source")))
    tilt = F.sqrt(F.sqrt(F.col("size").cast("double")))
    per_size = rows.groupBy("_s", "source", "size").agg(F.count("*").alias("_n"))
    targets = source_targets(per_size.groupBy("source").agg(F.sum(F.col("size") * F.col("_n")).alias("source_size")), weights, share, max_copies)
    targets = targets.withColumn("_s", _key(F.col("source"))).drop("source")

    # the factor of the tilt: documents that reach max_copies are the largest, so one pass by falling size finds it
    largest_first = Window.partitionBy("_s").orderBy(F.desc("size"))
    before = largest_first.rowsBetween(Window.unboundedPreceding, -1)
    onwards = largest_first.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    words = F.col("size") * F.col("_n")
    factor = (F.col("target") - max_copies * F.coalesce(F.sum(words).over(before), F.lit(0))) / F.sum(words * tilt).over(onwards)
    factors = (
        per_size.where("size > 0")
        .join(targets, "_s")
        .withColumn("_c", factor)
        .where(F.col("_c") * tilt <= max_copies)
        .groupBy("_s")
        .agg(F.max_by("_c", "size").alias("_c"))
    )
    # without a factor every document is taken max_copies times
    per_source = targets.join(factors, "_s", "left")
    expected = F.when(F.col("size") == 0, 0.0).otherwise(F.least(F.lit(float(max_copies)), F.coalesce(F.col("_c") * tilt, F.lit(float(max_copies)))))
    whole = F.floor("_expected").cast("long")
    fraction = F.col("_expected") - F.col("_whole")
    u = uniform(F.col("doc_id"))
    ranked = (
        rows.join(per_source, "_s")
        .withColumn("_expected", expected)
        .withColumn("_whole", whole)
        .withColumn("_rank", F.when(fraction > 0, (u / (1 - u)) / (fraction / (1 - fraction))))
        .withColumn("_range", F.floor(F.col("_rank") / (1 + F.col("_rank")) * RANGES).cast("int"))
        .drop("_c", "_expected")
    )
    ranked = reliable_checkpoint(ranked, "ranked")

    ranges = ranked.groupBy("_s", "_range").agg(
        F.sum("size").alias("_words"), F.sum(F.col("size") * F.col("_whole")).alias("_certain"), F.first("target").alias("target")
    )
    by_range = Window.partitionBy("_s").orderBy("_range")
    cuts = (
        ranges.withColumn("_missing", F.col("target") - F.sum("_certain").over(Window.partitionBy("_s")))
        .where(F.col("_range").isNotNull())
        .withColumn("_start", F.sum("_words").over(by_range) - F.col("_words"))
        .where((F.col("_start") < F.col("_missing")) & (F.col("_start") + F.col("_words") >= F.col("_missing")))
        .select("_s", F.col("_range").alias("_cut"), "_start", "_missing")
    )
    # no cut: none are missing, or more than there are
    missing = ranges.groupBy("_s").agg((F.first("target") - F.sum("_certain")).alias("_left"))
    cut = missing.join(cuts, "_s", "left")
    marked = ranked.join(cut, "_s")
    sure = F.when(F.col("_rank").isNull(), F.lit(False)).when(F.col("_cut").isNull(), F.col("_left") > 0).otherwise(F.col("_range") < F.col("_cut"))
    in_order = Window.partitionBy("_s").orderBy("_rank", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at_cut = (
        marked.where(F.col("_range") == F.col("_cut"))
        .withColumn("_before", F.col("_start") + F.sum("size").over(in_order) - F.col("size"))
        .withColumn("_extra", 2 * F.col("_before") + F.col("size") <= 2 * F.col("_missing"))  # the last one if that comes nearer
    )
    rest = marked.where(~F.coalesce(F.col("_range") == F.col("_cut"), F.lit(False))).withColumn("_extra", sure)
    copies = F.col("_whole") + F.col("_extra").cast("long")
    columns = ["doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")]
    return rest.select(*columns).unionByName(at_cut.select(*columns))


def sized_documents(documents: DataFrame) -> DataFrame:
    """``doc_id, source, size`` of each document, the size in words."""
    return documents.select("doc_id", "source", word_count(F.col("text")).alias("size"))


def mix_documents(documents: DataFrame, **settings) -> DataFrame:
    """The documents of the mix, each as often as it is taken, with the columns of the input.

    Rows are matched by doc_id, source and size, so repeated rows keep their own decisions: rows that agree in these
    have the same number of copies up to the one at the cut.
    """
    named = {"_d": F.col("doc_id"), "_o": F.col("source"), "_z": word_count(F.col("text"))}
    order = Window.partitionBy("_d", "_o", "_z").orderBy(F.md5(F.col("_row.text").cast("binary")))
    rows = documents.select(F.struct(*documents.columns).alias("_row"), *[c.alias(n) for n, c in named.items()]).withColumn("_m", F.row_number().over(order))
    mix = pareto_mix(sized_documents(documents), **settings)
    turn = F.row_number().over(Window.partitionBy("doc_id", "source", "size").orderBy("copies"))
    mix = mix.select(F.col("doc_id").alias("_d"), F.col("source").alias("_o"), F.col("size").alias("_z"), "copies", turn.alias("_m"))
    same = rows["_d"].eqNullSafe(mix["_d"]) & rows["_o"].eqNullSafe(mix["_o"]) & (rows["_z"] == mix["_z"]) & (rows["_m"] == mix["_m"])
    taken = rows.join(mix, same).where("copies > 0").select("_row", "copies")
    return taken.select("_row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select("_row.*")
