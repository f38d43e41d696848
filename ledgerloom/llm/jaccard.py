"""Similarity join on word n-grams: documents whose sets of n-grams have a Jaccard similarity of a threshold or more.

Which pairs may reach the threshold is decided by prefixes: with all n-grams in one order, two such documents share
``SHARED`` entries (all of them, if they are shorter) among the first ``n - ceil(threshold * n) + SHARED`` of each. The order
is by frequency, rare ones first, so that frequent passages and license lines fall out of the prefixes; it only decides how
much work is done, not what is found. Documents that share too few entries with others of their size are linked with none.
Documents that share a prefix entry and have sizes near enough form a family; equal families are one. The documents of a
family become blocks, rows of incidence matrices, whose products, added up over column blocks, are the overlaps of all
pairs; pairs below the bound that follows from the two sizes are discarded.

Documents with equal sets are one class, of which one member is compared. Each document is first compared in the largest of
its families. Only families that are not in one component then are compared whole. Families over ``BLOCK`` documents are
compared in three steps, so that a large group of copies costs in proportion to its size: inside blocks, then one
document of each component so found, then, where a family still is in several parts, all pairs of blocks from different parts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.components import components, whole_groups
from ledgerloom.llm.lookup import with_list
from ledgerloom.session import reliable_checkpoint

WORDS = 4
PERCENT = 85
BLOCK = 1024  # documents of an incidence matrix
COLUMNS = 2048  # columns of it that are multiplied at a time
SHARED = 8  # prefix entries that two linked documents share at least, if they are that long
FREQUENT = 1 << 21  # frequent n-grams whose order is known; the others count as equally rare
TOGETHER = 1 << 20  # characters of texts that are hashed together; a longer text is hashed alone
HELD = 1 << 22  # n-grams of a task that are counted together

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_BYTE = np.random.Generator(np.random.PCG64(11)).integers(1, 1 << 63, 256, dtype=np.uint64)
_ODD, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


def word_hashes(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A to Z lower-cased, and the number of words of each text."""
    parts = [(t or "").encode("utf-8", "surrogatepass").lower() for t in texts]  # of bytes: A to Z only
    data = np.frombuffer(b" ".join([*parts, b""]), dtype=np.uint8)
    inside = ~_SPACE[data]
    begins = np.flatnonzero(inside & ~np.concatenate((np.zeros(1, bool), inside[:-1])))
    if not len(begins):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = np.flatnonzero(inside & ~np.concatenate((inside[1:], np.zeros(1, bool)))) + 1 - begins
    letters = np.flatnonzero(inside)
    place = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    powers = np.cumprod(np.full(int(sizes.max()), _ODD, dtype=np.uint64))
    hashes = _mixed(np.add.reduceat(_BYTE[data[letters]] * powers[place], np.cumsum(sizes) - sizes))
    ends = np.cumsum([len(p) + 1 for p in parts])
    return hashes, np.diff(np.searchsorted(begins, np.append(0, ends)))


def shingle_sets(texts: list[str | None], words: int = WORDS) -> list[np.ndarray]:
    """The ascending distinct hashes of each text's word n-grams; a shorter text is one n-gram, one without words has none.

    Hashing takes some thirty times the memory of the texts, so few are hashed together.
    """
    out, held, size = [], [], 0
    for text in texts:
        held.append(text)
        size += len(text or "")
        if size >= TOGETHER:
            out += _sets_of(held, words)
            held, size = [], 0
    return out + _sets_of(held, words)


def _sets_of(texts: list[str | None], words: int) -> list[np.ndarray]:
    hashes, counts = word_hashes(texts)
    grams = hashes.copy()
    for i in range(1, words):
        grams[: len(grams) - i] = _mixed(grams[: len(grams) - i] * _ODD + hashes[i:])
    out, at = [], 0
    for n in counts.tolist():
        if n >= words:
            out.append(np.unique(grams[at : at + n - words + 1]))
        elif n:
            whole = np.uint64(n)
            for h in hashes[at : at + n]:
                whole = _mixed(np.array([whole]) * _ODD + h)[0]
            out.append(np.array([whole], dtype=np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        at += n
    return out


def _frequent_of_task(words: int):
    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, size = [], 0

        def flush():
            values, times = np.unique(np.concatenate(held), return_counts=True)
            often = times >= 2
            return pd.DataFrame({"gram": values[often].view(np.int64), "times": times[often]})

        for frame in frames:
            sets = shingle_sets(list(frame["text"]), words)
            held += sets
            size += sum(map(len, sets))
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()

    return count


def frequent_grams(documents: DataFrame, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent n-grams of the corpus, ascending, and the logarithm of how often each was counted: FREQUENT at
    most, which are collected and sent to the tasks."""
    counted = documents.select("text").mapInPandas(_frequent_of_task(words), "gram bigint, times bigint").groupBy("gram").agg(F.sum("times").alias("times"))
    top = counted.where("times >= 2").orderBy(F.desc("times"), "gram").limit(FREQUENT).toArrow()
    grams = top["gram"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(grams)
    return grams[order], np.log2(top["times"].to_numpy().astype(np.float64)[order] + 1).astype(np.uint8)


def _prefix_length(n: int, percent: int) -> int:
    """So many of the first entries that a linked document shares SHARED of them, or all that the smaller needs to have in common."""
    needed = -(-percent * n // 100)
    return n - needed + min(SHARED, needed)


def _least_shared(percent: int):
    """Entries that a document of ``n`` shares with any linked one at least: as _prefix_length has it for the smallest possible partner."""
    smallest = F.ceil(F.col("n") * percent / 100)
    return F.least(F.lit(SHARED), F.ceil(smallest * percent / 100))


def signatures(documents: DataFrame, frequent: tuple[np.ndarray, np.ndarray], words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """``doc_id, n, high, low, prefix``: set size, 128 bits that identify the set, prefix entries."""
    sent = documents.sparkSession.sparkContext.broadcast(frequent)

    def sign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        grams, level = sent.value
        for frame in frames:
            sets = shingle_sets(list(frame["text"]), words)
            high, low, prefix = [], [], []
            for s in sets:
                a, b = np.frombuffer(hashlib.blake2b(s.tobytes(), digest_size=16).digest(), dtype=np.int64)
                high.append(int(a))
                low.append(int(b))
                n = _prefix_length(len(s), percent)
                if len(grams) and n < len(s):
                    at = np.minimum(np.searchsorted(grams, s), len(grams) - 1)
                    rank = np.where(grams[at] == s, level[at], 0)
                    s = s[np.argsort(rank, kind="stable")]
                prefix.append(s[:n].view(np.int64))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "n": [len(s) for s in sets], "high": high, "low": low, "prefix": prefix})

    kind = documents.schema["doc_id"].dataType.simpleString()
    rows = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text")  # pandas has no whole numbers with nulls
    signed = rows.mapInPandas(sign, "doc_id string, n int, high bigint, low bigint, prefix array<bigint>")
    return signed.withColumn("doc_id", F.col("doc_id").cast(kind))


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of all pairs: products of incidence matrices, added up over blocks of columns."""
    m = len(sets)
    total = np.zeros((m, m), dtype=np.float32)
    values, row = np.concatenate(sets), np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(values)
    values, row = values[order], row[order]
    new = np.concatenate((np.ones(1, bool), values[1:] != values[:-1])) if len(values) else np.zeros(0, bool)
    column = np.cumsum(new) - 1
    shared = np.bincount(column, minlength=1)[column] > 1 if len(values) else new
    row, column = row[shared], column[shared]
    if not len(row):
        return total
    column = np.cumsum(np.concatenate((np.zeros(1, np.int64), np.diff(column) != 0)))
    cuts = np.searchsorted(column, np.arange(0, column[-1] + 1 + COLUMNS, COLUMNS))
    for low, high in zip(cuts[:-1], cuts[1:]):
        if high > low:
            part = np.zeros((m, min(COLUMNS, int(column[high - 1] - column[low] + 1))), dtype=np.float32)
            part[row[low:high], column[low:high] - column[low]] = 1
            total += part @ part.T
    return total


def links(sets: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Which pairs reach the threshold. Pairs whose overlap is below the bound of their sizes drop out."""
    size = np.array([len(s) for s in sets], dtype=np.int64)
    both = overlaps(sets).astype(np.int64)
    linked = (100 + percent) * both >= percent * (size[:, None] + size[None, :])
    return linked & (both > 0)


def _roots(linked: np.ndarray) -> np.ndarray:
    """The first member of each row's component."""
    label = np.arange(len(linked))
    linked = linked | np.eye(len(linked), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], len(label)).min(axis=1)
        new = np.minimum(new, new[new])
        if (new == label).all():
            return label
        label = new


def _links_of_blocks(percent: int):
    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        family, a, b = [], [], []
        for group in whole_groups(frames, "g1", "g2", "g3"):
            if len(group) < 2:
                continue
            ids = group["doc_id"].to_numpy()
            root = _roots(links([np.frombuffer(s, dtype=np.uint64) for s in group["grams"]], percent))
            own = np.flatnonzero(ids[root] != ids)
            family += group["g1"].to_numpy()[own].tolist()
            a += ids[own].tolist()
            b += ids[root[own]].tolist()
            if len(a) > 100_000:
                yield pd.DataFrame({"family": family, "a": a, "b": b})
                family, a, b = [], [], []
        if a:
            yield pd.DataFrame({"family": family, "a": a, "b": b})

    return compare


def _compared(blocks: DataFrame, documents: DataFrame, words: int, percent: int) -> DataFrame:
    """Edges ``family, a, b`` inside the groups ``g1, g2, g3`` of ``blocks`` (with doc_id): each document and the first of its
    component in the group; the family is ``g1``.

    Sets are made anew from the texts of the wanted documents, and dealt to the groups in one shuffle.
    """
    keys = ["g1", "g2", "g3"]
    kind = documents.schema["doc_id"].dataType.simpleString()

    def gather(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            sets = shingle_sets(list(frame["text"]), words)
            yield frame[["doc_id", *keys]].assign(grams=[s.tobytes() for s in sets])

    blocks = reliable_checkpoint(blocks.select("doc_id", *keys).distinct(), "blocks")
    texts = with_list(documents.select("doc_id", "text"), blocks)
    dealt = texts.mapInPandas(gather, f"doc_id {kind}, g1 bigint, g2 bigint, g3 bigint, grams binary")
    dealt = dealt.repartition(*keys).sortWithinPartitions(*keys)
    return reliable_checkpoint(dealt.mapInPandas(_links_of_blocks(percent), f"family bigint, a {kind}, b {kind}"), "links")


def _size_class(percent: int):
    """Classes of set sizes: linked documents are in the same or in neighbouring ones. A little wider than the threshold, for rounding."""
    return F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(100 / percent) * (1 + 1e-6)))).cast("int")


def _hung(rows: DataFrame, edges: DataFrame, column: str) -> DataFrame:
    """``rows`` with ``label``: the document of the same family under which ``edges`` hang that of ``column``, or itself."""
    roots = edges.groupBy("family", F.col("a").alias(column)).agg(F.min("b").alias("_root"))
    kept = [c for c in rows.columns if c != "label"]
    return rows.join(roots, ["family", column], "left").select(*kept, F.coalesce("_root", column).alias("label"))


def _family_links(narrow: DataFrame, documents: DataFrame, words: int, percent: int, block: int) -> DataFrame:
    """Edges between documents of a family (``doc_id, family, n``) that lead to the same components as all links."""

    def salt(count: str):
        return F.pmod(F.xxhash64("doc_id", "n"), F.ceil(F.col(count) / block).cast("bigint"))

    sizes = narrow.groupBy("family").agg(F.count("*").alias("_size"))
    sized = reliable_checkpoint(narrow.join(sizes.where("_size > 1"), "family"), "sized")
    first = _compared(sized.select("doc_id", F.col("family").alias("g1"), salt("_size").alias("g2"), F.lit(0).cast("bigint").alias("g3")), documents, words, percent)
    large = sized.where(F.col("_size") > block).drop("_size")
    if large.limit(1).count() == 0:
        return first.select("a", "b")
    # one document of each component of a block: what the others hang under is known, so no components have to be found
    hung = reliable_checkpoint(_hung(large, first, "doc_id"), "hung")
    heads = hung.where(F.col("label") == F.col("doc_id")).drop("label")
    counts = heads.groupBy("family").agg(F.count("*").alias("_size"))
    second = _compared(heads.join(counts, "family").select("doc_id", F.col("family").alias("g1"), salt("_size").alias("g2"), F.lit(1).cast("bigint").alias("g3")), documents, words, percent)
    edges = first.unionByName(second).select("a", "b")
    # families that are still in several parts: blocks of equal size class of large parts, and of all the small ones together
    labelled = reliable_checkpoint(_hung(hung, second, "label"), "labelled")
    parts = labelled.groupBy("family", "label").agg(F.count("*").alias("_part"))
    open_families = parts.groupBy("family").count().where("count > 1").select("family")
    if open_families.limit(1).count() == 0:
        return edges
    parted = labelled.join(open_families, "family", "left_semi").join(parts, ["family", "label"])
    # "of": the large part, or nothing for small parts
    part = F.when(F.col("_part") > block, F.col("label").cast("string")).otherwise("")
    classed = parted.withColumn("_of", part).withColumn("_class", _size_class(percent))
    keys = ["family", "_of", "_class"]
    per_block = classed.groupBy(*keys).agg(F.ceil(F.count("*") / block).cast("int").alias("_blocks"))
    classed = classed.join(per_block, keys).withColumn("_salt", F.pmod(F.xxhash64("doc_id", "n"), F.col("_blocks").cast("bigint")))
    blocks = per_block.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_blocks").cast("bigint") - 1)))
    blocks = reliable_checkpoint(blocks.select(*keys, "_salt", F.xxhash64(*keys, "_salt").alias("_name")), "block_names")
    other = blocks.select("family", F.col("_of").alias("_o"), F.col("_class").alias("_k"), F.col("_name").alias("_m"))
    # each block takes part in its pairs, which both of their blocks name alike; equal and next size classes only, and
    # not two blocks of one large part
    near = (F.abs(F.col("_class") - F.col("_k")) <= 1) & ((F.col("_of") == "") | (F.col("_of") != F.col("_o")))
    pairs = blocks.join(other, "family").where(near).select(*keys, "_salt", F.least("_name", "_m").alias("g2"), F.greatest("_name", "_m").alias("g3"))
    dealt = classed.join(pairs.distinct(), [*keys, "_salt"]).select("doc_id", F.col("family").alias("g1"), "g2", "g3")
    return edges.unionByName(_compared(dealt, documents, words, percent).select("a", "b"))


def _families(heads: DataFrame, percent: int) -> DataFrame:
    """``family, size, doc_id, n``: sets of documents that share a prefix entry and are of neighbouring size classes.

    Families are named by a hash of their members, so that entries with the same documents make one family. Two documents
    whose sizes rule a link out are none.
    """
    entries = heads.select("doc_id", "n", F.explode("prefix").alias("gram"))
    lists = entries.groupBy("gram").agg(F.min("doc_id").alias("_least"), F.max("doc_id").alias("_most")).where("_least < _most").select("gram")
    shared = entries.join(lists, "gram").distinct()
    classed = shared.withColumn("_class", _size_class(percent)).withColumn("_band", F.explode(F.array(F.col("_class"), F.col("_class") - 1)))
    classed = reliable_checkpoint(classed.drop("_class"), "shared")
    # documents that share too few entries with others of their size are linked with none
    met = classed.join(classed.groupBy("gram", "_band").count().where("count > 1").select("gram", "_band"), ["gram", "_band"])
    enough = met.groupBy("doc_id", "n").agg(F.count_distinct("gram").alias("_met")).where(F.col("_met") >= _least_shared(percent)).select("doc_id", "n")
    classed = reliable_checkpoint(met.join(enough, ["doc_id", "n"]), "met")
    named = classed.groupBy("gram", "_band").agg(
        F.bit_xor(F.xxhash64("doc_id", "n")).alias("family"), F.count("*").alias("size"), F.min("n").alias("_small"), F.max("n").alias("_big")
    )
    named = named.where(f"size > 2 OR size = 2 AND 100 * _small >= {percent} * _big").select("gram", "_band", "family", "size")
    return reliable_checkpoint(classed.join(named, ["gram", "_band"]).select("family", "size", "doc_id", "n").distinct(), "families")


def similarity_join(documents: DataFrame, words: int = WORDS, percent: int = PERCENT, block: int = BLOCK) -> DataFrame:
    """``doc_id, n_shingles, component_id`` for each row of ``documents`` (doc_id, text).

    Null, empty and blank texts have no n-grams and are linked with nothing. Rows without doc_id get their n_shingles, no
    component_id, and link nothing. Rows that share a doc_id count as one document with several texts.
    """
    signed = reliable_checkpoint(signatures(documents, frequent_grams(documents, words), words, percent), "signatures")
    used = signed.where("doc_id IS NOT NULL AND n > 0")
    classes = reliable_checkpoint(used.groupBy("high", "low").agg(F.min("doc_id").alias("head")), "classes")
    first = classes.select(F.col("head").alias("doc_id"), F.col("high").alias("_high"))
    heads = with_list(used.select("doc_id", "n", "high", "prefix"), first).where("high = _high")
    families = _families(heads, percent)

    # each document in the largest of its families
    largest = families.groupBy("doc_id", "n").agg(F.max(F.struct("size", "family")).alias("_f")).select("doc_id", "n", "_f.family")
    texts = documents.select("doc_id", "text")
    edges = _family_links(largest, texts, words, percent, block)
    # families that are not in one component yet
    known = components(edges).select(F.col("node").alias("doc_id"), F.col("component").alias("_known"))
    labelled = families.select("doc_id", "n", "family").join(known, "doc_id", "left").withColumn("label", F.coalesce("_known", "doc_id"))
    several = labelled.groupBy("family").agg(F.min("label").alias("_least"), F.max("label").alias("_most")).where("_least < _most").select("family")
    rest = reliable_checkpoint(labelled.join(several, "family", "left_semi").select("doc_id", "n", "family"), "rest")
    component = F.coalesce("_known", "head")
    classes = classes.join(known.withColumnRenamed("doc_id", "head"), "head", "left").select("high", "low", component.alias("_component"))
    if rest.limit(1).count():
        # the components of the components: only their smallest documents and those without any are joined further
        found = _family_links(rest, texts, words, percent, block)
        for end in ("a", "b"):
            found = found.join(known.select(F.col("doc_id").alias(end), F.col("_known").alias(f"_{end}")), end, "left")
        found = found.select(F.coalesce("_a", "a").alias("a"), F.coalesce("_b", "b").alias("b"))
        joined = components(found).select(F.col("node").alias("_component"), F.col("component").alias("_joined"))
        classes = classes.join(joined, "_component", "left").select("high", "low", F.coalesce("_joined", "_component").alias("_component"))
    own = signed.select("doc_id", "n", "high", "low").join(classes, ["high", "low"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("_component")), F.col("doc_id")))
    return own.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
