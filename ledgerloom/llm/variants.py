"""Spelling variants: words that differ by one letter, found in a trie over letter-group counts.

A word's vector holds how often each group of letters occurs in it; the groups are the commonest letters of the
vocabulary one by one and the others dealt over a few more. Words that differ by one inserted, deleted or replaced
letter have vectors in which at most one count is larger by one and at most one smaller by one. A trie has the count of
one group after the other as its levels. The search goes down depth-first with all words that are looked up, each with
a budget of one surplus and one deficit; a branch is left when nobody can pay for it. At the leaves words are compared.

The upper levels of the trie are the shuffle key: a word is stored at its own node and looked up at the nodes that its
budget reaches, of each two nodes only from the smaller. The depth of that key follows the largest node, so a task's
trie has a bounded size however large the vocabulary is; the words that are looked up stream past it. Frequent words
are summed in the tasks before any shuffle.

Null texts have no words, and a null doc_id counts as an empty string in the hash. Texts and words of any length are
whole. Repeated rows count as often as they occur, other columns are not read, and without words there are no rows.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import reliable_checkpoint

RUN = re.compile("(?<![a-zÀ-ÿ])[a-zÀ-ÿ]{7,}")  # of texts with small letters
DAMAGED = 31  # one of so many runs of a document loses a letter
LEAST_LENGTH, LEAST_COUNT, FACTOR = 7, 2, 10
HELD = 300_000  # words that a task sums up before it sends them
ALONE, TOGETHER = 20, 4  # groups of a single letter, and those that share the rest
LEVELS = ALONE + TOGETHER
MOST = 255  # counts are held in a byte; words over that only meet more others in the leaves
NODE = 20_000  # words of a node that is not divided any more
LEAF = 12  # words that are compared without going further down
LOOKED_UP = 100_000  # words that go down a trie at a time
PADDED = 40  # letters of words that are compared as rows of an array


def count_words(documents: DataFrame) -> DataFrame:
    """``word, n``: runs of letters in small letters, some without one letter, that are long and frequent enough."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[str] = Counter()
        for frame in frames:
            for doc_id, text in zip(frame["doc_id"], frame["text"]):
                if not text:
                    continue
                before = zlib.crc32(f"{doc_id or ''}:".encode())
                for run, n in Counter(RUN.findall(text.encode().lower().decode())).items():  # of bytes: A-Z only
                    h = zlib.crc32(run.encode(), before)
                    if h % DAMAGED == 0:
                        at = h % len(run)
                        run = run[:at] + run[at + 1 :]
                        if len(run) < LEAST_LENGTH:
                            continue
                    found[run] += n
                if len(found) > HELD:
                    yield pd.DataFrame({"word": list(found), "n": list(found.values())})
                    found = Counter()
        if found:
            yield pd.DataFrame({"word": list(found), "n": list(found.values())})

    parts = documents.select(F.col("doc_id").cast("string").alias("doc_id"), "text").mapInPandas(count, "word string, n bigint")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


# ------------------------------------------------------------------------------------------ vectors


def letter_groups(words: DataFrame) -> np.ndarray:
    """The group of each letter's code: the commonest letters alone, the others dealt over the last groups."""
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).groupBy("letter").count()
    ranked = sorted(((-r["count"], r["letter"]) for r in letters.collect() if r["letter"]))  # at most 90 letters
    groups = np.full(256, LEVELS - 1, dtype=np.int64)
    for rank, (_, letter) in enumerate(ranked):
        groups[ord(letter)] = rank if rank < ALONE else ALONE + (rank - ALONE) % TOGETHER
    return groups


def vectors(words: list[bytes], groups: np.ndarray) -> np.ndarray:
    """Counts of each group in each word, at most MOST."""
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    cells = np.repeat(np.arange(len(words)) * LEVELS, sizes) + groups[np.frombuffer(b"".join(words), dtype=np.uint8)]
    counts = np.bincount(cells, minlength=len(words) * LEVELS)
    return np.minimum(counts, MOST).astype(np.uint8).reshape(len(words), LEVELS)


def _latin(column: pd.Series) -> list[bytes]:
    return [w.encode("latin-1") for w in column]


def key_depth(words: DataFrame, groups: np.ndarray) -> int:
    """The fewest upper levels that divide the words into nodes of at most NODE; all levels if none do."""

    def keyed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            table = vectors(_latin(frame["word"]), groups) if len(frame) else np.zeros((0, LEVELS), np.uint8)
            found, n = np.unique(table, axis=0, return_counts=True)
            yield pd.DataFrame({"vector": [v.tobytes() for v in found], "n": n})

    leaves = reliable_checkpoint(words.select("word").mapInPandas(keyed, "vector binary, n bigint").groupBy("vector").agg(F.sum("n").alias("n")), "leaves")
    for depth in range(2, LEVELS):
        upper = F.expr(f"substring(vector, 1, {depth})")
        largest = leaves.groupBy(upper.alias("node")).agg(F.sum("n").alias("n")).agg(F.max("n")).first()[0]
        if (largest or 0) <= NODE:
            return depth
    return LEVELS


def dealt(words: DataFrame, groups: np.ndarray, depth: int) -> DataFrame:
    """``node, kind, word, n``: each word at its own node (kind 0) and at the larger nodes in reach.

    There kind is 1 when the budget for a surplus is spent, 2 when both are. A node is larger if its first
    count that differs is; to reach it a word needs one more of that group and may need one less of a later one.
    """

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            own = vectors(_latin(frame["word"]), groups)[:, :depth]
            parts = [(np.arange(len(own)), own, 0)]
            for more in range(depth):
                able = np.flatnonzero(own[:, more] < MOST)  # beyond it one more makes no difference
                ones = own[able]
                ones[:, more] += 1
                parts.append((able, ones, 1))
                for less in range(more + 1, depth):
                    some = np.flatnonzero(ones[:, less] > 0)
                    both = ones[some]
                    both[:, less] -= 1
                    parts.append((able[some], both, 2))
            words, counts = frame["word"].to_numpy(), frame["n"].to_numpy()
            for rows, keys, kind in parts:
                flat = keys.tobytes()
                nodes = [flat[i : i + depth] for i in range(0, len(flat), depth)]
                yield pd.DataFrame({"node": nodes, "kind": kind, "word": words[rows], "n": counts[rows]})

    return words.mapInPandas(deal, "node binary, kind int, word string, n bigint")


# ------------------------------------------------------------------------------------------ search


def differ_by_one(a: bytes, b: bytes) -> bool:
    """Whether two words differ by exactly one inserted, deleted or replaced letter."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    at = next((i for i in range(len(b)) if a[i] != b[i]), len(b))
    return a[at + 1 :] == (b[at:] if len(a) > len(b) else b[at + 1 :])


class Words:
    """Words with their counts, their vectors and their letters as rows of an array, as far as they are short."""

    def __init__(self, words: pd.Series, counts: pd.Series, groups: np.ndarray):
        self.names, self.counts, self.bytes = words.to_numpy(), counts.to_numpy(), _latin(words)
        self.vectors = vectors(self.bytes, groups)
        self.sizes = np.array([len(w) for w in self.bytes], dtype=np.int64)
        self.letters = np.array(self.bytes, dtype=f"S{PADDED + 1}").view(np.uint8).reshape(len(self.bytes), PADDED + 1)


def verified(left: Words, i: np.ndarray, right: Words, j: np.ndarray) -> np.ndarray:
    """Which of the pairs differ by exactly one letter."""
    out = np.zeros(len(i), dtype=bool)
    apart = left.sizes[i] - right.sizes[j]
    short = (left.sizes[i] <= PADDED) & (right.sizes[j] <= PADDED)
    for at in np.flatnonzero(~short & (np.abs(apart) <= 1)):
        out[at] = differ_by_one(left.bytes[i[at]], right.bytes[j[at]])
    at = np.flatnonzero(short & (apart == 0))
    out[at] = (left.letters[i[at]] != right.letters[j[at]]).sum(axis=1) == 1
    for longer, at in ((True, np.flatnonzero(short & (apart == 1))), (False, np.flatnonzero(short & (apart == -1)))):
        a, b = left.letters[i[at]], right.letters[j[at]]
        a, b = (a, b) if longer else (b, a)
        first = (a != b).argmax(axis=1)  # the shorter word is padded, so there is one
        wrong = (a[:, 1:] != b[:, :-1]) & (np.arange(PADDED) >= first[:, None])
        out[at] = ~wrong.any(axis=1)
    return out


class CountTrie:
    """Stored words in the order of their vectors: a node of the trie is a range of them."""

    def __init__(self, words: Words):
        self.words = words
        self.order = np.lexsort(words.vectors.T[::-1])
        self.table = words.vectors[self.order].astype(np.int16)

    def near(self, looked_up: Words, spent: np.ndarray, level: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (word looked up, stored word) that differ by one letter, from ``level`` on down.

        ``spent`` has a row of surplus and deficit already spent by each word above that level.
        """
        wanted = looked_up.vectors.astype(np.int16)
        stack = [(0, len(self.order), level, np.arange(len(wanted)), spent[:, 0], spent[:, 1])]
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0
        while stack:
            low, high, level, some, more, less = stack.pop()
            if high - low <= LEAF or level == LEVELS:
                for begin in range(0, len(some), 1 << 13):
                    part = slice(begin, begin + (1 << 13))
                    for at in range(low, high, LEAF):
                        over = self.table[None, at : min(at + LEAF, high), level:] - wanted[some[part], None, level:]
                        above = np.maximum(over, 0).sum(axis=2) + more[part, None]
                        below = above - over.sum(axis=2) - more[part, None] + less[part, None]
                        i, j = np.nonzero((above <= 1) & (below <= 1))
                        held.append((some[part][i], self.order[at + j]))
                        size += len(i)
                if size > 1 << 17:
                    yield self._checked(looked_up, held)
                    held, size = [], 0
                continue
            counts = self.table[low:high, level]
            cuts = np.flatnonzero(counts[1:] != counts[:-1]) + 1
            own = wanted[some, level]
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), high - low]):
                over = counts[begin] - own
                above, below = more + np.maximum(over, 0), less - np.minimum(over, 0)
                paid = np.flatnonzero((above <= 1) & (below <= 1))
                if len(paid):
                    stack.append((low + begin, low + end, level + 1, some[paid], above[paid], below[paid]))
        if held:
            yield self._checked(looked_up, held)

    def _checked(self, looked_up: Words, held: list) -> tuple[np.ndarray, np.ndarray]:
        i, j = np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held])
        right = verified(looked_up, i, self.words, j)
        return i[right], j[right]


SPENT = np.array([(0, 0), (1, 0), (1, 1)], dtype=np.int16)  # surplus and deficit by kind


def near_words(words: DataFrame) -> DataFrame:
    """``word, other, other_n``: both directions of each pair of ``words`` (word, n) that differs by one letter."""
    groups = letter_groups(words)
    depth = key_depth(words, groups)

    def both(left: Words, i: np.ndarray, right: Words, j: np.ndarray) -> pd.DataFrame:
        a, b = left.names[i], right.names[j]
        return pd.DataFrame({"word": np.concatenate([a, b]), "other": np.concatenate([b, a]), "other_n": np.concatenate([right.counts[j], left.counts[i]])})

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        node, trie, kept = None, None, {0: [], 1: []}  # rows of the node: stored words, words to look up

        def finish() -> Iterator[pd.DataFrame]:
            """Look up what is kept in the node's trie. All of its stored words have come by then."""
            nonlocal trie
            if trie is None and kept[0]:
                own = pd.concat(kept[0], ignore_index=True)
                trie = CountTrie(Words(own["word"], own["n"], groups))
                for i, j in trie.near(trie.words, np.zeros((len(own), 2), np.int16), depth):
                    yield both(trie.words, i[i < j], trie.words, j[i < j])
            if trie is not None and kept[1]:
                rows = pd.concat(kept[1], ignore_index=True)
                asked = Words(rows["word"], rows["n"], groups)
                for i, j in trie.near(asked, SPENT[rows["kind"]], depth):
                    yield both(asked, i, trie.words, j)
            kept[0], kept[1] = [], []

        for frame in frames:
            keys, stored = frame["node"].to_numpy(), frame["kind"].to_numpy() == 0
            new = (np.flatnonzero((keys[1:] != keys[:-1]) | (stored[1:] != stored[:-1])) + 1).tolist()
            for begin, end in zip([0, *new], [*new, len(frame)]):
                if begin == end:
                    continue
                if keys[begin] != node:
                    yield from finish()
                    node, trie = keys[begin], None
                if stored[begin] or kept[0] or trie is not None:  # otherwise no word is stored at the node
                    kept[0 if stored[begin] else 1].append(frame.iloc[begin:end])
                if sum(map(len, kept[1])) >= LOOKED_UP:
                    yield from finish()
        yield from finish()

    rows = dealt(words, groups, depth).repartition("node").sortWithinPartitions("node", "kind")
    return rows.mapInPandas(search, "word string, other string, other_n bigint")


def group_variants(documents: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of each word of ``documents`` (doc_id, text).

    The form is the near word with the largest n, the first in code point order of equal ones, if it is FACTOR times as
    frequent as the word. Counts grow by that factor from form to form, so roots are found in a few rounds, each of
    which doubles the way that has been followed.
    """
    words = reliable_checkpoint(count_words(documents), "words")
    best = F.min(F.struct((-F.col("other_n")).alias("minus"), F.col("other").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    likely = F.col("best.minus") <= F.col("n") * -FACTOR
    joined = words.join(near, "word", "left").select(
        "word", F.when(likely, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0).cast("bigint")).alias("n_near"), F.when(likely, -F.col("best.minus")).alias("form_n")
    )
    formed = reliable_checkpoint(joined, "forms")
    roots = formed.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        if not roots.join(further, "root", "left_semi").limit(1).count():
            break
        roots = reliable_checkpoint(roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
    return formed.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
