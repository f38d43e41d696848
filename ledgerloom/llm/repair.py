"""Faults of conversations and the cheapest edits that mend them.

A conversation is a row of messages by turn. The edits make its roles, by their first letters, ``(s?(ua)+)?``: keep
costs 0, giving another role (user or assistant) 3, deleting 4, inserting an empty message 3, and each message that is
cut off and stays 3 more. Blank and repeated messages have to go. Of equally cheap edits, those count whose letters
(K, R, D, I in order) come first. The state after each message is what stands before: nothing, s, u or a. Two different
texts of edits of equal cost for the same messages are never one the start of the other, because a further
insert costs something; so for each state the cheapest and first text of edits is enough to go on with.

These texts share their beginnings: each is a chain of nodes that know their ancestors 1, 2, 4, … steps up and the hash
of all letters up to them. A tie is settled by going down to the last ancestors with equal hashes and comparing what
follows. Equal hashes are checked against the letters.

**Size.** All messages are sorted over the cluster by conversation and turn, so a large conversation spreads over tasks. A
task finishes the conversations that lie inside its range. Those at its ends, and large ones, are finished in parts of
up to ``PART`` messages: for each state before a part, the cheapest edits to each state after it, and then part after
part. Their hash of the repaired text, which is one stream by definition, reads the messages in order without holding them.

**Odd rows.** A null role or text is one space, in the key of the damage a null conv_id or turn too; null is a conversation
of its own. Messages of one turn come in the order of a hash of role and text, so equal ones stand together. Repeated
rows are repeated messages. Long texts are whole. Other columns are not read; an empty table has no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.session import reliable_checkpoint

PART = 1 << 12  # messages of a part of a large conversation
HELD_ROWS, HELD_LETTERS = 2_000, 4_000_000  # of a conversation that is finished inside a task
REMEMBERED = 100_000  # results by the faults of short conversations
KEEP, ROLE, DELETE, INSERT, CUT_OFF = 0, 3, 4, 3, 3  # costs

# A message's code is 4 * fault + class of its role.
CLASS = {"s": 0, "u": 1, "a": 2}
OTHER = 3
SOUND, TRUNCATED, BLANK, REPEATED = range(4)
DROPPED = -1  # a message that the damage dropped: it only tells that there is the conversation
BEGIN, SYSTEM, USER, ASSISTANT = range(4)  # states
NEXT = (USER, USER, ASSISTANT, USER)  # the state that a message of the wanted role leads to
NAME = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {(0, 1), (1, 2), (2, 1)}  # classes of neighbours
WHITE = " \t\n\x0b\x0c\r"

_BASE, _MODULUS = 1_000_003, (1 << 61) - 1


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows after the damage, in ``conv_id, turn, role, text, dropped``; dropped ones are marked, without a text."""
    space = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    kind = F.col("_kind")
    named = conversations.select("conv_id", "turn", F.coalesce("role", space).alias("role"), F.coalesce("text", space).alias("text"), F.pmod(F.crc32(key.cast("binary")), F.lit(20)).alias("_kind"))
    text = F.when(kind <= 1, "").when(kind == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    times = F.when(kind == 3, F.array(F.lit(False), F.lit(False))).otherwise(F.array(kind == 0))
    return named.select("conv_id", "turn", F.when(kind == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(times).alias("dropped"))


# ------------------------------------------------------------------------------------------ texts of edits


class Trail:
    """A text of edits as its last piece and the text before; texts share what they have in common."""

    __slots__ = ("piece", "up", "depth", "size", "hash")

    def __init__(self, before: Trail | None, piece: str):
        self.piece, self.up = piece, []
        if before is None:
            self.depth, self.size, self.hash = 0, len(piece), 0
        else:
            self.depth, self.size, self.hash = before.depth + 1, before.size + len(piece), before.hash
            step = before
            for k in range(64):
                self.up.append(step)
                if k >= len(step.up):
                    break
                step = step.up[k]
        for letter in piece:
            self.hash = (self.hash * _BASE + ord(letter)) % _MODULUS

    def ancestor(self, depth: int) -> Trail:
        node = self
        while node.depth > depth:
            node = node.up[(node.depth - depth).bit_length() - 1]
        return node

    def text(self, depth: int = -1) -> str:
        """All letters after the ancestor of that depth."""
        pieces, node = [], self
        while node.depth > depth:
            pieces.append(node.piece)
            if not node.up:
                break
            node = node.up[0]
        return "".join(reversed(pieces))


def _same(a: Trail, b: Trail) -> bool:
    return a is b or (a.hash == b.hash and a.size == b.size)


def _surely_same(a: Trail, b: Trail) -> bool:
    """Whether two trails of equal hashes and depths have the same letters."""
    left, right = [], []
    while a is not b:
        left.append(a.piece)
        right.append(b.piece)
        if not a.up or not b.up:
            break
        a, b = a.up[0], b.up[0]
    return "".join(reversed(left)) == "".join(reversed(right))


def comes_first(a: Trail, b: Trail) -> bool:
    """Whether the text of ``a`` comes before that of ``b``, by the last ancestors that have the same text."""
    depth = min(a.depth, b.depth)
    low, other = a.ancestor(depth), b.ancestor(depth)
    if not _same(low, other):
        for k in reversed(range(len(low.up))):
            if k < len(low.up) and not _same(low.up[k], other.up[k]):
                low, other = low.up[k], other.up[k]
        if not low.up:
            return a.text() < b.text()
        low, other = low.up[0], other.up[0]
    if not _surely_same(low, other):  # different texts with equal hashes
        return a.text() < b.text()
    for reach in (low.depth + 4, low.depth + 64):
        one, two = a.ancestor(min(reach, a.depth)).text(low.depth), b.ancestor(min(reach, b.depth)).text(low.depth)
        common = min(len(one), len(two))
        if one[:common] != two[:common]:
            return one < two
    return a.text(low.depth) < b.text(low.depth)


# ------------------------------------------------------------------------------------------ cheapest edits

States = dict[int, tuple[int, Trail]]


def _better(found: States, state: int, cost: int, trail: Trail) -> None:
    known = found.get(state)
    if known is None or cost < known[0] or (cost == known[0] and comes_first(trail, known[1])):
        found[state] = (cost, trail)


def step(states: States, code: int) -> States:
    """The cheapest edits to each state after one more message."""
    fault, kind = divmod(code, 4)
    found: dict[int, list] = {}
    for state, (cost, trail) in states.items():
        options = [(state, cost + DELETE, "D")]
        if fault in (SOUND, TRUNCATED):
            stays = cost + (CUT_OFF if fault == TRUNCATED else 0)
            wanted = NEXT[state]
            kept = wanted if kind == wanted - 1 else SYSTEM if kind == 0 and state == BEGIN else None
            if kept is not None:
                options.append((kept, stays + KEEP, "K"))
            if kept != wanted:
                options.append((wanted, stays + ROLE, "R"))
            later = NEXT[wanted]  # after an inserted message; inserts come after deletions, for their letters
            if kind == later - 1:
                options.append((later, stays + INSERT + KEEP, "IK"))
            else:
                options.append((later, stays + INSERT + ROLE, "IR"))
        for to, total, letters in options:
            best = found.get(to)
            if best is None or total < best[0][0]:
                found[to] = [(total, trail, letters)]
            elif total == best[0][0]:
                best.append((total, trail, letters))
    out: States = {}
    for to, options in found.items():
        for total, trail, letters in options:
            for letter in letters:
                trail = Trail(trail, letter)
            _better(out, to, total, trail)
    return out


def finished(states: States) -> tuple[int, str]:
    """Cost and text of the cheapest edits, with the messages that are missing at the end."""
    out: States = {}
    for state, (cost, trail) in states.items():
        missing = {BEGIN: 0, ASSISTANT: 0, USER: 1, SYSTEM: 2}[state]
        for _ in range(missing):
            trail = Trail(trail, "I")
        _better(out, BEGIN, cost + INSERT * missing, trail)
    cost, trail = out[BEGIN]
    return cost, trail.text()


def cheapest(codes: Iterable[int]) -> tuple[int, str]:
    states: States = {BEGIN: (0, Trail(None, ""))}
    for code in codes:
        states = step(states, code)
    return finished(states)


def through(codes: list[int]) -> list[list[tuple[int, int, str]]]:
    """For each state before these messages: state after, cost and text of the cheapest edits."""
    out = []
    for begin in range(4):
        states: States = {begin: (0, Trail(None, ""))}
        for code in codes:
            states = step(states, code)
        out.append([(state, cost, trail.text()) for state, (cost, trail) in sorted(states.items())])
    return out


def joined(states: States, part: list[list[tuple[int, int, str]]]) -> States:
    """The cheapest edits to each state after one more part."""
    out: States = {}
    for before, (cost, trail) in states.items():
        for after, more, text in part[before]:
            known = out.get(after)
            if known is None or cost + more <= known[0]:
                _better(out, after, cost + more, Trail(trail, text))
    return out


class Repaired:
    """Hash of the repaired messages, fed in order."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, BEGIN
        self.hash, self.some = hashlib.sha256(), False

    def _line(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.some else "") + role + ":" + text).encode())
        self.some = True

    def _inserted(self) -> None:
        while self.at < len(self.audit) and self.audit[self.at] == "I":
            self.state = NEXT[self.state]
            self._line(NAME[self.state], "")
            self.at += 1

    def feed(self, role: str, text: str) -> None:
        self._inserted()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.state = SYSTEM if role[:1] == "s" else NEXT[self.state]
            self._line(role, text)
        elif edit == "R":
            self.state = NEXT[self.state]
            self._line(NAME[self.state], text)

    def result(self) -> str:
        self._inserted()
        return self.hash.hexdigest()


def _code(role: str, text: str) -> int:
    """The code of a message, as if none had come before it."""
    seen = text.rstrip(WHITE)
    fault = BLANK if not seen else SOUND if seen[-1] in ".!?" else TRUNCATED
    return 4 * fault + CLASS.get(role[:1], OTHER)


def _counts(codes: list[int]) -> list[int]:
    """Blank, repeated and truncated messages, and neighbours whose roles may not follow each other."""
    faults = [c >> 2 for c in codes]
    kinds = [c & 3 for c in codes]
    return [faults.count(BLANK), faults.count(REPEATED), faults.count(TRUNCATED), sum(pair not in LEGAL for pair in zip(kinds, kinds[1:]))]


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_MESSAGE = "pos bigint, turn bigint, role string, text string, code int, same binary"
_NAMES = [c.split()[0] for c in f"conv string, {_RESULT}, {_MESSAGE}".split(", ")]


def _in_ranges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Results of conversations inside a task's range of sorted messages, and the messages of all others."""
    memory: dict[bytes, tuple[int, str]] = {}
    done: list[tuple] = []
    apart: list[tuple] = []

    def put_apart(conv, rows) -> None:
        for pos, turn, role, text, dropped in rows:
            code = DROPPED if dropped else _code(role, text)
            same = hashlib.blake2b(f"{len(role)}:{role}{text}".encode(), digest_size=16).digest()
            apart.append((conv, *[None] * 8, pos, turn, role, text, code, same))

    def finish(conv, rows) -> None:
        codes, seen, turns = [], set(), set()
        rows = [r for r in rows if not r[4]]
        for _, turn, role, text, _ in rows:
            code = _code(role, text)
            if code >> 2 != BLANK and (role, text) in seen:
                code = 4 * REPEATED + (code & 3)
            seen.add((role, text))
            codes.append(code)
            if turn is not None:
                turns.add(turn)
        key = bytes(codes)
        known = memory.get(key)
        if known is None:
            known = memory[key] = cheapest(codes)
            if len(memory) > REMEMBERED:
                memory.clear()
        cost, audit = known
        repaired = Repaired(audit)
        for _, _, role, text, _ in rows:
            repaired.feed(role, text)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        done.append((conv, gaps, *_counts(codes), cost, audit, repaired.result(), *[None] * 6))

    def sent() -> pd.DataFrame:
        rows = pd.DataFrame(done + apart, columns=_NAMES, dtype=object)
        done.clear()
        apart.clear()
        return rows

    current, held, letters, open_ended = None, [], 0, True  # the first one may have begun in the range before
    for frame in frames:
        turns = [None if pd.isna(t) else int(t) for t in frame["turn"]]
        for conv, pos, turn, role, text, dropped in zip(frame["conv"], frame["pos"], turns, frame["role"], frame["text"], frame["dropped"]):
            if conv != current:
                if current is not None:
                    (put_apart if open_ended else finish)(current, held)
                    open_ended = False
                current, held, letters = conv, [], 0
            held.append((pos, turn, role, text, dropped))
            letters += len(text)
            if open_ended or len(held) > HELD_ROWS or letters > HELD_LETTERS:
                put_apart(conv, held)
                held, letters, open_ended = [], 0, True
        if done or apart:
            yield sent()
    put_apart(current, held)  # the last one may go on in the next range
    if apart:
        yield sent()


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for conv, part, codes in zip(frame["conv"], frame["part"], frame["codes"]):
            codes = [int(c) for c in codes]
            paths = [(before, *path) for before, found in enumerate(through(codes)) for path in found]
            ends = (codes[0] & 3, codes[-1] & 3) if codes else (-1, -1)
            rows.append((conv, part, *ends, *_counts(codes), [p[:3] for p in paths], [p[3] for p in paths]))
        names = ["conv", "part", "first", "last", "blank", "duplicate", "truncated", "illegal", "paths", "texts"]
        yield pd.DataFrame(rows, columns=names)


_PART = "conv string, part bigint, first int, last int, blank bigint, duplicate bigint, truncated bigint, illegal bigint, paths array<array<bigint>>, texts array<string>"


def _part_after_part(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Counts, cost and audit of each conversation from its parts, which come in order."""
    conv, states, counts, last = None, {}, np.zeros(4, np.int64), -1

    def result() -> pd.DataFrame:
        cost, audit = finished(states)
        return pd.DataFrame([(conv, *counts.tolist(), cost, audit)], columns=["conv", "blank", "duplicate", "truncated", "illegal", "cost", "audit"])

    for frame in frames:
        for row in frame.itertuples(index=False):
            if row.conv != conv:
                if conv is not None:
                    yield result()
                conv, states, counts, last = row.conv, {BEGIN: (0, Trail(None, ""))}, np.zeros(4, np.int64), -1
            part: list[list] = [[], [], [], []]
            for (before, after, cost), text in zip(row.paths, row.texts):
                part[int(before)].append((int(after), int(cost), text))
            states = joined(states, part)
            counts += [row.blank, row.duplicate, row.truncated, row.illegal]
            if row.first >= 0:
                counts[3] += last >= 0 and (last, row.first) not in LEGAL
                last = row.last
    if conv is not None:
        yield result()


def _hashes(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Hash of each conversation's repaired messages: its audit comes first, then its messages in order."""
    conv, repaired = None, None
    for frame in frames:
        for key, audit, role, text in zip(frame["conv"], frame["audit"], frame["role"], frame["text"]):
            if key != conv:
                if conv is not None:
                    yield pd.DataFrame({"conv": [conv], "repaired_sha256": [repaired.result()]})
                conv, repaired = key, Repaired(audit)
            else:
                repaired.feed(role, text)
    if conv is not None:
        yield pd.DataFrame({"conv": [conv], "repaired_sha256": [repaired.result()]})


def _in_parts(rows: DataFrame) -> DataFrame:
    """Results of conversations from their messages, which may lie in many ranges."""
    twice = rows.where(F.col("code") >= 0).groupBy("conv", "same").agg(F.min("pos").alias("first"), F.count("*").alias("times")).where("times > 1")
    narrow = rows.select("conv", "same", "pos", "code")
    marked = narrow.join(twice, ["conv", "same"], "left")
    repeated = (F.col("pos") > F.col("first")) & (F.col("code") >= 0) & (F.shiftright("code", 2) != BLANK)
    coded = marked.select("conv", "pos", F.when(repeated, 4 * REPEATED + F.col("code").bitwiseAND(3)).otherwise(F.col("code")).alias("code"))
    part = F.floor(F.col("pos") / PART).cast("bigint").alias("part")  # places count from a multiple of it in each range
    ordered = F.sort_array(F.collect_list(F.when(F.col("code") >= 0, F.struct("pos", "code"))))
    codes = coded.groupBy("conv", part).agg(F.transform(ordered, lambda x: x["code"]).alias("codes"))
    parts = codes.mapInPandas(_parts, _PART).repartition("conv").sortWithinPartitions("conv", "part")
    audited = reliable_checkpoint(parts.mapInPandas(_part_after_part, "conv string, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"), "audited")
    nothing = F.lit(None).cast("string")
    heads = audited.select("conv", F.lit(-1).cast("bigint").alias("pos"), "audit", nothing.alias("role"), nothing.alias("text"))
    messages = rows.where(F.col("code") >= 0).select("conv", "pos", nothing.alias("audit"), "role", "text")
    hashed = heads.unionByName(messages).repartition("conv").sortWithinPartitions("conv", "pos").mapInPandas(_hashes, "conv string, repaired_sha256 string")
    turns = rows.where("code >= 0 AND turn IS NOT NULL").groupBy("conv", "turn").agg(F.lit(1).alias("one")).groupBy("conv")
    turns = turns.agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    zero = F.coalesce("gaps", F.lit(0).cast("bigint")).alias("gaps")
    return audited.join(hashed, "conv").join(turns, "conv", "left").select("conv", zero, "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def repair(rows: DataFrame) -> DataFrame:
    """Faults, cost, audit and hash of the repaired messages of each conversation.

    ``rows`` has ``conv_id, turn, role, text`` and may have ``dropped``; conversations with dropped rows only count too.
    """
    dropped = F.col("dropped") if "dropped" in rows.columns else F.lit(False)
    kind = rows.schema["conv_id"].dataType.simpleString()
    # a text in the order of conv_id is not needed, only that equal ones stand together
    named = rows.select(
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("conv"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), dropped.alias("dropped"), F.xxhash64("role", "text").alias("_hash"),
    )
    order = ["conv", F.col("turn").asc_nulls_first(), "_hash"]
    ordered = named.repartitionByRange(*order).sortWithinPartitions(*order, "role", "text").withColumn("pos", F.monotonically_increasing_id())
    found = reliable_checkpoint(ordered.drop("_hash").mapInPandas(_in_ranges, f"conv string, {_RESULT}, {_MESSAGE}"), "conversations")
    results = [c.split()[0] for c in _RESULT.split(", ")]
    inside = found.where("pos IS NULL").select("conv", *results)
    across = _in_parts(found.where("pos IS NOT NULL"))
    conv_id = F.when(F.col("conv") != "", F.expr("substring(conv, 2)")).cast(kind).alias("conv_id")
    return inside.unionByName(across).select(conv_id, *results)


def repair_damaged(conversations: DataFrame) -> DataFrame:
    """``repair`` of all conversations after the damage."""
    return repair(damaged(conversations))
