"""Spelling variants, conversation repair and piece encoding against plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from functools import lru_cache

import numpy as np
import pytest

from corpus_helpers import prose, same
from ledgerloom.llm import pieces, queries, repair, variants
from ledgerloom.llm.memory import Memory

SF = "/root/testdata/sf0.001"


def small(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


# spelling variants


def plain_variants(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = small(run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            counts[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 7 and n >= 2}
    near = defaultdict(set)
    alike = defaultdict(set)
    for w in counts:
        for i in range(len(w)):
            alike[w[:i], w[i + 1 :]].add(w)
            shorter = w[:i] + w[i + 1 :]
            if shorter in counts:
                near[w].add(shorter)
                near[shorter].add(w)
    for group in alike.values():
        for w in group:
            near[w] |= group - {w}
    best = {w: min(near[w], key=lambda x: (-counts[x], x)) for w in counts if near[w]}
    form = {w: f for w, f in best.items() if counts[f] >= 10 * counts[w]}
    out = set()
    for w, n in counts.items():
        root = w
        while root in form:
            root = form[root]
        out.add((w, form.get(w), root, n, len(near[w]), counts[form[w]] if w in form else None))
    return out


def noisy_words(seed, documents):
    """Texts of a few frequent words, with slips of every kind, accents and capitals."""
    r = random.Random(seed)
    stems = ["thousand", "wondering", "PrÉcision", "mississippi", "aabbaabb", "straßen×÷", "ÿÿÿÿÿÿÿÿ"]
    rows = []
    for doc_id in range(documents):
        words = []
        for _ in range(60):
            w = r.choice(stems)
            if r.random() < 0.3:
                at = r.randrange(len(w))
                w = r.choice([w[:at] + w[at + 1 :], w[:at] + r.choice("aeßx") + w[at:], w[:at] + r.choice("aeßx") + w[at + 1 :]])
            words.append(w)
        rows.append((doc_id, r.choice([" ", ", ", "-", "_1"]).join(words)))
    return rows


@pytest.mark.parametrize("node, asked", [(20_000, 100_000), (5, 7)])
def test_variants_equal_brute_force(spark, monkeypatch, node, asked):
    monkeypatch.setattr(variants, "NODE", node)
    monkeypatch.setattr(variants, "LOOKED_UP", asked)
    rows = [*noisy_words(1, 60), (None, "nothing nothing"), (70, None), (71, ""), (72, "x" * 5000 + " " + "x" * 5000), (72, "x" * 4999 + " " + "x" * 4999)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = variants.group_variants(docs).collect()
    assert len(got) == len({r["word"] for r in got})
    assert {tuple(r) for r in got} == plain_variants(rows)


def test_variants_of_a_whole_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    assert {tuple(r) for r in queries.QUERIES["op11_spelling_variants"](spark, SF).collect()} == plain_variants([tuple(r) for r in docs.collect()])


def test_variants_of_odd_and_empty_tables(spark, odd, clashing, nothing):
    assert variants.group_variants(nothing).count() == 0
    found = variants.group_variants(odd)
    assert {tuple(r) for r in found.collect()} == plain_variants([tuple(r) for r in odd.select("doc_id", "text").collect()])
    assert same(found, variants.group_variants(clashing))


def test_roots_follow_chains_of_forms(spark):
    rows = [(1, " ".join(["abcdefgh"] * 2 + ["abcdefgi"] * 20 + ["abcdefji"] * 200 + ["abcdekji"] * 2000))]
    found = {r["word"]: (r["form"], r["root"]) for r in variants.group_variants(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    assert found["abcdefgh"] == ("abcdefgi", "abcdekji") and found["abcdekji"] == (None, "abcdekji")


def test_nodes_reached_are_those_within_budget():
    groups = np.full(256, variants.LEVELS - 1, dtype=np.int64)
    groups[[ord(c) for c in "abc"]] = [0, 1, 2]
    assert variants.vectors([b"abcabcaz", b""], groups)[:, [0, 1, 2, -1]].tolist() == [[3, 2, 2, 1], [0, 0, 0, 0]]
    for a, b, near in [(b"abc", b"abc", False), (b"abc", b"abd", True), (b"abc", b"ab", True), (b"abc", b"bc", True), (b"abc", b"acb", False), (b"a", b"abc", False)]:
        assert variants.differ_by_one(a, b) == variants.differ_by_one(b, a) == near


# conversations


def plain_repair(rows):
    """Faults and cheapest edits of (turn, role, text) in order, by trying all edits."""
    seen, faults = set(), []
    for _, role, text in rows:
        visible = re.findall(r"[^\x20\x09-\x0D]", text)
        faults.append("blank" if not visible else "duplicate" if (role, text) in seen else "truncated" if visible[-1] not in ".!?" else "")
        seen.add((role, text))
    first = [role[:1] for _, role, _ in rows]
    follows = {"": "su", "s": "u", "u": "a", "a": "u"}

    @lru_cache(None)
    def rest(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        for role in "ua" if inserted < 3 else "":
            if role in follows[state]:
                cost, audit = rest(i, role, inserted + 1)
                ways.append((cost + 3, "I" + audit))
        if i < len(rows):
            cost, audit = rest(i + 1, state, 0)
            ways.append((cost + 4, "D" + audit))
            more = 3 if faults[i] == "truncated" else 0
            for role, price, letter in [(first[i], 0, "K"), ("u", 3, "R"), ("a", 3, "R")] if faults[i] in ("", "truncated") else []:
                if role and role in follows[state]:
                    cost, audit = rest(i + 1, role, 0)
                    ways.append((cost + price + more, letter + audit))
        return min(ways, default=(10**9, ""))

    cost, audit = rest(0, "", 0)
    lines, state, left = [], "", list(zip(first, rows))
    for letter in audit:
        wanted = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[wanted]
        if letter == "I":
            lines.append(f"{name}:")
            state = wanted
            continue
        own, (_, role, text) = left.pop(0)
        if letter != "D":
            lines.append(f"{role if letter == 'K' else name}:{text}")
            state = own if letter == "K" else wanted
    turns = {t for t, _, _ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *map(faults.count, ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def plain_damage(rows):
    found = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        found[conv] += [(turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)
    return {conv: sorted(own, key=lambda r: (r[0] is not None, r[0] or 0)) for conv, own in found.items()}


CONVERSATION = "conv_id bigint, turn bigint, role string, text string"


def talk(seed, conversations, long=0):
    r = random.Random(seed)
    rows = []
    for conv in range(conversations):
        odd = r.random() < 0.5
        for turn in range(r.randint(1, 12)):
            if r.random() < 0.92:
                role = r.choice(["user", "assistant", "system", "tool", None, "", "ugly"]) if odd and r.random() < 0.4 else ["user", "assistant"][turn % 2]
                text = r.choice([f"a{turn}.", f"b{turn}", "x.", " ", None, f"Really {turn}?\n", "é" * turn + "!"])
                rows.append((conv or None, turn or None, role, text))
    rows += [(99_999, n, ["user", "assistant"][n % 2 if r.random() < 0.9 else 0], f"t{n if r.random() < 0.9 else 5}" + r.choice([".", ".", "?", ""])) for n in range(long)]
    return rows


@pytest.mark.parametrize("part", [1 << 12, 8])
def test_repair_equals_trying_all_edits(spark, monkeypatch, part):
    monkeypatch.setattr(repair, "PART", part)
    rows = talk(part, 150, long=150)
    got = repair.repair_damaged(spark.createDataFrame(rows, CONVERSATION).repartition(6)).collect()
    want = {conv: plain_repair(own) for conv, own in plain_damage(rows).items()}
    assert len(got) == len(want) and {r["conv_id"]: tuple(r)[1:] for r in got} == want


def test_repair_of_a_whole_table(spark):
    table = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text")
    want = {conv: plain_repair(own) for conv, own in plain_damage([tuple(r) for r in table.collect()]).items()}
    got = queries.QUERIES["op12_conversation_repair"](spark, SF)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert {r["conv_id"]: tuple(r)[1:] for r in got.collect()} == want


def test_large_conversations_are_mended_in_parts(spark, monkeypatch):
    rows = [(7777, n, "user" if n % 7 else "assistant", f"{n}." if n % 5 else "same.") for n in range(2_500)]
    table = spark.createDataFrame(rows, CONVERSATION).coalesce(1)  # one range, more rows than a task holds
    inside = talk(3, 30)
    got = {r["conv_id"]: tuple(r)[1:] for r in repair.repair(table.unionByName(spark.createDataFrame(inside, CONVERSATION))).collect()}
    states = [repair._code(role, text) for _, _, role, text in rows]
    seen = set()
    for i, (_, _, role, text) in enumerate(rows):
        if (role, text) in seen:
            states[i] = 4 * repair.REPEATED + states[i] % 4
        seen.add((role, text))
    assert got[7777][5:7] == repair.cheapest(states)


def test_repair_of_repeated_empty_and_wider_tables(spark):
    rows = talk(5, 40)
    table = spark.createDataFrame(rows + rows[:20], CONVERSATION)
    assert repair.repair_damaged(table.limit(0)).count() == 0
    wide = table.selectExpr("*", "'x' AS conv", "1 AS pos", "true AS dropped", "2 AS code", "'y' AS audit", "3 AS _kind")
    assert same(repair.repair_damaged(table), repair.repair_damaged(wide))
    dropped = spark.range(400).selectExpr("id AS conv_id", "id % 3 AS turn", "'user' AS role", "'.' AS text")
    gone = [r for r in repair.repair_damaged(dropped).collect() if zlib.crc32(f"{r['conv_id']}:{r['conv_id'] % 3}".encode()) % 20 == 0]
    assert gone and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in gone)


def test_trails_compare_as_their_texts(monkeypatch):
    r = random.Random(4)
    for modulus in (repair._MODULUS, 3):  # with the second, most hashes of different texts are equal
        monkeypatch.setattr(repair, "_MODULUS", modulus)
        trails = [repair.Trail(None, "")]
        for _ in range(300):
            trails.append(repair.Trail(r.choice(trails), r.choice(["K", "D", "KK", "KDR", "KKKKKKKK"])))
        for _ in range(2000):
            a, b = r.choice(trails), r.choice(trails)
            if a.text() != b.text():
                assert repair.comes_first(a, b) == (a.text() < b.text())


# pieces


@pytest.fixture(scope="module")
def encoder():
    import public_tokenizers

    return pieces.PieceEncoder(public_tokenizers.path(pieces.MODEL))


def test_pieces_equal_the_library(encoder, odd_rows):
    r = random.Random(1)
    signs = " ▁\n\tabehint.,<>0xß日本語한🙂é\x00́\r'\"()" + "".join(list(encoder.score)[:400])
    texts = [t for _, t, *_ in odd_rows if t] + ["", " ", "  a  b ", "x" * 40_000, " " * 40_000, "ab" * 20_000, prose(9, 5_000)]
    texts += ["".join(r.choice(signs) for _ in range(r.randint(0, 40))) for _ in range(3_000)]
    texts += [" " * r.randint(0, 70) + r.choice(signs) + " " * r.randint(0, 70) for _ in range(500)]
    texts += ["".join(r.choice(list(encoder.score)) for _ in range(5)).replace("▁", " ") for _ in range(500)]
    for text in texts:
        assert encoder(text) == encoder.library.encode(text), text[:80]


def test_backtracking_steps_back_and_across_windows(encoder, monkeypatch):
    text = pieces.SPACE + "".join(p for p in list(encoder.score)[300:3_000] if pieces.SPACE not in p)
    want = encoder.library.encode(text[1:])
    for window in (16, 64, 1 << 14):
        monkeypatch.setattr(pieces, "WINDOW", window)
        assert encoder._with_bytes(encoder.backtrack(text)) == want


def test_every_two_neighbours_of_a_result_are_compatible(encoder):
    ids = encoder.library.encode(prose(11, 300).replace(" ", ""))
    assert all(encoder.compatible(a, b) for a, b in zip(ids, ids[1:]))
    a, b = encoder.library.piece_to_id("th"), encoder.library.piece_to_id("e")
    assert not encoder.compatible(a, b)  # they would be joined


def test_memory_is_bounded_and_keeps_what_is_asked_for():
    memory = Memory(10)
    for i in range(100):
        memory.find(["often"])
        memory.keep("often" if i == 0 else i, i + 1)
        assert len(memory.young) + len(memory.old) <= 11
    assert memory.find(["often", 3, 99]) == ([1, None, 100], [1])


def test_pieces_of_whole_and_odd_tables(spark, odd, clashing, nothing, encoder):
    library = encoder.library

    def want(doc_id, text):
        ids = library.encode(text or "")
        digest = [hashlib.sha256(s.encode()).hexdigest() for s in (",".join(map(str, ids)), library.decode(ids) if ids else "")]
        return (doc_id, len(ids), *digest)

    table = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = queries.QUERIES["op13_pieces"](spark, SF)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(want(*r) for r in table.collect())
    coded = pieces.encode_and_decode(odd)
    rows = odd.select("doc_id", "text").collect()
    assert sorted(map(repr, ((r["doc_id"], list(r["ids"])) for r in coded.collect()))) == sorted(map(repr, ((i, library.encode(t or "")) for i, t in rows)))
    assert same(coded, pieces.encode_and_decode(clashing)) and same(coded.drop("decoded"), pieces.encode(odd))
    assert same(pieces.decode(coded.drop("decoded")), coded.selectExpr("doc_id", "decoded AS text"))
    assert pieces.encode(nothing).count() == 0 and pieces.decode(pieces.encode(nothing)).count() == 0
