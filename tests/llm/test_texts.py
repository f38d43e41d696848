"""Operators over texts: odd rows, empty tables, other columns, and comparison with plain versions."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpus_helpers import prose, same
from ledgerloom.llm import components, jaccard, language, mixing, packing, suffixes, tokens, toxicity, wavelet


def words(text):
    return (text or "").encode().lower().split()


# mixing


def test_targets_take_weights_in_turn_and_stop_at_twice_the_source(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 1000), ("c", 300), (None, 5)], "source string, source_size bigint")
    got = {r["source"]: r["target"] for r in mixing.source_targets(sizes).collect()}
    # weights 3, 1, 2, 3; "a" and null stop at twice their size, the excess goes to "b" and "c", then "c" stops too
    assert got["a"] == 20 and got[None] == 10 and got["c"] == 600
    assert got["b"] == pytest.approx(1.5 * 1315 - 630)


def test_mix_keeps_whole_rows_near_targets(odd):
    rows = mixing.pareto_mix(mixing.sized_documents(odd)).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert r["taken"] == r["copies"] * r["size"] and 0 <= r["copies"] <= 2
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= max(r["size"] for r in own)
    assert [r["size"] for r in rows if r["doc_id"] == 5] == [0]


def test_mix_is_repeatable_and_takes_sizes_with_unequal_probability(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "if(id % 3 = 0, 'hot', concat('s', id % 5)) AS source", "1 + id % 7 * 50 AS size")
    one, two = mixing.pareto_mix(docs, weights=(1.0,), share=0.5), mixing.pareto_mix(docs.repartition(5), weights=(1.0,), share=0.5)
    assert same(one, two)
    rows = one.collect()
    by_source = Counter()
    for r in rows:
        by_source[r["source"]] += r["taken"]
    for r in rows:
        assert abs(by_source[r["source"]] - r["target"]) <= 301
    share = {n: np.mean([r["copies"] for r in rows if r["size"] == n]) for n in (1, 301)}
    assert share[301] > 2 * share[1] > 0


def test_mix_of_nothing_and_with_clashing_columns(nothing, odd, clashing):
    assert mixing.mix_documents(nothing).count() == 0
    mixed = mixing.mix_documents(clashing)
    assert mixed.columns == clashing.columns
    assert same(mixed.select(*odd.columns), mixing.mix_documents(odd))


def test_mix_cut_at_the_end_of_a_range_equals_its_sql(spark, tmp_path):
    import oracle
    from ledgerloom.llm import queries

    # documents of equal length, each in a range of its own: the words missing are those of the first ranges exactly
    docs = spark.range(18).selectExpr("id AS doc_id", "'one two three four five six seven eight nine ten' AS text", "substr('abc', 1 + cast(id / 6 AS int), 1) AS source")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert oracle.compare(spark, con, str(tmp_path), queries.QUERIES["op1_pareto_mix"], queries.MIX_SQL) is None
    taken = Counter()
    for r in mixing.pareto_mix(mixing.sized_documents(docs)).collect():
        taken[r["source"]] += r["taken"]
    assert taken == {"a": 120, "b": 50, "c": 100}


# toxicity


def test_machine_learns_a_pair_that_single_weights_miss(monkeypatch):
    monkeypatch.setattr(toxicity, "MIN_CONTRAST", 0.0)
    r = np.random.default_rng(0)
    texts, labels = [], []
    for i in range(900):
        insult, group = bool(r.random() < 0.5), bool(r.random() < 0.5)
        texts.append(f"{prose(i, 8)} {'vermin' if insult else 'weather'} {'people' if group else 'garden'}")
        labels.append(int(insult != group))  # neither word tells anything alone
    terms, row = toxicity.terms_of(texts)
    train = row < 600
    model = toxicity.fit(terms[train], row[train], np.array(labels[:600]), rounds=300)
    scores = model.scores(terms[~train], row[~train] - 600, 300)
    assert ((scores >= 0.5) == np.array(labels[600:])).mean() > 0.95


def test_terms_count_stems_and_repeats():
    one, _ = toxicity.terms_of(["abcdefgh"])
    assert len(one) == 4  # the word and three stems
    assert len(toxicity.terms_of(["abc abc"])[0]) == 2 and len(toxicity.terms_of(["abc abc abc ABC"])[0]) == 3
    assert len(toxicity.terms_of([None, "", "12 !"])[0]) == 0
    known = np.zeros(toxicity.BUCKETS, dtype=bool)
    known[one[:2]] = True
    assert set(toxicity.terms_of(["abcdefgh other"], known)[0]) == set(one[:2])


def test_toxicity_of_odd_rows(spark, odd, nothing, clashing):
    labels = spark.createDataFrame([(0, 1), (2, 1), (9, 0), (11, 0), (None, 1), (8, None)], "doc_id bigint, toxic int")
    model = toxicity.train(odd, labels, ~language.held_out(5, 0))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == odd.count() and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in rows)
    assert same(toxicity.score(clashing, model), toxicity.score(odd, model))
    empty = toxicity.train(nothing, labels.where("false"), ~language.held_out(5, 0))
    assert toxicity.score(nothing, empty).count() == 0 and toxicity.score(odd, empty).count() == odd.count()


# suffix arrays


@pytest.mark.parametrize("seed", range(6))
def test_induced_order_and_prefixes_are_those_of_a_plain_sort(seed):
    r = np.random.default_rng(seed)
    data = r.integers(0, 1 + seed, 500, dtype=np.uint8)
    wanted = np.sort(r.choice(500, 200, replace=False))
    order = suffixes.sorted_suffixes(data, wanted)
    text = bytes(data) + bytes(suffixes.LENGTH)
    cut = [text[i : i + suffixes.LENGTH] for i in order]
    assert sorted(order) == list(wanted) and cut == sorted(cut)
    for a, b, n in zip(cut, cut[1:], suffixes.common_prefixes(data, order)):
        assert n == next((i for i in range(len(a)) if a[i] != b[i]), len(a))


def plain_removal(texts):
    size, data = suffixes.LENGTH, [(t or "").encode() for t in texts]
    seen = Counter(d[i : i + size] for d in data for i in range(len(d) - size + 1))
    out = []
    for d in data:
        gone = np.zeros(len(d) + 1, dtype=int)
        for i in range(len(d) - size + 1):
            if seen[d[i : i + size]] > 1:
                gone[i] += 1
                gone[i + size] -= 1
        flags = np.cumsum(gone)[: len(d)] > 0
        kept = bytes(b for b, f in zip(d, flags) if not f)
        out.append((len(d), int(flags.sum()), int((np.diff(np.concatenate(([0], flags.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("contexts", [suffixes.CONTEXTS, 1])
def test_removal_equals_brute_force(odd, odd_rows, contexts):
    got = suffixes.remove_repeats(odd, contexts).drop("kept_text").collect()
    want = [(r[0], *w) for r, w in zip(odd_rows, plain_removal([r[1] for r in odd_rows]))]
    assert sorted(map(repr, (tuple(r) for r in got))) == sorted(map(repr, want))


def test_removal_of_random_overlaps(spark):
    r = np.random.default_rng(5)
    stock = [prose(100 + i, 45) for i in range(6)]
    texts = [" ".join(stock[j] for j in r.integers(0, 6, r.integers(1, 5))) + prose(i, 20) for i in range(25)] + ["ab" * 400, "a" * 199, "a" * 200, "b" * 401]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r[0]: tuple(r)[1:] for r in suffixes.remove_repeats(docs).drop("kept_text").collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts)


def test_long_texts_are_taken_in_parts(monkeypatch):
    text = [prose(1, 3000).encode(), b"short", prose(2, 900).encode()]
    whole = [f for f in suffixes.anchors(text, True) if f is not None]
    monkeypatch.setattr(suffixes, "CHUNK", 1000)
    parts = [f for f in suffixes.anchors(text, True) if f is not None]

    def starts(found):
        return sorted((int(o), int(a), int(s) + i) for own, anchor, _, start, number in found for o, a, s, n in zip(own, anchor, start, number) for i in range(n))

    assert starts(whole) == starts(parts)


def test_removal_of_nothing_and_with_clashing_columns(nothing, odd, clashing):
    assert suffixes.remove_repeats(nothing).count() == 0
    assert same(suffixes.remove_repeats(clashing), suffixes.remove_repeats(odd))


# language


def test_language_of_odd_rows(odd, nothing, clashing):
    prototypes = language.learn_prototypes(odd.where(~language.held_out(3, 1)))
    rows = language.predict_languages(odd, prototypes).collect()
    assert len(rows) == odd.count()
    for r in rows:
        assert 0 <= r["score"] <= 1 and r["lang_pred"] in {"en", "fr", "und"}
    assert {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 5)} == {"und"}
    assert same(language.predict_languages(clashing, prototypes), language.predict_languages(odd, prototypes))
    none = language.learn_prototypes(nothing)
    assert none.count() == 0 and language.predict_languages(nothing, none).count() == 0
    assert {r["lang_pred"] for r in language.predict_languages(odd, none).collect()} == {"und"}


def test_vectors_are_those_of_the_definition(spark):
    text = "Ab c, abÜ"
    parts, counts = language._count_chunk([language.symbols(text), language.symbols("zz")])
    got = counts.astype(int) @ language.trigram_vectors(parts).astype(int)
    for row, folded in zip(got, (" ab c abü ", " zz ")):
        want = np.zeros(language.DIMENSIONS, dtype=int)
        for gram in zip(folded, folded[1:], folded[2:]):
            a, b, c = (language.letter_vector(0 if g == " " else ord(g)).astype(int) for g in gram)
            want += np.roll(a, 2) * np.roll(b, 1) * c
        assert (row == want).all()
    learned = language.learn_prototypes(spark.createDataFrame([(text, "x")], "text string, lang string")).collect()
    assert learned[0]["vector"] == got[0].tolist()


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    out = language.held_out(3, 1)
    found = language.predict_languages(docs, language.learn_prototypes(docs.where(~out)))
    rows = found.join(docs.where(out).where("lang IS NOT NULL").select("doc_id", "lang"), "doc_id").collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in rows]) > 0.95


# Jaccard join


def plain_join(rows, words_=4, percent=85):
    sets = []
    for _, text, *_ in rows:
        w = words(text)
        sets.append({tuple(w[i : i + words_]) for i in range(len(w) - words_ + 1)} if len(w) >= words_ else {tuple(w)} if w else set())
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                x, y = find(rows[i][0]), find(rows[j][0])
                root[max(x, y)] = min(x, y)
    return [(r[0], len(s), None if r[0] is None else find(r[0])) for r, s in zip(rows, sets)]


@pytest.mark.parametrize("block", [jaccard.BLOCK, 2])
def test_join_equals_all_pairs(odd, odd_rows, block):
    got = [tuple(r) for r in jaccard.similarity_join(odd, block=block).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, plain_join(odd_rows)))


def test_join_of_chained_groups(spark):
    r, rows, n = np.random.default_rng(2), [], 0
    for g in range(4):
        text = prose(50 + g, 60).split(" ")
        for _ in range(14):
            rows.append((n, " ".join(text)))
            n += 1
            text[int(r.integers(len(text)))] = prose(900 + n, 1)  # each like the one before, not like the first
    r.shuffle(rows)
    rows = [(int(i), str(t)) for i, t in rows]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    for block in (3, 1024):
        assert sorted(tuple(x) for x in jaccard.similarity_join(docs, block=block).collect()) == sorted(plain_join(rows))
    five = [tuple(x) for x in jaccard.similarity_join(docs, words=5, percent=80).collect()]
    assert sorted(five) == sorted(plain_join(rows, 5, 80))


def test_products_give_overlaps(monkeypatch):
    monkeypatch.setattr(jaccard, "COLUMNS", 7)
    r = np.random.default_rng(1)
    sets = [np.unique(r.integers(0, 60, r.integers(1, 40))).astype(np.uint64) for _ in range(12)]
    got = jaccard.overlaps(sets)
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if i != j:
                assert got[i, j] == len(np.intersect1d(a, b))


def test_join_of_nothing_and_with_clashing_columns(nothing, odd, clashing):
    assert jaccard.similarity_join(nothing).count() == 0
    assert same(jaccard.similarity_join(clashing), jaccard.similarity_join(odd))


def test_components_of_a_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 30)] + [(500, 500)]
    got = dict(tuple(r) for r in components.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect())
    assert got == {**{i: 0 for i in range(1, 41)}, **{100 + i: 100 for i in range(1, 30)}}


# tokens, shards, packing


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_stretches_give_the_ids_of_the_whole_text(odd_rows, name):
    library, of = tokens.tokenizer(name), tokens.Encoder(name)
    texts = [r[1] for r in odd_rows if r[1]] + ["  a  b ", "a ", " a", "it's  'll x's 't", "a\x1c \x1cb", "á ́b", "İ ß Σ", "a \x85 b​ "]
    for text in texts * 2:
        assert of(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", [wavelet.VOCABULARY, packing.VOCABULARY])
def test_texts_are_looked_up_together_by_units_in_bounded_memory(name):
    library, of, rng = tokens.tokenizer(name), tokens.Encoder(name, remembered=64), random.Random(6)
    signs = " \n\t.,'!aZ\u00e9\u00d7\u00f7\u00ff\u0100\u024f\u0250\u2014\u00a0\u3000\x000\u65e5\U0001f600<"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randrange(40))) for _ in range(600)] + [None, "", " ", "a" * 5000, " b" * 900]
    texts += [" ".join(rng.choice("abc\u00e9") * rng.randrange(1, 24) + rng.choice(["", ",", ").", "7"]) for _ in range(50)) for _ in range(40)]
    for some in (texts, texts[::-1]):
        assert [ids.tolist() for ids in of.many(some)] == [library.encode(t or "", add_special_tokens=False).ids for t in some]
        assert 0 < of.short.held <= 64 and len(of.short.low) <= 1024
        assert not any(len(key) > tokens.LONGEST for key in (*of.long.young, *of.long.old))


def test_units_of_texts_are_found_in_their_bytes():
    texts = [" it's (one) two,\nthree", "", "x  y \u00e9t\u00e9 \u00d7 z", "a\x00b\n"]
    raw = b"\0".join([*(t.encode() for t in texts), bytes(16)])
    starts = tokens.cut_units(np.frombuffer(raw, np.uint8), len(raw) - 16, np.cumsum([len(t.encode()) + 1 for t in texts]) - 1)
    units = [raw[a:b].decode() for a, b in zip(starts, [*starts[1:], len(raw) - 16])]
    parts = [[" it's", " (", "one", ")", " two", ",", "\n", "three"], [], ["x  y", " \u00e9t\u00e9 \u00d7 z"], ["a\x00b\n"]]
    assert units == [u for p in parts for u in [*p, "\0"]]


def ids_of(name, text, end):
    return np.array(tokens.tokenizer(name).encode(text or "", add_special_tokens=False).ids + [end], dtype="<u4")


def test_shards_round_trip(odd, odd_rows, nothing, clashing, monkeypatch):
    got = wavelet.token_shards(odd).collect()
    start, want = 0, []
    for doc_id, text, *_ in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, (r[1] or "").encode())):
        ids = ids_of(wavelet.VOCABULARY, text, 0)
        want.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(repr, map(tuple, got))) == sorted(map(repr, want))
    assert wavelet.token_shards(nothing).count() == 0
    assert same(wavelet.token_shards(clashing), wavelet.token_shards(odd))


def test_wavelet_matrix_answers_from_bytes():
    values = np.random.default_rng(3).integers(0, 300, 2000)
    _, lengths, matrix = wavelet.open_shard(wavelet.shard_bytes([1, None], [1500, 500], values))
    assert (matrix.decode() == values).all() and lengths.tolist() == [1500, 500]
    assert (matrix.access(np.arange(2000)) == values).all()
    for value in (0, 7, 299, 511, 70_000):
        places = np.flatnonzero(values == value)
        assert (matrix.occurrences(value) == places).all() and matrix.count(value) == len(places)
        assert [matrix.select(value, k) for k in range(0, len(places), 97)] == places[::97].tolist()
        for k in (-1, len(places)):
            with pytest.raises(IndexError):
                matrix.select(value, k)
        assert [matrix.rank(value, e) for e in (0, 1, 512, 777, 2000)] == [int((values[:e] == value).sum()) for e in (0, 1, 512, 777, 2000)]
    assert matrix.select(7, 1) == np.flatnonzero(values == 7)[1]
    empty = wavelet.WaveletMatrix.build(np.zeros(0, int), 3)
    assert empty.count(1) == 0 and len(empty.decode()) == 0 and len(empty.occurrences(1)) == 0


def test_packing_places_every_piece_once(odd, odd_rows, nothing, clashing):
    rows = packing.pack(odd).collect()
    want = []
    for doc_id, text, *_ in odd_rows:
        want += [(doc_id, *p) for p in packing.pieces_of(ids_of(packing.VOCABULARY, text, 1), packing.CAPACITY)]
    assert sorted(repr(tuple(r)[:5]) for r in rows) == sorted(map(repr, want))
    sequences = {}
    for r in rows:
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY
    assert len(sequences) == -(-sum(r["length"] for r in rows) // packing.CAPACITY)
    assert packing.pack(nothing).count() == 0
    assert same(packing.pack(clashing), packing.pack(odd))


@pytest.mark.parametrize("seed", range(20))
def test_plan_is_valid_and_near_the_bound(seed):
    r = np.random.default_rng(seed)
    lengths = np.minimum(r.geometric(1 / 60, 400), 100)
    counts = {int(k): int(v) for k, v in zip(*np.unique(lengths, return_counts=True))}
    plan = packing.Plan(dict(counts), 100)
    held, sums = Counter(), Counter()
    for length, first, last, sequence, each, _ in plan.places():
        held[length] += last - first
        for i in range(last - first):
            sums[sequence + i // each] += length
    assert held == counts and max(sums.values()) <= 100 and len(sums) == plan.sequences
    large = [n for n in lengths if 3 * n > 100]
    bound = max(-(-int(lengths.sum()) // 100), sum(2 * n > 100 for n in large))
    assert plan.sequences <= 1.25 * bound
