"""Vector searches, page extraction, the registered queries and the pipeline."""

import math

import numpy as np
import pytest

from corpus_helpers import same
from ledgerloom.llm import exact_search, neighbours, pages, queries

VECTORS = "vec_id bigint, embedding array<float>, label int"


@pytest.fixture(scope="module")
def vectors(spark):
    r = np.random.default_rng(4)
    rows = [(i, [float(x) for x in r.standard_normal(16)], 0) for i in range(700)]
    rows[300] = (300, rows[0][1], 0)  # ties
    rows[301] = (301, rows[0][1], 0)
    odd = [
        (900, None, 1), (901, [], 1), (902, [1.0, None] * 8, 1), (903, [math.nan] * 16, 1), (904, [math.inf] * 16, 1), (905, [0.0] * 16, 1),
        (906, [1.0] * 5, 1), (None, rows[1][1], 1), (5, rows[5][1], 1), (-20, rows[2][1], 1), (1000, [1.0] * 5, 1),
    ]
    return rows + odd, spark.createDataFrame(rows + odd, VECTORS).repartition(3)


def plain(rows, k, every, change, zero):
    usable = [(i, change(e)) for i, e, _ in rows if i is not None and e and all(x is not None and math.isfinite(x) for x in e) and (zero or any(e))]
    out, asked = [], {}
    for i, e in usable:
        if i % every == 0:
            asked.setdefault(i, e)
    for q, e in asked.items():
        found = sorted((-sum(a * b for a, b in zip(e, c)), i) for i, c in usable if i != q and len(c) == len(e))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(found[:k])]
    return out


def test_exact_search_equals_brute_force(vectors, monkeypatch):
    rows, table = vectors
    want = plain(rows, 10, 100, lambda e: [math.floor(1024 * x) for x in e], True)
    assert sorted(tuple(r) for r in exact_search.exact_top_k(table).collect()) == sorted(want)
    monkeypatch.setattr("ledgerloom.llm.vectors.CANDIDATE_BLOCK", 50)
    monkeypatch.setattr("ledgerloom.llm.vectors.QUERY_BLOCK", 3)
    assert sorted(tuple(r) for r in exact_search.exact_top_k(table).collect()) == sorted(want)


def test_neighbours_find_nearly_all(vectors):
    rows, table = vectors
    got = neighbours.nearest(table).collect()
    want = plain(rows, 20, 20, lambda e: [float(x) for x in np.array(e, dtype=np.float32).astype(float)], False)
    assert len(got) == len(want)
    true = {(q, i) for q, _, i, _ in want}
    assert len(true & {(r["query_id"], r["vec_id"]) for r in got}) / len(true) > 0.97
    scores = {(q, i): s for q, _, i, s in want}
    for r in got:
        assert (r["query_id"], r["vec_id"]) not in scores or r["score"] == pytest.approx(scores[r["query_id"], r["vec_id"]], abs=1e-12)


def test_estimates_stay_within_their_bounds():
    r = np.random.default_rng(6)
    data, query = r.standard_normal((4000, 32)), r.standard_normal(32)
    code, length, fit = neighbours.encode(data)
    signs = np.unpackbits(code, axis=1).astype(float) * 2 - 1
    bits = signs.shape[1]
    estimate = signs @ (neighbours.rotation(32) @ query) * length / (fit * np.sqrt(bits))
    bound = neighbours.BOUND * length * np.sqrt(1 - fit**2) / fit / np.sqrt(bits - 1) * np.linalg.norm(query)
    assert (np.abs(estimate - data @ query) <= bound).mean() > 0.92


def test_searches_of_nothing_and_with_other_columns(spark, vectors):
    from pyspark.sql import functions as F

    nothing = spark.createDataFrame([], VECTORS)
    more = vectors[1].withColumns({n: F.lit(1) for n in ("vector", "score", "rank", "_q", "query_id", "code")})
    for search in (exact_search.exact_top_k, neighbours.nearest):
        assert search(nothing).count() == 0
        assert same(search(more), search(vectors[1]))


# pages

PAGE = (
    "<!DOCTYPE html><html><head><title>A tale</title><style>p{}</style><script>var x='</p>';</script></head><body><nav><ul><li><a href='/a'>Home</a></li>"
    "<li><a href='/b'>More</a></ul></nav><!-- <p>no</p> --><div class=\"ad\">Buy this now.</div><article><h1>A tale</h1><p>Once &amp; for\n all, <b>bo</b>ld&#33;"
    "<p>Caf&eacute; &lt;p&gt; ended.</p></article><footer>&copy; example</footer></body></html>"
)


def test_blocks_of_a_page():
    found, title = pages.blocks(PAGE)
    assert title == "A tale"
    assert [t for _, t, _ in found] == ["Home", "More", "Buy this now.", "A tale", "Once & for all, bold!", "Café <p> ended.", "© example"]
    assert found[0][2] == 4 and "t:nav" in found[1][0] and "c:ad" in found[2][0] and "t:ul" not in found[2][0]


@pytest.mark.parametrize(
    "markup",
    [
        "<svg viewBox=\"0 0 1 1\"/>", "<math />", "<SVG/>", "<video-player src='a'></video-player>", "<title-bar></title-bar>", "<button-group>", "<select:x>",
        "<video src=a>", "<button>", "<template>", "<noscript>", "<object data=a />", "<script>var a</script >", "<script>var a</script x>", "<style>p {}</STYLE\n>",
        "<svg><path d='M0'/></svg>", "<iframe src=a></iframe>", "<textarea>no</textarea>",
    ],
)
def test_text_after_an_element_without_text_stays(markup):
    found, title = pages.blocks(f"<title>A tale</title><p>Before.</p>{markup}<p>Once.</p>{markup}<p>Ended.</p>")
    assert [t for _, t, _ in found] == ["Before.", "Once.", "Ended."] and title == "A tale"
    if markup != "<video src=a>":
        later = "<svg><text>no</text></svg><video>no</video>"
        assert [t for _, t, _ in pages.blocks(f"<p>Before.</p>{markup}<p>Once.</p>{later}")[0]] == ["Before.", "Once."]


def test_raw_text_without_an_end_goes_on_to_the_end_of_the_page():
    for name in ("script", "style", "textarea", "iframe", "title"):
        assert [t for _, t, _ in pages.blocks(f"<p>Before.</p><{name}><p>no</p>")[0]] == ["Before."]
    found, _ = pages.blocks("<button><p>a" * 20_000)  # each is looked up once
    assert len(found) == 20_000


@pytest.fixture(scope="module")
def chain(spark):
    return pages.train(spark.read.parquet("/root/testdata/sf0.001/pages.parquet"), 60)


def test_main_text_of_odd_pages(spark, chain):
    from pyspark.sql import functions as F

    odd = [None, "", " ", "<", "<p", "<!-- open", "<script>var a", "no tags", "<div><div><div>", "<p class=\"a>b</p>", "<ul><li>a<li>b</ul>", "&amp;&#0;&bogus;", PAGE, PAGE, "<p>" + "long text. " * 20000]
    table = spark.createDataFrame([(i if i else None, None if i == 1 else f"u{i}", p) for i, p in enumerate(odd)], "page_id bigint, url string, html string")
    rows = {r["page_id"]: r for r in pages.extract(table, chain).collect()}
    assert len(rows) == len(odd) and all(r["n_chars"] == len(r["text"]) for r in rows.values())
    assert rows[None]["text"] == "" and rows[2]["text"] == ""
    assert rows[12]["text"] == rows[13]["text"] == "A tale Once & for all, bold! Café <p> ended."
    more = table.withColumns({n: F.lit("x") for n in ("text", "_id", "n_chars")})
    assert same(pages.extract(more, chain), pages.extract(table, chain))
    assert pages.extract(table.where("false"), chain).count() == 0
    untrained = pages.train(table.where("false"))
    assert {r["text"] for r in pages.extract(table, untrained).collect()} == {""}


def test_other_markup_is_told_apart(spark, chain):
    html = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").where("page_id % 5 = 1").collect()]
    wrong = total = 0
    for sequence in pages.labelled_sequences(html, seed=123):
        emissions = [sum(chain.weights.get(f, 0.0) for f in found) for found, _ in sequence]
        wrong += sum(a != y for a, (_, y) in zip(chain.decode(emissions), sequence))
        total += len(sequence)
    assert wrong / total < 0.05


def test_viterbi_equals_all_paths():
    r = np.random.default_rng(8)
    chain = pages.Chain({}, r.standard_normal((2, 2)), r.standard_normal(2))
    for n in range(1, 8):
        e = r.standard_normal(n).tolist()

        def score(path):
            return chain.first[path[0]] + sum(x for x, s in zip(e, path) if s) + sum(chain.step[a, b] for a, b in zip(path, path[1:]))

        best = max(([i >> k & 1 for k in range(n)] for i in range(2**n)), key=score)
        assert chain.decode(e) == best
    assert chain.decode([]) == []


# queries and pipeline


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, sf, name):
    import oracle

    assert oracle.compare(spark, oracle.connect(sf), sf, queries.QUERIES[name], queries.SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_query_gives_every_row(spark, sf, name):
    rows = queries.QUERIES[name](spark, sf).count()
    table = "pages" if name == "op5_main_text" else "documents"
    if name == "op12_conversation_repair":
        assert rows == spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").distinct().count()
    elif name == "op4_neighbours":
        assert rows == 20 * spark.read.parquet(f"{sf}/embeddings.parquet").where("vec_id % 20 = 0").count()
    else:
        assert rows >= spark.read.parquet(f"{sf}/{table}.parquet").count()


def test_pipeline_stages(spark, odd, clashing, nothing, sf):
    import corpus_pipeline

    docs, kept = clashing, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        rows = stage(spark, docs, sf).collect()
        docs = spark.createDataFrame(rows, before.schema)
        assert docs.columns == clashing.columns
        kept[name] = sorted((r["doc_id"] for r in rows), key=repr)
    assert not {3, 4, 5} & set(kept["language"]) and {0, 1, 2, 6, 9, 11} <= set(kept["language"])
    assert not {1, 2} & set(kept["near_duplicates"]) and {0, 9, 10, 11} <= set(kept["near_duplicates"])
    assert kept["near_duplicates"].count(14) == 1 and kept["near_duplicates"].count(15) == 2  # equal rows, and texts that share an id only
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.where("piece = 0").count() == docs.count()
    empty = nothing
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0


def test_language_stage_drops_no_text_by_chance(spark, sf):
    import corpus_pipeline
    from corpus_helpers import prose

    learned = [(i, prose(i, 80), "en", "a", 1) for i in range(30)]
    unseen = [(100 + i, prose(i, 3, "\u4e00\u4e8c\u4e09\u56db\u4e94\u516d\u4e03"), None, "a", 1) for i in range(40)]
    docs = spark.createDataFrame([*learned, *unseen, (200, " 12 ", None, "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, docs, sf).collect()}
    assert kept == {*range(30), *range(100, 140)}
