"""One query for each operator, over whole tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import exact_search, jaccard, language, mixing, neighbours, packing, pages, pieces, repair, suffixes, toxicity, variants, wavelet

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# of an Arrow batch: with long texts, the usual 10,000 rows would be hundreds of megabytes
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "512", "spark.sql.execution.arrow.maxBytesPerBatch": str(16 << 20)}
# shuffle files go when their job is done: all operators pass on written tables, and a result that is asked for twice is made anew
BATCH["spark.sql.classic.shuffleDependency.fileCleanup.enabled"] = "true"


def bounded_batches(spark: SparkSession) -> None:
    for key, value in BATCH.items():
        spark.conf.set(key, value)


def _query(name: str, sql: str | None = None):
    def add(function):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            bounded_batches(spark)
            return function(spark, sf_dir)

        QUERIES[name] = run
        if sql:
            SQL[name] = sql.strip()
        return run

    return add


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


MIX_SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 2.0::DOUBLE * sum(size)::BIGINT AS cap,
         ([3.0, 1.0, 2.0])[1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3]::DOUBLE AS weight
  FROM d GROUP BY source
), l AS (
  SELECT *, (1.5::DOUBLE * (sum(source_size) OVER ())::BIGINT
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s
), t AS (
  SELECT source, source_size, coalesce(least(cap, weight * max(CASE WHEN level <= cap / weight THEN level END) OVER ()), cap) AS target FROM l
), z AS (
  SELECT source, size, count(*)::BIGINT AS n FROM d WHERE size > 0 GROUP BY source, size
), c AS (
  SELECT z.source, size, sqrt(sqrt(size::DOUBLE)) AS tilt,
         (target - 2 * coalesce((sum(size * n) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::BIGINT, 0))
         / sum(size * n * sqrt(sqrt(size::DOUBLE))) OVER (PARTITION BY z.source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS factor
  FROM z JOIN t ON z.source IS NOT DISTINCT FROM t.source
), f AS (
  SELECT source, max_by(factor, size) AS factor FROM c WHERE factor * tilt <= 2 GROUP BY source
), e AS (
  SELECT d.doc_id, d.source, d.size, t.source_size, t.target,
         CASE WHEN d.size = 0 THEN 0.0 ELSE least(2.0, coalesce(f.factor * sqrt(sqrt(d.size::DOUBLE)), 2.0)) END AS expected,
         (('0x' || substr(md5(coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN f ON d.source IS NOT DISTINCT FROM f.source
), r AS (
  SELECT *, floor(expected)::BIGINT AS whole, expected - floor(expected) AS fraction FROM e
), q AS (
  SELECT *, CASE WHEN fraction > 0 THEN (u / (1 - u)) / (fraction / (1 - fraction)) END AS odds,
         target - (sum(size * whole) OVER (PARTITION BY source))::BIGINT AS missing FROM r
), k AS (
  SELECT *, (sum(size) OVER (PARTITION BY source ORDER BY odds, doc_id, size ROWS UNBOUNDED PRECEDING))::BIGINT - size AS before
  FROM q WHERE odds IS NOT NULL
), a AS (
  SELECT doc_id, size, source_size, target, whole + CASE WHEN 2 * before + size <= 2 * missing THEN 1 ELSE 0 END AS copies FROM k
  UNION ALL SELECT doc_id, size, source_size, target, whole FROM q WHERE odds IS NULL
)
SELECT doc_id, size, source_size, target, (copies * size)::BIGINT AS taken FROM a
"""

TOP_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(range(1, len(q.e) + 1), lambda i: q.e[i] * c.e[i]))::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 100 = 0
)
SELECT query_id, rank, vec_id, score FROM (
  SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INTEGER AS rank FROM p
) WHERE rank <= 10
"""


JOIN_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words
  FROM documents
), g AS (
  SELECT doc_id, CASE WHEN len(words) = 0 THEN []::VARCHAR[] WHEN len(words) < 4 THEN [array_to_string(words, ' ')]
    ELSE list_distinct(list_transform(range(1, len(words) - 2), lambda i: array_to_string(words[i:i + 3], ' '))) END AS grams FROM w
), n AS (
  SELECT doc_id, len(grams)::INTEGER AS n FROM g
), e AS (
  SELECT doc_id, unnest(grams) AS gram FROM g
), o AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM e x JOIN e y ON x.gram = y.gram AND x.doc_id <> y.doc_id GROUP BY ALL
), l AS (
  SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)
), r AS (
  SELECT doc_id AS a, doc_id AS b FROM n
  UNION
  SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
)
SELECT n.doc_id, n.n AS n_shingles, min(r.b) AS component_id FROM n JOIN r ON r.a = n.doc_id GROUP BY ALL
"""


VARIANT_SQL = r"""
WITH RECURSIVE t AS (  -- crc32 of each byte
  SELECT list_transform(range(256), lambda i: list_reduce(range(9), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, 2 * i)) AS crc
), d AS (
  SELECT coalesce(doc_id::VARCHAR, '') AS id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{00C0}-\x{00FF}]+')) AS run
  FROM documents
), r AS (
  SELECT id, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL
), b AS (
  SELECT run, n, flatten(list_transform(string_split(id || ':' || run, ''), lambda c: CASE WHEN ord(c) < 128 THEN [ord(c)] ELSE [192 + (ord(c) >> 6), 128 + (ord(c) & 63)] END)) AS bytes
  FROM r
), h AS (
  SELECT run, n, xor(4294967295, list_reduce(bytes, lambda c, x: xor(c >> 8, t.crc[1 + (xor(c, x::BIGINT) & 255)]), 4294967295::BIGINT)) AS h FROM b, t
), o AS (
  SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word, n FROM h
), w AS (
  SELECT word, sum(n)::BIGINT AS n FROM o WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2
), c AS (
  SELECT word, i, substr(word, 1, i - 1) || substr(word, i + 1) AS cut FROM (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM w)
), s AS (
  SELECT x.word, y.word AS other FROM c x JOIN c y ON x.cut = y.cut AND x.i = y.i AND x.word <> y.word
  UNION SELECT c.word, w.word FROM c JOIN w ON c.cut = w.word
  UNION SELECT w.word, c.word FROM c JOIN w ON c.cut = w.word
), m AS (
  SELECT s.word, count(*) AS n_near, arg_min(s.other, (-w.n, s.other)) AS best, max(w.n) AS best_n FROM s JOIN w ON s.other = w.word GROUP BY s.word
), f AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * w.n THEN best END AS form, CASE WHEN best_n >= 10 * w.n THEN best_n END AS form_n
  FROM w LEFT JOIN m USING (word)
), z AS (
  SELECT word, word AS root, form AS next FROM f
  UNION ALL SELECT z.word, f.word, f.form FROM z JOIN f ON z.next = f.word
)
SELECT f.word, f.form, z.root, f.n, f.n_near, f.form_n FROM f JOIN z ON f.word = z.word WHERE z.next IS NULL
"""


@_query("op1_pareto_mix", MIX_SQL)
def op1(spark, sf_dir):
    mix = mixing.pareto_mix(mixing.sized_documents(_read(spark, sf_dir, "documents")))
    return mix.select("doc_id", "size", "source_size", "target", "taken")


@_query("op2_toxicity")
def op2(spark, sf_dir):
    documents, out = _read(spark, sf_dir, "documents"), language.held_out(5, 0)
    model = toxicity.train(documents, _read(spark, sf_dir, "labels"), ~out)
    return toxicity.score(documents, model).select("doc_id", out.alias("held_out"), "score", "predicted")


@_query("op3_suffix_dedup")
def op3(spark, sf_dir):
    return suffixes.remove_repeats(_read(spark, sf_dir, "documents")).drop("kept_text")


@_query("op4_neighbours")
def op4(spark, sf_dir):
    return neighbours.nearest(_read(spark, sf_dir, "embeddings"))


@_query("op5_main_text")
def op5(spark, sf_dir):
    pages_table = _read(spark, sf_dir, "pages")
    return pages.extract(pages_table, pages.train(pages_table))


@_query("op6_wavelet_shards")
def op6(spark, sf_dir):
    return wavelet.token_shards(_read(spark, sf_dir, "documents"))


@_query("op7_language")
def op7(spark, sf_dir):
    documents, out = _read(spark, sf_dir, "documents"), language.held_out(3, 1)
    prototypes = language.learn_prototypes(documents.where(~out))
    return language.predict_languages(documents, prototypes).select("doc_id", out.alias("held_out"), "lang_pred", "score")


@_query("op8_exact_top_k", TOP_SQL)
def op8(spark, sf_dir):
    return exact_search.exact_top_k(_read(spark, sf_dir, "embeddings"))


@_query("op10_packing")
def op10(spark, sf_dir):
    return packing.pack(_read(spark, sf_dir, "documents"))


@_query("op9_ngram_jaccard", JOIN_SQL)
def op9(spark, sf_dir):
    return jaccard.similarity_join(_read(spark, sf_dir, "documents"))


@_query("op11_spelling_variants", VARIANT_SQL)
def op11(spark, sf_dir):
    return variants.group_variants(_read(spark, sf_dir, "documents"))


@_query("op12_conversation_repair")
def op12(spark, sf_dir):
    return repair.repair_damaged(_read(spark, sf_dir, "conversations"))


@_query("op13_pieces")
def op13(spark, sf_dir):
    coded = pieces.encode_and_decode(_read(spark, sf_dir, "documents"))
    listed = F.array_join(F.transform("ids", lambda i: i.cast("string")), ",")
    return coded.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), F.sha2(listed, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
