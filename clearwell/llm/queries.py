"""The registered queries of the subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clearwell.runtime import scratch_path

from . import pii, secrets
from .alignment import align_counts
from .byte_bpe import encode
from .classifier import fit, fold, score
from .interpolation import OTHER, TRAIN, WEIGHTS, score_texts
from .pivots import link_vectors
from .prefix_trie import prefix_trie, shared_openings, turns
from .simhash import near_duplicates
from .spans import joined, merged
from .suffix_trees import digests, without_repeats
from .templates import decontaminate
from .token_counts import count_tokens
from .token_files import crc32_of, read_tokens, write_tokens

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _query(fn=None, *, oracle: str | None = None):
    if fn is None:
        return lambda fn: _query(fn, oracle=oracle)
    QUERIES[fn.__name__] = fn
    if oracle:
        ORACLES[fn.__name__] = oracle
    return fn


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@_query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    space = fit(docs, _table(spark, sf_dir, "labels"), usable=fold(3) != 1)
    return score(docs, space).select(
        "doc_id", (fold(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )


@_query(
    oracle=r"""
    WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM w WHERE len(w) >= 50),
    k AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS k FROM s),
    f AS (SELECT k, min(doc_id) AS least FROM k GROUP BY k),
    c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 50)) AS i FROM k JOIN f USING (k) WHERE doc_id > least),
    p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM w),
    r AS (SELECT p.doc_id, count(c.i) AS n, string_agg(word, ' ' ORDER BY p.i) FILTER (c.i IS NULL) AS kept
          FROM p LEFT JOIN c ON p.doc_id = c.doc_id AND p.i = c.i GROUP BY p.doc_id)
    SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
    FROM w LEFT JOIN r ON w.doc_id = r.doc_id
    """
)
def op2_suffix_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(without_repeats(_table(spark, sf_dir, "documents")))


@_query
def op3_pivot_permutations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_vectors(_table(spark, sf_dir, "embeddings"))


@_query
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_table(spark, sf_dir, "documents"))


def _digests(found: DataFrame, base: list[str], added: list[str]) -> DataFrame:
    return found.select(
        "doc_id",
        *[F.size(k).cast("long").alias(f"n_{k}") for k in base],
        F.sha2(joined(merged(base)), 256).alias("base_sha256"),
        joined(merged(base + added)).alias("spans"),
    )


@_query
def op5_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = F.when(fold(7) == 2, OTHER).when(fold(7) == 6, WEIGHTS).otherwise(TRAIN)
    scored = score_texts(_table(spark, sf_dir, "documents"), part)
    return scored.select("doc_id", (fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


@_query
def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents")).withColumnRenamed("spans", "scored")
    return _digests(found, pii.BASE, pii.ADDED)


@_query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = count_tokens(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 512)


@_query
def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    coded = encode(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


@_query
def op9_benchmark_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), shortest=1)


@_query
def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _digests(secrets.find_secrets(_table(spark, sf_dir, "documents")), secrets.BASE, secrets.ADDED)


@_query(
    oracle=r"""
    WITH t AS (SELECT conv_id AS c, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL),
    k AS (SELECT c, turn, sha256(length(r) || ':' || r || x) AS k, len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS w FROM t),
    o AS (SELECT c, k, w, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, k) AS p FROM k),
    n AS (SELECT c, count(*) AS n, c - c % 20 AS b, list_reduce(list_concat([4294967295], list_transform(string_split(c::VARCHAR, ''), lambda s: ascii(s)::BIGINT)),
            lambda a, s: list_reduce(list_concat([xor(a, s)], [0, 1, 2, 3, 4, 5, 6, 7]), lambda y, z: xor(y >> 1, CASE WHEN y % 2 = 1 THEN 3988292384 ELSE 0 END))) AS crc FROM o GROUP BY c),
    h AS (SELECT c, n, b, xor(crc, 4294967295) % 4 AS h FROM n),
    e AS (SELECT h.c, h.h, h.n, h.b, least(h.h, coalesce(f.n, 0)) AS f FROM h LEFT JOIN h AS f ON f.c = h.b),
    s AS (SELECT e.c, o.p, o.k, o.w FROM e JOIN o ON o.c = e.b AND o.p <= e.f
          UNION ALL SELECT e.c, o.p - e.h + e.f, o.k, o.w FROM e JOIN o ON o.c = e.c AND o.p > e.h),
    l AS (SELECT e.c, coalesce(list(s.k ORDER BY s.p), []) AS k, coalesce(list(s.w ORDER BY s.p), []) AS w FROM
          e LEFT JOIN s ON s.c = e.c GROUP BY e.c),
    q AS (SELECT c, CASE WHEN k[1] IS NULL THEN [] ELSE k END AS k, w FROM l),
    d AS (SELECT c, len(k) AS n, unnest(range(0, len(k) + 1)) AS d, k, w FROM q),
    m AS (SELECT c, n, d, md5(array_to_string(k[1:d], ',')) AS k, CASE WHEN d = 0 THEN 0 ELSE w[d] END AS w FROM d),
    v AS (SELECT min(c) AS v, d, k, count(*) AS n, min(w) AS w, string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (c IS NOT NULL AND m.n = d) AS ends FROM m GROUP BY d, k),
    a AS (SELECT m.c, m.d, v.v FROM m JOIN v USING (d, k)),
    u AS (SELECT v.*, a.v AS up FROM v LEFT JOIN a ON a.c = v.v AND a.d = v.d - 1),
    g AS (SELECT up AS v, d - 1 AS d, count(*) AS n FROM u WHERE up IS NOT NULL GROUP BY ALL),
    y AS (SELECT u.*, coalesce(g.n, 0) AS kids FROM u LEFT JOIN g ON g.v = u.v AND g.d = u.d),
    z AS (SELECT a.v, a.d, sum(CASE WHEN y.kids = 0 THEN 1 ELSE 0 END) AS leaves, sum((y.n - 1) * y.w) AS saved FROM y JOIN a ON a.c = y.v AND a.d <= y.d GROUP BY a.v, a.d)
    SELECT y.v AS conv_id, y.d AS depth, y.up AS parent_conv_id, y.n AS n_convs, y.kids AS n_children,
           z.leaves::BIGINT AS n_leaves, z.saved::BIGINT AS saved_tokens, sha256(coalesce(y.ends, '')) AS ends_sha256
    FROM y JOIN z ON z.v = y.v AND z.d = y.d
    """
)
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(*shared_openings(turns(_table(spark, sf_dir, "conversations"))))


@_query
def op12_pointer_jumping(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, second = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_counts(_table(spark, sf_dir, "documents"), first, second)


@_query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "token-files")
    write_tokens(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"), end_id=0)
    return crc32_of(read_tokens(spark, path))
