"""The queries of this folder, each over its whole table, and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from recordloom.llm import exact_dedup, external_shuffle, id_files, longest_match, mixing, near_dedup, packing, periodic_runs, ranked_search, surrogates, toxicity, vector_dedup, warc_archive
from recordloom.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def case(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def early_and_late(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A history and a batch: the lower and the upper half of the range of doc_ids. Null ids come last."""
    low, high = docs.agg(F.min("doc_id"), F.max("doc_id")).first()
    early = F.col("doc_id") <= F.lit(None if low is None else (low + high) // 2).cast("long")
    return docs.filter(early), docs.filter(~F.coalesce(early, F.lit(False)))


@case(
    r"""WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS h FROM documents)
    SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = min(doc_id) OVER w AS kept, h AS text_sha256
    FROM d WINDOW w AS (PARTITION BY h)"""
)
def op1_exact_dedup(spark, sf):
    return exact_dedup.exact_dedup(*early_and_late(table(spark, sf, "documents")))


@case()
def op5_token_id_files(spark, sf):
    return id_files.written_and_read(spark, table(spark, sf, "documents"), tokenizer_path(), end_id=2)


@case()
def op7_two_pass_shards(spark, sf):
    return external_shuffle.shard_rows(table(spark, sf, "documents"), shards=16)


@case()
def op2_genetic_packing(spark, sf):
    return packing.packed_pieces(table(spark, sf, "documents"), tokenizer_path(), end_id=0)


@case()
def op3_prob_minhash(spark, sf):
    return near_dedup.classes(table(spark, sf, "documents"))


@case(
    """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
    l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
      WHERE list_cosine_similarity(a.e, b.e) >= 0.98),
    r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a),
    n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
    SELECT r.a AS vec_id, coalesce(any_value(n.n), 0) AS n_links, min(r.b) AS component_id, r.a = min(r.b) AS kept
    FROM r LEFT JOIN n ON n.a = r.a GROUP BY r.a"""
)
def op6_principal_tiles(spark, sf):
    return vector_dedup.near_vectors(table(spark, sf, "embeddings"))


@case()
def op4_longest_match_counts(spark, sf):
    return longest_match.token_counts(table(spark, sf, "documents"), tokenizer_path("piece_bpe_32k.model"))


@case()
def op10_toxic_segments(spark, sf):
    return toxicity.judged(table(spark, sf, "documents"), table(spark, sf, "labels"))


@case()
def op8_temperature_mix(spark, sf):
    return mixing.mix(table(spark, sf, "documents"), repeats=1.5)


@case()
def op9_surrogates(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return surrogates.with_surrogates(docs, key="documents", counted="replaced").select("doc_id", "text", "replaced")


@case(
    """WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    q AS (SELECT page_id, strlen(t) AS n, h, min(page_id) OVER (PARTITION BY t) AS first_id FROM p)
    SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(32), lambda i:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((CAST(('0x' || substr(h, 1 + 5 * CAST(i // 4 AS INT), 5)) AS BIGINT) >> (15 - 5 * CAST(i % 4 AS INT))) & 31 AS INT), 1)), '') AS payload_digest,
    CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM q"""
)
def op11_content_addressed_warc(spark, sf):
    return warc_archive.archived(table(spark, sf, "pages")).drop("url")


@case()
def op12_periodic_runs(spark, sf):
    return periodic_runs.digested(periodic_runs.with_runs(periodic_runs.made_periodic(table(spark, sf, "documents"))))


@case(
    r"""WITH words AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM documents),
    asked AS (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
    wanted AS (SELECT item_id, term, count(*) AS times FROM asked GROUP BY item_id, term),
    sizes AS (SELECT doc_id, count(*) AS n FROM words GROUP BY doc_id),
    whole AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM sizes),
    postings AS (SELECT term, doc_id, count(*) AS tf FROM words WHERE term IN (SELECT term FROM asked) GROUP BY term, doc_id),
    weights AS (SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * any_value(docs) + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM postings, whole GROUP BY term),
    scored AS (SELECT item_id, doc_id, CAST(sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * docs) // terms)))) AS BIGINT) AS score
      FROM wanted JOIN postings USING (term) JOIN weights USING (term) JOIN sizes USING (doc_id), whole GROUP BY item_id, doc_id),
    ranked AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM scored WHERE score > 0)
    SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 20"""
)
def op13_ranked_search(spark, sf):
    return ranked_search.search(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
