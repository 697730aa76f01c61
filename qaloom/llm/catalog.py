"""Each operator of this subpackage as a query over its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from qaloom.llm import alignment, bpe, collocations, langmix, lines, passages, quality, simhash, suffixes, surrogates, tiling, toxicity, warc
from qaloom.llm.registry import ORACLES, QUERIES, query, table  # noqa: F401


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op9_bpe")
def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path())


@query("op4_simhash")
def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


@query("op10_suffixes")
def op10_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.digest(suffixes.without_repeats(table(spark, sf_dir, "documents")))


@query("op2_toxicity")
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.predictions(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op6_quality")
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.verdicts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_langmix")
def op8_langmix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langmix.predictions(table(spark, sf_dir, "documents"))


@query("op1_tiling")
def op1_tiling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tiling.report(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op5_lines")
def op5_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.report(table(spark, sf_dir, "documents"))


@query("op3_surrogates")
def op3_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return surrogates.pseudonymized(docs, key="a key of this example")


@query("op7_passages")
def op7_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.report(table(spark, sf_dir, "documents"))


# The 160 bits of a SHA-1 in groups of twenty, each as four letters of base 32.
WARC_SQL = """
WITH payloads AS (
    SELECT page_id, coalesce(html, '') AS body FROM pages
), digests AS (
    SELECT page_id, CAST(octet_length(encode(body)) AS BIGINT) AS payload_bytes, sha1(body) AS h,
           max(page_id) OVER (PARTITION BY sha1(body)) AS top
    FROM payloads
)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           CAST(((CAST('0x' || substr(h, CAST(i // 4 * 5 + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - i % 4 * 5 AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
       CASE WHEN page_id = top THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> top THEN top END AS refers_to
FROM digests
"""


@query("op11_warc", WARC_SQL)
def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(table(spark, sf_dir, "pages"))


@query("op12_alignment")
def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return alignment.aligned(docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model"))


COLLOCATIONS_SQL = r"""
WITH pieces AS (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
    FROM documents
), word_lists AS (
    SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM pieces
), places AS (
    SELECT lang, ws, unnest(range(1, len(ws) + 1)) AS i FROM word_lists
), spans AS (
    SELECT lang, ws, i, unnest(range(1, 6)) AS k FROM places
), counts AS (
    SELECT lang, k, ws[i:i + k - 1] AS part, count(*) AS a FROM spans WHERE i + k - 1 <= len(ws) GROUP BY ALL
), totals AS (
    SELECT lang, CAST(sum(a) AS BIGINT) AS n FROM counts WHERE k = 1 GROUP BY lang
), frequent AS (
    SELECT lang, k, part, array_to_string(part, ' ') AS phrase, a FROM counts WHERE a >= 100
), kept AS (
    SELECT * FROM frequent c WHERE k > 1 AND NOT EXISTS (
        SELECT 1 FROM frequent g WHERE g.lang = c.lang AND g.k > c.k AND 100 * g.a >= 100 * c.a
            AND contains(' ' || g.phrase || ' ', ' ' || c.phrase || ' '))
), steps AS (
    SELECT *, unnest(range(1, k)) AS cut FROM kept
), cuts AS (
    SELECT s.lang, s.phrase, s.cut, s.a, x.a AS l, y.a AS r, t.n,
           CAST(1000::HUGEINT * s.a * t.n // (x.a::HUGEINT * y.a) AS BIGINT) AS score
    FROM steps s JOIN totals t ON t.lang = s.lang
    JOIN frequent x ON x.lang = s.lang AND x.phrase = array_to_string(s.part[1:s.cut], ' ')
    JOIN frequent y ON y.lang = s.lang AND y.phrase = array_to_string(s.part[s.cut + 1:s.k], ' ')
), best AS (
    SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM best QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


@query("op13_collocations", COLLOCATIONS_SQL)
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mined(table(spark, sf_dir, "documents"))
