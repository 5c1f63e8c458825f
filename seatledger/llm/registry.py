"""One query for each operator over its whole table, and the SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _files
from ._store import ship
from .alignment import align
from .collocation import collocations
from .decontam import mark_contaminated
from .line_dedup import drop_common_lines
from .mtree import top_k
from .packing import pack
from .pitman_yor import score_texts
from .quality import score_quality
from .simhash import document_groups, hexadecimal
from .substring_dedup import drop_repeated_passages
from .suffix_dedup import drop_repeated_bytes
from .token_files import read_tokens, write_tokens
from .toxicity import score_toxicity

CAPACITY, END = 1024, 2
VOCABULARY = 50_257  # ids of byte_bpe_50k.json
QUALITY_FROM = 0.7
TOXIC_FROM = 0.3


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact top-k search: the five highest integer products of each 50th vector."""
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    usable = F.forall("embedding", lambda x: F.coalesce(F.abs(x.cast("double")) < float("inf"), F.lit(False)))
    whole = F.when(usable, F.transform("embedding", lambda x: F.floor(F.lit(256) * x.cast("double")).cast("long")))
    return top_k(rows.select("vec_id", whole.alias("vector")), F.col("vec_id") % 50 == 0, k=5)


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suffix-array dedup: bytes of strings of 200 bytes that occur twice."""
    kept = drop_repeated_bytes(table(spark, sf_dir, "documents").select("doc_id", "text"), length=200)
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash near-dedup: 4-word shingles, at most 4 differing bits."""
    found = document_groups(table(spark, sf_dir, "documents"), shingle=4, max_bits=4)
    return found.select("doc_id", hexadecimal(F.col("simhash")).alias("fingerprint"), "component_id")


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best-fit packing into sequences of 1024 tokens."""
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), CAPACITY, END)


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line dedup: lines of at least one code point found in at least ten documents."""
    kept = drop_common_lines(table(spark, sf_dir, "documents"), min_docs=10, min_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Substring dedup: words of passages of 35 words that occur twice."""
    kept = drop_repeated_passages(table(spark, sf_dir, "documents").select("doc_id", "text"), length=35)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


def learnable(doc_id: str = "doc_id") -> Column:
    """Rows that labels may be learned from; the rest is held out."""
    return F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) != 2


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity scores and offending spans by a linear-chain conditional random field."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_toxicity(docs, table(spark, sf_dir, "labels"), learnable(), "toxic")
    return scored.select(
        "doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"), "spans"
    )


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores by regularised quadratic discriminant."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = score_quality(docs, table(spark, sf_dir, "labels"), learnable(), "quality")
    return scored.select("doc_id", (~learnable()).alias("held_out"), "score", (F.col("score") >= QUALITY_FROM).cast("int").alias("predicted"))


def op9_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language-model scores from a hierarchical Pitman-Yor model of four fifths of the texts."""
    part = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5))
    scored = score_texts(table(spark, sf_dir, "documents").select("doc_id", "text"), F.coalesce(part != 1, F.lit(False)))
    return scored.withColumn("held_out", part == 1)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark decontamination by greedy string tiling, over all documents and items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return mark_contaminated(docs, table(spark, sf_dir, "benchmark"))


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phrase collocation mining: each language's first 2000 phrases of two and three words."""
    return collocations(table(spark, sf_dir, "documents"), min_count=10, share=50, first=2000)


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token files: all documents' ids written by frequency rank, and read again."""
    docs, path = table(spark, sf_dir, "documents"), _files.folder(spark, "token-files")
    write_tokens(docs, path, public_tokenizers.path("byte_bpe_50k.json"), VOCABULARY, end=0)
    return read_tokens(spark, path, docs.schema["doc_id"].dataType.simpleString(), ids=False)


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cross-tokenizer alignment of a byte-level and a piece vocabulary."""
    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_top_k, op2_suffix_dedup, op3_simhash, op4_packing, op5_line_dedup, op6_toxicity, op7_substring_dedup, op8_quality, op9_language_model, op10_decontamination, op11_collocations, op12_token_files, op13_alignment)
}

_BLANK = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
ORACLE: dict[str, str] = {
    "op1_top_k": """
        WITH v AS (
          SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
          WHERE len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        scored AS (
          SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
          FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.e) = len(c.e) WHERE q.vec_id % 50 = 0),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored)
        SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5""",
    "op5_line_dedup": f"""
        WITH line AS (
          SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
                 unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS pos
          FROM documents),
        keyed AS (
          SELECT *, translate(trim(line, {_BLANK}), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM line),
        common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
        marked AS (SELECT keyed.*, common.k IS NOT NULL AS gone FROM keyed LEFT JOIN common ON keyed.k = common.k)
        SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
               sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
        FROM marked GROUP BY doc_id""",
    "op11_collocations": """
        WITH piece AS (
          SELECT coalesce(lang, 'und') AS lang,
                 unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[.,;:!?\\x0A-\\x0D]')) AS piece
          FROM documents),
        split AS (
          SELECT lang, row_number() OVER () AS p, list_filter(string_split_regex(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM piece),
        word AS (SELECT lang, p, unnest(w) AS w1, unnest(range(len(w))) AS i FROM split),
        run AS (SELECT lang, w1, lead(w1) OVER o AS w2, lead(w1, 2) OVER o AS w3 FROM word WINDOW o AS (PARTITION BY p ORDER BY i)),
        f1 AS (SELECT lang, w1, count(*)::BIGINT AS f FROM run GROUP BY ALL),
        f2 AS (SELECT lang, w1, w2, count(*)::BIGINT AS f FROM run WHERE w2 IS NOT NULL GROUP BY ALL),
        f3 AS (SELECT lang, w1, w2, w3, count(*)::BIGINT AS f FROM run WHERE w3 IS NOT NULL GROUP BY ALL HAVING count(*) >= 10),
        total AS (SELECT lang, sum(f)::BIGINT AS n FROM f1 GROUP BY lang),
        most AS (
          SELECT lang, w1, w2, max(f) AS longer
          FROM (SELECT lang, w1, w2, f FROM f3 UNION ALL SELECT lang, w2, w3, f FROM f3) GROUP BY ALL),
        cut AS (
          SELECT c.lang, c.w1 || ' ' || c.w2 AS phrase, 1 AS k, c.f AS a, x.f AS l, y.f AS r
          FROM f2 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w2
          LEFT JOIN most m ON m.lang = c.lang AND m.w1 = c.w1 AND m.w2 = c.w2
          WHERE c.f >= 10 AND (m.longer IS NULL OR 100 * m.longer < 50 * c.f)
          UNION ALL
          SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 1, c.f, x.f, y.f
          FROM f3 c JOIN f1 x ON x.lang = c.lang AND x.w1 = c.w1 JOIN f2 y ON y.lang = c.lang AND y.w1 = c.w2 AND y.w2 = c.w3
          UNION ALL
          SELECT c.lang, c.w1 || ' ' || c.w2 || ' ' || c.w3, 2, c.f, x.f, y.f
          FROM f3 c JOIN f2 x ON x.lang = c.lang AND x.w1 = c.w1 AND x.w2 = c.w2 JOIN f1 y ON y.lang = c.lang AND y.w1 = c.w3),
        scored AS (SELECT *, ((1000000::HUGEINT * a * a) // (l::HUGEINT * r))::BIGINT AS score FROM cut),
        best AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
        ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM best)
        SELECT lang, rank, phrase, a, l, r, n, score FROM ranked JOIN total USING (lang) WHERE rank <= 2000""",
}
