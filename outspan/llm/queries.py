"""Queries over the whole text tables, one for each operator, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe
from .bbit_minhash import near_classes
from .centroid_heaps import heap_clusters
from .chosen_path import jaccard_classes
from .common import table
from .multi_index import nearest, sign_codes
from .packing import pack
from .pii import find_pii
from .quality_classifier import quality_scores
from .quality_rules import quality_rules
from .quality_sql import op1_sql
from .site_style_tree import extract_main_text
from .spelling_variants import spelling_variants, word_counts
from .suffix_dedup import PASSAGE, remove_repeats
from .text_sql import op11_sql, op12_sql, op13_sql
from .toxicity import toxicity_scores

TOKENIZER = "byte_bpe_50k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text")
    return quality_rules(docs, drop_text=True).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op5_pii_anchor_expansion(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_pii(docs).drop("text")
    base = F.filter("pii_spans", lambda s: s["kind"].isin("email", "ip", "card", "phone"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in ("email", "ip", "card", "phone")], F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"), count("account"), count("url"), F.size("pii_spans").cast("long").alias("n_spans"))


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeats(docs, digest=True, passage=PASSAGE)


def op8_bpe_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.encode(docs, tokenizer_path(), decoded="decoded", drop_text=True)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_chosen_path_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return jaccard_classes(docs).select("doc_id", "class_id", "n_links", "n_same")


def op10_mixture_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return pack(docs, tokenizer_path())


def op2_site_style_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    out = extract_main_text(pages)
    return out.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op3_multi_index_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    codes = sign_codes(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding"), "embedding")
    return nearest(codes, codes.filter(F.col("id") % 100 == 0), k=10)


def op4_rff_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op6_mil_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return scored.select("doc_id", (F.col("fold") == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "offending")


def op11_permuterm_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = word_counts(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


def op12_heap_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_clusters(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))


def op13_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_site_style_tree": op2_site_style_tree,
    "op3_multi_index_topk": op3_multi_index_topk,
    "op4_rff_quality": op4_rff_quality,
    "op6_mil_toxicity": op6_mil_toxicity,
    "op5_pii_anchor_expansion": op5_pii_anchor_expansion,
    "op7_suffix_dedup": op7_suffix_dedup,
    "op8_bpe_trie": op8_bpe_trie,
    "op9_chosen_path_join": op9_chosen_path_join,
    "op10_mixture_packing": op10_mixture_packing,
    "op11_permuterm_variants": op11_permuterm_variants,
    "op12_heap_clusters": op12_heap_clusters,
    "op13_bbit_minhash": op13_bbit_minhash,
}


def _op3_sql() -> str:
    half = lambda a: " + ".join(f"CASE WHEN embedding[{i + 1}] > 0 THEN {1 << (i - a)} ELSE 0 END" for i in range(a, a + 32))
    return f"""WITH c AS (SELECT vec_id AS id, CAST({half(0)} AS BIGINT) AS lo, CAST({half(32)} AS BIGINT) AS hi FROM embeddings WHERE embedding IS NOT NULL AND vec_id IS NOT NULL),
        d AS (SELECT q.id AS query_id, c.id AS neighbor_id, CAST(bit_count(xor(q.lo, c.lo)) + bit_count(xor(q.hi, c.hi)) AS INTEGER) AS distance FROM c q, c WHERE q.id % 100 = 0)
        SELECT query_id, neighbor_id, distance, CAST(row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id) AS INTEGER) AS rank FROM d QUALIFY rank <= 10"""


ORACLE = {
    "op1_quality_rules": op1_sql(),
    "op3_multi_index_topk": _op3_sql(),
    "op11_permuterm_variants": op11_sql(),
    "op12_heap_clusters": op12_sql(),
    "op13_bbit_minhash": op13_sql(),
}
