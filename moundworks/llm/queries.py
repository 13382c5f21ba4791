"""The registered queries of this subpackage, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from moundworks.llm import codes, jaccard, langid, main_text, mixing, multi_index, oracles, packed_ids, packing, suffix, superkmers, toxicity, weighted_fingerprints, whitening
from moundworks.llm.shared import table


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op2_temperature_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mixing.mix(table(spark, sf_dir, "documents"), repetition_limit=2.0)
    return out.select("doc_id", "source", "mix_tokens", "mix_pass", "mix_block", "mix_order", "mix_row")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify(table(spark, sf_dir, "pages"), table(spark, sf_dir, "documents"))


def op4_packed_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed_ids.encode_and_read(table(spark, sf_dir, "documents"), tokenizer_path())


def op5_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.dedup(table(spark, sf_dir, "documents"), width=50)


def op6_super_kmer_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return superkmers.dedup(table(spark, sf_dir, "documents"), width=20)


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024)
    return out.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op8_inverted_multi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return multi_index.search(table(spark, sf_dir, "embeddings"), every=50, k=5)


def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.links(table(spark, sf_dir, "documents"), words=5, threshold=0.8)


def op10_weighted_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return weighted_fingerprints.fingerprints(table(spark, sf_dir, "documents"))


def op11_digit_slice_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_delta_lloyd_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codes.quantise(table(spark, sf_dir, "embeddings"))


def op13_tree_model_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract(table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # stands at the repository's top and imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    "pipeline": pipeline,
    "op1_toxicity": op1_toxicity,
    "op2_temperature_mixing": op2_temperature_mixing,
    "op3_language_id": op3_language_id,
    "op4_packed_ids": op4_packed_ids,
    "op5_suffix_array_dedup": op5_suffix_array_dedup,
    "op6_super_kmer_dedup": op6_super_kmer_dedup,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op8_inverted_multi_index": op8_inverted_multi_index,
    "op9_ngram_jaccard_join": op9_ngram_jaccard_join,
    "op10_weighted_fingerprints": op10_weighted_fingerprints,
    "op11_digit_slice_whitening": op11_digit_slice_whitening,
    "op12_delta_lloyd_codes": op12_delta_lloyd_codes,
    "op13_tree_model_main_text": op13_tree_model_main_text,
}
#: Removal of byte strings can be said in SQL too, but takes minutes on the smallest table.
ORACLES = {"op6_super_kmer_dedup": oracles.OP6, "op9_ngram_jaccard_join": oracles.OP9}
