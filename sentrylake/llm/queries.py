"""One query for each operator, over the whole of its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, byte_bpe, conversations, exact_dedup, languages, licenses, ngram_join, packing, passages, spelling, suffix_dedup, token_store, toxicity
from .common import new_path, read, ship


def op1_substring_dedup(spark, sf_dir):
    ship(spark)
    return passages.repeats(read(spark, sf_dir, "documents"))


def op2_best_fit_packing(spark, sf_dir):
    ship(spark)
    return packing.pack(read(spark, sf_dir, "documents"))


def op3_block_nearest(spark, sf_dir):
    ship(spark)
    v = read(spark, sf_dir, "embeddings")
    return ann.search(v, v.filter("vec_id % 20 = 0"), 20)


def op4_license_scan(spark, sf_dir):
    ship(spark)
    return licenses.scan(read(spark, sf_dir, "documents"))


def op5_toxicity(spark, sf_dir):
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    model = toxicity.fit(docs, read(spark, sf_dir, "labels"))
    # a null id counts as empty text
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 5 == 0
    return toxicity.tag(docs, model).select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), F.size("spans").alias("n_spans"))


def op6_token_store(spark, sf_dir):
    ship(spark)
    folder = new_path(spark, "token-store")
    token_store.write(read(spark, sf_dir, "documents"), folder)
    return token_store.read_digests(spark, folder)


def op7_ngram_jaccard(spark, sf_dir):
    ship(spark)
    return ngram_join.join(read(spark, sf_dir, "documents"))


def op8_byte_bpe(spark, sf_dir):
    ship(spark)
    import public_tokenizers

    return byte_bpe.round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op9_exact_dedup(spark, sf_dir):
    ship(spark)
    return exact_dedup.report(read(spark, sf_dir, "documents"))


def op10_suffix_array_dedup(spark, sf_dir):
    ship(spark)
    return suffix_dedup.report(read(spark, sf_dir, "documents")).withColumn("repeats", F.col("n_removed") > 0)


def op11_language_id(spark, sf_dir):
    ship(spark)
    docs = read(spark, sf_dir, "documents")
    return languages.predict(docs, languages.fit(docs))


def op12_conversation_repair(spark, sf_dir):
    ship(spark)
    return conversations.repair(read(spark, sf_dir, "conversations"))


def op13_spelling_variants(spark, sf_dir):
    ship(spark)
    return spelling.group(read(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_best_fit_packing, op3_block_nearest, op4_license_scan, op5_toxicity, op6_token_store, op7_ngram_jaccard, op8_byte_bpe, op9_exact_dedup, op10_suffix_array_dedup, op11_language_id, op12_conversation_repair, op13_spelling_variants)}

ORACLE_SQL = {
    "op9_exact_dedup": """
        with d as (select doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) as text_sha256 from documents)
        select doc_id, max(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
            doc_id = max(doc_id) over (partition by text_sha256) as kept, text_sha256
        from d""",
    "op12_conversation_repair": conversations.SQL,
    "op13_spelling_variants": spelling.SQL,
}
