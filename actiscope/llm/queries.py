"""One registered query per operation, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from actiscope.llm import ann, fingerprints, infill, lm, mixing, online, packing, quality, repair, sharding, similar, substrings, urls
from actiscope.llm.common import load, query

TOKENIZER = "byte_bpe_50k.json"


@query("op1_winnowing")
def op1(spark, sf_dir):
    return fingerprints.fingerprint_edits(load(spark, sf_dir, "documents"))


@query("op2_byte_convnet")
def op2(spark, sf_dir):
    docs = load(spark, sf_dir, "documents")
    net = quality.fit(docs, load(spark, sf_dir, "labels"))
    return quality.with_quality(docs, net).select(
        "doc_id", (quality.fold() == quality.HELD_OUT).alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted")
    )


@query("op3_extendible_shards", sharding.ORACLE)
def op3(spark, sf_dir):
    return sharding.shards(load(spark, sf_dir, "documents"))


@query("op4_best_two_fit")
def op4(spark, sf_dir):
    return packing.pack_documents(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op5_poisson_mix", mixing.ORACLE)
def op5(spark, sf_dir):
    return mixing.mix(load(spark, sf_dir, "documents"))


@query("op6_signature_trees")
def op6(spark, sf_dir):
    return similar.classes_of(load(spark, sf_dir, "documents"), similar.Rule(4, 85)).select("doc_id", "n_shingles", "component_id")


@query("op7_host_trust", urls.oracle())
def op7(spark, sf_dir):
    return urls.judge(load(spark, sf_dir, "pages"))


@query("op8_one_bit_codes")
def op8(spark, sf_dir):
    vectors = load(spark, sf_dir, "embeddings")
    return ann.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


@query("op9_gated_lm")
def op9(spark, sf_dir):
    return lm.log_likelihood(load(spark, sf_dir, "documents"), quality.fold() == 1)


@query("op10_super_kmers")
def op10(spark, sf_dir):
    cut = substrings.without_repeats(load(spark, sf_dir, "documents"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


@query("op11_hirschberg_repair")
def op11(spark, sf_dir):
    conversations = load(spark, sf_dir, "conversations")
    return repair.repair_report(repair.damage(conversations), conversations)


@query("op12_sum_of_squares")
def op12(spark, sf_dir):
    return online.pack_online(load(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


@query("op13_unit_captures", infill.ORACLE)
def op13(spark, sf_dir):
    made = infill.fill_in_middle(load(spark, sf_dir, "documents"))
    digests = (F.sha2("output", 256).alias("output_sha256"), F.sha2(infill.restored(), 256).alias("restored_sha256"))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", *digests)
