"""One registered query per operator, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import ann, bpe, exactdedup, htmltree, langid, licenses, lmscore, media, packing, repair, resample, secretscan, simhash
from .common import cut, table
from .registry import operation


@operation("op4_simhash_near_dedup")
def op4(spark, sf_dir):
    found = simhash.components(table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


@operation("op2_byte_bpe")
def op2(spark, sf_dir):
    import public_tokenizers as P

    path = P.path("byte_bpe_multi_50k.tiktoken")
    both = bpe.decode(bpe.encode(table(spark, sf_dir, "documents"), path, P.PATTERN), path)
    joined = F.concat_ws(",", F.col("ids").cast("array<string>"))
    return both.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(joined, 256).alias("ids_sha256"), F.sha2("bytes", 256).alias("decoded_sha256"))


@operation("op6_best_fit_packing")
def op6(spark, sf_dir):
    import public_tokenizers as P

    docs = table(spark, sf_dir, "documents")
    parts = packing.pieces(docs, P.path("word_bpe_49k.json"))
    parts = parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids")
    return packing.pack(parts, docs.count())


@operation("op3_secret_scan", secretscan.oracle())
def op3(spark, sf_dir):
    found = secretscan.scan(table(spark, sf_dir, "documents"), repository="doc_id", owner="source")
    kinds = [secretscan.of_kind(F.col("_base"), k).alias(f"n_{k}") for k in secretscan.BASE]
    base, spans = secretscan.spans_text(F.col("_base")), secretscan.spans_text(F.col("_spans"))
    return found.select("doc_id", *kinds, F.sha2(base, 256).alias("base_sha256"), spans.alias("spans"), F.col("_live").alias("n_live"), F.col("_examples").alias("n_examples"))


def held_out(column: str = "doc_id"):
    """Documents that language ID never learns from."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % 4 == 2


@operation("op1_language_id")
def op1(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    bounds = langid.Training()
    model = langid.train(langid.sample(docs.filter(~held_out()), "lang", "text", bounds), bounds)
    return langid.predict(docs, model).select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "agreement")


@operation("op10_html_extraction")
def op10(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    model = htmltree.fit(htmltree.sample(pages))
    found = htmltree.extract(pages, model)
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


@operation("op9_media_columns")
def op9(spark, sf_dir):
    stored = media.store(media.from_documents(table(spark, sf_dir, "documents")))
    # Entries of one digest are the same bytes: one of them stands for all.
    known = cut(media.features(stored.select("digest", "stored"))).dropDuplicates(["digest"])
    refs = media.resolve(stored.select("doc_id", "n_bytes", "items"), known)
    names = ["payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    return refs.select("doc_id", "n_bytes", *names, "position", "caption")


@operation("op5_inverted_multi_index")
def op5(spark, sf_dir):
    return ann.search(table(spark, sf_dir, "embeddings"), query_every=20, k=20)


@operation("op7_license_scan")
def op7(spark, sf_dir):
    found = licenses.scan(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "license", "start", "end", "exact", F.round("saving", 6).alias("saving"), F.concat_ws(" ", "missing").alias("missing"), F.concat_ws(" ", "extra").alias("extra"))


@operation("op8_pseudo_likelihood")
def op8(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    words = cut(lmscore.word_counts(docs))
    known = lmscore.vocabulary(lmscore.id_counts(words))
    return lmscore.score(docs, lmscore.fit(docs, known), known, words)


@operation("op11_conversation_repair", repair.oracle())
def op11(spark, sf_dir):
    rows = repair.normal(table(spark, sf_dir, "conversations"))
    broken = repair.damaged(rows)
    found = repair.repair(broken, F.col("copies"))
    every = rows.select("conv_id").distinct()
    known = repair.audit(found).withColumnRenamed("conv_id", "_a")
    texts = repair.repaired_digests(broken, found).withColumnRenamed("conv_id", "_b")
    out = every.join(known, F.col("conv_id").eqNullSafe(F.col("_a")), "left").join(texts, F.col("conv_id").eqNullSafe(F.col("_b")), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


@operation("op12_importance_resampling", resample.oracle())
def op12(spark, sf_dir):
    found = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")


@operation("op13_exact_dedup", exactdedup.oracle())
def op13(spark, sf_dir):
    found = exactdedup.classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))
