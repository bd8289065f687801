"""The registered queries of the subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from credsieve.llm import (
    alignment,
    blocks,
    collisions,
    decontaminate,
    langid,
    licenses,
    packing,
    relative_lz,
    simhash,
    sql,
    suffix,
    toxicity,
    warc,
    whitening,
)
from credsieve.llm.common import remainder, table

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(f: Query) -> Query:
    REGISTRY[f.__name__] = f
    return f


@query
def op1_toxicity(spark, sf_dir):
    """Toxicity of all documents, learnt from the labels of three quarters of them."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = remainder(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, labels, ~held_out)
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")


@query
def op2_packing(spark, sf_dir):
    """All documents, concatenated and cut into sequences of 4096 ids."""
    pieces = packing.pack(table(spark, sf_dir, "documents"))
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op3_substring_dedup(spark, sf_dir):
    """All documents without the words of windows of 20 words that also start earlier."""
    docs = table(spark, sf_dir, "documents")
    found = relative_lz.without_copies(docs, relative_lz.factors(docs))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query
def op4_embedding_near_dedup(spark, sf_dir):
    """All vectors with their links of cosine 0.98 or more inside a label."""
    return collisions.near_duplicates(table(spark, sf_dir, "embeddings"))


@query
def op5_html_extraction(spark, sf_dir):
    """Main text of all pages."""
    return blocks.extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def as_files(docs: DataFrame) -> DataFrame:
    """Documents as a tree of files: source, thousand and ten of the id are directories.

    A document of whose words a fifth or more stand in licence headers is a licence file.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    headers = licenses.header_lines(text)
    in_headers = F.size(F.flatten(F.transform(headers, licenses.tokens)))
    is_license = (F.size(headers) > 0) & (5 * in_headers >= F.size(licenses.tokens(text)))
    number = F.coalesce("doc_id", F.lit(0))
    folder = F.concat_ws(
        "/", F.coalesce("source", F.lit("none")), F.floor(number / 1000), F.floor(number / 10)
    )
    name = F.concat(
        F.when(is_license, "LICENSE.").otherwise("doc."), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    )
    return docs.select("doc_id", "text", F.concat(folder, F.lit("/"), name).alias("path"))


@query
def op6_license_scan(spark, sf_dir):
    """Licences of all documents, by header or from the directories above."""
    return licenses.scan(as_files(table(spark, sf_dir, "documents")))


@query
def op7_simhash_near_dedup(spark, sf_dir):
    """Fingerprints of all documents and their groups within two bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.as_hex(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_language_id(spark, sf_dir):
    """Languages of all documents, learnt from two thirds of them."""
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 3) == 1
    model = langid.fit(docs.where(~held_out))
    return langid.predict(docs, model).select(
        "doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected"
    )


@query
def op9_benchmark_decontamination(spark, sf_dir):
    """Documents that contain windows of 13 words of benchmark items."""
    docs, items = table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")
    return decontaminate.contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(
            F.array_join(F.array_sort(F.transform("item_ids", lambda i: i.cast("string"))), ","), 256
        ).alias("items_sha256"),
        decontaminate.is_contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@query
def op10_suffix_array_dedup(spark, sf_dir):
    """All documents without the bytes of strings of 400 bytes that occur twice."""
    docs = table(spark, sf_dir, "documents")
    found = suffix.without_spans(docs, suffix.repeated_spans(docs))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return found.select(
        "doc_id",
        "n_bytes",
        F.coalesce(removed, F.lit(0).cast("long")).alias("n_removed"),
        F.coalesce(F.size("spans"), F.lit(0)).cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


@query
def op11_warc(spark, sf_dir):
    """All pages written as WARC archives and read back, in the order of their captures."""
    pages = table(spark, sf_dir, "pages")
    # the table has no times: a page is captured as many seconds after a fixed time as its id
    captured = F.lit(1_700_000_000) + F.col("page_id")
    return warc.round_trip(pages, captured=captured)


@query
def op12_embedding_whitening(spark, sf_dir):
    """All usable vectors along the eight largest principal components."""
    found = whitening.whiten(table(spark, sf_dir, "embeddings"))
    # n² times a squared distance leaves the range of a long at some 10 million rows
    return found.withColumn("deviation", F.expr("try_cast(deviation AS bigint)"))


@query
def op13_cross_tokenizer_alignment(spark, sf_dir):
    """All documents in both vocabularies, with the counts of their linked id pairs."""
    return alignment.align(table(spark, sf_dir, "documents"))


ORACLES["op9_benchmark_decontamination"] = sql.DECONTAMINATION
ORACLES["op6_license_scan"] = sql.licenses(licenses.TEMPLATES)
