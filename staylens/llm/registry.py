"""The registered queries of the subpackage: one thin query per operator, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from staylens.llm import align, bytebpe, chat, html, langid, minhash, mixing, pivots, quality, shard, unigram, variants, warc
from staylens.llm.common import table
from staylens.llm.oracle import SQL
from staylens.plans.materialize import materialize, scratch_path

N_SHARDS = 24


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Archives all pages, rebuilds the records, and measures the payloads that they hold."""
    path = scratch_path(spark, "warc")
    warc.write_archive(table(spark, sf_dir, "pages"), path)
    archive = warc.read_archive(spark, path)
    back = archive.select("page", "record_type", "refers_to_page", warc.payload_of(archive).alias("payload"))
    return back.select(
        F.col("page").cast("long").alias("page_id"),
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        warc.base32_sha1(F.col("payload")).alias("payload_digest"),
        "record_type",
        F.col("refers_to_page").cast("long").alias("refers_to"),
    )


#: The planted conversation whose texts are control strings.
PLANTED = ((-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"))


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats all conversations and the planted one, and reads turns and loss text back from the output."""
    cols = ["conv_id", "turn", "role", "text"]
    planted = spark.range(1).select(
        F.inline(F.array(*[F.struct(*[F.lit(v).alias(c) for c, v in zip(cols, row, strict=True)]) for row in PLANTED]))
    )
    turns = table(spark, sf_dir, "conversations").select(*cols).unionByName(planted)
    back = chat.read_chats(chat.format_chats(turns))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
        "n_blocks",
    )


def op3_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all documents on three-word shingles."""
    found = minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)
    return found.select(F.col("id").alias("doc_id"), "n_shingles", F.col("component").alias("component_id"), "kept")


def op4_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of all embeddings, inside labels."""
    found = pivots.near_embeddings(table(spark, sf_dir, "embeddings"))
    return found.select(F.col("id").alias("vec_id"), "n_links", F.col("component").alias("component_id"), "kept")


def held_out():
    """A quarter of the documents, by the checksum of their id, that training never sees."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(4)) == 2


def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned from the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs.filter(~held_out()))
    return langid.identify(docs, model, keep=["doc_id"]).select(
        "doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"),
    )


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and the cascade's verdict for every document."""
    judged = quality.quality_cascade(table(spark, sf_dir, "documents").select("doc_id", "text"), all_counts=True)
    n, repeats = F.col("__n_words"), F.col("__n_repeat_words")
    return judged.select(
        "doc_id",
        n.alias("n_words"),
        F.col("__word_chars").alias("word_chars"),
        F.col("__n_symbols").alias("n_symbols"),
        F.col("__n_dup_lines").alias("n_dup_lines"),
        repeats.alias("n_repeat_words"),
        ((n < 20) | (repeats * 100 > n * 30)).alias("base_failed"),
        F.col("__kept").alias("kept"),
    )


#: The piece model that op7 and the pipeline encode with.
PIECE_MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of every document, and whether they decode to its text."""
    return unigram.encode(table(spark, sf_dir, "documents"), unigram.load(PIECE_MODEL), k=2, keep=["doc_id"])


def op8_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = table(spark, sf_dir, "pages")
    return html.extract(pages, html.train(pages), keep=["page_id", "url"]).select(
        "page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"),
    )


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of each document, in training order of the first copy."""
    plan = mixing.mix_plan(table(spark, sf_dir, "documents"))
    return (
        plan.withColumn("__row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
        .orderBy(F.element_at(F.concat("positions", F.array(F.lit(2.0))), 1), "doc_id")
        .select("doc_id", "size", "source_size", "target", "taken")
    )


def op10_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shard and slot of each document under the ``bytes`` law."""
    return shard.shard_by_bytes(table(spark, sf_dir, "documents"), N_SHARDS).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


#: The vocabularies that op11 and op13 encode with.
BYTE_RANKS = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
BYTE_MODEL = "/opt/tokenizers/byte_bpe_50k.json"


def op11_bytebpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Byte-level BPE ids of every document, and the text read back from ids and offsets."""
    ranks = bytebpe.load(BYTE_RANKS)
    encoded = bytebpe.encode(table(spark, sf_dir, "documents"), ranks, keep=["doc_id"])
    ids = F.sha2("ids", 256).alias("ids_sha256")
    back = bytebpe.decode(encoded.select("*", ids), ranks, keep=["doc_id", "n_tokens", "ids_sha256"])
    return back.select("doc_id", "n_tokens", "ids_sha256", F.sha2("decoded", 256).alias("decoded_sha256"))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the corpus that is frequent enough, its near words and the spelling that it is a variant of."""
    return variants.spelling_variants(table(spark, sf_dir, "documents"))


def op13_align(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment of two tokenizers' tokens of every document, and how frequent its pairs of ids are in all documents."""
    a, b = bytebpe.load(BYTE_MODEL), align.load_pieces(PIECE_MODEL)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.monotonically_increasing_id().alias("row"))
    found = align.align(docs, a, b, keep=["doc_id", "row"])
    digest = F.when(F.col("n_a") > 0, F.sha2("groups", 256)).otherwise("").alias("groups_sha256")
    narrow, _ = materialize(found.select("doc_id", "row", "n_a", "n_b", "n_groups", "n_links", digest, "pairs"), "aligned")
    scores = align.link_scores(narrow, len(b.sizes), row_col="row")
    none = F.lit(0).cast("long")
    return narrow.drop("pairs").join(scores.hint("merge"), "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links",
        F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256",
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc": op1_warc,
        "op2_chat": op2_chat,
        "op3_minhash": op3_minhash,
        "op4_embeddings": op4_embeddings,
        "op5_langid": op5_langid,
        "op6_quality": op6_quality,
        "op7_sentencepiece": op7_sentencepiece,
        "op8_html": op8_html,
        "op9_mixing": op9_mixing,
        "op10_shard": op10_shard,
        "op11_bytebpe": op11_bytebpe,
        "op12_variants": op12_variants,
        "op13_align": op13_align,
    }


def oracle_sql() -> dict[str, str]:
    """SQL for the queries that SQL can express; the tests hold the others against brute-force versions."""
    return dict(SQL)
