"""Corpus preparation: full texts joined with their manifest, and complaint narratives."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.functions.convert import embedding_text, split_entities, strip, word_count
from tallyframe.functions.text import redact_complaint
from tallyframe.operators import vector_index
from tallyframe.session import materialise

CORPUS_SCHEMA = "doc_id string, title string, category string, doc_type string, date string, source_file string, text string"


def corpus_problems(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """``(doc_id, problem)``: repeated documents and documents the manifest does not list."""
    repeated = corpus.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select(
        "doc_id", F.lit("duplicate doc_id in corpus").alias("problem"))
    missing = corpus.select("doc_id").distinct().join(manifest.select("doc_id"), "doc_id", "left_anti").select(
        "doc_id", F.lit("missing from the manifest").alias("problem"))
    return repeated.unionByName(missing)


def prepare_corpus(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row per document: id, text to embed, payload. ``manifest`` has one row per document."""
    listed = manifest.select(
        "doc_id", split_entities(F.coalesce("entities", F.lit(""))).alias("entities"),
        F.coalesce("summary", F.lit("")).alias("summary"))
    text = strip(F.col("text"))
    joined = corpus.withColumn("text", text).join(listed, "doc_id")
    payload = ["doc_id", "title", "category", "doc_type", "date", "source_file", "entities", "summary", "text"]
    return joined.select("doc_id", embedding_text(F.col("title"), F.col("text")).alias("embedding_text"),
                         F.struct(*payload).alias("payload"))


def load_corpus(corpus: DataFrame, manifest: DataFrame) -> DataFrame:
    """As ``prepare_corpus``, stopping at the first problem."""
    problem = corpus_problems(corpus, manifest).take(1)
    if problem:
        raise ValueError(f"{problem[0].doc_id}: {problem[0].problem}")
    return prepare_corpus(corpus, manifest)


def corpus_words(documents: DataFrame, text: str) -> DataFrame:
    return documents.agg(F.count(F.lit(1)).alias("documents"), F.sum(word_count(F.col(text)).cast("long")).alias("words"))


def complaint_documents(complaints: DataFrame) -> DataFrame:
    """Consented narratives, redacted, with a hashed source id and coarse metadata only."""
    return complaints.where(F.col("consumer_consent_provided") == "Consent provided").select(
        F.sha2(F.col("complaint_id").cast("string"), 256).alias("source_id"),
        redact_complaint(F.col("consumer_complaint_narrative")).alias("text"),
        "product", "sub_product", "issue", "company", "state", F.year("date_received").cast("long").alias("received_year"),
    )


def visible(scopes: list[str]) -> Column:
    """What a caller may see: allowed scope, active, current version; nothing where no scope is allowed."""
    allowed = F.col("access_scope").isin(*scopes) if scopes else F.lit(False)
    return allowed & (F.col("status") == "active") & F.col("is_current")


def current_chunks(chunks: DataFrame, scopes: list[str]) -> DataFrame:
    """Chunks a caller may see; applied before any ranking."""
    return chunks.where(visible(scopes))


#: columns by which chunks are stored, so that what a caller may not see is not opened
SCOPE_FOLDERS = ("access_scope", "status", "is_current")
#: candidates per question that are ranked again, and what the words of a question count beside the vectors
RERANKED, LEXICAL_WEIGHT = 50, 0.3


def store_chunks(chunks: DataFrame, path: str, *, size: int, block_rows: int = vector_index.BLOCK_ROWS) -> vector_index.VectorStore:
    """Chunks (item_id, vector, text and scope columns) in folders of scope, status and version, clustered inside."""
    return vector_index.build(chunks, path, size=size, folders=SCOPE_FOLDERS, block_rows=block_rows)


def words_found(words: Column, text: Column) -> Column:
    """Share of the words that are words of the text, letters of A to Z in either case; 0 without words."""
    low = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    own = F.split(F.translate(low, "\t\n\x0b\x0c\r", "     "), " ")
    return F.coalesce(F.try_divide(F.size(F.array_intersect(words, own)).cast("double"), F.size(F.array_distinct(words))), F.lit(0.0))


def scoped_search(
    store: vector_index.VectorStore, questions: DataFrame, scopes: list[str], k: int, *,
    candidates: int = RERANKED, weight: float = LEXICAL_WEIGHT,
) -> DataFrame:
    """``(query_id, item_id, score, lexical, final, rank)`` of chunks that the caller's scopes allow.

    ``questions`` have query_id, vector and words (lower-case). Scope, status and version decide first, as folders that are
    pruned; then the nearest ``candidates`` are found exactly among what is left, and only these are ranked again by
    vectors and words together, ties by item id. Texts are read for candidates alone.
    """
    if k < 1 or candidates < k:
        raise ValueError("ask for at least one chunk, and for no more than there are candidates")
    found, _ = vector_index.search(store, questions, candidates, where=visible(scopes))
    near = materialise(found.drop("rank"), "candidates")
    texts = store.rows().where(visible(scopes)).select("item_id", "text").join(near.select("item_id").distinct(), "item_id", "left_semi")
    scored = near.join(questions.select("query_id", "words"), "query_id").join(texts, "item_id").withColumn("lexical", words_found(F.col("words"), F.col("text")))
    final = (1 - weight) * F.col("score") + weight * F.col("lexical")
    order = Window.partitionBy("query_id").orderBy(F.desc("final"), "item_id")
    return scored.withColumn("final", final).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", "item_id", "score", "lexical", "final", "rank")
