"""Embedding, vector and retrieval queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from tallyframe.functions.text import point_id
from tallyframe.operators import access, answers, documents as corpus, vector_index, vectors
from tallyframe.plans import star
from tallyframe.plans.registry import query
from tallyframe.session import fresh_path, materialise

SIZE = 64

# Query vectors: the mean vector of each label.
_CENTROIDS = """
    with cells as (
        select label, i, avg(cast(embedding[i] as double)) as x
        from embeddings, (select unnest(generate_series(1, 64)) as i) group by label, i),
    q as (select label as query_id, list(x order by i) as v from cells group by label),
    scored as (
        select q.query_id, e.vec_id as item_id, list_cosine_similarity(q.v, e.embedding::double[]) as score from q, embeddings e),
    ranked as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from scored)"""


def centroids(spark, folder) -> DataFrame:
    """One query per label; averaged per position, so a large label combines map-side."""
    cells = star.table(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("i", "x"))
    means = cells.groupBy("label", "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return means.groupBy(F.col("label").alias("query_id")).agg(
        F.transform(F.sort_array(F.collect_list(F.struct("i", "x"))), lambda c: c["x"]).alias("vector"))


def catalog(spark, folder) -> DataFrame:
    return star.table(spark, folder, "embeddings").select(F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"))


def _shown(ranked: DataFrame) -> DataFrame:
    return ranked.withColumn("score", F.round("score", 6)).withColumn("rank", F.col("rank").cast("long"))


@query("vec_topk", _CENTROIDS + """
    select query_id, item_id, round(score, 6) as score, rank from ranked where rank <= 5""")
def vec_topk(spark, folder):
    return _shown(vectors.top_k(centroids(spark, folder), catalog(spark, folder), 5, size=SIZE))


@query("vec_topk_threshold", _CENTROIDS + """
    select query_id, item_id, round(score, 6) as score, rank from ranked where rank <= 20 and score >= 0.35""")
def vec_topk_threshold(spark, folder):
    return _shown(vectors.top_k(centroids(spark, folder), catalog(spark, folder), 20, size=SIZE, threshold=0.35))


@query("vec_topk_blocks", _CENTROIDS + """
    select query_id, item_id, round(score, 6) as score, rank from ranked where rank <= 3""")
def vec_topk_blocks(spark, folder):
    """Both sides in blocks, the way for queries that are too many to be sent."""
    return _shown(vectors.top_k_by_blocks(
        centroids(spark, folder), catalog(spark, folder), 3, size=SIZE, block_rows=500))


@query("vec_topk_pruned", _CENTROIDS + """
    select query_id, item_id, round(score, 6) as score, rank from ranked where rank <= 5""")
def vec_topk_pruned(spark, folder):
    """The catalogue stored in clusters; those that cannot hold one of the best are not opened."""
    store = vector_index.build(catalog(spark, folder), fresh_path(spark, "vector-store"), size=SIZE, block_rows=100)
    return _shown(vector_index.search(store, centroids(spark, folder), 5)[0])


def _payloads(spark, folder) -> DataFrame:
    return star.table(spark, folder, "documents").select(
        F.col("doc_id").alias("item_id"), F.col("doc_id").cast("string").alias("doc_id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"), F.col("lang").alias("category"),
        F.col("source").alias("doc_type"), F.lit("2026-01-01").alias("date"), F.col("n_chars").alias("secret"), "text")


_DOCS = """
    docs as (select doc_id as item_id, cast(doc_id as varchar) as doc_id, 'Document ' || doc_id as title, lang as category,
             source as doc_type, '2026-01-01' as date, text from documents)"""


@query("doc_search", _CENTROIDS + "," + _DOCS + """
    select r.query_id, r.rank, d.doc_id, d.title, d.category, d.doc_type, d.date, md5(d.text) as digest
    from ranked r join docs d on r.item_id = d.item_id where r.rank <= 10""")
def doc_search(spark, folder):
    """Fifty are asked for, ten is the cap; only the allowed payload leaves."""
    hits = vectors.search(centroids(spark, folder), catalog(spark, folder), size=SIZE, k=50)
    safe = access.safe_payload(hits.join(_payloads(spark, folder), "item_id"))
    return safe.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text").withColumn("rank", F.col("rank").cast("long"))


@query("doc_safe_payload", """
    select cast(doc_id as varchar) as doc_id, lang as category, source as doc_type, md5(text) as digest
    from documents where lang <> 'fr'""")
def doc_safe_payload(spark, folder):
    """French documents lose their id and must not come through."""
    hits = _payloads(spark, folder).drop("title", "date").withColumn(
        "doc_id", F.when(F.col("category") == "fr", "").otherwise(F.col("doc_id")))
    safe = access.safe_payload(hits)
    return safe.withColumn("digest", F.md5(F.col("text").cast("binary"))).drop("text")


@query("doc_citations", _CENTROIDS + "," + _DOCS + """
    select r.query_id, r.rank, d.doc_id as source_hash, d.title, d.doc_type, d.category, d.date
    from ranked r join docs d on r.item_id = d.item_id where r.rank <= 8 and d.category = 'en'""")
def doc_citations(spark, folder):
    """Answers cite the English documents, twice each, and one document that was not retrieved."""
    hits = vectors.search(centroids(spark, folder), catalog(spark, folder), size=SIZE, k=8).join(
        _payloads(spark, folder), "item_id")
    # what an answer names is reduced to retrieved documents, each once, in the order it names them
    given = hits.groupBy("query_id").agg(F.collect_set("doc_id").alias("shown"), F.transform(F.sort_array(F.collect_list(
        F.when(F.col("category") == "en", F.struct("rank", "doc_id")))), lambda h: h["doc_id"]).alias("named"))
    named = F.concat("named", F.array(F.lit("none")), "named")
    cited = given.select("query_id", F.explode(answers.distinct_in_order(named, F.col("shown"))).alias("doc_id"))
    return access.citations(hits, cited, ["query_id"]).withColumn("rank", F.col("rank").cast("long"))


_TWO_LISTS = """
    with first_list as (
        select label as query_id, vec_id as item_id, row_number() over (partition by label order by vec_id) as rank from embeddings),
    second_list as (
        select label as query_id, vec_id as item_id, row_number() over (partition by label order by embedding[1] desc, vec_id) as rank
        from embeddings),
    places as (
        select query_id, item_id, min((rank, list)) as place from (
            select query_id, item_id, rank, 0 as list from first_list where rank <= 8
            union all select query_id, item_id, rank, 1 from second_list where rank <= 8) group by 1, 2),
    merged as (select query_id, item_id, row_number() over (partition by query_id order by place) as merged_rank from places)"""


def _ranked_lists(spark, folder) -> list[DataFrame]:
    rows = star.table(spark, folder, "embeddings").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"), F.col("embedding")[0].alias("x"))
    by_id = Window.partitionBy("query_id").orderBy("item_id")
    by_x = Window.partitionBy("query_id").orderBy(F.desc("x"), "item_id")
    return [rows.withColumn("rank", F.row_number().over(w)).where("rank <= 8") for w in (by_id, by_x)]


@query("rank_merge", _TWO_LISTS + "select query_id, item_id, merged_rank from merged where merged_rank <= 10")
def rank_merge(spark, folder):
    merged = vectors.merge_rankings(_ranked_lists(spark, folder))
    return merged.withColumn("merged_rank", F.col("merged_rank").cast("long"))


# What a label's query should find: its vectors with the highest first number, as many as the least k.
_EXPECTED = """,
    expected as (select query_id, item_id from (
        select label as query_id, vec_id as item_id, row_number() over (partition by label order by embedding[1] desc, vec_id) as n from embeddings) where n <= 4),
    per_query as (
        select k, e.query_id, count(*) as expected, count(r.item_id) as found
        from expected e cross join (values (4), (6), (8)) as ks(k)
        left join (select * from ranked where rank <= 8) r on e.query_id = r.query_id and e.item_id = r.item_id and r.rank <= k group by 1, 2)"""


@query("retrieval_recall", _CENTROIDS + _EXPECTED + """
    select cast(k as bigint) as k, cast(count(*) as bigint) as questions,
           cast(count(*) filter (where found = expected) as double) / nullif(count(*), 0) as all_sources_found,
           cast(sum(found) as double) / nullif(sum(expected), 0) as source_recall from per_query group by 1""")
def retrieval_recall(spark, folder):
    """Four vectors of a label are expected for its query; recall at several cuts of one search."""
    retrieved = materialise(vectors.search(centroids(spark, folder), catalog(spark, folder), size=SIZE, k=8), "retrieved")
    best = Window.partitionBy("label").orderBy(F.desc(F.col("embedding")[0]), "vec_id")
    expected = star.table(spark, folder, "embeddings").withColumn("n", F.row_number().over(best)).where("n <= 4").select(
        F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"))
    return vectors.recall_at(retrieved, expected, [4, 6, 8])


@query("retrieval_misses", _CENTROIDS + """
    select e.label as query_id, e.vec_id as item_id from embeddings e
    where not exists (select 1 from ranked r where r.rank <= 10 and r.query_id = e.label and r.item_id = e.vec_id)""")
def retrieval_misses(spark, folder):
    retrieved = vectors.search(centroids(spark, folder), catalog(spark, folder), size=SIZE, k=10)
    return vectors.misses(retrieved, _expected(spark, folder))


def _expected(spark, folder) -> DataFrame:
    return star.table(spark, folder, "embeddings").select(F.col("label").alias("query_id"), F.col("vec_id").alias("item_id"))


_LETTERS = "etaoinsr"
_POINT_ID = """
    (select substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-5' || substr(h, 14, 3) || '-'
            || substr('89ab', cast(('0x' || substr(h, 17, 1))::int % 4 as int) + 1, 1) || substr(h, 18, 3) || '-' || substr(h, 21, 12)
     from (select sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({0})) as h))"""
_COUNTS = " || ',' || ".join(f"(length(text) - length(replace(text, '{c}', '')))" for c in _LETTERS)


def _embedded(spark, folder) -> DataFrame:
    documents = star.table(spark, folder, "documents").select(F.col("doc_id").cast("string").alias("doc_id"), "lang", "text")
    return vectors.embed(documents, vectors.LetterCountEmbedder(_LETTERS), "text")


def _vector_text(column: str) -> F.Column:
    return F.array_join(F.transform(column, lambda x: x.cast("long").cast("string")), ",")


@query("embed_batch", f"select cast(doc_id as varchar) as doc_id, {_COUNTS} as vector from documents")
def embed_batch(spark, folder):
    return _embedded(spark, folder).select("doc_id", _vector_text("vector").alias("vector"))


@query("embed_cache", star.sql(star.MCC) + f"""
    select mcc, description as text, {_COUNTS.replace("text", "description")} as vector from mcc""")
def embed_cache(spark, folder):
    """Category embeddings computed once, stored, and read back for later joins."""
    codes = star.mcc_codes(spark, folder).withColumnRenamed("description", "text")
    path = fresh_path(spark, "embedding-cache")
    vectors.embed(codes, vectors.LetterCountEmbedder(_LETTERS), "text").write.parquet(path)
    return spark.read.parquet(path).select("mcc", "text", _vector_text("vector").alias("vector"))


_SCORED = """
    select q.id as query_id, c.id as item_id, list_cosine_similarity(q.v, c.v) as score from q, c"""


def _counts_sql(text: str) -> str:
    return "[" + ", ".join(f"cast(length({text}) - length(replace({text}, '{c}', '')) as double)" for c in _LETTERS) + "]"


@query("resolve_category", star.sql(star.MCC) + f""",
    q as (select 'spending on ' || t as id, {_counts_sql("'spending on ' || t")} as v from (select distinct p_type as t from part)),
    c as (select mcc as id, {_counts_sql("description")} as v from mcc),
    s as ({_SCORED}),
    r as (select *, row_number() over (partition by query_id order by score desc, item_id) as rank from s)
    select query_id, item_id, round(score, 6) as score, rank from r where rank <= 5 and score >= 0.35""")
def resolve_category(spark, folder):
    """Questions, one per part type, against the stored category embeddings: five best, then the threshold."""
    embedder = vectors.LetterCountEmbedder(_LETTERS)
    codes = star.mcc_codes(spark, folder).withColumnRenamed("description", "text")
    stored = materialise(vectors.embed(codes, embedder, "text"), "category-embeddings")
    asked = star.table(spark, folder, "part").select(F.concat(F.lit("spending on "), "p_type").alias("query_id")).distinct()
    embedded = vectors.embed(asked.withColumn("text", F.col("query_id")), embedder, "text")
    return _shown(vectors.top_k(embedded, stored, vectors.DEFAULT_TOP_K, size=len(_LETTERS), threshold=vectors.DEFAULT_THRESHOLD, item_id="mcc"))


@query("retrieve_documents", f"""
    with q as (select item_id as qid, w, 'q' || item_id || w as id, {_counts_sql("text")} as v from (
        select item_id, 'rewritten' as w, 'about ' || text as text from benchmark union all select item_id, 'asked', text from benchmark)),
    c as (select doc_id as id, {_counts_sql("text")} as v from documents),
    s as (select qid, w, item_id, case when isnan(score) then 0.0 else score end as score from (
        select q.qid, q.w, c.id as item_id, list_cosine_similarity(q.v, c.v) as score from q, c)),
    r as (select *, row_number() over (partition by qid, w order by score desc, cast(item_id as varchar)) as rank from s),
    places as (select qid, item_id, min((rank, case w when 'rewritten' then 0 else 1 end)) as place from r where rank <= 6 group by 1, 2),
    m as (select qid, item_id, row_number() over (partition by qid order by place) as rank from places)
    select m.qid as query_id, m.rank, cast(m.item_id as varchar) as source_hash, 'Document ' || m.item_id as title, d.source as doc_type, d.lang as category
    from m join documents d on d.doc_id = m.item_id where m.rank <= 6""")
def retrieve_documents(spark, folder):
    """From question to citations: documents are embedded and upserted, each question is embedded as asked and
    as rewritten, both searches are merged, and the six best are cited through the safe payload."""
    embedder = vectors.LetterCountEmbedder(_LETTERS)
    documents = star.table(spark, folder, "documents").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.col("lang").alias("category"), F.col("source").alias("doc_type"), "text")
    fields = ["doc_id", "title", "category", "doc_type", "text"]
    incoming = vectors.points(vectors.embed(documents, embedder, "text"), "doc_id", len(_LETTERS), fields)
    stored = materialise(vectors.upsert(incoming.limit(0), incoming), "document-vectors").select("payload.*", "vector")
    asked = star.table(spark, folder, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    lists = [vectors.search(vectors.embed(q, embedder, "text"), stored, size=len(_LETTERS), k=6, item_id="doc_id") for q in (
        asked.withColumn("text", F.concat(F.lit("about "), "text")), asked)]
    hits = vectors.merge_rankings(lists, cap=6).withColumnsRenamed({"item_id": "doc_id", "merged_rank": "rank"}).join(stored.drop("vector"), "doc_id")
    safe = access.safe_payload(hits)
    shown = access.citations(safe, safe.select("query_id", "doc_id"), ["query_id"])
    return shown.select("query_id", F.col("rank").cast("long").alias("rank"), "source_hash", "title", "doc_type", "category")


@query("point_ids", f"select doc_id, {_POINT_ID.format('cast(doc_id as varchar)')} as point_id from documents")
def point_ids(spark, folder):
    return star.table(spark, folder, "documents").select("doc_id", point_id(F.col("doc_id")).alias("point_id"))


@query("vec_upsert", f"""
    select {_POINT_ID.format('cast(doc_id as varchar)')} as point_id, cast(doc_id as varchar) as doc_id,
           case when lang = 'en' then 'new' else 'old' end as revision, {_COUNTS} as vector from documents""")
def vec_upsert(spark, folder):
    """All documents are stored, then the English ones arrive again, each twice, in two upserts."""
    embedded = _embedded(spark, folder)

    def stored(rows, revision):
        return vectors.points(rows.withColumn("revision", F.lit(revision)), "doc_id", len(_LETTERS), ["doc_id", "revision"])

    first = stored(embedded, "old")
    incoming = stored(embedded.where("lang = 'en'"), "new")
    incoming = incoming.unionByName(incoming)  # every point twice in one input
    table = vectors.upsert(vectors.upsert(first, incoming), incoming)
    return table.select("point_id", "payload.doc_id", "payload.revision", _vector_text("vector").alias("vector"))


@query("vec_dim_check", """
    select cast(count(*) as bigint) as row_count, cast(count(*) filter (where label = 3 or label = 4) as bigint) as violations
    from embeddings""")
def vec_dim_check(spark, folder):
    shortened = F.when(F.col("label") == 3, F.slice("embedding", 1, 63)).when(F.col("label") != 4, F.col("embedding"))
    return vectors.dimension_violations(
        star.table(spark, folder, "embeddings").select(shortened.alias("vector")), "vector", SIZE)


@query("join_corpus_manifest", r"""
    select cast(doc_id as varchar) as doc_id, md5('T ' || doc_id || chr(10) || chr(10) ||
           regexp_replace(regexp_replace(text, '^\s+', ''), '\s+$', '')) as embedding_digest,
           source || '|' || lang as entities, 'About ' || lang as summary from documents""")
def join_corpus_manifest(spark, folder):
    texts, manifest = _corpus(spark, folder)
    prepared = corpus.load_corpus(texts, manifest)
    return prepared.select(
        "doc_id", F.md5(F.col("embedding_text").cast("binary")).alias("embedding_digest"),
        F.array_join("payload.entities", "|").alias("entities"), F.col("payload.summary").alias("summary"))


@query("corpus_problems", """
    select cast(doc_id as varchar) as doc_id, 'duplicate doc_id in corpus' as problem from documents where lang = 'de'
    union all select cast(doc_id as varchar), 'missing from the manifest' from documents where lang = 'fr'""")
def corpus_problems(spark, folder):
    """German texts come twice, French ones are not listed."""
    texts, manifest = _corpus(spark, folder)
    return corpus.corpus_problems(
        texts.unionByName(texts.where("category = 'de'")), manifest.where("category <> 'fr'"))


def _corpus(spark, folder) -> tuple[DataFrame, DataFrame]:
    documents = star.table(spark, folder, "documents").withColumn("doc_id", F.col("doc_id").cast("string"))
    texts = documents.select(
        "doc_id", F.concat(F.lit("T "), "doc_id").alias("title"), F.col("lang").alias("category"),
        F.col("source").alias("doc_type"), F.lit("2026-01-01").alias("date"), F.col("source").alias("source_file"), "text")
    manifest = documents.select(
        "doc_id", F.col("lang").alias("category"), F.concat("source", F.lit("; "), "lang", F.lit(" ;")).alias("entities"),
        F.concat(F.lit("About "), "lang").alias("summary"))
    return texts, manifest


# A caller who may see the chunks of some labels asks with each label's mean vector and three words.
_SCOPES = ["team-0", "team-1", "team-2", "team-3"]


@query("scoped_search", _CENTROIDS + """,
    chunks as (
        select e.vec_id as item_id, e.embedding, coalesce(d.text, '') as text from embeddings e left join documents d on d.doc_id = e.vec_id
        where e.label in (0, 1, 2, 3) and e.embedding[1] > -1 and e.embedding[2] > -1),
    near as (
        select q.query_id, c.item_id, c.text, list_cosine_similarity(q.v, c.embedding::double[]) as score from q, chunks c
        qualify row_number() over (partition by q.query_id order by score desc, c.item_id) <= 30),
    again as (
        select query_id, item_id, score, len(list_intersect(['the', 'und', 'que'],
            string_split(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13),
                                   'abcdefghijklmnopqrstuvwxyz     '), ' '))) / 3.0::double as lexical from near)
    select query_id, item_id, round(score, 6) as score, round(lexical, 6) as lexical, round(0.7 * score + 0.3 * lexical, 6) as final, rank from (
        select *, row_number() over (partition by query_id order by (1 - 0.3::double) * score + 0.3::double * lexical desc, item_id) as rank from again)
    where rank <= 8""")
def scoped_search(spark, folder):
    """Scope, status and version first, as pruned folders; then exact search; then a second ranking of thirty."""
    texts = star.table(spark, folder, "documents").select(F.col("doc_id").alias("item_id"), "text")
    chunks = star.table(spark, folder, "embeddings").select(
        F.col("vec_id").alias("item_id"), F.col("embedding").alias("vector"),
        F.concat(F.lit("team-"), F.col("label").cast("string")).alias("access_scope"),
        F.when(F.col("embedding")[0] > -1, "active").otherwise("withdrawn").alias("status"), (F.col("embedding")[1] > -1).alias("is_current"))
    store = corpus.store_chunks(
        chunks.join(texts, "item_id", "left").withColumn("text", F.coalesce("text", F.lit(""))), fresh_path(spark, "chunks"), size=SIZE, block_rows=200)
    questions = centroids(spark, folder).withColumn("words", F.array(F.lit("the"), F.lit("und"), F.lit("que")))
    found = corpus.scoped_search(store, questions, _SCOPES, 8, candidates=30)
    return _shown(found).withColumn("lexical", F.round("lexical", 6)).withColumn("final", F.round("final", 6))
