"""Registered retrieval queries: the documents are the corpus, the benchmark passages the questions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gleaner.functions.text import tokens
from gleaner.operators import assembly, blocks, dense, fusion, index, inverted_lists, latent, search, snapshots
from gleaner.session import new_folder, small_side, write_table
from gleaner.sources.tables import Tables, benchmark_questions, named_documents, vector_corpus


def _inputs(spark: SparkSession, folder: str):
    t = Tables(spark, folder)
    return benchmark_questions(t.benchmark), named_documents(t.documents)


_indexes: dict[tuple[str, str], str] = {}


def _content_key(spark: SparkSession, docs: DataFrame) -> tuple[str, str]:
    """The session and the fingerprint of the documents: other documents are another index."""
    return spark.sparkContext.applicationId, snapshots.fingerprint(snapshots.document_hashes(docs)).first().fingerprint


def written_index(spark: SparkSession, folder: str) -> index.Index:
    """The corpus is indexed once per session and content, then only read."""
    docs = named_documents(Tables(spark, folder).documents)
    key = _content_key(spark, docs)
    if key not in _indexes:
        _indexes[key] = new_folder(spark, "index")
        index.build_index(docs, _indexes[key])
    return index.read_index(spark, _indexes[key])


def build_index(spark: SparkSession, folder: str) -> tuple[index.Index, int]:
    """Index the corpus anew and make that the session's index of it."""
    path = new_folder(spark, "index")
    docs = named_documents(Tables(spark, folder).documents)
    chunks = index.build_index(docs, path)
    _indexes[_content_key(spark, docs)] = path
    return index.read_index(spark, path), chunks


def ranked(rows: DataFrame) -> DataFrame:
    return rows.select("q_id", "doc_id", F.col("rank").cast("long").alias("rank"), F.round("score", 6).alias("score"))


def corpus_scan(spark, folder):
    docs = named_documents(Tables(spark, folder).documents)
    return docs.select("doc_id", "file_name", F.length("text").cast("long").alias("n_chars"), F.md5("text").alias("text_md5"))


def tokenize(spark, folder):
    words = tokens(F.col("text"))
    return Tables(spark, folder).documents.select(
        "doc_id", F.size(words).cast("long").alias("n_tokens"), F.md5(F.array_join(words, " ")).alias("tokens_md5")
    )


def bm25_stats(spark, folder):
    _, docs = _inputs(spark, folder)
    counted = write_table(index.counted_words(docs), "counted")
    terms = write_table(index.doc_frequencies(counted.where("term is not null")), "terms")
    stats = write_table(index.corpus_stats(counted.where("opens is not null"), terms), "stats")
    n_docs, avg_dl, mean_idf = (stats.select(c).scalar() for c in ("n_docs", "avg_dl", "mean_idf"))
    return terms.select(
        "term",
        "df",
        F.round(search.bm25_idf(F.col("df"), n_docs, mean_idf, 0.25), 6).alias("idf"),
        n_docs.alias("n_docs"),
        F.round(avg_dl, 6).alias("avg_dl"),
    )


def bm25_topk(spark, folder):
    questions, docs = _inputs(spark, folder)
    return ranked(search.bm25_topk(questions, written_index(spark, folder)))


# Documents of one block: small, as the given corpora are.
BLOCK_DOCS = 16


def bm25_topk_blocks(spark, folder):
    """The rows of bm25_topk, from postings in blocks that are skipped by their largest impact."""
    questions, docs = _inputs(spark, folder)
    idx, path = written_index(spark, folder), new_folder(spark, "packed")
    blocks.build_blocks(idx, path, block_docs=BLOCK_DOCS)
    return ranked(blocks.bm25_topk_blocks(questions, blocks.read_blocks(spark, path, idx)))


def tfidf_cosine_topk(spark, folder):
    questions, docs = _inputs(spark, folder)
    return ranked(search.tfidf_topk(questions, written_index(spark, folder)))


def tfidf_vectors(spark, folder):
    _, docs = _inputs(spark, folder)
    return index.tfidf_vectors(docs).select("doc_id", "term", F.round("weight", 6).alias("weight"))


def _lists(spark, folder):
    questions, _ = _inputs(spark, folder)
    idx = written_index(spark, folder)
    return questions, idx, search.tfidf_topk(questions, idx), search.bm25_topk(questions, idx)


def rrf_fuse(spark, folder):
    *_, vectors, words = _lists(spark, folder)
    return ranked(fusion.rrf_fuse(vectors, words))


def rrf_dense_only(spark, folder):
    """Fusion with an empty second list keeps the first list's order."""
    questions, docs = _inputs(spark, folder)
    vectors = search.tfidf_topk(questions, written_index(spark, folder))
    return ranked(fusion.rrf_fuse(vectors, vectors.where(F.lit(False))))


def rerank_topk(spark, folder):
    questions, idx, vectors, words = _lists(spark, folder)
    fused = write_table(fusion.rrf_fuse(vectors, words), "candidates")
    return ranked(fusion.rerank(fused, fusion.word_overlap(fused, questions, idx)))


def rerank_fallback(spark, folder):
    *_, vectors, words = _lists(spark, folder)
    return ranked(fusion.rerank(fusion.rrf_fuse(vectors, words), None))


def _best(spark, folder):
    questions, docs = _inputs(spark, folder)
    return questions, docs, fusion.hybrid_retrieve(questions, written_index(spark, folder))


def hybrid_retrieve(spark, folder):
    return _best(spark, folder)[2]


def citations(spark, folder):
    """Citations name the source of each document, so names repeat and are cited once."""
    *_, best = _best(spark, folder)
    sources = Tables(spark, folder).documents.select("doc_id", F.col("source").alias("file_name"))
    cited = fusion.citations(sources.join(small_side(best.drop("file_name"), "cited"), "doc_id"))
    return cited.select("q_id", F.array_join("citations", ", ").alias("citations"))


def context_block(spark, folder):
    _, docs, best = _best(spark, folder)
    blocks = assembly.context_blocks(best, docs)
    return blocks.select("q_id", F.length("context").cast("long").alias("n_chars"), F.md5("context").alias("context_md5"))


def prompt_build(spark, folder):
    questions, docs, best = _best(spark, folder)
    prompts = assembly.prompts(questions, assembly.context_blocks(best, docs))
    return prompts.select("q_id", F.length("content").cast("long").alias("n_chars"), F.md5("content").alias("content_md5"))


def recall_at_k(spark, folder):
    """How many questions have a document among their best five that quotes them whole, and their share."""
    return _quoted(*_best(spark, folder))


def _quoted(questions, docs, best):
    quoted = F.contains(F.lower("text"), F.lower("question"))
    asked = small_side(best.select("q_id", "doc_id").join(questions, "q_id"), "answered")
    found = docs.join(asked, "doc_id").where(quoted).select("q_id").distinct()
    marked = questions.select("q_id").join(found.withColumn("found", F.lit(1)), "q_id", "left")
    return marked.agg(F.count(F.lit(1)).alias("n_questions"), F.count("found").alias("n_found")).withColumn(
        "recall", F.round(F.try_divide("n_found", "n_questions"), 6)
    )


_latents: dict[tuple[str, str], str] = {}


def _written_latent(spark, folder):
    """The index and its words' and documents' dense vectors, made once per session and content."""
    idx = written_index(spark, folder)
    key = _content_key(spark, named_documents(Tables(spark, folder).documents))
    if key not in _latents:
        path = new_folder(spark, "latent")
        latent.build_latent(idx, path)
        _latents[key] = path
    return idx, latent.read_latent(spark, _latents[key])


def latent_vectors(spark, folder):
    """Every document's dense vector, made of the tf-idf matrix' leading singular vectors."""
    vectors = _written_latent(spark, folder)[1].docs
    squares = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x * x)
    return vectors.select("doc_id", F.size("vector").alias("n_dims"), F.round(F.sqrt(squares), 6).alias("length"), F.transform("vector", lambda x: F.round(x, 6)).alias("vector"))


def _latent_list(spark, folder):
    questions, _ = _inputs(spark, folder)
    idx, vectors = _written_latent(spark, folder)
    return questions, idx, dense.dense_topk(latent.question_vectors(questions, idx, vectors), vectors.docs, metric="cosine")


def latent_topk(spark, folder):
    """Nearest documents of every question over dense vectors of both."""
    return _latent_list(spark, folder)[2]


def hybrid_retrieve_latent(spark, folder):
    """Hybrid retrieval whose vector side are dense vectors."""
    questions, idx, near = _latent_list(spark, folder)
    return fusion.hybrid_retrieve(questions, idx, dense=near)


def latent_recall(spark, folder):
    """recall_at_k of hybrid retrieval over dense vectors."""
    questions, docs = _inputs(spark, folder)
    return _quoted(questions, docs, hybrid_retrieve_latent(spark, folder))


def _dense(spark, folder, search_fn, **options):
    corpus = vector_corpus(Tables(spark, folder).embeddings)
    asked = dense.label_means(corpus).select(F.col("label").cast("long").alias("q_id"), "vector")
    return search_fn(asked, corpus, **options).select("q_id", "doc_id", "distance", "rank")


def dense_topk_l2(spark, folder):
    return _dense(spark, folder, dense.dense_topk)


def dense_topk_cosine(spark, folder):
    return _dense(spark, folder, dense.dense_topk, metric="cosine")


def dense_topk_lsh(spark, folder):
    return _dense(spark, folder, dense.dense_topk_lsh)


_lists_of: dict[tuple, str] = {}


def _every_twentieth(spark, folder):
    corpus = vector_corpus(Tables(spark, folder).embeddings)
    return corpus, corpus.where("doc_id % 20 = 0").select(F.col("doc_id").alias("q_id"), "vector")


def _content_of(spark, corpus) -> tuple:
    return spark.sparkContext.applicationId, *corpus.agg(F.count(F.lit(1)), F.sum(F.xxhash64("doc_id", "vector").cast("decimal(20,0)"))).first()


def _new_lists(spark, corpus) -> inverted_lists.Lists:
    path = new_folder(spark, "inverted")
    inverted_lists.build_lists(corpus, path)
    _lists_of[_content_of(spark, corpus)] = path
    return inverted_lists.read_lists(spark, path)


def _written_lists(spark, corpus) -> inverted_lists.Lists:
    """The vectors are filed once per session and content, then only searched."""
    path = _lists_of.get(_content_of(spark, corpus))
    return inverted_lists.read_lists(spark, path) if path else _new_lists(spark, corpus)


def inverted_lists_build(spark, folder):
    """The lists of a new index with their sizes, and how many of them a question probes."""
    built = _new_lists(spark, vector_corpus(Tables(spark, folder).embeddings))
    return built.lists.groupBy("list").agg(F.count(F.lit(1)).alias("n_rows"), F.min("doc_id").alias("first_id")).withColumn("probes", F.lit(built.probes))


def dense_neighbours(spark, folder):
    """Exact neighbours of every twentieth vector."""
    corpus, asked = _every_twentieth(spark, folder)
    return dense.dense_topk(asked, corpus)


def dense_neighbours_lists(spark, folder):
    """The same questions answered from inverted lists."""
    corpus, asked = _every_twentieth(spark, folder)
    return inverted_lists.search_lists(asked, _written_lists(spark, corpus))


def inverted_lists_recall(spark, folder):
    """One row: how many of the exact neighbours of every twentieth vector the lists give."""
    exact, found = (write_table(f(spark, folder), "neighbours") for f in (dense_neighbours, dense_neighbours_lists))
    hits = exact.join(found.select("q_id", "doc_id", F.lit(1).alias("hit")), ["q_id", "doc_id"], "left")
    return hits.agg(F.count(F.lit(1)).alias("n_exact"), F.count("hit").alias("n_found")).withColumn("recall", F.round(F.try_divide("n_found", "n_exact"), 6))


QUERIES = {
    f.__name__: f
    for f in (
        corpus_scan, tokenize, bm25_stats, bm25_topk, bm25_topk_blocks, tfidf_cosine_topk, tfidf_vectors, rrf_fuse, rrf_dense_only,
        rerank_topk, rerank_fallback, hybrid_retrieve, citations, context_block, prompt_build, recall_at_k,
        dense_topk_l2, dense_topk_cosine, dense_topk_lsh,
        inverted_lists_build, dense_neighbours, dense_neighbours_lists, inverted_lists_recall,
        latent_vectors, latent_topk, hybrid_retrieve_latent, latent_recall,
    )
}

_DOCS = """docs AS (
  SELECT doc_id, 'doc_' || doc_id || '.md' AS file_name, text, source FROM documents
  WHERE length(regexp_replace(text, '\\s', '', 'g')) > 0
)"""
INDEX_OF_DOCS = """, doc_words AS (
  SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM docs
), lengths AS (SELECT doc_id, len(words) AS dl FROM doc_words),
counts AS (
  SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest(words) AS term FROM doc_words) GROUP BY ALL
), freq AS (SELECT term, count(*) AS df FROM counts GROUP BY term),
totals AS (SELECT count(*) AS n, sum(dl) / count(*) AS avg_dl FROM lengths),
raw_idf AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw, ln((n + 1.0) / (df + 1.0)) + 1 AS smooth FROM freq, totals),
mean AS (SELECT avg(raw) AS mean_idf FROM raw_idf),
idf AS (SELECT term, df, smooth, CASE WHEN raw < 0 THEN 0.25 * mean_idf ELSE raw END AS idf FROM raw_idf, mean)"""
_INDEX = _DOCS + INDEX_OF_DOCS
_VECTORS = """, norms AS (
  SELECT doc_id, sqrt(sum((tf * smooth) * (tf * smooth))) AS norm FROM counts JOIN idf USING (term) GROUP BY doc_id
), vectors AS (
  SELECT doc_id, term, tf * smooth / norm AS weight FROM counts JOIN idf USING (term) JOIN norms USING (doc_id)
)"""


def asked_sql(questions: str = "(SELECT item_id AS q_id, text AS question FROM benchmark)") -> str:
    return f""", asked AS (
  SELECT q_id, term, count(*) AS qtf FROM (
    SELECT q_id, unnest(regexp_extract_all(lower(question), '[a-z0-9_]+')) AS term FROM {questions}
  ) GROUP BY ALL
)"""


_ASKED = asked_sql()
BM25 = """, bm25 AS (
  SELECT q_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM asked JOIN idf USING (term) JOIN counts USING (term) JOIN lengths USING (doc_id), totals GROUP BY ALL
), bm25_top AS (
  SELECT * FROM (
    SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank
    FROM bm25 WHERE score > 0
  ) WHERE rank <= 20
)"""
_COSINE = """, asked_weights AS (
  SELECT q_id, term, qtf * (ln((n + 1.0) / (coalesce(df, 0) + 1.0)) + 1) AS w FROM asked LEFT JOIN freq USING (term), totals
), asked_norms AS (SELECT q_id, sqrt(sum(w * w)) AS q_norm FROM asked_weights GROUP BY q_id),
cosine AS (
  SELECT q_id, doc_id, round(sum(w / q_norm * weight), 6) AS score
  FROM asked_weights JOIN asked_norms USING (q_id) JOIN vectors USING (term) GROUP BY ALL
), cosine_top AS (
  SELECT * FROM (
    SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, doc_id) AS rank
    FROM cosine WHERE score > 0
  ) WHERE rank <= 20
)"""
_FUSED = """, fused_scores AS (
  SELECT q_id, doc_id, sum(1.0 / (60 + rank)) AS score, min(list_no * 1000 + rank) AS first_seen FROM (
    SELECT q_id, doc_id, rank, 0 AS list_no FROM cosine_top UNION ALL SELECT q_id, doc_id, rank, 1 FROM bm25_top
  ) GROUP BY ALL
), fused AS (
  SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, first_seen) AS rank FROM fused_scores
)"""
_BEST = """, shared_words AS (
  SELECT f.q_id, f.doc_id, f.rank AS fused_rank,
         round(count(c.term) / count(DISTINCT a.term), 6) AS score
  FROM fused f JOIN asked a ON a.q_id = f.q_id
  LEFT JOIN counts c ON c.doc_id = f.doc_id AND c.term = a.term GROUP BY ALL
), best AS (
  SELECT * FROM (
    SELECT q_id, doc_id, score, row_number() OVER (PARTITION BY q_id ORDER BY score DESC, fused_rank) AS rank FROM shared_words
  ) WHERE rank <= 5
)"""
_RETRIEVED = BM25 + _COSINE + _FUSED + _BEST
_ALL = "WITH " + _INDEX + _VECTORS + _ASKED + _RETRIEVED
_BLOCKS = """, blocks AS (
  SELECT q_id, chr(10) || chr(10) || '## Schema Context' || chr(10) || chr(10) ||
    string_agg('[Source: ' || file_name || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank) AS context
  FROM best JOIN docs USING (doc_id) GROUP BY q_id
)"""
_CONTEXT = _ALL + _BLOCKS


def context_sql(questions: str) -> str:
    """The CTEs up to `blocks` (q_id, context) for another table of (q_id, question)."""
    return _INDEX + _VECTORS + asked_sql(questions) + _RETRIEVED + _BLOCKS


_MEANS = """WITH means AS (
  SELECT label, pos, avg(value) AS value FROM (
    SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding::DOUBLE[]) AS value FROM embeddings
  ) GROUP BY label, pos
), asked AS (SELECT label::BIGINT AS q_id, list(value ORDER BY pos) AS q FROM means GROUP BY label),
pairs AS (SELECT q_id, q, vec_id AS doc_id, embedding::DOUBLE[] AS v FROM asked, embeddings)
SELECT q_id, doc_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, doc_id) AS rank FROM (
    SELECT q_id, doc_id, {distance} AS distance FROM pairs
  )
) WHERE rank <= 20"""

def _kmeans(rounds: int) -> str:
    """CTEs k1 to k`rounds` (list, c): Lloyd's rounds over whole numbers; a centroid that no row is nearest to stays."""
    found = ""
    for i in range(1, rounds + 1):
        found += f""", near{i} AS (
  SELECT x, arg_min(list, d) AS list FROM (
    SELECT id, x, list, list_inner_product(c, c) - 2 * list_inner_product(x, c) + list * 1e-4 AS d FROM sample, k{i - 1}
  ) GROUP BY id, x
), sums{i} AS (
  SELECT list, list(floor(s / n) ORDER BY pos) AS c FROM (
    SELECT list, pos, sum(v) AS s, count(*) AS n FROM (SELECT list, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM near{i}) GROUP BY ALL
  ) GROUP BY list
), k{i} AS (SELECT list, coalesce(s.c, k.c) AS c FROM k{i - 1} k LEFT JOIN sums{i} s USING (list))"""
    return found


_L2 = "round(list_sum(list_transform(range(1, len({a}) + 1), lambda i: ({a}[i] - {b}[i]) * ({a}[i] - {b}[i]))), 6)"
_EXACT = f"""exact AS (
  SELECT q_id, doc_id, distance, row_number() OVER (PARTITION BY q_id ORDER BY distance, doc_id) AS rank
  FROM (SELECT q.id AS q_id, h.id AS doc_id, {_L2.format(a="q.v", b="h.v")} AS distance FROM held q, held h WHERE q.id % 20 = 0)
)"""
# Distances of whole numbers; the fraction added to equal ones orders them by list.
_LISTS = """WITH held AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v, md5(vec_id::VARCHAR) AS h FROM embeddings),
size AS (
  SELECT count(*) AS n, least(4096, greatest(1, round(sqrt(count(*)))))::BIGINT AS n_lists,
         pow(2, 10 - floor(log2(sum(list_sum(list_transform(v, lambda t: abs(t)))) / sum(len(v))))) AS scale FROM held
), whole AS (
  SELECT id, h, list_transform(v, lambda t: greatest(-1048576, least(1048576, floor(t * scale + 0.5)))) AS x FROM held, size
), sample AS (
  SELECT id, h, x FROM whole, size WHERE '0' || h[1:8] < lpad(lower(hex(least(4294967296, ceil(4294967296 * 65536.0 / n))::BIGINT)), 9, '0')
), k0 AS (SELECT * FROM (SELECT row_number() OVER (ORDER BY h, id) - 1 AS list, x AS c FROM sample), size WHERE list < n_lists)""" + _kmeans(
    inverted_lists.ROUNDS
) + f""", ordered AS (
  SELECT id, list, row_number() OVER (
    PARTITION BY id ORDER BY list_inner_product(c, c) - 2 * list_inner_product(x, c), list
  ) AS place FROM whole, k{inverted_lists.ROUNDS}
), filed AS (SELECT id, list FROM ordered WHERE place = 1),
audited AS (SELECT id, v FROM held ORDER BY h, id LIMIT 64),
audit AS (
  SELECT q_id, doc_id FROM (
    SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, doc_id) AS rank FROM (
      SELECT a.id AS q_id, b.id AS doc_id, {_L2.format(a="a.v", b="b.v")} AS distance FROM audited a, held b WHERE a.id <> b.id
    )
  ) WHERE rank <= 20
), places AS (
  SELECT place, row_number() OVER (ORDER BY place) AS nth, count(*) OVER () AS n
  FROM audit JOIN filed ON filed.id = doc_id JOIN ordered o ON o.id = q_id AND o.list = filed.list
), probing AS (SELECT min(place) AS probes FROM places WHERE nth = ceil(0.95 * n - 1e-9)),
sizes AS (SELECT list, count(*) AS n_rows FROM filed GROUP BY list)"""
_FOUND = f""", reached AS (
  SELECT o.id AS q_id, o.list, place, coalesce(sum(coalesce(n_rows, 0)) OVER (PARTITION BY o.id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held_before
  FROM ordered o LEFT JOIN sizes USING (list) WHERE o.id % 20 = 0
), near AS (
  SELECT q_id, doc_id, distance, row_number() OVER (PARTITION BY q_id ORDER BY distance, doc_id) AS rank FROM (
    SELECT q_id, f.id AS doc_id, {_L2.format(a="q.v", b="h.v")} AS distance
    FROM reached r, probing JOIN filed f ON f.list = r.list JOIN held q ON q.id = q_id JOIN held h ON h.id = f.id
    WHERE place <= probes OR held_before < 20
  )
)"""

_STEP = "(x * x * x + 12345 * x + 6789) % 1000003"
_SIDES = """SELECT id, list(code ORDER BY tab) AS codes FROM (
    SELECT id, j // 8 AS tab, sum(CASE WHEN side > middle THEN 1 << (j % 8)::INTEGER ELSE 0 END)::BIGINT AS code
    FROM (SELECT id, j, list_sum(list_transform(range(1, len(v) + 1), lambda i: v[i] * w[i])) AS side FROM {rows}, planes)
    JOIN middles USING (j) GROUP BY ALL
  ) GROUP BY id"""
_LSH = """WITH means AS (
  SELECT label, pos, avg(value) AS value FROM (
    SELECT label, unnest(range(1, len(embedding) + 1)) AS pos, unnest(embedding::DOUBLE[]) AS value FROM embeddings
  ) GROUP BY label, pos
), asked AS (SELECT label::BIGINT AS id, list(value ORDER BY pos) AS v FROM means GROUP BY label),
held AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings),
numbers AS (
  SELECT j, d, j * 1009 + d AS x FROM range(128) a(j), range(1, (SELECT max(len(v)) FROM held) + 1) b(d)
), planes AS (
  SELECT j, list((x % 2001 - 1000)::DOUBLE ORDER BY d) AS w FROM (
    SELECT j, d, """ + _STEP + """ AS x FROM (SELECT j, d, """ + _STEP + """ AS x FROM (SELECT j, d, """ + _STEP + """ AS x FROM numbers))
  ) GROUP BY j
), centre AS (
  SELECT list(value ORDER BY pos) AS c FROM (
    SELECT pos, avg(value) AS value FROM (SELECT unnest(range(1, len(v) + 1)) AS pos, unnest(v) AS value FROM held) GROUP BY pos
  )
), middles AS (SELECT j, list_sum(list_transform(range(1, len(c) + 1), lambda i: c[i] * w[i])) AS middle FROM planes, centre),
asked_codes AS (""" + _SIDES.format(rows="asked") + """), held_codes AS (""" + _SIDES.format(rows="held") + """),
pairs AS (
  SELECT a.id AS q_id, h.id AS doc_id FROM asked_codes a, held_codes h
  WHERE len(list_filter(range(1, 17), lambda t: bit_count(xor(a.codes[t], h.codes[t])) <= 1)) > 0
), short AS (
  SELECT id AS q_id FROM asked LEFT JOIN pairs ON q_id = id GROUP BY id HAVING count(doc_id) < 20
), compared AS (
  SELECT q_id, doc_id FROM pairs WHERE q_id NOT IN (SELECT q_id FROM short)
  UNION ALL SELECT q_id, h.id FROM short, held h
)
SELECT q_id, doc_id, distance, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY q_id ORDER BY distance, doc_id) AS rank FROM (
    SELECT q_id, doc_id, round(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: (a.v[i] - h.v[i]) * (a.v[i] - h.v[i]))), 6) AS distance
    FROM compared JOIN asked a ON a.id = q_id JOIN held h ON h.id = doc_id
  )
) WHERE rank <= 20"""

TOP = " SELECT q_id, doc_id, rank, round(score, 6) AS score FROM "
ORACLES = {
    "corpus_scan": f"WITH {_DOCS} SELECT doc_id, file_name, length(text) AS n_chars, md5(text) AS text_md5 FROM docs",
    "tokenize": """SELECT doc_id, len(words) AS n_tokens, md5(array_to_string(words, ' ')) AS tokens_md5
        FROM (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9_]+') AS words FROM documents)""",
    "bm25_stats": f"""WITH {_INDEX} SELECT term, df, round(idf, 6) AS idf, n AS n_docs, round(avg_dl, 6) AS avg_dl
        FROM idf, totals""",
    "bm25_topk": "WITH " + _INDEX + _ASKED + BM25 + TOP + "bm25_top",
    "bm25_topk_blocks": "WITH " + _INDEX + _ASKED + BM25 + TOP + "bm25_top",
    "tfidf_vectors": "WITH " + _INDEX + _VECTORS + " SELECT doc_id, term, round(weight, 6) AS weight FROM vectors",
    "tfidf_cosine_topk": "WITH " + _INDEX + _VECTORS + _ASKED + _COSINE + TOP + "cosine_top",
    "rrf_fuse": _ALL + TOP + "fused",
    "rrf_dense_only": _ALL + " SELECT q_id, doc_id, rank, round(1.0 / (60 + rank), 6) AS score FROM cosine_top",
    "rerank_topk": _ALL + TOP + "best",
    "rerank_fallback": _ALL + TOP + "fused WHERE rank <= 5",
    "hybrid_retrieve": _ALL + " SELECT q_id, rank, doc_id, file_name, score FROM best JOIN docs USING (doc_id)",
    "citations": _ALL + """ SELECT q_id, string_agg(source, ', ' ORDER BY first_rank) AS citations FROM (
        SELECT q_id, source, min(rank) AS first_rank FROM best JOIN docs USING (doc_id) GROUP BY ALL) GROUP BY q_id""",
    "context_block": _CONTEXT + " SELECT q_id, length(context) AS n_chars, md5(context) AS context_md5 FROM blocks",
    "prompt_build": _CONTEXT + """ SELECT q_id, length(content) AS n_chars, md5(content) AS content_md5 FROM (
        SELECT item_id AS q_id, regexp_replace(coalesce(context, '') || chr(10) || chr(10) || '## Question' || chr(10) || text,
          '^\\s+|\\s+$', '', 'g') AS content FROM benchmark LEFT JOIN blocks ON q_id = item_id)""",
    "recall_at_k": _ALL + """ SELECT count(*) AS n_questions, count(found) AS n_found, round(count(found) / count(*), 6) AS recall
        FROM benchmark LEFT JOIN (
          SELECT DISTINCT q_id, 1 AS found FROM best JOIN docs USING (doc_id) JOIN benchmark b ON b.item_id = q_id
          WHERE contains(lower(docs.text), lower(b.text))) ON q_id = item_id""",
    "dense_topk_l2": _MEANS.format(
        distance="round(list_sum(list_transform(range(1, len(q) + 1), lambda i: (q[i] - v[i]) * (q[i] - v[i]))), 6)"
    ),
    "dense_topk_lsh": _LSH,
    "inverted_lists_build": _LISTS + """ SELECT list, n_rows, first_id, probes
        FROM sizes JOIN (SELECT list, min(id) AS first_id FROM filed GROUP BY list) USING (list), probing""",
    "dense_neighbours": f"WITH held AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings), {_EXACT} SELECT * FROM exact WHERE rank <= 20",
    "dense_neighbours_lists": _LISTS + _FOUND + " SELECT q_id, doc_id, distance, rank FROM near WHERE rank <= 20",
    "inverted_lists_recall": _LISTS + _FOUND + f""", {_EXACT} SELECT count(*) AS n_exact, count(near.q_id) AS n_found, round(count(near.q_id) / count(*), 6) AS recall
        FROM exact LEFT JOIN near ON near.q_id = exact.q_id AND near.doc_id = exact.doc_id AND near.rank <= 20 WHERE exact.rank <= 20""",
    "dense_topk_cosine": _MEANS.format(distance="round(1 - list_cosine_similarity(q, v), 6)"),
}
