"""The engine's operators over the standard tables, each with the same result in SQL.

Vectors stand for chunks, documents for chunk texts and files, benchmark items for search queries, events for
votes on notes (users as notes), orders for files and work items, lineitem for line ranges."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import constants as K
from ..functions import text as T
from ..functions import vectors as V
from ..functions.hashing import xxh64_hex
from ..functions.keeping import keep, shared_folder
from ..operators import capture, evaluation, hashed, ingest, lexicon, notes, search, store, work
from ..streaming import note_state

NOW = 1_706_745_600  # 2024-02-01T00:00:00Z
DIM = 64

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def seconds(ts):
    """Seconds since 1970 of a time without zone, whatever the session's zone."""
    ts = F.col(ts) if isinstance(ts, str) else ts
    return F.unix_date(ts.cast("date")).cast("long") * 86_400 + F.hour(ts) * 3600 + F.minute(ts) * 60 + F.second(ts)


def _vectors(spark, d) -> tuple[DataFrame, DataFrame]:
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("query_id"), "embedding", F.col("label").alias("scope")), e.select(F.col("vec_id").alias("chunk_id"), "embedding", F.col("label").alias("scope"))


_COS = "round(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), 6)"
_E = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings)"


@query(f"{_E} SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS distance FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), b.vec_id) <= 10")
def dense_knn(spark, d):
    q, c = _vectors(spark, d)
    return search.nearest(q, c, 10, exclude=F.col("query_id") == F.col("chunk_id")).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query(f"{_E} SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} AS distance FROM e a JOIN e b ON a.label = b.label AND a.vec_id <> b.vec_id QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), b.vec_id) <= 5")
def dense_knn_scoped(spark, d):
    q, c = _vectors(spark, d)
    return search.nearest(q, c, 5, scoped=True, exclude=F.col("query_id") == F.col("chunk_id")).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


_BITS = "(SELECT vec_id, embedding, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS bits FROM embeddings)"


@query(
    f"""WITH e AS {_BITS}, q AS (SELECT * FROM e WHERE vec_id % 20 = 0),
h AS (SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, bit_count(xor(q.bits, e.bits)) AS h, q.embedding AS a, e.embedding AS b FROM q, e
  QUALIFY row_number() OVER (PARTITION BY q.vec_id ORDER BY bit_count(xor(q.bits, e.bits)), e.vec_id) <= 200)
SELECT query_id, chunk_id, round(1 - list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 6) AS distance FROM h
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), chunk_id) <= 10"""
)
def binary_coarse(spark, d):
    """Every vector whose id is divisible by 20 against all."""
    q, c = _vectors(spark, d)
    return search.nearest_coarse(q.where("query_id % 20 = 0"), c, 10, DIM).select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query(f"WITH e AS {_BITS} SELECT q.vec_id AS query_id, e.vec_id AS chunk_id, bit_count(xor(q.bits, e.bits))::INTEGER AS h FROM e q, e WHERE bit_count(xor(q.bits, e.bits)) <= 19")
def hamming_within(spark, d):
    """All pairs of vectors whose sign bits differ in at most 19 of 64 places; a reach that wide compares all codes."""
    q, c = _vectors(spark, d)
    return hashed.within(q, c, DIM, 19, hashed.pieces(DIM, 19, 4))


_TURNED = """t AS (SELECT vec_id * 20 + i AS chunk_id, list_concat(embedding[i + 1:], embedding[:i]) AS embedding FROM embeddings, range(20) r(i)),
e AS (SELECT *, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '')::BIT AS bits FROM t), q AS (SELECT * FROM e WHERE chunk_id % 400 = 0)"""


@query(
    f"""WITH {_TURNED}, h AS (SELECT q.chunk_id AS query_id, e.chunk_id, q.embedding AS a, e.embedding AS b FROM q, e WHERE q.chunk_id <> e.chunk_id
  QUALIFY row_number() OVER (PARTITION BY q.chunk_id ORDER BY bit_count(xor(q.bits, e.bits)), e.chunk_id) <= (SELECT if(count(*) > 8192, 200, count(*)) FROM e))
SELECT query_id, chunk_id, round(1 - list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), 6) AS distance FROM h
QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY 1 - list_cosine_similarity(a::DOUBLE[], b::DOUBLE[]), chunk_id) <= 10"""
)
def adaptive_legs(spark, d):
    """Vectors whose id is divisible by 20 against every vector in twenty turns: by the size of that, exact or in two phases."""
    e = table(spark, d, "embeddings").select("vec_id", "embedding", F.explode(F.sequence(F.lit(0), F.lit(19))).alias("i"))
    turned = F.concat(F.slice("embedding", F.col("i") + 1, DIM), F.slice("embedding", F.lit(1), F.col("i")))
    c = e.select((F.col("vec_id") * 20 + F.col("i")).alias("chunk_id"), turned.alias("embedding"))
    q = c.where("chunk_id % 400 = 0").withColumnRenamed("chunk_id", "query_id")
    found = search.nearest_adaptive(q, c, 10, DIM, exclude=F.col("query_id") == F.col("chunk_id"))
    return found.select("query_id", "chunk_id", F.round("distance", 6).alias("distance"))


@query()
def recall_to_target(spark, d):
    """The recall that a search to a target of 0.95 reaches, and its radius of sign bits, over every vector whose id is
    divisible by 20; a vector is not its own neighbour."""
    q, c = _vectors(spark, d)
    q, own = q.where("query_id % 20 = 0"), F.col("query_id") == F.col("chunk_id")
    radius = hashed.fit_radius(q, c, 10, DIM, 0.95, own)
    reached = evaluation.ann_recall(search.nearest(q, c, 10, exclude=own), hashed.nearest_to_recall(q, c, 10, DIM, 0.95, own), 10)
    return reached.agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(radius).alias("radius"), F.lit(hashed.plan(DIM, radius) is not None).alias("by_hashing"), "recall")


@query(f"{_E} SELECT a.vec_id AS note_id, round(greatest(0, least(2, coalesce(min(1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e)))), 1))), 6) AS surprise FROM e a LEFT JOIN e b ON b.vec_id % 2 = 0 OR b.vec_id < a.vec_id WHERE a.vec_id % 2 = 1 GROUP BY 1")
def batch_surprise(spark, d):
    """Odd vectors as a batch of new notes in the order of their ids, against the even ones, which are stored, and each other."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("note_id"), "embedding")
    new = e.where("note_id % 2 = 1").withColumn("seq", F.col("note_id"))
    return notes.surprises(new, e.where("note_id % 2 = 0")).select("note_id", F.round("surprise", 6).alias("surprise"))


@query()
def ann_recall_curve(spark, d):
    """Recall of the two-phase scan by the size of its first phase, over every vector whose id is divisible by 20; a vector
    is not its own neighbour."""
    q, c = _vectors(spark, d)
    q, own = q.where("query_id % 20 = 0"), F.col("query_id") == F.col("chunk_id")
    exact = keep(search.nearest(q, c, 10, exclude=own))
    sizes = (100, 200, 400, 800, 1600)
    met = keep(search.coarse(q, c, DIM, max(sizes), own))  # a smaller first phase is its beginning
    out = None
    for n in sizes:
        found = search.top(met.where(F.col("coarse") < n).select("query_id", "chunk_id", "distance"), ["query_id"], ["distance", "chunk_id"], 10)
        r = evaluation.ann_recall(exact, found, 10).agg(F.round(F.avg("recall"), 6).alias("recall")).select(F.lit(n).alias("coarse_k"), "recall")
        out = r if out is None else out.unionByName(r)
    return out


_TOK = r"regexp_split_to_array({}, '[^\p{{L}}\p{{N}}_:]+')"
_TERMS = r"list_filter(regexp_split_to_array(translate(lower({}), 'àáâãäåçèéêëìíîïñòóôõöùúûüýÿ', 'aaaaaaceeeeiiiinooooouuuuyy'), '[^\p{{L}}\p{{N}}]+'), lambda t: t <> '')"
_BM25 = f"""
WITH toks AS (SELECT item_id, list_filter({_TOK.format('text')}, lambda t: strlen(t) >= 2)[1:12] AS ts FROM benchmark),
qt AS (SELECT item_id, p, ts[p] AS tok FROM (SELECT item_id, ts, unnest(range(1, len(ts) + 1)) AS p FROM toks)),
q AS (SELECT item_id, p, ({_TERMS.format('tok')})[1] AS term, strlen(tok) >= 4 AS pre FROM qt),
w AS (SELECT doc_id, unnest({_TERMS.format('text')}) AS term FROM documents),
tf AS (SELECT doc_id, term, count(*) AS n FROM w GROUP BY ALL),
dl AS (SELECT doc_id, sum(n) AS len FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n_all, sum(len) AS len_all FROM dl),
v AS (SELECT DISTINCT term FROM tf),
m AS (SELECT q.item_id, q.p, v.term FROM q JOIN v ON CASE WHEN q.pre THEN starts_with(v.term, q.term) ELSE v.term = q.term END),
f AS (SELECT item_id, p, doc_id, sum(n) AS f FROM m JOIN tf USING (term) GROUP BY ALL),
idf AS (SELECT item_id, p, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id AS chunk_id, -sum(greatest(1e-6, ln((n_all - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len * n_all / len_all))) AS score
  FROM f JOIN idf USING (item_id, p) JOIN dl USING (doc_id), st GROUP BY ALL),
lexical AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 6), chunk_id) - 1 AS rank FROM s QUALIFY rank < {{}})"""


_INDEXED: dict[tuple, str] = {}


def _index(spark, d, name: str, chunks: DataFrame, fields: list[str]) -> lexicon.Index:
    """The kept index of chunks: written by the first query of a session that asks for it, read by all."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _INDEXED:
        folder = f"{shared_folder(spark)}/lexicon-{uuid.uuid4().hex}"
        lexicon.write_segment(chunks, folder, fields)
        _INDEXED[key] = folder
    return lexicon.read_segment(spark, _INDEXED[key])


def _lexical(spark, d, k=10):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))
    c = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    return lexicon.search_index(q, _index(spark, d, "content", c, ["content"]), k)


_FIELDS = f"""
WITH d AS (SELECT doc_id, text AS content, source AS symbol, lang || '/' || source || '/' || doc_id AS relpath FROM documents),
toks AS (SELECT item_id, list_filter({_TOK.format("text || ' src_' || (item_id % 20) || ' ' || coalesce(array_to_string(string_split(text, ' ')[3:4], '_'), '')")}, lambda t: strlen(t) >= 2) AS ts FROM benchmark),
qt AS (SELECT item_id, p, ts[p] AS tok FROM (SELECT item_id, list_concat(ts[1:10], ts[-2:]) AS ts, unnest(range(1, 13)) AS p FROM toks)),
q AS (SELECT item_id, p, {_TERMS.format('tok')} AS terms, strlen(tok) >= 4 AS pre FROM qt WHERE tok IS NOT NULL),
part AS (SELECT doc_id, 'content' AS field, 1.0 AS w, {_TERMS.format('content')} AS terms FROM d UNION ALL SELECT doc_id, 'symbol', 2.0, {_TERMS.format('symbol')} FROM d UNION ALL SELECT doc_id, 'relpath', 2.5, {_TERMS.format('relpath')} FROM d),
w AS (SELECT doc_id, field, w, unnest(terms) AS term, unnest(range(1, len(terms) + 1)) AS pos FROM part),
dl AS (SELECT doc_id, sum(len(terms)) AS len FROM part GROUP BY doc_id),
st AS (SELECT count(*) AS n_all, sum(len) AS len_all FROM dl),
v AS (SELECT DISTINCT term FROM w),
m AS (SELECT item_id, p, i, len(terms) AS n, v.term FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS i FROM q) q JOIN v ON CASE WHEN pre AND i = len(terms) THEN starts_with(v.term, terms[i]) ELSE v.term = terms[i] END),
hit AS (SELECT item_id, p, doc_id, field, any_value(w) AS w, pos - i AS start FROM m JOIN w USING (term) GROUP BY item_id, p, n, doc_id, field, pos - i HAVING count(DISTINCT i) = n),
f AS (SELECT item_id, p, doc_id, sum(w) AS f FROM hit GROUP BY ALL),
idf AS (SELECT item_id, p, count(*) AS n FROM f GROUP BY ALL),
s AS (SELECT item_id AS query_id, doc_id AS chunk_id, round(-sum(greatest(1e-6, ln((n_all - n + 0.5) / (n + 0.5))) * f * 2.2 / (f + 1.2 * (1 - 0.75 + 0.75 * len * n_all / len_all))), 6) AS score
  FROM f JOIN idf USING (item_id, p) JOIN dl USING (doc_id), st GROUP BY ALL)"""


def _in_fields(spark, d, **of) -> DataFrame:
    """Items as queries over text, source and path: ten of their words, a source as a phrase, and two words as a phrase."""
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"), F.col("source").alias("symbol"), F.concat_ws("/", "lang", "source", F.col("doc_id").cast("string")).alias("relpath"))
    words = F.split("text", " ", -1)
    said = F.concat("text", F.lit(" src_"), (F.col("item_id") % 20).cast("string"), F.lit(" "), F.array_join(F.slice(words, 3, 2), "_"))
    tokens = T.query_tokens(said)
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), F.array_join(F.concat(F.slice(tokens, 1, 10), F.slice(tokens, -2, 2)), " ").alias("query"))
    return lexicon.search_index(q, _index(spark, d, "fields", docs, list(K.FIELD_WEIGHTS)), 10, **of).select("query_id", "chunk_id", "score")


_TEN = "QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score, chunk_id) <= 10"


@query(f"{_FIELDS} SELECT query_id, chunk_id, score FROM s {_TEN}")
def bm25_fields(spark, d):
    """Three fields, phrases of several terms and prefixes."""
    return _in_fields(spark, d)


@query(f"{_FIELDS} SELECT query_id, chunk_id, score FROM s JOIN d ON d.doc_id = s.chunk_id WHERE relpath ILIKE 'EN/src1%' {_TEN}")
def bm25_path_filter(spark, d):
    """The same below a path; statistics stay those of all."""
    return _in_fields(spark, d, prefix="EN/src1/")


@query(f"{_BM25.replace('{}', '10')} SELECT query_id, chunk_id, round(score, 6) AS score FROM lexical")
def bm25_search(spark, d):
    return _lexical(spark, d).select("query_id", "chunk_id", "score")


@query(
    f"""{_BM25.replace('{}', '50')}, e AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
dense AS (SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), b.vec_id) - 1 AS rank
  FROM e a SEMI JOIN benchmark ON a.vec_id = item_id, e b QUALIFY rank < 50),
tok AS (SELECT item_id, list_filter({_TOK.format('text')}, lambda t: strlen(t) >= 2) AS ts FROM benchmark),
r AS (SELECT item_id AS query_id, len(ts) <= 3 OR (len(ts) <= 6 AND len(list_filter(ts, lambda t: contains(t, '_') OR contains(t, '::') OR regexp_matches(t, '(?s)^\\p{{Ll}}.*\\p{{Lu}}'))) > 0) AS lex FROM tok),
fused AS (SELECT query_id, chunk_id, coalesce(CASE WHEN lex THEN 0.35 ELSE 0.7 END / (61 + dense.rank), 0) + coalesce(CASE WHEN lex THEN 0.65 ELSE 0.3 END / (61 + lexical.rank), 0) AS score
FROM dense FULL JOIN lexical USING (query_id, chunk_id) JOIN r USING (query_id))
SELECT query_id, chunk_id, round(score, 9) AS score FROM fused QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= 50"""
)
def rrf_fusion(spark, d):
    """The lexical leg with one of vectors, where the vector of an item's number stands for its query; 50 hits each."""
    q = table(spark, d, "benchmark")
    vectors, chunks = _vectors(spark, d)
    asked = vectors.join(q.select(F.col("item_id").alias("query_id")), "query_id", "left_semi")
    routes = q.select(F.col("item_id").alias("query_id"), T.route_query(F.col("text")).alias("r")).select("query_id", "r.*")
    fused = search.fuse(search.nearest(asked, chunks, K.CANDIDATES), _lexical(spark, d, K.CANDIDATES), routes)
    return fused.select("query_id", "chunk_id", F.round("score", 9).alias("score"))


@query(
    rf"""WITH t AS (SELECT item_id, list_filter({_TOK.format('text')}, lambda t: strlen(t) >= 2) AS ts FROM benchmark
  UNION ALL SELECT 1000000 + p_partkey, list_filter({_TOK.format('p_name')}, lambda t: strlen(t) >= 2) FROM part),
r AS (SELECT item_id, len(ts) AS n, len(ts) <= 3 OR (len(ts) <= 6 AND len(list_filter(ts, lambda t: contains(t, '_') OR contains(t, '::') OR regexp_matches(t, '(?s)^\p{{Ll}}.*\p{{Lu}}'))) > 0) AS lex FROM t)
SELECT item_id AS query_id, n::INTEGER AS n_tokens, CASE WHEN lex THEN 0.35 ELSE 0.7 END::DOUBLE AS dense_weight, CASE WHEN lex THEN 0.65 ELSE 0.3 END::DOUBLE AS lexical_weight, NOT lex AS natural_language FROM r"""
)
def route_queries(spark, d):
    q = table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text").union(table(spark, d, "part").select(F.col("p_partkey") + 1_000_000, "p_name"))
    return q.select("query_id", F.size(T.query_tokens(F.col("text"))).alias("n_tokens"), T.route_query(F.col("text")).alias("r")).select("query_id", "n_tokens", "r.*")


@query(
    rf"""WITH t AS (SELECT item_id, list_filter({_TOK.format('text')}, lambda t: strlen(t) >= 2)[1:12] AS ts FROM benchmark)
SELECT item_id AS query_id, array_to_string(list_transform(ts, lambda t: '"' || t || '"' || CASE WHEN strlen(t) >= 4 THEN '*' ELSE '' END), ' OR ') AS fts FROM t"""
)
def fts_strings(spark, d):
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), T.fts_query(F.col("text")).alias("fts"))


@query(
    r"""WITH w AS (SELECT p_partkey AS query_id, unnest(list_distinct(list_transform(list_filter(regexp_split_to_array(p_name, '[^\p{L}\p{N}_:]+'), lambda t: strlen(t) >= 3), lambda t: lower(t)))) AS word FROM part),
y AS (SELECT DISTINCT p_type || 'Item > ' || p_name AS symbol FROM part),
p AS (SELECT symbol, i AS nth, string_split(symbol, ' > ')[i] AS part FROM y, (SELECT unnest([1, 2]) AS i)),
s AS (SELECT *, lower(unnest(list_filter(regexp_split_to_array(regexp_replace(part, '(\p{Lu})', ' \1', 'g'), '[^\p{L}\p{N}]+'), lambda t: t <> ''))) AS sub FROM p),
m AS (SELECT DISTINCT query_id, symbol, nth, part FROM w JOIN s ON sub = word OR (least(strlen(sub), strlen(word)) >= 4 AND (starts_with(sub, word) OR starts_with(word, sub)))),
o AS (SELECT * FROM m WHERE NOT EXISTS (SELECT 1 FROM w WHERE w.query_id = m.query_id AND word = lower(part)) QUALIFY row_number() OVER (PARTITION BY query_id, lower(part) ORDER BY symbol, nth) = 1)
SELECT query_id, part AS symbol, row_number() OVER (PARTITION BY query_id ORDER BY symbol, nth)::INTEGER AS k FROM o QUALIFY k <= 8"""
)
def symbol_expand(spark, d):
    """Names of all parts as queries, and as the inner parts of symbol paths."""
    parts = table(spark, d, "part")
    q = parts.select(F.col("p_partkey").alias("query_id"), F.col("p_name").alias("query"))
    found = search.expand_symbols(q, parts.select(F.concat("p_type", F.lit("Item > "), "p_name").alias("symbol")))
    return found.select("query_id", F.posexplode("expansions").alias("k", "symbol")).select("query_id", "symbol", (F.col("k") + 1).cast("int").alias("k"))


@query(f"SELECT o_orderkey, round(o_totalprice * (1 + 0.1 * exp(-greatest(0, ({NOW * 1000} - epoch_ms(o_orderdate)) / 86400000.0) / 14)), 6) AS score FROM orders")
def recency_boost(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", F.round(search.recency(F.col("o_totalprice"), seconds("o_orderdate") * 1000, NOW * 1000), 6).alias("score"))


@query()
def near_dup_greedy(spark, d):
    """Ten lexical hits of each query's CANDIDATES, without those too like a better one."""
    hits = keep(_lexical(spark, d, K.CANDIDATES).withColumn("score", -F.col("score")))
    rows = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")).join(F.broadcast(hits), "chunk_id")  # CANDIDATES ids an item
    return search.drop_near_duplicates(rows, 10).select("query_id", "chunk_id", "pos")


@query(
    r"""WITH t AS (SELECT page_id, rtrim(trim(url), '/') AS u FROM pages), s AS (SELECT page_id, contains(u, '://') AS sch, u, regexp_extract(u, '(?s)://(.*)$', 1) AS r FROM t),
h AS (SELECT page_id, CASE WHEN sch THEN split_part(r, '/', 1) WHEN contains(u, ':') THEN split_part(u, ':', 1) END AS host, CASE WHEN sch THEN regexp_extract(r, '(?s)^[^/]*/(.*)$', 1) ELSE regexp_extract(u, '(?s)^[^:]*:(.*)$', 1) END AS path FROM s),
k AS (SELECT page_id, lower(regexp_replace(split_part(host, '@', -1), ':[0-9]*$', '')) AS host, regexp_replace(ltrim(path, '/'), '\.git$', '') AS path FROM h)
SELECT page_id, CASE WHEN host <> '' AND path <> '' THEN host || '/' || path END AS repo_key FROM k"""
)
def repo_keys(spark, d):
    return table(spark, d, "pages").select("page_id", T.repo_key(F.col("url")).alias("repo_key"))


_MARKED = """m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'x' || chr(10) || '// @generated by a tool' || chr(10) || text WHEN doc_id % 11 = 0 THEN repeat('y' || chr(10), 5) || '@generated' || chr(10) || text WHEN doc_id % 13 = 0 THEN text || chr(10) || repeat('z' || chr(10), 90) || chr(10) || 'w' ELSE text END AS text FROM documents)"""


def _marked(spark, d) -> DataFrame:
    """Documents, some with a mark of generated files in the first five lines, some with one below them, some longer."""
    text = F.col("text")
    made = F.when(F.col("doc_id") % 7 == 0, F.concat(F.lit("x\n// @generated by a tool\n"), text)).when(F.col("doc_id") % 11 == 0, F.concat(F.lit("y\n" * 5 + "@generated\n"), text))
    made = made.when(F.col("doc_id") % 13 == 0, F.concat(text, F.lit("\n" + "z\n" * 90 + "\nw"))).otherwise(text)
    return table(spark, d, "documents").select("doc_id", made.alias("text"))


@query(
    rf"""WITH RECURSIVE {_MARKED}, l AS (SELECT doc_id, CASE WHEN text LIKE '%' || chr(10) THEN string_split(text, chr(10))[:-2] ELSE string_split(text, chr(10)) END AS x FROM m
  WHERE text <> '' AND NOT contains(text, chr(0)) AND len(list_filter(string_split(text, chr(10))[1:5], lambda x: contains(x, '@generated'))) = 0),
r AS (SELECT doc_id, x, 0::BIGINT AS s, CASE WHEN len(x) <= {K.WINDOW} THEN len(x) ELSE coalesce(list_max(list_filter(range({K.WINDOW - K.SNAP}, {K.WINDOW}), lambda i: regexp_matches(x[i + 1], '^\s*$'))), {K.WINDOW}) END AS e FROM l
  UNION ALL SELECT doc_id, x, t AS s, CASE WHEN len(x) <= t + {K.WINDOW} THEN len(x) ELSE coalesce(list_max(list_filter(range(t + {K.WINDOW - K.SNAP}, t + {K.WINDOW}), lambda i: regexp_matches(x[i + 1], '^\s*$'))), t + {K.WINDOW}) END AS e
  FROM (SELECT doc_id, x, greatest(e - {K.OVERLAP}, s + 1) AS t FROM r WHERE e < len(x)))
SELECT doc_id, (s + 1)::INTEGER AS start_line, e::INTEGER AS end_line FROM r WHERE len(list_filter(x[s + 1:e], lambda y: NOT regexp_matches(y, '^\s*$'))) > 0"""
)
def chunked_lines(spark, d):
    """Every line window of every document."""
    from ..operators.chunking import chunk_files

    files = _marked(spark, d).select(F.lit("r").alias("repo_key"), F.col("doc_id").cast("string").alias("relpath"), F.col("text").alias("content"))
    return chunk_files(files).select(F.col("relpath").cast("long").alias("doc_id"), "start_line", "end_line")


@query(f"WITH {_MARKED} SELECT doc_id FROM m WHERE NOT contains(text, chr(0)) AND len(list_filter(string_split(text, chr(10))[1:5], lambda x: contains(x, '@generated'))) = 0")
def generated_filter(spark, d):
    return _marked(spark, d).where(~F.contains("text", F.lit("\0")) & ~T.is_generated(F.col("text"))).select("doc_id")


@query(
    """WITH a AS (SELECT doc_id, md5(text) AS h FROM documents WHERE doc_id % 3 <> 0), b AS (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN md5(text || 'x') ELSE md5(text) END AS h FROM documents WHERE doc_id % 7 <> 0)
SELECT coalesce(a.doc_id, b.doc_id)::VARCHAR AS relpath, CASE WHEN a.h IS NULL THEN 'delete' WHEN a.h = b.h THEN 'unchanged' ELSE 'upsert' END AS action FROM a FULL JOIN b ON a.doc_id = b.doc_id"""
)
def manifest_diff(spark, d):
    """Two manifests made of documents: a third left out of one, a seventh of the other, a fifth changed."""
    t = table(spark, d, "documents").select("doc_id", F.col("doc_id").cast("string").alias("relpath"), "text")
    disk = t.where("doc_id % 3 <> 0").select("relpath", F.md5("text").alias("hash"))
    stored = t.where("doc_id % 7 <> 0").select("relpath", F.md5(F.when(F.col("doc_id") % 5 == 0, F.concat("text", F.lit("x"))).otherwise(F.col("text"))).alias("hash"))
    return ingest.manifest_diff(disk, stored)


@query("SELECT doc_id, md5(text) AS content_hash, md5(text) IN (SELECT md5(text) FROM documents WHERE doc_id % 4 = 0) AS reused FROM documents")
def vector_reuse(spark, d):
    """Documents to embed, where a fourth of them have vectors already."""
    rows = table(spark, d, "documents").select("doc_id", F.md5("text").alias("content_hash"), F.col("text").alias("input"))
    embedder = ingest.HashEmbedder(8)
    known = rows.where("doc_id % 4 = 0").select("content_hash", ingest.embed_with(embedder)(F.col("input")).alias("embedding"))
    return ingest.with_vectors(rows, known, embedder).select("doc_id", "content_hash", "reused")


@query(
    f"""WITH RECURSIVE f AS (SELECT coalesce(lang, '') AS repo_key, doc_id::VARCHAR AS relpath, coalesce(strlen(text), 0) * 64 AS size, row_number() OVER (PARTITION BY coalesce(lang, '') ORDER BY doc_id::VARCHAR) AS i FROM documents),
g AS (SELECT repo_key, i, relpath, size AS bytes, 1 AS n, (size > {K.BATCH_BYTES})::BIGINT AS batch FROM f WHERE i = 1
  UNION ALL SELECT f.repo_key, f.i, f.relpath, CASE WHEN g.n >= {K.BATCH_FILES} OR g.bytes + f.size > {K.BATCH_BYTES} THEN f.size ELSE g.bytes + f.size END, CASE WHEN g.n >= {K.BATCH_FILES} OR g.bytes + f.size > {K.BATCH_BYTES} THEN 1 ELSE g.n + 1 END,
    CASE WHEN g.n >= {K.BATCH_FILES} OR g.bytes + f.size > {K.BATCH_BYTES} THEN g.batch + 1 ELSE g.batch END FROM g JOIN f ON f.repo_key = g.repo_key AND f.i = g.i + 1)
SELECT repo_key, relpath, batch, 'upsert' AS action FROM g UNION ALL SELECT DISTINCT coalesce(lang, ''), 'old/' || source, 0, 'delete' FROM documents"""
)
def sync_batches(spark, d):
    """Documents as files of 64 times their size (so that both limits act), languages as repositories, sources as what
    they have lost."""
    docs = table(spark, d, "documents").withColumn("repo_key", F.coalesce("lang", F.lit("")))
    files = docs.select("repo_key", F.col("doc_id").cast("string").alias("relpath"), (F.octet_length("text") * 64).alias("size"))
    return ingest.sync_requests(files, docs.select("repo_key", F.concat(F.lit("old/"), "source").alias("relpath")).distinct())


@query(
    """WITH f AS (SELECT doc_id, strlen(text) AS n, doc_id % 5 = 0 AS changed, doc_id % 7 = 0 AS deleted FROM documents)
SELECT doc_id, CASE WHEN deleted AND changed THEN n + 3 WHEN deleted THEN NULL WHEN changed THEN n + 2 ELSE n END::BIGINT AS size, CASE WHEN changed THEN 'stale' ELSE 'live' END AS status, CASE WHEN changed THEN CASE WHEN deleted THEN 300 ELSE 200 END END::BIGINT AS stale_at FROM f"""
)
def store_replay(spark, d):
    """Commits of documents, each with a note anchored to its first text: all of them; then a fifth changed and a seventh
    deleted, twice, as a batch that comes again; then those in both added again.  What is stored, and which notes are stale."""
    folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
    own, embedder = store.Store(spark, folder, 16), ingest.HashEmbedder(8)
    docs = table(spark, d, "documents").select("doc_id", F.lit("r").alias("repo_key"), F.col("doc_id").cast("string").alias("relpath"), F.col("text").alias("content"), F.lit(1).cast("long").alias("mtime_ms"))
    none, empty = docs.limit(0).select("repo_key", "relpath"), [F.lit(None).cast("long").alias(c) for c in ("repo_id", "superseded_by", "stale_at", "helpful_at", "reverified_at", "contradicted_at")]
    zero = [F.lit(0).cast("long").alias(c) for c in ("created_at", "last_access", "access_count", "helpful_count", "noise_count")]
    own.put("notes", docs.select(F.col("doc_id").alias("id"), F.lit("fact").alias("kind"), F.lit("c").alias("content"), F.lit(0.5).alias("salience"), F.lit("live").alias("status"), F.lit("agent").alias("source"), *empty, *zero))
    own.put("anchors", docs.select("repo_key", "relpath", xxh64_hex(F.col("content")).alias("hash"), F.col("doc_id").alias("note_id")), whole_keys=False)
    own.commit(docs, none, embedder, 100, 0)
    with_more = lambda rows, more: rows.withColumn("content", F.concat("content", F.lit(more)))
    for _ in range(2):
        own.commit(with_more(docs.where("doc_id % 5 = 0 and doc_id % 7 <> 0"), "\nx"), docs.where("doc_id % 7 = 0").select("repo_key", "relpath"), embedder, 200, 1)
    own.commit(with_more(docs.where("doc_id % 35 = 0"), "\nyz"), none, embedder, 300, 2)
    sizes = own.table("files").select(F.col("relpath").cast("long").alias("doc_id"), "size")
    return own.table("notes").select(F.col("id").alias("doc_id"), "status", "stale_at").join(sizes, "doc_id", "left").select("doc_id", "size", "status", "stale_at")


@query(
    r"""WITH e AS (SELECT conv_id::VARCHAR AS session, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS n, role AS kind, coalesce(text, '') AS body FROM conversations),
l AS (SELECT *, '[#' || n || '] ' || kind || ': ' || body AS line, length('[#' || n || '] ' || kind || ': ' || body) + 1 AS len FROM e),
r AS (SELECT *, sum(len) OVER (PARTITION BY session ORDER BY n) AS head, sum(len) OVER (PARTITION BY session ORDER BY n DESC) AS tail, sum(len) OVER (PARTITION BY session) AS total, count(*) OVER (PARTITION BY session) AS last FROM l),
f AS (SELECT *, coalesce(max(head) FILTER (head <= 200) OVER (PARTITION BY session), 0) AS used FROM r),
k AS (SELECT *, total <= 600 OR head <= 200 AS in_head, total > 600 AND head > 200 AND tail <= 600 - used AS in_tail FROM f),
g AS (SELECT session, any_value(total) AS total, any_value(last) AS last, count(*) FILTER (in_head) AS h, min(n) FILTER (in_tail) AS t, string_agg(line, chr(10) ORDER BY n) FILTER (in_head) AS head, string_agg(line, chr(10) ORDER BY n) FILTER (in_tail) AS tail FROM k GROUP BY session)
SELECT session, CASE WHEN total <= 600 THEN head ELSE concat_ws(chr(10), head, '[... entries #' || (h + 1) || '-#' || coalesce(t - 1, last) || ' omitted ...]', tail) END AS text FROM g"""
)
def capped_render(spark, d):
    """Conversations as transcripts of at most 600 letters: a third for the first entries, the last ones, and what is left out."""
    c = table(spark, d, "conversations")
    n = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn", "role", "text"))
    own = c.select(F.col("conv_id").cast("string").alias("session"), n.cast("long").alias("n"), F.col("role").alias("kind"), F.coalesce("text", F.lit("")).alias("body"))
    return capture.render(own, 600)


def _notes(spark, d) -> DataFrame:
    """A note for each user: purchases are helpful votes, errors noise, views uses."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("id")).agg(
        F.count_if(F.col("event_type") == "view").alias("access_count"), F.count_if(F.col("event_type") == "purchase").alias("helpful_count"), F.count_if(F.col("event_type") == "error").alias("noise_count"),
        seconds(F.max("ts")).alias("last_access"), seconds(F.min("ts")).alias("created_at"), seconds(F.max(F.when(F.col("event_type") == "purchase", F.col("ts")))).alias("helpful_at"), seconds(F.max(F.when(F.col("event_type") == "signup", F.col("ts")))).alias("stale_at"),
    )
    pick = lambda words, n: F.get(F.array(*map(F.lit, words)), (F.col("id") % n).cast("int"))
    nothing = F.lit(None).cast("long")
    return e.withColumns({
        "repo_id": F.when(F.col("id") % 3 != 0, F.col("id") % 3), "kind": pick(K.KINDS, 6), "source": pick(K.SOURCES, 2), "salience": 0.05 + (F.col("id") % 20) * 0.05, "superseded_by": F.when(F.col("id") % 17 == 0, F.col("id") + 1),
        "status": F.when(F.col("id") % 11 == 0, "archived").when(F.col("stale_at").isNotNull() & (F.col("id") % 2 == 0), "stale").otherwise("live"), "reverified_at": nothing, "contradicted_at": F.when(F.col("id") % 5 == 0, F.col("stale_at")),
    })


_NOTES = f"""WITH e AS (SELECT user_id AS id, count(*) FILTER (event_type = 'view') AS access_count, count(*) FILTER (event_type = 'purchase') AS helpful_count, count(*) FILTER (event_type = 'error') AS noise_count,
  floor(epoch(max(ts)))::BIGINT AS last_access, floor(epoch(max(ts) FILTER (event_type = 'purchase')))::BIGINT AS helpful_at, floor(epoch(max(ts) FILTER (event_type = 'signup')))::BIGINT AS stale_at FROM events GROUP BY 1),
n AS (SELECT *, CASE WHEN id % 3 <> 0 THEN id % 3 END AS repo_id, {K.KINDS}[1 + id % 6] AS kind, {K.SOURCES}[1 + id % 2] AS source, 0.05 + (id % 20) * 0.05::DOUBLE AS salience, CASE WHEN id % 17 = 0 THEN id + 1 END AS superseded_by,
  CASE WHEN id % 11 = 0 THEN 'archived' WHEN stale_at IS NOT NULL AND id % 2 = 0 THEN 'stale' ELSE 'live' END AS status, CASE WHEN id % 5 = 0 THEN stale_at END AS contradicted_at FROM e)"""
_RECALL = f"(0.2 + 0.8 * salience) * (0.3 + 0.7 * exp(-ln(2) * greatest(0, ({NOW} - last_access) / 86400.0) / 29)) * (1 + 0.5 * helpful_count / greatest(access_count, 1)) * CASE WHEN status = 'stale' THEN 0.5 ELSE 1 END"


@query(f"{_NOTES} SELECT source, count(*) AS total, count(*) FILTER (status = 'live') AS live, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'archived') AS archived, count(superseded_by) AS superseded, sum(helpful_count)::BIGINT AS helpful, sum(noise_count)::BIGINT AS noise FROM n GROUP BY source HAVING count(*) > 0")
def memory_stats(spark, d):
    return notes.source_stats(_notes(spark, d))


@query(f"{_NOTES} SELECT count(*) AS total, count(*) FILTER (status = 'live') AS live, count(*) FILTER (status = 'stale') AS stale, count(*) FILTER (status = 'archived') AS archived FROM n")
def memory_counts(spark, d):
    return notes.counts(_notes(spark, d))


@query(f"{_NOTES} SELECT id, round({_RECALL}, 6) AS score FROM n")
def recall_scores(spark, d):
    age = F.greatest(F.lit(0.0), (F.lit(NOW) - F.col("last_access")) / notes.DAY)
    return _notes(spark, d).select("id", F.round(notes.recall_score(F.lit(1.0), F.col("salience"), age, F.col("helpful_count"), F.col("access_count"), F.col("status") == "stale"), 6).alias("score"))


@query(f"{_NOTES} SELECT id, round((0.8 + 0.2 * salience) * (1 + 0.5 * helpful_count / greatest(access_count, 1)) * CASE WHEN status = 'stale' THEN 0.5 ELSE 1 END, 6) AS score FROM n")
def query_scores(spark, d):
    return _notes(spark, d).select("id", F.round(notes.query_score(F.lit(1.0), F.col("salience"), F.col("helpful_count"), F.col("access_count"), F.col("status") == "stale"), 6).alias("score"))


@query(
    f"""{_NOTES}, s AS (SELECT 1 AS scope_id UNION ALL SELECT 2), seen AS (SELECT scope_id, id, repo_id, round({_RECALL}, 9) AS score FROM n, s WHERE superseded_by IS NULL AND status = 'live' AND (repo_id IS NULL OR repo_id = scope_id)),
c AS (SELECT *, sum((repo_id IS NULL)::INT) OVER (PARTITION BY scope_id ORDER BY score DESC, id ROWS UNBOUNDED PRECEDING) AS g FROM seen)
SELECT scope_id, id AS note_id, row_number() OVER (PARTITION BY scope_id ORDER BY score DESC, id)::INTEGER AS k FROM c WHERE repo_id IS NOT NULL OR g <= 2 QUALIFY k <= 8"""
)
def brief_capped_globals(spark, d):
    scopes = spark.range(1, 3).select(F.col("id").alias("scope_id"), F.col("id").alias("repo_id"))
    none = spark.range(0).select(F.col("id").alias("note_id"), F.col("id").alias("repo_id"))
    own = notes.brief(scopes, _notes(spark, d), none, NOW)
    return own.where("part = 'live'").select(F.col("scope_id").cast("int").alias("scope_id"), "note_id", (F.col("rank") + 1).cast("int").alias("k"))


@query(
    f"""{_NOTES}, v AS (SELECT DISTINCT user_id AS id, event_id % 4 AS repo_id FROM events WHERE event_type = 'error' AND event_id % 4 <> 0),
x AS (SELECT n.id, count(*) FILTER (v.repo_id = n.repo_id) AS own_noise, count(DISTINCT v.repo_id) AS scopes FROM n JOIN v USING (id) GROUP BY 1),
r AS (SELECT CASE WHEN status = 'archived' THEN NULL WHEN superseded_by IS NOT NULL THEN 'superseded'
  WHEN status = 'stale' AND NOT coalesce(helpful_at >= stale_at, false) AND coalesce(contradicted_at >= stale_at, false) THEN 'contradicted'
  WHEN status = 'stale' AND NOT coalesce(helpful_at >= stale_at, false) AND stale_at < {NOW} - 30 * 86400 THEN 'stale'
  WHEN kind = 'episode' AND helpful_count = 0 AND {_RECALL} < 0.1 THEN 'episode'
  WHEN helpful_count = 0 AND CASE WHEN repo_id IS NOT NULL THEN coalesce(own_noise, 0) > 0 ELSE coalesce(scopes, 0) >= 2 END THEN 'noise' END AS rule FROM n LEFT JOIN x USING (id))
SELECT rule, count(*) AS n FROM r WHERE rule IS NOT NULL GROUP BY rule"""
)
def gc_rules(spark, d):
    muted = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("note_id"), (F.col("event_id") % 4).alias("repo_id")).distinct()
    return notes.gc(_notes(spark, d), muted, NOW, dry_run=True)[1]


_ANCHORS = "a AS (SELECT l_orderkey AS note_id, l_linenumber AS seq, l_suppkey AS repo_id, l_partkey::VARCHAR AS relpath, md5(l_partkey::VARCHAR) AS hash FROM lineitem), f AS (SELECT DISTINCT l_suppkey AS repo_id, l_partkey::VARCHAR AS relpath, md5(CASE WHEN l_partkey % 9 = 0 THEN 'new' ELSE l_partkey::VARCHAR END) AS hash FROM lineitem WHERE l_partkey % 10 <> 0)"


def _anchors(spark, d) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "lineitem")
    part = F.col("l_partkey").cast("string")
    anchors = rows.select(F.col("l_orderkey").alias("note_id"), F.col("l_linenumber").alias("seq"), F.col("l_suppkey").alias("repo_id"), part.alias("relpath"), F.md5(part).alias("hash"))
    files = rows.where("l_partkey % 10 <> 0").select(F.col("l_suppkey").alias("repo_id"), part.alias("relpath"), F.md5(F.when(F.col("l_partkey") % 9 == 0, F.lit("new")).otherwise(part)).alias("hash")).distinct()
    return anchors, files


@query(f"WITH {_ANCHORS} SELECT note_id, seq::INTEGER AS seq FROM a WHERE EXISTS (SELECT 1 FROM f WHERE f.repo_id = a.repo_id AND f.relpath = a.relpath AND f.hash <> a.hash)")
def stale_anchors(spark, d):
    return ingest.stale_anchors(*_anchors(spark, d)).select("note_id", "seq")


@query(f"WITH {_ANCHORS}, s AS (SELECT DISTINCT note_id FROM a JOIN f USING (repo_id, relpath) WHERE f.hash <> a.hash) SELECT note_id, string_agg(DISTINCT relpath, ',' ORDER BY relpath) AS paths FROM a SEMI JOIN s USING (note_id) GROUP BY 1")
def stale_list(spark, d):
    anchors, files = _anchors(spark, d)
    ids = anchors.select(F.col("note_id").alias("id")).distinct()
    state = ids.select("id", F.lit("live").alias("status"), F.lit(None).cast("long").alias("stale_at"), F.lit(None).cast("long").alias("superseded_by"))
    now = notes.mark_stale(state, ingest.stale_anchors(anchors, files), NOW)
    return notes.stale_list(now, anchors).select(F.col("id").alias("note_id"), F.array_join("paths", ",").alias("paths"))


@query("SELECT a.l_orderkey AS anchor_id, a.l_linenumber AS line, b.l_linenumber AS chunk FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber <= a.l_linenumber + 1 AND b.l_linenumber + 1 >= a.l_linenumber")
def reverify_overlap(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("anchor_id"), F.lit(1).alias("repo_id"), F.col("l_orderkey").alias("relpath"), F.col("l_linenumber").alias("start_line"))
    rows = rows.withColumn("end_line", F.col("start_line") + 1)
    met = search.overlapping(rows, rows.drop("anchor_id"))
    return met.select("anchor_id", F.col("lo").alias("line"), F.col("start_line").alias("chunk"))


@query(
    """SELECT o_custkey AS id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 ELSE 1 END, o_orderkey) FILTER (o_orderstatus IN ('P', 'O')) AS items,
(SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM (SELECT DISTINCT o_custkey AS c, o_orderpriority AS k, 'x' AS v FROM orders) s WHERE s.c = o.o_custkey) AS state FROM orders o WHERE o_custkey % 5 <> 0 GROUP BY o_custkey"""
)
def work_lists(spark, d):
    o = table(spark, d, "orders")
    lists = o.select(F.col("o_custkey").alias("id"), F.lit(1).alias("repo_id"), F.col("o_custkey").cast("string").alias("name"), F.when(F.col("o_custkey") % 5 == 0, NOW).alias("closed_at"), F.lit(0).alias("updated_at")).distinct()
    status = F.when(F.col("o_orderstatus") == "P", "doing").when(F.col("o_orderstatus") == "O", "todo").when(F.col("o_orderstatus") == "F", "done").otherwise("?")
    items = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("list_id"), F.lit("t").alias("task"), status.alias("status"), F.lit(None).cast("string").alias("note"))
    state = o.select(F.col("o_custkey").alias("list_id"), F.col("o_orderpriority").alias("key"), F.lit("x").alias("value")).distinct()
    nested = work.work_lists(lists, items, state)
    return nested.select("id", F.array_join(F.transform("items", lambda x: x["item_id"].cast("string")), ",").alias("items"), F.array_join(F.transform("state", lambda x: F.concat(x["key"], F.lit("="), x["value"])), ",").alias("state"))


@query(
    f"""WITH RECURSIVE {_NOTES[5:]}, c AS MATERIALIZED (SELECT row_number() OVER (ORDER BY event_id) AS k, user_id AS old_id, (user_id * 7 + event_id) % (SELECT max(user_id) FROM events) AS new_id FROM events WHERE event_type = 'purchase'),
f AS MATERIALIZED (SELECT list(id) AS free FROM n WHERE superseded_by IS NULL),
g AS (SELECT 0::BIGINT AS k, free, NULL::BIGINT AS old_id, NULL::BIGINT AS new_id, false AS acts FROM f
  UNION ALL SELECT c.k, CASE WHEN ok THEN list_filter(free, lambda x: x <> c.old_id) ELSE free END, c.old_id, c.new_id, ok
  FROM (SELECT c.*, g.free, c.old_id <> c.new_id AND list_contains(g.free, c.old_id) AND list_contains(g.free, c.new_id) AS ok FROM g JOIN c ON c.k = g.k + 1) c)
SELECT new_id AS note_id, old_id AS related_id, 'supersedes' AS relation FROM g WHERE acts"""
)
def supersede_chain(spark, d):
    """Purchases as commands, one by one: each supersedes its user's note by another, so that chains, cycles and commands
    on one note abound."""
    e = table(spark, d, "events")
    most = e.agg(F.max("user_id").alias("most"))
    commands = e.where("event_type = 'purchase'").join(F.broadcast(most)).select(F.col("event_id").alias("seq"), F.col("user_id").alias("old_id"), ((F.col("user_id") * 7 + F.col("event_id")) % F.col("most")).alias("new_id"))
    return notes.supersede(_notes(spark, d), commands)[1]


_SCORED = "WITH s AS (SELECT quality = 1 AS label, (n_chars % 997) / 997.0::DOUBLE AS score FROM labels JOIN documents USING (doc_id))"


def _scored(spark, d) -> DataFrame:
    return table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select((F.col("quality") == 1).alias("label"), (F.col("n_chars") % 997 / 997.0).alias("score"))


@query(f"{_SCORED}, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM s) SELECT round((sum(r) FILTER (label) - count(*) FILTER (label) * (count(*) FILTER (label) + 1) / 2.0) / (count(*) FILTER (label) * count(*) FILTER (NOT label)), 9)::DOUBLE AS auroc FROM r")
def auroc(spark, d):
    return evaluation.auroc(_scored(spark, d)).select(F.round("auroc", 9).cast("double").alias("auroc"))


@query(f"{_SCORED}, w AS (SELECT max(score) AS worst FROM s WHERE NOT label) SELECT round(median(score), 9) AS median, count(*) FILTER (NOT label AND score >= 0.5) AS false_accepts, count(*) FILTER (label AND score < 0.5) AS false_rejects, round(max(worst), 9) AS worst_negative, count(*) FILTER (label AND score <= worst) AS lost_above_worst FROM s, w")
def calibration(spark, d):
    r = evaluation.calibration(_scored(spark, d), 0.5)
    return r.withColumns({c: F.round(c, 9) for c in ("median", "worst_negative")})


@query(f"{_E}, k AS (SELECT a.vec_id AS q, a.label = b.label AS hit, row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), b.vec_id) - 1 AS r FROM e a JOIN e b ON a.vec_id <> b.vec_id QUALIFY r < 10), f AS (SELECT q, min(r) FILTER (hit) AS rank FROM k GROUP BY q) SELECT count(*) AS cases, round(avg((rank IS NOT NULL)::INT), 9) AS recall, round(avg(coalesce(1.0 / (rank + 1), 0)), 9)::DOUBLE AS mrr FROM f")
def recall_mrr(spark, d):
    """Nearest vectors, where those of the query's label are expected."""
    q, c = _vectors(spark, d)
    hits = search.nearest(q, c, 10, exclude=F.col("query_id") == F.col("chunk_id")).join(c.select("chunk_id", "scope"), "chunk_id").select(F.col("query_id").alias("case_no"), F.col("rank").alias("pos"), F.col("scope").cast("string").alias("relpath"), F.lit(1).alias("start_line"), F.lit(1).alias("end_line"))
    cases = q.select(F.col("query_id").alias("case_no"), F.array(F.col("scope").cast("string")).alias("expect"))
    r = evaluation.summarize(evaluation.first_ranks(cases, hits))
    return r.select("cases", F.round("recall", 9).alias("recall"), F.round("mrr", 9).alias("mrr"))


@query("SELECT event_type, value AS p95 FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events WHERE value IS NOT NULL) WHERE i = (n - 1) * 95 // 100")
def percentiles(spark, d):
    return evaluation.percentile(table(spark, d, "events"), "value", 95, ["event_type"])


_STEPS = r"""c AS (SELECT conv_id, turn, role, text FROM conversations),
x AS (SELECT conv_id, turn, 0 AS part, 'user' AS kind, left(text, 4000) AS body, NULL AS tool, NULL AS edited FROM c WHERE role <> 'assistant' UNION ALL
  SELECT conv_id, turn, 1, 'tool_use', CASE turn % 4 WHEN 0 THEN 'Edit {"file_path":"f' || turn || '.py"}' WHEN 1 THEN 'Read {"file_path":"a.py"}' WHEN 2 THEN 'Bash {"command":"curl https://a.b/c"}' ELSE 'Bash {"command":"cat notes.txt"}' END,
    turn % 4, CASE WHEN turn % 4 = 0 THEN 'f' || turn || '.py' END FROM c WHERE role = 'assistant' UNION ALL
  SELECT conv_id, turn, 2, 'tool_result', CASE WHEN turn % 4 = 2 THEN '[web content omitted]' WHEN length(text) > 1500 THEN '...' || right(text, 1500) ELSE text END, turn % 4, NULL FROM c WHERE role = 'assistant'),
e AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, part) AS n, kind <> 'tool_result' OR tool IN (1, 3) AS provable, kind = 'tool_result' AND tool IN (0, 2) AS echoed FROM x)"""


def _steps(spark, d) -> DataFrame:
    """Conversations as transcripts: what the assistant says is the result of a call that it makes."""
    c = table(spark, d, "conversations").withColumn("kind", F.col("turn") % 4)
    call = F.concat(F.lit("c"), F.col("turn").cast("string"))
    name = F.when(F.col("kind") == 0, "Edit").when(F.col("kind") == 1, "Read").otherwise("Bash")
    path = F.when(F.col("kind") == 0, F.concat(F.lit("f"), F.col("turn").cast("string"), F.lit(".py"))).when(F.col("kind") == 1, "a.py")
    command = F.when(F.col("kind") == 2, "curl https://a.b/c").when(F.col("kind") == 3, "cat notes.txt")
    asked = F.array(F.struct(F.lit("tool_use").alias("type"), call.alias("id"), name.alias("name"), F.struct(path.alias("file_path"), command.alias("command")).alias("input")))
    said = F.array(F.struct(F.lit("tool_result").alias("type"), call.alias("tool_use_id"), F.col("text").alias("content")))
    line = lambda role, content: F.to_json(F.struct(F.lit(role).alias("type"), F.struct(content.alias("content")).alias("message")))
    key = lambda part: [F.col("conv_id").cast("string").alias("session"), (F.col("turn") * 4 + part).alias("line_no")]
    user = c.where("role <> 'assistant'").select(*key(0), line("user", F.col("text")).alias("raw"))
    tools = c.where("role = 'assistant'")
    return user.union(tools.select(*key(1), line("assistant", asked))).union(tools.select(*key(2), line("user", said)))


def _claims(own: DataFrame) -> DataFrame:
    """A note for each entry, which it or its neighbour is to prove."""
    kind = F.get(F.array(*map(F.lit, ["fact", "decision", "skill", "episode"])), (F.col("n") % 4).cast("int"))
    entry = F.when(F.col("n") % 3 == 0, F.col("n") + 1).otherwise(F.col("n"))
    quote = F.substring(capture.squeeze(F.col("body")), F.lit(5), 15 + (F.col("n") % 5) * 10)
    return own.select("session", F.col("n").alias("claim_no"), kind.alias("kind"), entry.alias("entry"), quote.alias("quote"), F.lit("note").alias("content"), F.array(F.concat(F.lit("f"), (F.col("n") % 8).cast("string"), F.lit(".py:3"))).alias("anchors"), F.lit(7).cast("long").alias("supersedes"))


_CLAIMS = rf"""{_STEPS}, q AS (SELECT conv_id, n, ['fact', 'decision', 'skill', 'episode'][1 + n % 4] AS kind, CASE WHEN n % 3 = 0 THEN n + 1 ELSE n END AS entry, trim(substr(trim(regexp_replace(body, '\s+', ' ', 'g')), 5, 15 + (n % 5) * 10)) AS quote FROM e),
p AS (SELECT q.*, e.kind AS entry_kind, coalesce(length(quote) >= 20 AND contains(trim(regexp_replace(body, '\s+', ' ', 'g')), quote) AND NOT echoed AND provable, false) AS cited FROM q LEFT JOIN e ON e.conv_id = q.conv_id AND e.n = q.entry),
v AS (SELECT *, cited AND ((kind = 'fact' AND entry_kind = 'tool_result') OR (kind = 'decision' AND entry_kind IN ('user', 'tool_result'))) AS proven FROM p)"""


@query(f"WITH {_STEPS}, r AS (SELECT *, sum(length('[#' || n || '] ' || kind || ': ' || body) + 1) OVER (PARTITION BY conv_id ORDER BY n) AS head FROM e) SELECT conv_id::VARCHAR AS session, n::INTEGER AS n, kind, length(body)::INTEGER AS chars, provable, echoed, edited, head::BIGINT AS running FROM r")
def transcript_entries(spark, d):
    """Numbered entries of transcripts, what they may prove, and the running length of their rendering."""
    rows = capture.number(capture.entries(_steps(spark, d)), -1)
    line = F.concat(F.lit("[#"), F.col("n").cast("string"), F.lit("] "), "kind", F.lit(": "), "body")
    w = Window.partitionBy("session").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("session", "n", "kind", F.length("body").alias("chars"), "provable", "echoed", "edited", F.sum(F.length(line) + 1).over(w).alias("running"))


@query(f"WITH {_CLAIMS} SELECT conv_id::VARCHAR AS session, n::INTEGER AS claim_no, cited, proven FROM v")
def quote_proof(spark, d):
    """Notes that quote an entry of their own conversation."""
    own = capture.number(capture.entries(_steps(spark, d)), -1)
    return capture.proofs(_claims(own), own).select("session", "claim_no", "cited", "proven")


@query(
    f"""WITH {_CLAIMS}, f AS (SELECT conv_id, list(DISTINCT edited) AS paths FROM e WHERE edited IS NOT NULL GROUP BY 1)
SELECT conv_id::VARCHAR AS session, n::INTEGER AS claim_no, CASE WHEN proven THEN kind ELSE 'episode' END AS kind, CASE WHEN cited THEN '[#' || entry || '] ' || quote END AS evidence,
  CASE WHEN proven AND list_contains(coalesce(paths, []), 'f' || (n % 8) || '.py') THEN 1 ELSE 0 END::INTEGER AS n_anchors, CASE WHEN proven THEN 7::BIGINT END AS supersedes
FROM v LEFT JOIN f USING (conv_id) QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY n) <= 5"""
)
def capture_plan(spark, d):
    """The notes that are kept of each conversation, as they are written."""
    own = capture.number(capture.entries(_steps(spark, d)), -1)
    settled = capture.plan(capture.settle(capture.proofs(_claims(own), own), own.where("edited is not null")))
    return settled.select("session", "claim_no", "kind", "evidence", F.size("anchors").alias("n_anchors"), "supersedes")


#: Commands with hand-made labels: whether they reach the network.
COMMANDS = [
    ("ls -la", False), ("curl https://example.org", True), ("/usr/bin/wget x", True), ("git status", False), ("git -C x pull", True), ("git commit -m 'fetch later'", True), ("pip install requests", True), ("pip list", False),
    ("python -m pip list", True), ("cargo add serde", True), ("cargo build", False), ("gh api /user", True), ("gh pr list", False), ("cat curl.txt", False), ("(nc -l 80)", True), ("echo http://localhost:80/x", False),
    ("echo http://127.0.0.1/x", False), ("echo https://user@example.org:443/x", True), ("echo 'HTTP://[::1]:80/'", False), ("open file:///etc/x", False), ("uv run x", False), ("npm ci", False), ("quillstone search -w x", True), ("quillstone search x", False),
]


@query(f"SELECT p_partkey AS id, {[label for _, label in COMMANDS]!s}[1 + p_partkey % {len(COMMANDS)}] AS network FROM part")
def network_commands(spark, d):
    command = F.get(F.array(*[F.lit(c) for c, _ in COMMANDS]), (F.col("p_partkey") % len(COMMANDS)).cast("int"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), capture.network_command(command).alias("network"))


@query(
    """WITH o AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
g AS (SELECT user_id, ts, sum(first) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM o)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_seen, strftime(max(ts) + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS quiet_at, count(*) AS n FROM g GROUP BY user_id, g"""
)
def debounce_sessions(spark, d):
    from ..streaming.jobs import bursts

    told = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return bursts(table(spark, d, "events"), "1 hour").select("user_id", told("start").alias("first_seen"), told("end").alias("quiet_at"), "n")


@query(f"{_E} SELECT a.vec_id AS query_id, b.vec_id AS chunk_id, {_COS} + 0.0::DOUBLE AS distance FROM e a, e b WHERE a.vec_id % 20 = 0 AND b.label = 3 QUALIFY row_number() OVER (PARTITION BY a.vec_id ORDER BY 1 - list_dot_product(a.e, b.e) / (sqrt(list_dot_product(a.e, a.e)) * sqrt(list_dot_product(b.e, b.e))), b.vec_id) <= 10")
def scoped_search(spark, d):
    """Every vector whose id is divisible by 20 against one repository, exact or in two phases by its size."""
    q, c = _vectors(spark, d)
    c = c.withColumn("repo_key", F.col("scope").cast("string"))
    own = c.where(search.require_repo(c, "3"))
    return search.nearest_adaptive(q.where("query_id % 20 = 0"), own, 10, DIM).select("query_id", "chunk_id", (F.round("distance", 6) + F.lit(0.0)).alias("distance"))


@query("SELECT l_suppkey::VARCHAR AS repo_key, sum(l_linenumber) FILTER (l_partkey % 10 <> 0)::BIGINT AS chunks FROM lineitem WHERE l_partkey % 10 <> 0 GROUP BY 1 UNION ALL SELECT s_suppkey::VARCHAR, 0 FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_partkey % 10 <> 0)")
def scope_counts(spark, d):
    """Chunks of each supplier's files, where line numbers stand for counts of chunks."""
    files = table(spark, d, "lineitem").where("l_partkey % 10 <> 0").select(F.col("l_suppkey").cast("string").alias("repo_key"), F.col("l_linenumber").alias("chunk_count"))
    return search.scope_counts(files, table(spark, d, "supplier").select(F.col("s_suppkey").cast("string").alias("repo_key")))


@query(
    f"""WITH i AS (SELECT doc_id, 'repo > d' || doc_id || '.md' || CASE WHEN doc_id % 2 = 0 THEN ' > ' || source ELSE '' END || chr(10) || text AS s FROM documents)
SELECT doc_id, md5(CASE WHEN strlen(s) <= {K.RERANK_BYTES} THEN s ELSE left(s, list_max(list_filter(range({K.RERANK_BYTES // 4}, {K.RERANK_BYTES + 1}), lambda n: strlen(left(s, n)) <= {K.RERANK_BYTES}))::BIGINT) END) AS document FROM i"""
)
def rerank_documents(spark, d):
    """What a reranker is shown of each document; every second one has a symbol."""
    t = table(spark, d, "documents")
    path = F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit(".md"))
    return t.select("doc_id", F.md5(search.rerank_document(F.lit("repo"), path, F.when(F.col("doc_id") % 2 == 0, F.col("source")), F.col("text"))).alias("document"))


@query("SELECT user_id AS note_id, string_agg(DISTINCT (event_id % 4)::VARCHAR, ',' ORDER BY (event_id % 4)::VARCHAR) AS scopes FROM events WHERE event_type = 'error' AND event_id % 4 <> 0 GROUP BY 1")
def suppression_scopes(spark, d):
    muted = table(spark, d, "events").where("event_type = 'error'").select(F.col("user_id").alias("note_id"), (F.col("event_id") % 4).alias("repo_id"))
    return notes.suppression_scopes(muted).select("note_id", F.array_join(F.transform("scopes", lambda x: x.cast("string")), ",").alias("scopes"))


@query(f"WITH {_ANCHORS}, n AS (SELECT DISTINCT l_orderkey AS id, l_orderkey % 5 = 0 AS old FROM lineitem), s AS (SELECT DISTINCT note_id AS id FROM a JOIN f USING (repo_id, relpath) WHERE f.hash <> a.hash) SELECT id, CASE WHEN old THEN 'archived' WHEN id IN (SELECT id FROM s) THEN 'stale' ELSE 'live' END AS status, CASE WHEN NOT old AND id IN (SELECT id FROM s) THEN {NOW} END::BIGINT AS stale_at FROM n")
def commit_staleness(spark, d):
    """Notes after the files that lineitem stands for were stored; a fifth of the notes is archived."""
    anchors, files = _anchors(spark, d)
    state = anchors.select(F.col("note_id").alias("id")).distinct().select("id", F.when(F.col("id") % 5 == 0, "archived").otherwise("live").alias("status"), F.lit(None).cast("long").alias("stale_at"))
    return notes.commit_staleness(state, anchors, files, NOW).select("id", "status", F.col("stale_at").cast("long").alias("stale_at"))


@query('SELECT conv_id::VARCHAR AS session, max(greatest(turn, CASE WHEN conv_id % 3 = 0 THEN 5 ELSE 0 END))::BIGINT AS "offset" FROM conversations GROUP BY conv_id')
def session_offsets(spark, d):
    """How far each conversation is read; a third of them were read to line 5 before."""
    lines = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("line_no"), "conv_id")
    before = lines.where("conv_id % 3 = 0").select("session", F.lit(5).alias("offset")).distinct()
    return capture.commit_offsets(before, lines)


@query(
    f"""{_NOTES}, v AS (SELECT user_id AS id, count(*) FILTER (event_type = 'purchase') AS h, count(*) FILTER (event_type = 'error') AS m, floor(epoch(max(ts) FILTER (event_type = 'purchase')))::BIGINT AS voted_at FROM events WHERE event_type IN ('purchase', 'error') GROUP BY 1)
SELECT n.id, round(salience * pow(0.8, coalesce(m, 0)), 9) AS salience, noise_count + coalesce(m, 0) AS noise_count, helpful_count + coalesce(h, 0) AS helpful_count, coalesce(voted_at, last_access) AS last_access FROM n LEFT JOIN v USING (id)"""
)
def feedback_votes(spark, d):
    """Notes after every purchase (helpful) and error (noise) is cast as a vote."""
    e = table(spark, d, "events").where("event_type in ('purchase', 'error')")
    cast = e.select(F.col("event_id").alias("seq"), seconds("ts").alias("ts"), F.col("user_id").alias("note_id"), (F.col("event_type") == "purchase").alias("helpful"), (F.col("event_id") % 4).alias("repo_id"))
    none = spark.createDataFrame([], "note_id long, repo_id long, created_at long")
    after = notes.apply_votes(_notes(spark, d), none, cast)[0]
    return after.select("id", F.round("salience", 9).alias("salience"), "noise_count", "helpful_count", "last_access")


_HOLDS = "((id * 37) % 100) / 100.0::DOUBLE AS holds, ((id * 53) % 100) / 100.0::DOUBLE AS contradiction"


@query(
    """WITH e AS (SELECT user_id AS note_id, floor(epoch(ts))::BIGINT AS sec, CASE event_type WHEN 'purchase' THEN 'helpful' WHEN 'error' THEN 'noise' WHEN 'view' THEN 'touch' ELSE (['stale', 'archive', 'restore'])[event_id % 3 + 1] END AS kind,
  row_number() OVER (PARTITION BY user_id ORDER BY floor(epoch(ts)), event_id) AS n FROM events),
a AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('archive', 'restore') THEN kind = 'archive' END IGNORE NULLS) OVER (PARTITION BY note_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS away FROM e),
g AS (SELECT note_id, count(*) FILTER (kind = 'touch') AS access_count, count(*) FILTER (kind = 'helpful') AS helpful_count, count(*) FILTER (kind = 'noise') AS noise_count, max(sec) FILTER (kind = 'helpful') AS helpful_at,
  arg_max(kind = 'archive', n) FILTER (kind IN ('archive', 'restore')) AS gone, arg_max(CASE WHEN kind = 'stale' THEN sec ELSE -1 END, n) FILTER ((kind = 'stale' AND NOT away) OR (kind = 'restore' AND away)) AS d FROM a GROUP BY 1)
SELECT note_id, access_count, helpful_count, noise_count, helpful_at, CASE WHEN gone THEN 'archived' WHEN d >= 0 THEN 'stale' ELSE 'live' END AS status, nullif(d, -1) AS stale_at FROM g"""
)
def note_stream(spark, d):
    """All events as a stream in four micro-batches of what happens to notes, with a fifth that has the last one again: the
    state of each note at the end."""
    folder = f"{shared_folder(spark)}/notes-{uuid.uuid4().hex}"
    kind = F.when(F.col("event_type") == "purchase", "helpful").when(F.col("event_type") == "error", "noise").when(F.col("event_type") == "view", "touch")
    kind = F.coalesce(kind, F.element_at(F.array(*map(F.lit, ("stale", "archive", "restore"))), (F.col("event_id") % 3 + 1).cast("int")))
    events = table(spark, d, "events").select(F.col("user_id").alias("note_id"), F.col("event_id").alias("seq"), F.timestamp_seconds(seconds("ts")).alias("at"), kind.alias("kind"))
    edges = [x for x in events.select(F.unix_seconds("at").alias("s")).approxQuantile("s", [0.25, 0.5, 0.75], 0.01)]  # three times; any will do
    part = sum((F.when(F.unix_seconds("at") >= int(e), 1).otherwise(0) for e in edges), F.lit(0))
    own = spark.newSession()
    own.conf.set("spark.sql.streaming.stateStore.providerClass", note_state.ROCKSDB)

    def store_batch(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/out/batch={number}")

    for i in (0, 1, 2, 3, 3):
        events.where(part == i).write.mode("append").parquet(f"{folder}/in")
        stream = note_state.note_states(own.readStream.schema(events.schema).parquet(f"{folder}/in"), "1 day")
        stream.writeStream.foreachBatch(store_batch).outputMode("update").trigger(availableNow=True).option("checkpointLocation", f"{folder}/state").start().awaitTermination()
    last = spark.read.parquet(f"{folder}/out").groupBy("note_id").agg(F.max_by(F.struct("access_count", "helpful_count", "noise_count", "helpful_at", "status", "stale_at"), "batch").alias("s"))
    return last.select("note_id", "s.*")


@query(
    f"""{_NOTES}, v AS (SELECT *, CASE WHEN holds >= 0.5 THEN 'holds' WHEN contradiction >= 0.8 THEN 'contradicted' ELSE 'inconclusive' END AS verdict FROM (SELECT *, {_HOLDS} FROM n WHERE status = 'stale'))
SELECT id, verdict, CASE WHEN verdict = 'holds' THEN 'live' ELSE 'stale' END AS status, CASE WHEN verdict <> 'holds' THEN {NOW} END::BIGINT AS reverified_at, CASE WHEN verdict = 'contradicted' THEN {NOW} ELSE contradicted_at END::BIGINT AS contradicted_at FROM v"""
)
def verdict_commit(spark, d):
    """Stale notes after scores of a verifier that go by their ids."""
    stale = _notes(spark, d).where("status = 'stale'")
    score = lambda m: (F.col("id") * m) % 100 / 100.0
    told = stale.select(F.col("id").alias("note_id"), notes.verdict(score(37), score(53)).alias("verdict"))
    after = notes.commit_verdicts(stale, told, NOW).join(told.withColumnRenamed("note_id", "id"), "id")
    return after.select("id", "verdict", "status", F.col("reverified_at").cast("long").alias("reverified_at"), F.col("contradicted_at").cast("long").alias("contradicted_at"))


@query(
    f"""{_NOTES} SELECT id, CASE WHEN b AND (id % 3 = 0 OR stale_at IS NOT NULL) THEN 'stale' WHEN b THEN 'live' ELSE status END AS status, round(CASE WHEN b THEN least(1, salience / pow(0.8, noise_count)) ELSE salience END, 9) AS salience,
CASE WHEN b THEN 0 ELSE noise_count END::BIGINT AS noise_count, CASE WHEN b THEN {NOW} ELSE last_access END::BIGINT AS last_access FROM (SELECT *, status = 'archived' AND superseded_by IS NULL AND id % 4 <> 1 AS b FROM n)"""
)
def restored_notes(spark, d):
    """Archived notes come back, where an anchor of every third one has drifted."""
    own = _notes(spark, d)
    none = spark.createDataFrame([], "note_id long, repo_id long, created_at long")
    after = notes.restore(own, own.where("id % 4 <> 1").select("id"), own.where("id % 3 = 0").select(F.col("id").alias("note_id")), none, NOW)[0]
    return after.select("id", "status", F.round("salience", 9).alias("salience"), F.col("noise_count").cast("long").alias("noise_count"), F.col("last_access").cast("long").alias("last_access"))


class LengthVerifier:
    """Scores by the length of the claim, and fails on lengths that end in 3."""

    def ask(self, question: str, claim: str, evidence: str) -> float:
        if len(claim) % 10 == 3:
            raise ValueError("no answer")
        return len(claim) % 997 / 997.0


@query("""WITH s AS (SELECT quality = 1 AS label, CASE WHEN length(text) % 10 = 3 THEN 0 ELSE (length(text) % 997) / 997.0::DOUBLE END AS score FROM labels JOIN documents USING (doc_id)), w AS (SELECT max(score) AS worst FROM s WHERE NOT label)
SELECT count(*) FILTER (NOT label AND score >= 0.5) AS false_accepts, count(*) FILTER (label AND score < 0.5) AS false_rejects, round(max(worst), 9) AS worst_negative FROM s, w""")
def verifier_calibration(spark, d):
    """A verifier over labelled documents as claims; a row that it fails on counts as rejected."""
    pairs = table(spark, d, "labels").join(table(spark, d, "documents"), "doc_id").select(F.col("text").alias("claim"), F.lit("e").alias("evidence"), (F.col("quality") == 1).alias("label"))
    return evaluation.calibrate(pairs, LengthVerifier()).select("false_accepts", "false_rejects", F.round("worst_negative", 9).alias("worst_negative"))
