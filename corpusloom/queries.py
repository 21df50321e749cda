"""The engine's queries over the driver's tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.config import EmbeddingConfig
from corpusloom.functions import text as TX
from corpusloom.functions import vectors as V
from corpusloom.operators import counts as C
from corpusloom.operators import sampling as S
from corpusloom.operators import skipgrams as G
from corpusloom.operators import vocabulary as VO
from corpusloom.plans import training as TR
from corpusloom.sources import corpus, embeddings
from corpusloom.storage import materialise
from corpusloom.streaming.word_counts import stream_counts

CONFIG = EmbeddingConfig(owners=4)
OWNERS, WINDOW, EPOCHS = CONFIG.owners, CONFIG.window_size, CONFIG.epochs
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

# --- Parts of the SQL -----------------------------------------------------------------------

_TOKENS = r"""tokens AS (
  SELECT doc_id, generate_subscripts(w, 1) - 1 AS pos, unnest(w) AS word
  FROM (SELECT doc_id, list_filter(string_split_regex(lower(text), '[ \t\n\r\f\v]'), lambda x: x <> '') AS w FROM documents))"""
_COUNTS = _TOKENS + ", counts AS (SELECT word, count(*) AS cnt FROM tokens GROUP BY word)"
_OWNED = _COUNTS + f", owned AS (SELECT word, cnt, cast(('0x' || substr(md5(word), 1, 8))::BIGINT % {OWNERS} AS INTEGER) AS owner FROM counts)"
_KEPT = (
    _OWNED
    + f""", t AS (SELECT owner, coalesce(sum(cnt) FILTER (cnt >= {CONFIG.min_count}), 0)::DOUBLE * {CONFIG.sample}::DOUBLE AS threshold FROM owned GROUP BY owner)
, prob AS (SELECT *, CASE WHEN cnt >= {CONFIG.min_count} THEN least(1.0::DOUBLE, (sqrt(cnt / threshold) + 1) * (threshold / cnt)) ELSE 0.0 END AS p FROM owned JOIN t USING (owner))
, subsampled AS (SELECT *, cnt >= {CONFIG.min_count} AND p > ('0x' || substr(md5(word || '#{CONFIG.seed}'), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS kept FROM prob)
, kept AS (SELECT word, cnt, owner FROM subsampled WHERE kept)"""
)
_VOCAB = (
    _KEPT
    + f""", parts AS (
  SELECT o.owner, count(word) AS length FROM (SELECT cast(unnest(range({OWNERS})) AS INTEGER) AS owner) o LEFT JOIN kept USING (owner) GROUP BY o.owner)
, first AS (SELECT owner, length, cast(coalesce(sum(length) OVER (ORDER BY owner ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS first_word_index FROM parts)
, vocab AS (SELECT word, cnt, owner, cast(row_number() OVER (PARTITION BY owner ORDER BY word) - 1 AS INTEGER) AS local_idx,
    row_number() OVER (PARTITION BY owner ORDER BY word) - 1 + first_word_index AS global_idx FROM kept JOIN first USING (owner))"""
)
_PAIRS = (
    _VOCAB
    + f""", enc AS (SELECT doc_id, pos, t.word, global_idx AS idx, owner FROM tokens t JOIN vocab v ON t.word = v.word)
, pairs AS (SELECT a.doc_id, a.pos, a.word AS center, b.word AS ctx, a.idx AS out_idx, b.idx AS in_idx, a.owner, b.owner AS in_owner
  FROM enc a JOIN (SELECT * FROM enc, (SELECT unnest(range(-{WINDOW}, {WINDOW} + 1)) AS k)) b ON a.doc_id = b.doc_id AND a.pos = b.pos + b.k WHERE k <> 0)"""
)


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return corpus.read_table(spark, sf_dir)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(C.word_counts(_docs(spark, sf_dir)), "counts")


def _subsampled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return VO.subsample(_counts(spark, sf_dir), CONFIG)


def _vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return materialise(VO.vocabulary(_docs(spark, sf_dir), CONFIG), "vocabulary")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.document_pairs(_docs(spark, sf_dir), _vocab(spark, sf_dir), WINDOW)


# --- Scans and partitions ---------------------------------------------------------------------


@query("SELECT doc_id, text FROM documents")
def corpus_scan(spark, sf_dir):
    return _docs(spark, sf_dir)


@query("""WITH p AS (SELECT doc_id, strlen(text) AS n, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS off FROM documents),
s AS (SELECT greatest(1, ceil(sum(n) / 16.0::DOUBLE))::BIGINT AS size FROM p)
SELECT doc_id, cast(least(off // size, 15) AS INTEGER) AS part, cast(off AS BIGINT) AS read_offset, n AS read_length FROM p, s""")
def corpus_partitions(spark, sf_dir):
    return corpus.balanced_partitions(_docs(spark, sf_dir), 16)


@query(f"WITH {_TOKENS} SELECT doc_id, cast(pos AS INTEGER) AS pos, word FROM tokens")
def tokens(spark, sf_dir):
    return C.tokens(_docs(spark, sf_dir))


@query(f"WITH {_TOKENS} SELECT d.doc_id, count(word) AS n_tokens FROM documents d LEFT JOIN tokens t ON d.doc_id = t.doc_id GROUP BY d.doc_id")
def doc_token_counts(spark, sf_dir):
    return C.doc_token_counts(_docs(spark, sf_dir))


@query(r"""SELECT doc_id, strlen(text) AS n_bytes,
  cast(length(regexp_extract(text, '^([^\t\n ]*)[\t\n ]', 0)) - 1 AS INTEGER) AS first_delimiter,
  cast(CASE WHEN regexp_matches(text, '[\t\n ]') THEN length(text) - length(regexp_extract(text, '[^\t\n ]*$', 0)) - 1 ELSE length(text) END AS INTEGER) AS last_delimiter FROM documents""")
def delimiters(spark, sf_dir):
    t = F.col("text")
    return _docs(spark, sf_dir).select("doc_id", TX.byte_count(t).alias("n_bytes"), TX.first_delimiter(t).alias("first_delimiter"), TX.last_delimiter(t).alias("last_delimiter"))


_ENDS = r"""d AS (SELECT doc_id, regexp_split_to_array(text, '[\t\n ]') AS s, strlen(text) AS n FROM documents), ends AS MATERIALIZED (
  SELECT doc_id, i FROM (SELECT doc_id, k, m, cast(sum(strlen(p) + 1) OVER (PARTITION BY doc_id ORDER BY k) - 1 AS BIGINT) AS i
    FROM (SELECT doc_id, unnest(s) AS p, generate_subscripts(s, 1) AS k, len(s) AS m FROM d)) WHERE k < m)"""
_CUT = "z{k} AS (SELECT p.doc_id, p.n, p.z AS a, coalesce(min(e.i), p.n) AS z FROM {before} p LEFT JOIN ends e ON e.doc_id = p.doc_id AND e.i >= p.z + p.n // 4 GROUP BY p.doc_id, p.n, p.z)"


@query(
    f"""WITH {_ENDS}, z0 AS (SELECT doc_id, n, 0::BIGINT AS a, 0::BIGINT AS z FROM d), {", ".join(_CUT.format(k=k, before=f"z{k - 1}") for k in (1, 2, 3))}
{" UNION ALL ".join(f"SELECT doc_id, {k - 1}::INTEGER AS part, a AS read_offset, z - a AS read_length FROM z{k}" for k in (1, 2, 3))} UNION ALL SELECT doc_id, 3::INTEGER, z, n - z FROM z3"""
)
def byte_partitions(spark, sf_dir):
    return corpus.text_ranges(_docs(spark, sf_dir), 4)


@query(f"WITH {_TOKENS} SELECT d.doc_id, sha256(any_value(d.text)) AS text_sha256, count(word) AS n_tokens FROM documents d LEFT JOIN tokens t ON d.doc_id = t.doc_id WHERE d.text <> '' GROUP BY d.doc_id")
def chunk_reassembly(spark, sf_dir):
    """Pieces of whole words: put together they are the text, and cut apart they have its words."""
    rows = corpus.reassembled(_docs(spark, sf_dir)).withColumn("n", F.size(TX.tokenise(F.col("text"))))
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("piece", "text"))), lambda p: p["text"]), "")
    return rows.groupBy("doc_id").agg(F.sha2(whole, 256).alias("text_sha256"), F.sum("n").alias("n_tokens"))


# --- Counts and owners ------------------------------------------------------------------------


@query(f"WITH {_COUNTS} SELECT word, cnt FROM counts")
def word_count(spark, sf_dir):
    return C.word_counts(_docs(spark, sf_dir))


@query(f"WITH {_COUNTS} SELECT word, cnt FROM counts")
def word_count_partial_final(spark, sf_dir):
    docs = _docs(spark, sf_dir)
    return C.merge_counts(*[C.word_counts(docs.where(F.pmod("doc_id", F.lit(4)) == k)) for k in range(4)])


@query(f"WITH {_COUNTS} SELECT word, cnt FROM counts")
def streaming_word_count(spark, sf_dir):
    return stream_counts(spark, f"{sf_dir}/documents.parquet")


@query(f"WITH {_COUNTS} SELECT cast(sum(cnt) AS BIGINT) AS n_tokens, count(*) AS n_types FROM counts")
def corpus_size(spark, sf_dir):
    return C.word_counts(_docs(spark, sf_dir)).agg(F.sum("cnt").alias("n_tokens"), F.count("*").alias("n_types"))


@query(f"WITH {_OWNED} SELECT word, owner FROM owned")
def word_owner(spark, sf_dir):
    return C.owned(C.word_counts(_docs(spark, sf_dir)), OWNERS).select("word", "owner")


@query(f"WITH {_OWNED} SELECT owner, count(*) AS n_types, cast(sum(cnt) AS BIGINT) AS n_tokens FROM owned GROUP BY owner")
def owner_word_counts(spark, sf_dir):
    rows = C.owned(C.word_counts(_docs(spark, sf_dir)), OWNERS)
    return rows.groupBy("owner").agg(F.count("*").alias("n_types"), F.sum("cnt").alias("n_tokens"))


# --- Subsampling and the vocabulary -----------------------------------------------------------


@query(f"WITH {_COUNTS} SELECT word, cnt FROM counts WHERE cnt >= {CONFIG.min_count}")
def min_count_filter(spark, sf_dir):
    return C.word_counts(_docs(spark, sf_dir)).where(F.col("cnt") >= CONFIG.min_count)


@query(f"WITH {_KEPT} SELECT owner, threshold FROM t")
def subsample_threshold(spark, sf_dir):
    return VO.thresholds(_counts(spark, sf_dir), CONFIG).groupBy("owner").agg(F.max("threshold").alias("threshold"))


@query(f"WITH {_KEPT} SELECT word, cnt, p FROM prob WHERE cnt >= {CONFIG.min_count}")
def keep_probability(spark, sf_dir):
    return _subsampled(spark, sf_dir).where(F.col("cnt") >= CONFIG.min_count).select("word", "cnt", "p")


@query(f"WITH {_KEPT} SELECT word, cnt, owner FROM kept")
def subsample_keep(spark, sf_dir):
    return _subsampled(spark, sf_dir).where("kept").select("word", "cnt", "owner")


@query(f"WITH {_KEPT} SELECT owner, count(*) AS n_types, count(*) FILTER (kept) AS n_kept FROM subsampled GROUP BY owner")
def retention_ratio(spark, sf_dir):
    return VO.retention(_subsampled(spark, sf_dir))


@query(f"WITH {_VOCAB} SELECT word, owner, local_idx FROM vocab")
def vocab_local_index(spark, sf_dir):
    return VO.local_index(_subsampled(spark, sf_dir).where("kept")).select("word", "owner", "local_idx")


@query(f"WITH {_VOCAB} SELECT owner, length, first_word_index FROM first")
def vocab_partitions(spark, sf_dir):
    return VO.partitions(_subsampled(spark, sf_dir).where("kept"), OWNERS)


@query(f"WITH {_VOCAB} SELECT word, cnt, owner, local_idx, global_idx FROM vocab")
def vocab_global_index(spark, sf_dir):
    return VO.vocabulary(_docs(spark, sf_dir), CONFIG)


@query(f"WITH {_VOCAB} SELECT word, global_idx, cast(global_idx - first_word_index AS INTEGER) AS local_idx FROM vocab JOIN first USING (owner)")
def index_translation(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    first = VO.partitions(vocab, OWNERS)
    return vocab.join(F.broadcast(first), "owner").select("word", "global_idx", VO.to_local(F.col("global_idx"), F.col("first_word_index")).alias("local_idx"))


@query(f"WITH {_VOCAB} SELECT doc_id, cast(pos AS INTEGER) AS pos, word FROM tokens WHERE word IN (SELECT word FROM vocab)")
def in_vocab_tokens(spark, sf_dir):
    return VO.in_vocabulary(C.tokens(_docs(spark, sf_dir)), _vocab(spark, sf_dir)).select("doc_id", "pos", "word")


@query(f"WITH {_VOCAB} SELECT doc_id, cast(pos AS INTEGER) AS pos, word FROM tokens WHERE word NOT IN (SELECT word FROM vocab)")
def oov_tokens(spark, sf_dir):
    return VO.out_of_vocabulary(C.tokens(_docs(spark, sf_dir)), _vocab(spark, sf_dir)).select("doc_id", "pos", "word")


# --- Skip-grams -------------------------------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT doc_id, cast(pos AS INTEGER) AS pos, center, ctx, count(*) AS n FROM pairs GROUP BY ALL")
def skipgram_pairs(spark, sf_dir):
    return G.counted_pairs(_docs(spark, sf_dir), _vocab(spark, sf_dir), WINDOW)


@query(
    f"""WITH {_PAIRS}, sizes AS (SELECT d.doc_id, count(word) AS n FROM documents d LEFT JOIN tokens t ON d.doc_id = t.doc_id GROUP BY d.doc_id)
, offs AS (SELECT doc_id, coalesce(sum(n) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM sizes)
, placed AS (SELECT o + pos AS g, enc.* FROM enc JOIN offs USING (doc_id))
SELECT a.word AS center, count(*) AS n_pairs, cast(sum(b.idx) AS BIGINT) AS sum_in, count(*) FILTER (a.doc_id <> b.doc_id) AS n_across
FROM placed a JOIN (SELECT placed.*, g - k AS place FROM placed, (SELECT unnest(range(-{WINDOW}, {WINDOW} + 1)) AS k) WHERE k <> 0) b ON a.g = b.place GROUP BY a.word"""
)
def skipgram_pairs_corpus_scope(spark, sf_dir):
    docs, vocab = _docs(spark, sf_dir), _vocab(spark, sf_dir)
    inside = G.document_pairs(docs, vocab, WINDOW).select("out_idx", "in_idx", F.lit(0).alias("x"))
    across = G.seam_pairs(docs, vocab, WINDOW).select("out_idx", "in_idx", F.lit(1).alias("x"))
    rows = inside.unionByName(across).groupBy("out_idx").agg(F.count("*").alias("n_pairs"), F.sum("in_idx").alias("sum_in"), F.sum("x").alias("n_across"))
    return rows.join(vocab.select(F.col("global_idx").alias("out_idx"), F.col("word").alias("center")), "out_idx").drop("out_idx")


@query(f"WITH {_PAIRS} SELECT doc_id, cast(pos AS INTEGER) AS pos, center, string_agg(ctx, ' ' ORDER BY ctx) AS inputs FROM pairs GROUP BY doc_id, pos, center")
def skipgram_inputs_grouped(spark, sf_dir):
    return G.joined_inputs(_docs(spark, sf_dir), _vocab(spark, sf_dir), WINDOW)


@query(f"WITH {_PAIRS} SELECT in_owner, center, count(*) AS n_inputs, count(DISTINCT ctx) AS n_words FROM pairs GROUP BY in_owner, center")
def inputs_by_resolver(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    rows = G.by_resolver(G.document_pairs(_docs(spark, sf_dir), vocab, WINDOW))
    return rows.join(vocab.select(F.col("global_idx").alias("out_idx"), F.col("word").alias("center")), "out_idx").drop("out_idx")


@query(f"WITH {_PAIRS} SELECT out_idx, in_idx, owner, count(*) AS n FROM pairs GROUP BY ALL")
def encoded_pairs(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("out_idx", "in_idx", "owner").agg(F.count("*").alias("n"))


@query(f"WITH {_PAIRS} SELECT owner, count(*) AS n_pairs, count(DISTINCT in_idx) AS n_inputs FROM pairs GROUP BY owner")
def pairs_per_owner(spark, sf_dir):
    return _pairs(spark, sf_dir).groupBy("owner").agg(F.count("*").alias("n_pairs"), F.countDistinct("in_idx").alias("n_inputs"))


@query(f"WITH {_PAIRS} SELECT cast(e AS INTEGER) AS epoch, owner, count(*) AS n_pairs FROM pairs, (SELECT unnest(range({EPOCHS})) AS e) GROUP BY e, owner")
def epoch_pairs(spark, sf_dir):
    return G.repeated(_pairs(spark, sf_dir), EPOCHS).groupBy("epoch", "owner").agg(F.count("*").alias("n_pairs"))


# --- Sampling ---------------------------------------------------------------------------------


@query(f"WITH {_VOCAB} SELECT word, owner, round(cnt / sum(cnt) OVER (PARTITION BY owner), 12) AS p FROM vocab")
def unigram_probability(spark, sf_dir):
    return S.unigram_probability(_vocab(spark, sf_dir)).select("word", "owner", F.round("p", 12).alias("p"))


@query(f"""WITH {_VOCAB}, n AS (SELECT *, sum(cnt) OVER (PARTITION BY owner) AS total, count(*) OVER (PARTITION BY owner) AS n FROM vocab)
SELECT owner, local_idx, round(cnt / total * n, 9) AS s, local_idx AS alias, CASE WHEN cnt * n < total THEN 'low' WHEN cnt * n > total THEN 'high' ELSE 'even' END AS queue FROM n""")
def alias_init(spark, sf_dir):
    return S.alias_start(_vocab(spark, sf_dir)).withColumn("s", F.round("s", 9))


@query(f"WITH {_VOCAB} SELECT owner, local_idx, round(cnt / sum(cnt) OVER (PARTITION BY owner), 9) AS p FROM vocab")
def alias_mass(spark, sf_dir):
    return S.alias_mass(materialise(S.alias_tables(_vocab(spark, sf_dir)), "alias")).withColumn("p", F.round("p", 9))


@query(f"""WITH {_VOCAB}, c AS (SELECT owner, local_idx, cnt, sum(cnt) OVER (PARTITION BY owner ORDER BY local_idx) AS hi, sum(cnt) OVER (PARTITION BY owner) AS total FROM vocab)
, d AS (SELECT owner, draw, ('0x' || substr(md5(owner || '#' || draw || '#{CONFIG.seed}'), 1, 8))::BIGINT % total AS r FROM (SELECT DISTINCT owner, total FROM c), (SELECT unnest(range(1000)) AS draw))
SELECT draw, d.owner, local_idx FROM d JOIN c ON d.owner = c.owner AND r < hi AND r >= hi - cnt""")
def negative_draw_cdf(spark, sf_dir):
    return S.draw_by_cdf(_vocab(spark, sf_dir), 1000, CONFIG.seed)


_EACH = f"""each_ AS (SELECT DISTINCT out_idx, in_idx, owner, in_owner FROM pairs)
, sizes AS (SELECT owner, count(*) AS words FROM vocab GROUP BY owner)"""


@query(
    f"""WITH {_PAIRS}, {_EACH}
SELECT out_idx, in_idx, least({CONFIG.negative_samples}, words - 1 - CASE WHEN in_owner = e.owner AND in_idx <> out_idx THEN 1 ELSE 0 END) AS n, 0::BIGINT AS n_repeated, 0::BIGINT AS n_excluded, 0::BIGINT AS n_foreign
FROM each_ e JOIN sizes s ON e.owner = s.owner"""
)
def negative_samples_distinct(spark, sf_dir):
    """What holds of the negatives of every pair whatever is drawn: their number, and that none repeats, is one of the pair, or isn't the owner's."""
    vocab = _vocab(spark, sf_dir)
    drawn = S.negatives(G.document_pairs(_docs(spark, sf_dir), vocab, WINDOW), vocab, CONFIG.negative_samples, CONFIG.seed)
    rows = drawn.join(F.broadcast(VO.partitions(vocab, OWNERS)), "owner")  # a row an owner
    words = F.transform("negatives", lambda k: F.when((k >= 0) & (k < F.col("length")), VO.to_global(k, F.col("first_word_index"))))
    n = F.size("negatives").cast("long")
    return rows.withColumn("words", words).select(
        "out_idx",
        "in_idx",
        n.alias("n"),
        (n - F.size(F.array_distinct("negatives"))).alias("n_repeated"),
        F.size(F.filter("words", lambda w: w.isin(F.col("out_idx"), F.col("in_idx")))).cast("long").alias("n_excluded"),
        F.size(F.filter("words", lambda w: w.isNull())).cast("long").alias("n_foreign"),
    )


# --- Vectors and the training step ------------------------------------------------------------


@query(f"""WITH {_VOCAB}, e AS (SELECT word, global_idx, k, ('0x' || substr(md5(global_idx || '#' || k || '#in#{CONFIG.seed}'), 1, 8))::BIGINT / 2147483648.0::DOUBLE - 1 AS x FROM vocab, (SELECT unnest(range(16)) AS k))
SELECT word, global_idx, round(sqrt(sum(x * x)), 6) AS raw_norm, round(min(x), 6) AS least, round(max(x), 6) AS most, 1.0::DOUBLE AS norm FROM e GROUP BY word, global_idx""")
def init_weights(spark, sf_dir):
    idx = F.col("global_idx")
    raw = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda k: TX.word_hash(F.concat_ws("#", idx.cast("string"), k.cast("string")), f"#in#{CONFIG.seed}") / F.lit(float(2**31)) - 1)
    rows = _vocab(spark, sf_dir).select("word", "global_idx", raw.alias("raw"), TR.initial_vector(idx, "in", 16, CONFIG.seed).alias("v"))
    return rows.select("word", "global_idx", F.round(V.norm(F.col("raw")), 6).alias("raw_norm"), F.round(F.array_min("raw"), 6).alias("least"), F.round(F.array_max("raw"), 6).alias("most"), F.round(V.norm(F.col("v")), 9).alias("norm"))


@query("SELECT cast(e AS INTEGER) AS epoch, round(0.1::DOUBLE - e * (0.1::DOUBLE - 0.0001::DOUBLE) / 10, 9) AS rate FROM (SELECT unnest(range(10)) AS e)")
def learning_rate(spark, sf_dir):
    c = CONFIG
    e = F.col("id")
    return spark.range(c.epochs).select(e.cast("int").alias("epoch"), F.round(F.lit(c.learning_rate) - e * (c.learning_rate - c.min_learning_rate) / max(1, c.epochs), 9).alias("rate"))


_VEC = "v AS (SELECT vec_id AS i, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings)"
#: Input i is trained with output i + 1 and negatives i + 2 to i + 6, ids taken modulo their number.
_STEP = f"""{_VEC}, size AS (SELECT count(*) AS n FROM embeddings), far AS (SELECT unnest(range(1, 7)) AS d)
, dots AS (SELECT a.i, d, sum(a.x * b.x) AS dot FROM v a, far, size JOIN v b ON b.i = (a.i + d) % n AND b.k = a.k GROUP BY a.i, d)
, err AS (SELECT i, d, 1 / (1 + exp(-dot)) - CASE WHEN d = 1 THEN 1 ELSE 0 END AS e FROM dots)
, units AS (SELECT i, sqrt(sum(x * x)) AS norm FROM v GROUP BY i)
, gout AS (SELECT e.i, d, k, e * x AS g FROM err e JOIN v ON e.i = v.i)
, gin AS (SELECT e.i, b.k, sum(e * b.x) AS g FROM err e, size JOIN v b ON b.i = (e.i + e.d) % n GROUP BY e.i, b.k)"""


def _step_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """i, d, v (input vector), t (vector at distance d): 1 is the output, 2 to 6 are negatives."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").cast("array<double>").alias("v"))
    n = rows.agg(F.count("*").alias("n"))
    far = rows.join(F.broadcast(n)).withColumn("d", F.explode(F.array(*[F.lit(d) for d in range(1, 7)]))).withColumn("j", (F.col("i") + F.col("d")) % F.col("n"))
    return far.join(rows.select(F.col("i").alias("j"), F.col("v").alias("t")), "j").select("i", "d", "v", "t")


def _error() -> F.Column:
    return V.sigmoid(V.dot(F.col("v"), F.col("t"))) - F.when(F.col("d") == 1, 1).otherwise(0)


def _exploded(df: DataFrame, vector: str, *keys: str) -> DataFrame:
    return df.select(*keys, F.posexplode(vector).alias("k", "x")).select(*keys, (F.col("k") + 1).cast("long").alias("k"), F.round("x", 6).alias("x"))


@query(f"WITH {_VEC}, u AS (SELECT i, sqrt(sum(x * x)) AS norm FROM v GROUP BY i) SELECT i, k, round(x / norm, 6) AS x FROM v JOIN u USING (i)")
def l2_normalise(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i"), V.normalise(F.col("embedding").cast("array<double>")).alias("v"))
    return _exploded(rows, "v", "i")


@query(f"WITH {_STEP} SELECT i, cast(d AS INTEGER) AS d, round(dot, 6) AS dot, round(e, 6) AS error FROM dots JOIN err USING (i, d)")
def dot_sigmoid(spark, sf_dir):
    return _step_rows(spark, sf_dir).select("i", "d", F.round(V.dot(F.col("v"), F.col("t")), 6).alias("dot"), F.round(_error(), 6).alias("error"))


@query(f"WITH {_STEP} SELECT i, k, round(g, 6) AS x FROM gout WHERE d = 1")
def sgd_output_gradient(spark, sf_dir):
    rows = _step_rows(spark, sf_dir).where("d = 1").withColumn("g", V.scale(F.col("v"), _error()))
    return _exploded(rows, "g", "i")


def _input_gradient(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _step_rows(spark, sf_dir).withColumn("g", V.scale(F.col("t"), _error()))
    return parts.groupBy("i").agg(F.array(*[F.sum(F.col("g")[k]) for k in range(64)]).alias("g"), F.any_value("v").alias("v"))


@query(f"WITH {_STEP} SELECT i, k, round(g, 6) AS x FROM gin")
def sgd_input_gradient(spark, sf_dir):
    return _exploded(_input_gradient(spark, sf_dir), "g", "i")


_UPDATED = """, norms AS (SELECT {keys}, sqrt(sum(g * g)) AS gn FROM {g} GROUP BY {keys})
, moved AS (SELECT {keys}, k, w.x - CASE WHEN gn > 0 THEN 0.1::DOUBLE * g / gn ELSE 0 END AS x FROM {g} JOIN norms USING ({keys}) {weights})
, mn AS (SELECT {keys}, sqrt(sum(x * x)) AS n FROM moved GROUP BY {keys})
SELECT {out}, k, round(x / n, 6) AS x FROM moved JOIN mn USING ({keys})"""
_NEAR = "JOIN (SELECT v.i AS j, v.k AS kk, v.x, n AS size_ FROM v, size) w ON w.j = ({g}.i + {g}.d) % w.size_ AND w.kk = {g}.k"


@query(f"WITH {_STEP}" + _UPDATED.format(keys="i, d", g="gout", weights=_NEAR.format(g="gout") + " AND d > 1", out="i, cast(d AS INTEGER) AS d"))
def sgd_negative_step(spark, sf_dir):
    rows = _step_rows(spark, sf_dir).where("d > 1").withColumn("w", V.update(F.col("t"), V.scale(F.col("v"), _error()), F.lit(0.1)))
    return _exploded(rows, "w", "i", "d")


@query(f"WITH {_STEP}" + _UPDATED.format(keys="i, d", g="gout", weights=_NEAR.format(g="gout") + " AND d = 1", out="i"))
def sgd_output_update(spark, sf_dir):
    rows = _step_rows(spark, sf_dir).where("d = 1").withColumn("w", V.update(F.col("t"), V.scale(F.col("v"), _error()), F.lit(0.1)))
    return _exploded(rows, "w", "i")


@query(f"WITH {_STEP}" + _UPDATED.format(keys="i", g="gin", weights="JOIN (SELECT i AS j, k AS kk, x FROM v) w ON w.j = gin.i AND w.kk = gin.k", out="i"))
def sgd_input_update(spark, sf_dir):
    rows = _input_gradient(spark, sf_dir).withColumn("w", V.update(F.col("v"), F.col("g"), F.lit(0.1)))
    return _exploded(rows, "w", "i")


# --- Results ----------------------------------------------------------------------------------


@query("SELECT vec_id || ' ' || array_to_string(list_transform(embedding, lambda x: printf('%.6f', round(x::DOUBLE, 6))), ' ') AS value FROM embeddings")
def embedding_text_format(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").cast("string").alias("word"), F.col("embedding").cast("array<double>").alias("in_w"))
    return embeddings.lines(rows, digits=6)


@query(f"WITH {_VOCAB} SELECT word, owner, global_idx FROM vocab")
def result_union(spark, sf_dir):
    vocab = _vocab(spark, sf_dir)
    out = vocab.where(F.col("owner") == 0)
    for k in range(1, OWNERS):
        out = out.unionByName(vocab.where(F.col("owner") == k))
    return out.select("word", "owner", "global_idx").orderBy("owner", "word")


@query()
def train_embeddings(spark, sf_dir):
    """All epochs and dimensions of the operator's defaults over the whole corpus; a row a word."""
    weights = TR.train(_docs(spark, sf_dir), EmbeddingConfig())
    return weights.select("word", "owner", "global_idx", F.round(V.norm(F.col("in_w").cast("array<double>")), 6).alias("in_norm"), F.round(V.norm(F.col("out_w").cast("array<double>")), 6).alias("out_norm"))


# --- The same operators over other texts --------------------------------------------------------


def _other(table: str, key: str) -> None:
    words = _COUNTS.replace("FROM documents", f"FROM (SELECT {key} AS doc_id, text FROM {table})")

    def count(spark: SparkSession, sf_dir: str) -> DataFrame:
        return C.word_counts(corpus.read_table(spark, sf_dir, table, key))

    QUERIES[f"word_count_{table}"], SQL[f"word_count_{table}"] = count, f"WITH {words} SELECT word, cnt FROM counts"


_other("conversations", "conv_id")
_other("benchmark", "item_id")
