"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat, decontaminate, html, near, packing, quality, suffixes, tokens, units, warc
from corpusloom.llm.common import read

PROBE = r"\### Assistant: </turn> ok"


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_bpe() -> tuple[str, str, str]:
    import public_tokenizers

    return tokenizer_path("byte_bpe_50k.json"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def op1_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return chat.digest(chat.format_chat(rows.unionByName(probe)))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.token_counts(read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Every line that isn't blank, and the sentences of eight words or more in lines of several.
    return units.removed_units(read(spark, sf_dir, "documents"), sentences=True, min_sentence=8).drop("row")


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read(spark, sf_dir, "documents"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_components(read(spark, sf_dir, "documents"))


def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), byte_bpe())


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.substring_dedup(read(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_text(read(spark, sf_dir, "pages"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read_archives(warc.write_archives(read(spark, sf_dir, "pages"))).drop("archive")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


# Roles in the tables hold no control strings; texts are counted in full.
_OP1 = r"""
WITH t AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), s AS (
  SELECT *, length(text) + CASE WHEN regexp_matches(text, '\\[\\/#:]|</turn>|###')
      THEN length(text) - length(replace(text, '\', ''))
         + (length(text) - length(replace(text, '</turn>', ''))) // 7
         + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda x: length(x) - 2)), 0)
      ELSE 0 END + length(role) + 14 AS shown
  FROM t
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  cast(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  cast(sum(shown) AS BIGINT) AS formatted_chars
FROM s GROUP BY conv_id
"""

_OP2 = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[i:i + least(len(w), 13) - 1], ' ') AS k
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (
  SELECT doc_id, i, p.n, item_id FROM places p JOIN windows USING (n, k)
), hit AS (
  SELECT DISTINCT doc_id, i + j - 1 AS place FROM (SELECT doc_id, i, unnest(range(0, n)) AS j FROM hits)
), runs AS (
  SELECT doc_id, min(place) AS a, max(place) + 1 AS z FROM (SELECT doc_id, place, place - row_number() OVER (PARTITION BY doc_id ORDER BY place) AS run FROM hit) GROUP BY doc_id, run
), words AS (
  SELECT doc_id, cast(sum(z - a) AS BIGINT) AS n_hit, string_agg(a || '-' || z, ',' ORDER BY a) AS spans FROM runs GROUP BY doc_id
), same AS (
  SELECT doc_id, item_id, copy, i, i - j AS diagonal
  FROM (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM d) JOIN (SELECT item_id, row_number() OVER () AS copy, unnest(w) AS x, generate_subscripts(w, 1) AS j FROM b) USING (x)
), matches AS (
  SELECT doc_id, min(i) - 1 AS a, count(*) AS n
  FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, copy, diagonal ORDER BY i) AS run FROM same) GROUP BY doc_id, copy, diagonal, run
), longest AS (
  SELECT doc_id, max(n) AS n, min(a) FILTER (n = most) AS a FROM (SELECT *, max(n) OVER (PARTITION BY doc_id) AS most FROM matches) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids
  FROM (SELECT DISTINCT doc_id, cast(item_id AS VARCHAR) AS item_id FROM hits) GROUP BY doc_id
)
SELECT doc_id, cast(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated,
  coalesce(spans, '') AS hit_spans, coalesce(n, 0) AS longest_match, a AS longest_start
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id) LEFT JOIN longest USING (doc_id)
"""

_OP4 = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS part, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS unit FROM documents
), placed AS (
  SELECT *, coalesce(sum(length(part) + 1) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start,
    regexp_extract_all(part, '[.!?]*[^.!?]+[.!?]*') AS s FROM lines
), inner_ AS (
  SELECT doc_id, unit, start, unnest(s) AS part, generate_subscripts(s, 1) AS i FROM placed WHERE len(s) > 1
), both_ AS (
  SELECT doc_id, unit, false AS sentence, start, part FROM placed
  UNION ALL
  SELECT doc_id, unit, true, start + coalesce(sum(length(part)) OVER (PARTITION BY doc_id, unit ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), part FROM inner_
), normal AS (
  SELECT *, trim(regexp_replace(translate(part, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS u FROM both_
), ranked AS (
  SELECT *, first_value(doc_id) OVER w AS kept_doc_id, first_value(start) OVER w AS kept_start, row_number() OVER w AS k,
    NOT sentence AND row_number() OVER (PARTITION BY u, sentence ORDER BY doc_id, start) > 1 AS by_line
  FROM normal WHERE u <> '' AND (NOT sentence OR length(u) - length(replace(u, ' ', '')) + 1 >= 8)
  WINDOW w AS (PARTITION BY u ORDER BY doc_id, start, sentence)
), gone AS (SELECT *, bool_and(sentence) OVER (PARTITION BY doc_id, unit) AS parts FROM ranked WHERE k > 1)
SELECT doc_id, cast(unit AS INTEGER) AS unit, sentence, cast(start AS BIGINT) AS start, length(part) AS length, CASE WHEN by_line THEN 'line' ELSE 'sentence' END AS found_by, kept_doc_id, cast(kept_start AS BIGINT) AS kept_start
FROM gone WHERE NOT sentence OR parts
"""


def _op5() -> str:
    """Quality rules; the sketches' steps and the fences written out."""
    blanks = r"[\x20\x09-\x0D]"
    f = quality.FEATURES
    values = ", ".join(f"coalesce(({units} * {top}) // nullif({bottom}, 0), 0) AS {k}" for k, (top, bottom, units, _) in f.items())
    each = " UNION ALL ".join(f"SELECT lang, source, '{k}' AS feature, {k} AS v FROM vals WHERE NOT base_failed" for k in f)

    def level(name: str, keys: str) -> str:
        by = f"{keys}, feature" if keys else "feature"
        ranks = f"count(*) OVER (PARTITION BY {by}) AS size, count(*) OVER (PARTITION BY {by} ORDER BY step) AS below, count(*) FILTER (step = 0) OVER (PARTITION BY {by}) AS zeros"
        least = lambda ok: f"min(step) FILTER ({ok})"
        return f"""{name} AS (
  SELECT {by}, max(size) AS n, max(size - zeros) AS some, {least("below * 4 >= size")} AS q1, {least("below * 4 >= 3 * size")} AS q3,
    coalesce({least("step > 0 AND (below - zeros) * 4 >= size - zeros")}, 0) AS s1, coalesce({least("step > 0 AND (below - zeros) * 4 >= 3 * (size - zeros)")}, 0) AS s3
  FROM (SELECT {by}, step, {ranks} FROM each_) GROUP BY {by})"""

    drawn = lambda a, b: ", ".join(f"({a}.{n} * {a}.{q} + 200 * {b}.{q}) // ({a}.{n} + 200) AS {q}" for n, q in (("n", "q1"), ("n", "q3"), ("some", "s1"), ("some", "s3")))
    inside = " AND ".join([f"s.{k} <= l.{k}_hi" for k in f] + [f"s.{k} >= l.{k}_lo" for k, x in f.items() if x[-1]])
    tops = ", ".join([f"max(q3 + w) FILTER (feature = '{k}') AS {k}_hi, max(q1 - w) FILTER (feature = '{k}') AS {k}_lo" for k in f])
    return f"""
WITH d AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text,
    list_filter(regexp_split_to_array(coalesce(text, ''), '{blanks}+'), lambda x: x <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM documents
), r AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM (SELECT doc_id, i, unnest(range(0, 8)) AS j FROM (
    SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, k) AS n FROM (
      SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) > 7))) WHERE n > 1) GROUP BY doc_id
), facts AS (
  SELECT d.doc_id, lang, source, len(w) AS n_words, length(regexp_replace(text, '{blanks}', '', 'g')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words
  FROM d LEFT JOIN r ON d.doc_id = r.doc_id
), vals AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, {values} FROM facts
), each_ AS (SELECT lang, source, feature, v - v % (1::BIGINT << greatest(length(bin(v)) - 9, 0)) AS step FROM ({each})),
{level("own", "lang, source")},
{level("bylang", "lang")},
{level("whole", "")},
langs AS (SELECT b.lang, b.feature, {drawn("b", "c")} FROM bylang b JOIN whole c ON b.feature = c.feature),
picked AS (SELECT a.lang, a.source, a.feature, {drawn("a", "b")} FROM own a JOIN langs b ON a.lang IS NOT DISTINCT FROM b.lang AND a.feature = b.feature),
limits AS (
  SELECT lang, source, {tops} FROM (SELECT *, greatest(3 * (q3 - q1), 3 * (s3 - s1) // 2) AS w FROM picked) GROUP BY lang, source
)
SELECT s.doc_id, cast(n_words AS BIGINT) AS n_words, cast(word_chars AS BIGINT) AS word_chars, cast(n_symbols AS BIGINT) AS n_symbols, cast(n_dup_lines AS BIGINT) AS n_dup_lines,
  cast(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND coalesce({inside}, true) AS kept
FROM vals s LEFT JOIN limits l ON s.lang IS NOT DISTINCT FROM l.lang AND s.source IS NOT DISTINCT FROM l.source
"""


_OP6 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)
), n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), t AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.k = b.k AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), link AS MATERIALIZED (SELECT a, b FROM t JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach(a, b) AS (SELECT doc_id, doc_id FROM n UNION SELECT r.a, l.b FROM reach r JOIN link l ON l.a = r.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, coalesce(c.b, d.doc_id) AS component_id, coalesce(c.b, d.doc_id) = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS b FROM reach GROUP BY a) c USING (doc_id)
"""

# Texts as hex digits, two a byte; every string of 50 bytes with the first document that has it.
_OP8 = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents
), w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS k FROM (SELECT doc_id, h, unnest(range(0, n - 49)) AS i FROM d WHERE n >= 50)
), f AS (SELECT k, min(doc_id) AS first FROM w GROUP BY k HAVING count(DISTINCT doc_id) > 1
), hit AS (SELECT doc_id, i FROM w JOIN f ON w.k = f.k AND first < doc_id
), g AS (SELECT doc_id, i, CASE WHEN i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50 OR lag(i) OVER (PARTITION BY doc_id ORDER BY i) IS NULL THEN 1 ELSE 0 END AS new FROM hit
), runs AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM g) GROUP BY doc_id, run
), kept AS (
  SELECT doc_id, string_agg(substr(h, 2 * p + 1, 2 * (nxt - p)), '' ORDER BY p) AS kh FROM (
    SELECT d.doc_id, h, p, coalesce(nxt, n) AS nxt FROM d JOIN (
      SELECT doc_id, 0 AS p, min(a) AS nxt FROM runs GROUP BY doc_id
      UNION ALL SELECT doc_id, z, lead(a) OVER (PARTITION BY doc_id ORDER BY a) FROM runs) USING (doc_id)) GROUP BY doc_id
)
SELECT d.doc_id, n AS n_bytes, coalesce(r.gone, 0) AS n_removed, coalesce(r.spans, 0) AS n_spans, sha256(unhex(coalesce(kh, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id) LEFT JOIN (SELECT doc_id, cast(sum(z - a) AS BIGINT) AS gone, count(*) AS spans FROM runs GROUP BY doc_id) r USING (doc_id)
"""


_OP10 = """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n AS payload_bytes, p.d AS payload_digest,
  CASE WHEN first <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN first <> page_id THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_formatting": _OP1, "op2_decontamination": _OP2, "op4_substring_dedup": _OP4, "op5_quality_rules": _op5(), "op6_near_dedup": _OP6, "op8_suffix_array_dedup": _OP8, "op10_warc": _OP10}
