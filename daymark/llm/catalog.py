"""The corpus operators bound to the given tables, with SQL where SQL can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from daymark.catalog import Registry
from daymark.llm import aligning, article, bpe, lexical, mixing, packing, pii, quality, quotes, shards, simhash, topk, toxicity

registry = Registry()
RANKS = "byte_bpe_multi_50k.tiktoken"
WORDS, BYTES, PIECES = "word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


@registry.add("op1_simhash_near_dedup")
def _simhash(spark: SparkSession, d: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, d, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def _limits_sql(name: str, by: list[str]) -> str:
    """Thresholds of one level of merged sketches, from the bucket counts in `k`."""
    keys = "".join(f"{b}, " for b in by)
    part = "PARTITION BY " + keys + "rate"

    def at(percent: int) -> str:
        return f"min(low) FILTER (100 * upto >= {percent} * total)"

    return f"""{name}_c AS (SELECT {keys}rate, code, any_value(low) AS low, sum(n) AS n FROM k GROUP BY {keys}rate, code),
{name}_p AS (SELECT *, sum(n) OVER ({part} ORDER BY code) AS upto, sum(n) OVER ({part}) AS total FROM {name}_c),
{name}_q AS (SELECT {keys}rate, max(total) AS rows, {at(25)} AS q25, {at(50)} AS q50, {at(75)} AS q75 FROM {name}_p GROUP BY {keys}rate),
{name} AS (SELECT {keys}rate, rows, q50 + {quality.REACH} * greatest(q75 - q50, least_spread) AS high,
  CASE WHEN two_sided THEN q50 - {quality.REACH} * greatest(q50 - q25, least_spread) END AS low FROM {name}_q JOIN rates USING (rate))"""


_SHIFT, _BACK = "greatest(0, length(bin(value)) - 6)", "greatest(0, code // 32 - 1)"
_RATE_SQL = {name: sql.replace(" div ", " // ") for name, (sql, _, _) in quality.RATES.items()}
QUALITY_SQL = (
    r"""
WITH t AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '-') AS lang_key, coalesce('=' || source, '-') AS source_key,
         coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
i AS (SELECT r, words, unnest(range(1, len(words) - 3)) AS i FROM t WHERE len(words) >= 5),
s AS (SELECT r, i, array_to_string(words[i:i + 4], ' ') AS win FROM i),
x AS (SELECT r, i, count(*) OVER (PARTITION BY r, win) AS seen FROM s),
m AS (SELECT r, count(DISTINCT i + o) AS n_repeat_words FROM x, range(5) g(o) WHERE seen > 1 GROUP BY r),
c AS (
  SELECT doc_id, lang_key, source_key, CAST(len(words) AS BIGINT) AS n_words,
         length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
         CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, coalesce(n_repeat_words, 0) AS n_repeat_words,
         CAST(len(lines) AS BIGINT) AS n_lines, length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper
  FROM t LEFT JOIN m USING (r)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, """
    + ", ".join(f"{sql} AS {name}" for name, sql in _RATE_SQL.items())
    + """ FROM c),
rates AS (SELECT * FROM (VALUES """
    + ", ".join(f"('{name}', {spread}, {two})" for name, (_, spread, two) in quality.RATES.items())
    + f""") v(rate, least_spread, two_sided)),
u AS (UNPIVOT (SELECT lang_key, source_key, {", ".join(quality.RATES)} FROM b WHERE NOT base_failed)
      ON {", ".join(quality.RATES)} INTO NAME rate VALUE value),
n AS (SELECT lang_key, source_key, rate, 32 * {_SHIFT} + (value >> {_SHIFT}) AS code, count(*) AS n FROM u GROUP BY ALL),
k AS (SELECT *, (code - 32 * {_BACK}) << {_BACK} AS low FROM n),
"""
    + ",\n".join(_limits_sql(n, by) for n, by in (("own", ["lang_key", "source_key"]), ("lang", ["lang_key"]), ("corpus", [])))
    + f""",
l AS (
  SELECT own.lang_key, own.source_key, rate, CASE WHEN own.rows >= {quality.MIN_ROWS} THEN own.high WHEN lang.rows >= {quality.MIN_ROWS} THEN lang.high ELSE corpus.high END AS high,
         CASE WHEN own.rows >= {quality.MIN_ROWS} THEN own.low WHEN lang.rows >= {quality.MIN_ROWS} THEN lang.low ELSE corpus.low END AS low
  FROM own JOIN lang USING (lang_key, rate) JOIN corpus USING (rate)),
g AS (SELECT lang_key, source_key, """
    + ", ".join(f"max(high) FILTER (rate = '{n}') AS {n}_high, max(low) FILTER (rate = '{n}') AS {n}_low" for n in quality.RATES)
    + """ FROM l GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  coalesce(NOT base_failed AND """
    + " AND ".join(f"{n} <= {n}_high" + (f" AND {n} >= {n}_low" if two else "") for n, (_, _, two) in quality.RATES.items())
    + """, false) AS kept
FROM b LEFT JOIN g USING (lang_key, source_key)"""
)


@registry.add("op2_quality_rules", QUALITY_SQL)
def _quality(spark: SparkSession, d: str) -> DataFrame:
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(table(spark, d, "documents")).select(columns)


@registry.add("op3_html_extraction")
def _article(spark: SparkSession, d: str) -> DataFrame:
    return article.main_texts(table(spark, d, "pages"))


@registry.add("op4_toxicity")
def _toxicity(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.toxicity(table(spark, d, "documents"), table(spark, d, "labels"))


TOPK_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.vec, c.vec) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
  FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""


@registry.add("op5_exact_top_k", TOPK_SQL)
def _top_k(spark: SparkSession, d: str) -> DataFrame:
    vectors = table(spark, d, "embeddings")
    return topk.top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10)


@registry.add("op6_sharding")
def _shards(spark: SparkSession, d: str) -> DataFrame:
    placed = shards.shard_by_bytes(table(spark, d, "documents"), 24)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


QUOTE_SQL = r"""
WITH RECURSIVE msg AS (
  SELECT row_number() OVER () AS id, *, coalesce('=' || conv_id, '-') AS conv, string_split(text, chr(10)) AS lines FROM conversations),
ln AS (SELECT id, conv, turn, unnest(range(len(lines))) AS pos, unnest(lines) AS line FROM msg WHERE text IS NOT NULL),
lv AS (
  SELECT *, length(regexp_replace(regexp_extract(line, '^[ \t>]*>'), '[^>]', '', 'g')) AS level,
         trim(regexp_replace(lower(regexp_replace(line, '^[ \t>]*>', '')), '[\x09-\x0D ]+', ' ', 'g')) AS body
  FROM ln),
st AS (SELECT *, coalesce(lag(CASE WHEN body <> '' THEN level END) OVER (PARTITION BY id ORDER BY pos) = level, false) AS goes_on FROM lv),
pt AS (SELECT *, sum(CASE WHEN goes_on THEN 0 ELSE 1 END) OVER (PARTITION BY id ORDER BY pos) AS part FROM st),
psg AS (
  SELECT id, conv, turn, level, body FROM pt WHERE body <> '' AND turn IS NOT NULL
  UNION ALL SELECT id, any_value(conv), any_value(turn), level, string_agg(body, ' ' ORDER BY pos) FROM pt
  WHERE body <> '' AND turn IS NOT NULL GROUP BY id, level, part HAVING count(*) > 1),
org AS (SELECT conv, body, min(turn) AS origin FROM psg WHERE level = 0 GROUP BY conv, body),
vote AS (
  SELECT id, psg.conv, turn, level, origin, sum(length(body)) AS weight, count(*) AS n
  FROM psg JOIN org USING (conv, body) WHERE level > 0 AND origin < turn GROUP BY ALL),
rep AS (
  SELECT id, conv, turn, origin AS reply_to, CAST(all_n AS BIGINT) AS n_linked
  FROM (SELECT *, sum(n) OVER (PARTITION BY id) AS all_n, row_number() OVER (PARTITION BY id ORDER BY level, weight DESC, origin DESC) AS rn FROM vote)
  WHERE rn = 1),
one AS (SELECT conv, turn, min(reply_to) AS parent FROM rep GROUP BY conv, turn),
up AS (
  SELECT conv, turn, parent AS root, 1 AS depth FROM one
  UNION ALL SELECT up.conv, up.turn, one.parent, depth + 1 FROM up JOIN one ON up.conv = one.conv AND up.root = one.turn),
top AS (SELECT conv, turn, max(depth) AS depth, arg_max(root, depth) AS root FROM up GROUP BY conv, turn),
quoted AS (SELECT id, count(*) FILTER (level > 0) AS n_quoted_lines FROM lv GROUP BY id),
own AS (
  SELECT id, array_to_string(list_filter(lines, lambda x, i: NOT regexp_matches(x, '^[ \t>]*>')
         AND NOT (regexp_matches(x, '(?i)^\s*on\b.*\bwrote:\s*$') AND coalesce(regexp_matches(lines[i + 1], '^[ \t>]*>'), false))), chr(10)) AS kept
  FROM msg),
res AS (
  SELECT msg.conv_id, msg.turn, msg.role, msg.conv, CASE WHEN coalesce(n_quoted_lines, 0) = 0 THEN msg.text ELSE trim(kept) END AS text,
         coalesce(n_quoted_lines, 0) AS n_quoted_lines, coalesce(n_linked, 0) AS n_linked, reply_to,
         CASE WHEN reply_to IS NULL THEN msg.turn ELSE top.root END AS root_turn, CASE WHEN reply_to IS NULL THEN 0 ELSE top.depth END AS depth
  FROM msg LEFT JOIN quoted USING (id) LEFT JOIN own USING (id) LEFT JOIN rep USING (id)
       LEFT JOIN top ON top.conv = msg.conv AND top.turn = msg.turn)
SELECT conv_id, turn, role, text, n_quoted_lines, n_linked, reply_to, root_turn, depth,
  dense_rank() OVER (PARTITION BY conv ORDER BY root_turn NULLS FIRST, turn NULLS FIRST) - 1 AS position FROM res"""


@registry.add("op7_quote_linking", QUOTE_SQL)
def _quotes(spark: SparkSession, d: str) -> DataFrame:
    return quotes.thread(table(spark, d, "conversations"))


@registry.add("op8_pii")
def _pii(spark: SparkSession, d: str) -> DataFrame:
    found = pii.find(table(spark, d, "documents"))
    return found.withColumn("spans", pii.span_text(F.col("spans")))


@registry.add("op9_byte_bpe")
def _bpe(spark: SparkSession, d: str) -> DataFrame:
    return bpe.token_digests(table(spark, d, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


MIX_SQL = f"""
WITH d AS (
  SELECT doc_id, source, coalesce('=' || source, '-') AS source_key,
         CAST(coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0) AS BIGINT) AS size,
         md5(concat_ws('|', '{mixing.SEED}', CAST(doc_id AS VARCHAR))) AS draw
  FROM documents),
s AS (SELECT source_key, any_value(source) AS source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source_key),
w AS (
  SELECT source_key, source_size, 2 * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight
  FROM s),
l AS (
  SELECT *, row_number() OVER o AS pos,
         (1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE)
          - CAST(coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE))
         / CAST(sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS level
  FROM w WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / weight, source_key)),
f AS (SELECT min_by(level, pos) AS level FROM l WHERE level * weight < cap),
t AS (
  SELECT l.source_key, l.source_size, coalesce(least(CAST(cap AS DOUBLE), f.level * weight), CAST(cap AS DOUBLE)) AS target
  FROM l CROSS JOIN f),
r AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END AS rate,
         CAST(('0x' || substr(md5('{mixing.SEED}|' || source_key), 1, 8)) AS BIGINT) / 4294967296.0::DOUBLE AS offs
  FROM t),
p AS (SELECT *, row_number() OVER (PARTITION BY source_key ORDER BY size, draw, doc_id) - 1 AS k FROM d),
c AS (
  SELECT doc_id, size, source_size, target,
         CAST(least(floor(offs + rate * (k + 1)) - floor(offs + rate * k), ceil(rate)) AS BIGINT) AS copies
  FROM p JOIN r USING (source_key))
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c"""


@registry.add("op10_source_mixing", MIX_SQL)
def _mixing(spark: SparkSession, d: str) -> DataFrame:
    drawn = mixing.sample(table(spark, d, "documents"))
    return drawn.select("doc_id", "size", "source_size", "target", "copies", "taken")


@registry.add("op11_packing")
def _packing(spark: SparkSession, d: str) -> DataFrame:
    pieces = packing.pack(table(spark, d, "documents"), public_tokenizers.path(WORDS), by_word=True)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@registry.add("op12_tokenizer_alignment")
def _aligning(spark: SparkSession, d: str) -> DataFrame:
    models = public_tokenizers.path(BYTES), public_tokenizers.path(PIECES)
    return aligning.alignments(table(spark, d, "documents"), *models)


_SEARCH_TERMS = r"""regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"""
SEARCH_SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_SEARCH_TERMS} AS words FROM documents),
s AS (SELECT count(*) AS n_docs, CAST(sum(len(words)) AS BIGINT) AS n_terms FROM d WHERE len(words) > 0),
q AS (SELECT DISTINCT item_id, list_sort(list_distinct({_SEARCH_TERMS})) AS terms FROM benchmark),
i AS (SELECT row_number() OVER () AS item, item_id, unnest(terms) AS term FROM q),
t AS (SELECT r, doc_id, len(words) AS n, unnest(words) AS term FROM d),
f AS (SELECT r, doc_id, n, term, count(*) AS tf FROM t SEMI JOIN i USING (term) GROUP BY ALL),
w AS (
  SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(n_docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w
  FROM f CROSS JOIN s GROUP BY term),
p AS (
  SELECT r, doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + ((90 * n * n_docs) // n_terms)))) AS impact
  FROM f JOIN w USING (term) CROSS JOIN s),
c AS (SELECT item, item_id, r, doc_id, CAST(sum(impact) AS BIGINT) AS score FROM i JOIN p USING (term) GROUP BY ALL),
o AS (
  SELECT item_id, CAST(row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
  FROM c WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM o WHERE rank <= 10"""


@registry.add("op13_lexical_search", SEARCH_SQL)
def _lexical(spark: SparkSession, d: str) -> DataFrame:
    return lexical.search(table(spark, d, "documents"), table(spark, d, "benchmark"), k=10)
