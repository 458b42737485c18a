"""One query per operator over its whole table: ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    chat_format,
    decontaminate,
    html_crf,
    line_dedup,
    packing,
    pii,
    quality_rules,
    secret_scan,
    sentencepiece_fst,
    simhash,
    token_alignment,
    token_counts,
    whitening,
)
from .common import table

MAX_TOKENS = 4096
TEXTS_PER_BATCH = 1000
#: A real job passes its own secret.
PII_KEY = b"example key of the query"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The documents.  Texts are long, so fewer of them make a batch for Python workers."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    return table(spark, sf_dir, "documents")


def op1_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", TEXTS_PER_BATCH)
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_crf.extract(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base numbers and verdict of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang", "source")
    return quality_rules.quality(docs, ["doc_id"])


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    found = decontaminate.find_benchmark(docs, table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        F.col("found.words").alias("n_words"),
        F.col("found.hits").alias("n_hit"),
        F.size("found.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("found.items", ","), 256).alias("items_sha256"),
        (F.col("found.hits") > 0).alias("contaminated"),
    )


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that three documents share."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.dedup_lines(docs).select(
        "doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256")
    )


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Piece ids of every document, and the text they decode to."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    coded = sentencepiece_fst.decode(sentencepiece_fst.encode(docs))
    plain = F.translate(F.coalesce("text", F.lit("")), sentencepiece_fst.SPACE, " ")
    return coded.select(
        "doc_id",
        F.size("token_ids").cast("long").alias("n_tokens"),
        F.xxhash64("token_ids").alias("ids_hash"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        (F.col("decoded") == plain).alias("round_trip"),
    )


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate groups of the documents."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return simhash.near_duplicates(docs).select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under pseudonyms, and where they stand."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    named = pii.pseudonymise(docs, PII_KEY)
    of_kind = lambda k: F.size(F.filter("pii", lambda s: s["kind"] == k)).cast("long")
    return named.select(
        "doc_id",
        F.col("new_text").alias("text"),
        *[of_kind(k).alias(f"n_{k}") for k in pii.KINDS],
        F.col("pii").alias("spans"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text", "source")
    found = secret_scan.find_secrets(docs)
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["kind"] == secret_scan.KINDS.index(k))).cast("long")
    live = F.size(F.filter("verdicts", lambda v: v["live"])).cast("long")
    return found.select(
        "doc_id",
        *[of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(secret_scan.span_text(F.col("base")), 256).alias("base_sha256"),
        secret_scan.span_text(F.col("spans")).alias("spans"),
        live.alias("n_live"),
        (F.size("verdicts") - live).alias("n_examples"),
    )


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    counted = token_counts.count_tokens(docs)
    return counted.select(
        "doc_id",
        F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"),
        "n_tokens",
        (F.col("n_tokens") > MAX_TOKENS).alias("over_limit"),
    )


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Examples of all conversations, read back; conversation -1 holds the marks themselves."""
    marks = "</s>[INST] ok [/INST]"
    own = spark.range(1).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.explode(
            F.array(*[F.struct(F.lit(k).cast("long").alias("turn"), F.lit(r).alias("role")) for k, r in enumerate(("user", "assistant"))])
        ).alias("t"),
        F.lit(marks).alias("text"),
    )
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    both = turns.unionByName(own.select("conv_id", "t.turn", "t.role", "text"))
    return chat_format.read_back(chat_format.expand_examples(both))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whitened components of all embeddings; a deviation beyond a long is null."""
    white = whitening.whiten(table(spark, sf_dir, "embeddings"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of all documents in full sequences."""
    return packing.pack(table(spark, sf_dir, "documents")).drop("ids")


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of two tokenizers' tokens in every document, and how usual their links are."""
    return token_alignment.score(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_html_extraction": op1_html_extraction,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_line_dedup": op4_line_dedup,
    "op5_sentencepiece": op5_sentencepiece,
    "op6_simhash": op6_simhash,
    "op7_pii": op7_pii,
    "op8_secret_scan": op8_secret_scan,
    "op9_token_counts": op9_token_counts,
    "op10_chat_format": op10_chat_format,
    "op11_whitening": op11_whitening,
    "op12_packing": op12_packing,
    "op13_token_alignment": op13_token_alignment,
}
ORACLE: dict[str, str] = {
    "op2_quality_rules": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         translate(coalesce(text, ''), E' \t\n\x0b\x0c\r', '') AS dense,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         [x FOR x IN string_split(coalesce(text, ''), chr(10)) IF trim(x, E' \t\n\x0b\x0c\r') <> ''] AS l
  FROM documents),
grams AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM docs)),
again AS (SELECT r, i FROM grams QUALIFY count(*) OVER (PARTITION BY r, g) > 1),
repeats AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM again) GROUP BY r),
base AS (
  SELECT d.*, len(w)::BIGINT AS n_words, length(dense)::BIGINT AS word_chars,
         (length(t) - length(translate(t, '#*$%&|<>', '')))::BIGINT AS n_symbols,
         (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words,
         length(dense) - length(translate(dense, '!"''()+,-./:;=?@[\]^_`{}~#*$%&|<>', '')) AS marks,
         length(dense) - length(translate(dense, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', '')) AS capitals
  FROM docs d LEFT JOIN repeats USING (r)),
rules AS (
  SELECT *, n_words < 50 OR n_repeat_words * 100 > n_words * 50 AS base_failed,
         [{'rule': 'symbols', 'v': CASE WHEN word_chars > 0 THEN n_symbols * 1000 // word_chars ELSE 0 END},
          {'rule': 'marks', 'v': CASE WHEN word_chars > 0 THEN marks * 1000 // word_chars ELSE 0 END},
          {'rule': 'capitals', 'v': CASE WHEN word_chars > 0 THEN capitals * 1000 // word_chars ELSE 0 END},
          {'rule': 'dup_lines', 'v': CASE WHEN len(l) > 0 THEN n_dup_lines * 1000 // len(l) ELSE 0 END},
          {'rule': 'repeats', 'v': CASE WHEN n_words > 0 THEN n_repeat_words * 1000 // n_words ELSE 0 END},
          {'rule': 'word_length', 'v': CASE WHEN n_words > 0 THEN word_chars * 100 // n_words ELSE 0 END}] AS rs
  FROM base),
vals AS (SELECT r, lang, source, x.rule AS rule, x.v::BIGINT AS v FROM (SELECT r, lang, source, unnest(rs) AS x FROM rules)),
buckets AS (
  SELECT *, (v >> greatest(length(bin(v)) - 6, 0)) << greatest(length(bin(v)) - 6, 0) AS b FROM vals),
spread AS (
  SELECT *, CASE WHEN rule = 'dup_lines' THEN 4 WHEN rule IN ('symbols', 'repeats') THEN 16 ELSE 8 END AS fence FROM buckets
  WHERE b > 0 OR rule NOT IN ('symbols', 'dup_lines', 'repeats')),
quartiles AS (
  SELECT 0 AS level, lang, source, rule, count(*) AS n, any_value(fence) AS fence,
         quantile_disc(b, 0.25) AS q1, quantile_disc(b, 0.5) AS q2, quantile_disc(b, 0.75) AS q3 FROM spread GROUP BY lang, source, rule
  UNION ALL
  SELECT 1, lang, NULL, rule, count(*), any_value(fence),
         quantile_disc(b, 0.25), quantile_disc(b, 0.5), quantile_disc(b, 0.75) FROM spread GROUP BY lang, rule
  UNION ALL
  SELECT 2, NULL, NULL, rule, count(*), any_value(fence),
         quantile_disc(b, 0.25), quantile_disc(b, 0.5), quantile_disc(b, 0.75) FROM spread GROUP BY rule),
cuts AS (
  SELECT *, q2 + fence * (q2 - q1 + w) AS high, greatest(0, q2 - fence * (q3 - q2 + w)) AS low
  FROM (SELECT *, 1 << greatest(length(bin(q2)) - 6, 0) AS w FROM quartiles)),
groups AS (SELECT DISTINCT lang, source, rule FROM vals),
blended AS (
  SELECT g.lang, g.source, g.rule, c.high AS h2, c.low AS l2, least(coalesce(l.n, 0), 1000000)::BIGINT AS n1, coalesce(l.high, 0) AS h1, coalesce(l.low, 0) AS l1,
         least(coalesce(o.n, 0), 1000000)::BIGINT AS n0, coalesce(o.high, 0) AS h0, coalesce(o.low, 0) AS l0
  FROM groups g
  LEFT JOIN cuts c ON c.level = 2 AND c.rule = g.rule
  LEFT JOIN cuts l ON l.level = 1 AND l.rule = g.rule AND l.lang IS NOT DISTINCT FROM g.lang
  LEFT JOIN cuts o ON o.level = 0 AND o.rule = g.rule AND o.lang IS NOT DISTINCT FROM g.lang AND o.source IS NOT DISTINCT FROM g.source),
limits AS (
  SELECT lang, source, rule, (n0 * n0 * h0 + 2500 * ((n1 * n1 * h1 + 2500 * h2) // (n1 * n1 + 2500))) // (n0 * n0 + 2500) AS high,
         (n0 * n0 * l0 + 2500 * ((n1 * n1 * l1 + 2500 * l2) // (n1 * n1 + 2500))) // (n0 * n0 + 2500) AS low FROM blended),
outside AS (
  SELECT DISTINCT v.r FROM vals v JOIN limits f ON v.rule = f.rule AND v.lang IS NOT DISTINCT FROM f.lang
  AND v.source IS NOT DISTINCT FROM f.source
  WHERE v.v > f.high OR (v.rule = 'word_length' AND v.v < f.low))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND r NOT IN (SELECT r FROM outside) AS kept
FROM rules
""",
    "op8_secret_scan": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, '') AS owner, coalesce(text, '') AS t FROM documents),
runs AS (
  SELECT r, doc_id, owner, 0 AS k, 'assign' AS kind,
         regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 0) AS m,
         regexp_extract_all(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS v,
         regexp_split_to_array(t, '([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS b FROM docs
  UNION ALL
  SELECT r, doc_id, owner, 1, 'access', regexp_extract_all(t, 'AKIA[A-Z0-9]+'), NULL, regexp_split_to_array(t, 'AKIA[A-Z0-9]+') FROM docs
  UNION ALL
  SELECT r, doc_id, owner, 2, 'hex', regexp_extract_all(t, '[0-9a-f]{32,}'), NULL, regexp_split_to_array(t, '[0-9a-f]{32,}') FROM docs
  UNION ALL
  SELECT r, doc_id, owner, 3, 'token', regexp_extract_all(t, '[A-Za-z0-9+/_-]{24,}'), NULL, regexp_split_to_array(t, '[A-Za-z0-9+/_-]{24,}') FROM docs),
placed AS (
  SELECT r, doc_id, owner, k, kind, i, m[i] AS m, coalesce(v[i], m[i]) AS v,
         sum(length(b[i]) + length(m[i])) OVER (PARTITION BY r, k ORDER BY i) AS e
  FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM runs)),
spans AS (
  SELECT *, (e - length(m))::BIGINT AS s,
         regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') AND len(list_distinct(string_split(v, ''))) >= 8 AS rnd
  FROM placed WHERE (k = 0 AND length(v) >= 8) OR (k = 1 AND length(m) >= 16) OR (k = 2 AND length(m) >= 32) OR (k = 3 AND length(m) >= 24)),
wide AS (
  SELECT * FROM spans w WHERE k = 3 AND rnd
  AND NOT EXISTS (SELECT 1 FROM spans b WHERE b.r = w.r AND b.k < 3 AND b.s < w.e AND w.s < b.e)),
cand AS (SELECT * FROM spans WHERE k < 3 UNION ALL SELECT * FROM wide),
judged AS (SELECT v, bool_or(rnd) AND count(DISTINCT owner) <= 2 AND count(DISTINCT coalesce(doc_id::VARCHAR, '')) <= 10 AS live FROM cand GROUP BY v),
shown AS (SELECT c.*, j.live FROM cand c JOIN judged j USING (v)),
rowwise AS (
  SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
         string_agg(kind || ':' || s || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3) AS base,
         string_agg(kind || ':' || s || ':' || e::BIGINT, ',' ORDER BY s, k) FILTER (k < 3 OR live) AS spans,
         count(DISTINCT v) FILTER (live) AS n_live, count(DISTINCT v) FILTER (NOT live) AS n_examples
  FROM shown GROUP BY r)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
       coalesce(n_live, 0) AS n_live, coalesce(n_examples, 0) AS n_examples
FROM docs d LEFT JOIN rowwise USING (r)
""",
    "op10_chat_format": r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
marked AS (
  SELECT *, length(regexp_replace(replace(text, '\', '\\'), '<(/?s>|</?SYS>>)|\[(/?INST\]|/?REPLY\]|/?ROLE)', '\0x', 'g'))
         + CASE role WHEN 'system' THEN 15 WHEN 'user' THEN 13 WHEN 'assistant' THEN 11
           ELSE 15 + length(replace(regexp_replace(replace(role, '\', '\\'), '<(/?s>|</?SYS>>)|\[(/?INST\]|/?REPLY\]|/?ROLE)', '\0x', 'g'), ']', '\]')) END AS chars
  FROM turns),
placed AS (
  SELECT *, 3 + sum(chars) OVER w AS upto, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS from_end
  FROM marked WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text ROWS UNBOUNDED PRECEDING))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(upto) FILTER (role = 'assistant' OR from_end = 1)::BIGINT AS formatted_chars
FROM placed GROUP BY conv_id
""",
    "op3_decontamination": r"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL),
wins AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
        FROM (SELECT item_id, w, least(10, len(w)) AS n FROM items WHERE len(w) > 0))),
sizes AS (SELECT DISTINCT n FROM wins),
grams AS (
  SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, sizes)),
found AS (SELECT r, i, n, item_id FROM grams JOIN wins USING (n, g)),
hits AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT r, i, n FROM found)) GROUP BY r),
names AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids
  FROM (SELECT DISTINCT r, item_id::VARCHAR AS s FROM found) GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM docs LEFT JOIN hits USING (r) LEFT JOIN names USING (r)
""",
    "op4_line_dedup": r"""
WITH lines AS (
  SELECT doc_id, pos, line,
         translate(trim(line, E' \t\n\x0b\x0c\r'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS pos
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents))),
common AS (
  SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20
  GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
marked AS (
  SELECT l.doc_id, l.pos, l.line, c.keeper IS NOT NULL AND l.doc_id <> c.keeper AS lost
  FROM lines l LEFT JOIN common c ON l.key = c.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT lost), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
