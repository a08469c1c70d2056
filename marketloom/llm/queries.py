"""Queries of the corpus operators, each beside the SQL it must agree with where SQL can state it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marketloom.llm import bpe, chat, language, merkle, minhash_paths, mixing, pii, shards, substring, tries, url_rules, vectors, winnow

PLANS: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        PLANS[name] = fn
        if sql is not None:
            SQL[name] = sql
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_url_rules")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    rules = url_rules.mined_rules(url_rules.page_labels(pages, table(spark, sf_dir, "labels")))
    return url_rules.judged(pages, rules)


@query("op2_language")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = language.predict(documents.select("doc_id", "text"), language.trained(documents))
    return found.select("doc_id", language.held_out().alias("held_out"), "lang_pred", "score")


SHARD_BYTES = 1 << 20

SHARDS_SQL = f"""
WITH hashed AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS n_bytes,
    CAST('0x' || left(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), '-'), md5(coalesce(text, '')))), 15) AS BIGINT) AS hash
  FROM documents
), levels AS (
  SELECT *, sum(n_bytes) OVER (PARTITION BY depth, hash >> (60 - depth)) AS bytes
  FROM hashed, (SELECT CAST(i AS INTEGER) AS depth FROM range(61) r(i))
), settled AS (
  SELECT doc_id, n_bytes, hash, coalesce(min(depth) FILTER (bytes <= {SHARD_BYTES}), 60) AS depth FROM levels GROUP BY ALL
)
SELECT doc_id, n_bytes, CASE WHEN depth = 0 THEN '' ELSE lpad(ltrim(bin(hash >> (60 - depth)), '0'), depth, '0') END AS shard,
  CAST(depth AS BIGINT) AS depth, CAST(0 AS BIGINT) AS page
FROM settled
"""


@query("op3_shards", SHARDS_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.assigned(table(spark, sf_dir, "documents"), SHARD_BYTES)


VECTORS_SQL = """
WITH v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings
), sound AS (
  SELECT * FROM v WHERE label IS NOT NULL AND x IS NOT NULL AND len(list_filter(x, lambda e: e IS NULL OR NOT isfinite(e))) = 0 AND len(list_filter(x, lambda e: e <> 0)) > 0
), links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.x) = len(b.x) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.x, b.x) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), counted AS (SELECT a, count(*) AS n FROM links GROUP BY a), least AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON least.a = vec_id LEFT JOIN counted ON counted.a = vec_id
""".replace("WITH v", "WITH RECURSIVE v")


@query("op4_sorted_projections", VECTORS_SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors.near_duplicates(table(spark, sf_dir, "embeddings"))


WORDS_SQL = "regexp_extract_all(coalesce({}, ''), '[^ \\t-\\r]+')"

NEAR_SQL = f"""
WITH RECURSIVE cut AS (
  SELECT doc_id, {WORDS_SQL.format("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), shingles AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))
    WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS s FROM cut
), sizes AS (
  SELECT doc_id, count(s) AS n FROM cut LEFT JOIN shingles USING (doc_id) GROUP BY 1
), shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY 1)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM sizes JOIN least USING (doc_id)
"""


@query("op5_minhash_paths", NEAR_SQL)
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_paths.near_duplicates(table(spark, sf_dir, "documents"))


REPEATS_SQL = f"""
WITH cut AS (
  SELECT doc_id, {WORDS_SQL.format("text")} AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM cut)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY h) AS earliest FROM windows) WHERE earliest < doc_id
), placed AS (
  SELECT doc_id, i, w[i] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM cut)
), judged AS (
  SELECT doc_id, i, word, coalesce(max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i) >= p.i - 49, false) AS gone
  FROM placed p LEFT JOIN repeated r USING (doc_id, i)
), kept AS (
  SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS text FROM judged GROUP BY 1
)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256 FROM documents LEFT JOIN kept USING (doc_id)
""".replace("max(r.i)", "max(CASE WHEN r.i IS NOT NULL THEN p.i END)")


@query("op6_substring", REPEATS_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substring.cleaned(table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


@query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return bpe.digests(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


@query("op8_winnow")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnow.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op9_pii")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find(documents, pii.fit(documents))

    def printed(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")

    def count(kind):
        return F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    base = F.filter("spans", lambda s: s["base"])
    counts = [count(k) for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(printed(base), 256).alias("base_sha256"), printed(F.col("spans")).alias("spans"))


MIXING_SQL = """
WITH counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^ \\t-\\r]+')) AS BIGINT) AS size FROM documents
), totals AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM counted GROUP BY source
), weighed AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3] AS DOUBLE) AS weight, source_size * CAST(2 AS DOUBLE) AS most FROM totals
), levels AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed WINDOW o AS (ORDER BY most / weight, source IS NULL, source)
), opened AS (
  SELECT *, min(CASE WHEN level * weight <= most THEN most / weight END) OVER () AS first_open,
    arg_min(CASE WHEN level * weight <= most THEN level END, CASE WHEN level * weight <= most THEN most / weight END) OVER () AS last_level
  FROM levels
), targets AS (
  SELECT source, source_size, CASE WHEN most / weight >= first_open THEN least(most, weight * last_level) ELSE most END AS target FROM opened
), bounds AS (
  SELECT *, CASE WHEN lead(source_size) OVER o IS NULL THEN 2147483648 ELSE CAST(floor(sum(target) OVER (o ROWS UNBOUNDED PRECEDING) / sum(target) OVER () * 2147483648) AS BIGINT) END AS upper
  FROM targets WHERE target > 0 WINDOW o AS (ORDER BY source IS NULL, source)
), ranges AS (
  SELECT *, coalesce(lag(upper) OVER (ORDER BY upper), 0) AS lower FROM bounds
), slots AS (
  SELECT i, (i % 2147483648) * 1327217885 % 2147483648 AS point FROM range(CAST((SELECT ceil(sum(target) / 256) FROM targets) AS BIGINT)) r(i)
), ranked AS (
  SELECT source, source_size, row_number() OVER (PARTITION BY source ORDER BY i) - 1 AS rank FROM slots JOIN ranges ON point >= lower AND point < upper
), times AS (
  SELECT source, rank % CAST(ceil(source_size / 256) AS BIGINT) AS block, count(*) AS times FROM ranked WHERE rank < 2 * CAST(ceil(source_size / 256) AS BIGINT) GROUP BY ALL
), laid AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY md5(concat_ws(':', doc_id, size)), size ROWS UNBOUNDED PRECEDING) - size AS start FROM counted
), pieces AS (
  SELECT source, start, size, unnest(range(CAST(start // 256 AS BIGINT), CAST((start + size - 1) // 256 AS BIGINT) + 1)) AS block FROM laid WHERE size > 0
), took AS (
  SELECT p.source, p.start, CAST(sum((least(start + size, (p.block + 1) * 256) - greatest(start, p.block * 256)) * times) AS BIGINT) AS taken
  FROM pieces p JOIN times t ON p.source IS NOT DISTINCT FROM t.source AND p.block = t.block GROUP BY ALL
)
SELECT l.doc_id, l.source, l.size, t.source_size, t.target, coalesce(k.taken, 0) AS taken
FROM laid l JOIN targets t ON l.source IS NOT DISTINCT FROM t.source
LEFT JOIN took k ON l.source IS NOT DISTINCT FROM k.source AND l.start = k.start AND l.size > 0
"""


@query("op10_mixing", MIXING_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixed(table(spark, sf_dir, "documents"))


CHAT_SQL = r"""
WITH given AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), sized AS (
  SELECT *, md5(concat_ws(':', coalesce(CAST(conv_id AS VARCHAR), '-'), coalesce(CAST(turn AS VARCHAR), '-'), CAST(strlen(role) AS VARCHAR), role || text)) AS key,
    len(regexp_extract_all(text, '[\p{L}\p{M}]+|\p{N}|[^\x20\x09-\x0D\p{L}\p{M}\p{N}]')) + 6 AS t,
    length('### ' || url_encode(role) || ':') + 1 AS head, length(text) + len(regexp_extract_all(text, '### |</turn>')) AS size
  FROM given
), placed AS (
  SELECT *, sum(t) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key ROWS UNBOUNDED PRECEDING) - t AS pre,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, key) AS n FROM sized
), led AS (
  SELECT *, n = 1 AND role = 'system' AND 2 * t <= 1024 AS lead, max(CASE WHEN n = 1 AND role = 'system' AND 2 * t <= 1024 THEN t ELSE 0 END) OVER (PARTITION BY conv_id) AS s FROM placed
), cells AS (
  SELECT *, CASE WHEN lead THEN -1 ELSE pre - s END AS q, CASE WHEN lead THEN 0 ELSE CAST((pre - s) // (768 - s) AS BIGINT) END AS cell FROM led
), parts AS (
  SELECT *, NOT lead AND q > a AND q + t - a > 1024 - s AS part FROM (SELECT *, min(CASE WHEN NOT lead THEN q END) OVER (PARTITION BY conv_id, cell) AS a FROM cells)
), spans AS (
  SELECT conv_id, cell, part, coalesce(min(q) FILTER (NOT lead), 0) AS a, coalesce(max(q + t) FILTER (NOT lead), 0) AS b, max(s) AS s FROM parts GROUP BY ALL
), dealt AS (
  SELECT conv_id, head, size FROM parts
  UNION ALL SELECT p.conv_id, head, size FROM spans w JOIN parts p ON w.conv_id IS NOT DISTINCT FROM p.conv_id
    WHERE CASE WHEN lead THEN w.cell > 0 OR w.part ELSE q < w.a AND q >= w.a - least(256, 1024 - w.s - b + w.a) END
), sums AS (SELECT conv_id, sum(head + size + 9) AS formatted_chars FROM dealt GROUP BY 1)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY n)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY n) FILTER (role = 'assistant'), '')) AS loss_sha256, CAST(any_value(formatted_chars) AS BIGINT) AS formatted_chars
FROM placed JOIN sums USING (conv_id) GROUP BY conv_id
"""


@query("op11_chat_windows", CHAT_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.digests(chat.windows(chat.with_tricky(table(spark, sf_dir, "conversations"))))


#: DuckDB has no crc32: the table of the polynomial and its fold over the bytes of a decimal number.
CRC = """crc(bits) AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) FROM range(256) r(i))"""
CRC_OF = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST({} AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
  lambda c, b: xor(c >> 8, bits[(xor(c, b) & 255) + 1])), 4294967295)"""

LEAF = "sha256(" + " || ".join(f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')" for c in ("doc_id", "source", "lang", "n_chars", "text")) + ")"

MERKLE_SQL = f"""
WITH RECURSIVE {CRC}, changed AS (
  SELECT d.* REPLACE (CASE WHEN {CRC_OF.format("doc_id")} % 3 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END AS text) FROM documents d, crc
), placed AS (
  SELECT lang, doc_id, a.leaf, b.leaf AS start, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i FROM (SELECT doc_id, lang, {LEAF} AS leaf FROM documents) a JOIN (SELECT doc_id, {LEAF} AS leaf FROM changed) b USING (doc_id)
), low AS (
  SELECT lang, 0 AS level, i, leaf AS h, count(*) OVER (PARTITION BY lang) AS n FROM placed
  UNION ALL SELECT lang, level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM low WHERE n > 1 GROUP BY lang, level, i // 8
), subroots AS (SELECT lang, level AS height, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE n = 1),
high AS (
  SELECT 0 AS level, place AS i, subroot AS h, count(*) OVER () AS n FROM subroots
  UNION ALL SELECT level + 1, i // 8, sha256(string_agg(h, '' ORDER BY i)), (any_value(n) + 7) // 8 FROM high WHERE n > 1 GROUP BY level, i // 8
), nodes AS (
  SELECT lang, false AS upper, level, i, h FROM low WHERE n > 1 UNION ALL SELECT NULL, true, level, i, h FROM high WHERE n > 1
), runs AS (SELECT lang, upper, level, i // 8 AS run, list(h ORDER BY i) AS hs FROM nodes GROUP BY ALL),
steps AS (
  SELECT doc_id, CASE WHEN upper THEN height + level ELSE level END AS step, hs, 1 + CASE WHEN upper THEN place ELSE i END // CAST(8 ** level AS BIGINT) % 8 AS slot
  FROM placed JOIN subroots s ON placed.lang IS NOT DISTINCT FROM s.lang JOIN runs r ON (r.upper OR r.lang IS NOT DISTINCT FROM placed.lang)
    AND r.run = CASE WHEN upper THEN place ELSE i END // CAST(8 ** (level + 1) AS BIGINT)
), proofs AS (
  SELECT doc_id, max(step) + 1 AS steps, sha256(string_agg(array_to_string(hs[:slot - 1], '') || array_to_string(hs[slot + 1:], ''), '' ORDER BY step)) AS proof_sha256 FROM steps GROUP BY 1
), climbed AS (
  SELECT doc_id, 0 AS step, start AS h FROM placed
  UNION ALL SELECT c.doc_id, c.step + 1, sha256(array_to_string(hs[:slot - 1], '') || c.h || array_to_string(hs[slot + 1:], '')) FROM climbed c JOIN steps USING (doc_id, step)
), ends AS (SELECT doc_id, arg_max(h, step) AS folded_root FROM climbed GROUP BY 1)
SELECT doc_id, leaf, subroot, root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN subroots s ON placed.lang IS NOT DISTINCT FROM s.lang CROSS JOIN (SELECT h AS root FROM high WHERE n = 1) JOIN ends USING (doc_id) LEFT JOIN proofs USING (doc_id)
"""


@query("op12_merkle", MERKLE_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


TRIE_SQL = f"""
WITH {CRC}, own AS (
  SELECT conv_id, md5(strlen(r) || ':' || r || x) AS item, length(x) AS chars, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(strlen(r) || ':' || r || x)) AS pos
  FROM (SELECT conv_id, turn, coalesce(role, '') AS r, coalesce(text, '') AS x FROM conversations WHERE conv_id IS NOT NULL)
), heads AS (SELECT c.conv_id, c.conv_id - c.conv_id % 100 AS base, {CRC_OF.format("conv_id")} % 6 AS h FROM (SELECT DISTINCT conv_id FROM own) c, crc),
said AS (
  SELECT heads.conv_id, 0 AS later, o.pos, item, chars FROM heads JOIN own o ON o.conv_id = base AND o.pos <= h
  UNION ALL SELECT heads.conv_id, 1, o.pos, item, chars FROM heads JOIN own o ON o.conv_id = heads.conv_id AND o.pos > h
), whole AS (
  SELECT conv_id, coalesce(s, []) AS s, coalesce(l, []) AS l FROM heads LEFT JOIN (SELECT conv_id, list(item ORDER BY later, pos) AS s, list(chars ORDER BY later, pos) AS l FROM said GROUP BY 1) USING (conv_id)
), passes AS (
  SELECT conv_id, d AS depth, s[:d] AS node, CASE WHEN d > 0 THEN s[:d - 1] END AS up, CASE WHEN d > 0 THEN l[d] ELSE 0 END AS chars, d = len(s) AS ends
  FROM (SELECT *, unnest(range(len(s) + 1)) AS d FROM whole)
), nodes AS (
  SELECT node, up, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(chars) AS chars, sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM passes GROUP BY ALL
), kids AS (SELECT up AS node, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1),
linked AS (SELECT n.*, coalesce(n_children, 0) AS n_children, p.conv_id AS parent_conv_id FROM nodes n LEFT JOIN kids k ON k.node = n.node LEFT JOIN nodes p ON p.node = n.up),
under AS (
  SELECT node[:d] AS node, count(*) FILTER (n_children = 0) AS n_leaves, sum((n_convs - 1) * chars) AS saved_tokens FROM (SELECT *, unnest(range(depth + 1)) AS d FROM linked) GROUP BY 1
)
SELECT conv_id, CAST(depth AS BIGINT) AS depth, parent_conv_id, n_convs, n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, ends_sha256 FROM linked JOIN under USING (node)
"""


@query("op13_conversation_trie", TRIE_SQL)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.nodes(*tries.rebuilt(table(spark, sf_dir, "conversations")))


def load() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    import corpus_pipeline

    return PLANS | {"pipeline": corpus_pipeline.run}


def load_sql() -> dict[str, str]:
    return dict(SQL)
