"""Registered queries of this package, and their SQL where DuckDB can express the result."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitaloom.llm import (block_search, decontaminate, filter_audit, jaccard_join, labelled, merkle, quality, radix_dedup, recompression, sharding, spelling,
                          toxicity, transducer, warc)
from vitaloom.llm.common import fold, read

SHARDS = [f"shard-{i:02d}" for i in range(64)]
LEAVES = 7


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's shard, and where it goes when one shard has left."""
    docs = read(spark, sf_dir, "documents").select("doc_id")
    left = [s for i, s in enumerate(SHARDS) if i != LEAVES]
    placed = sharding.place(docs, "doc_id", SHARDS)
    return sharding.place(placed, "doc_id", left, shard="shard_after").select("doc_id", "slot", "shard", "shard_after")


# One iteration for each attempt to claim a slot; the taken slots are a bit string.
CLAIMS = """
{name}_shards AS (SELECT list('shard-' || lpad(i::VARCHAR, 2, '0') ORDER BY i) AS names FROM range({n}) r(i) WHERE i <> {without}),
{name}_prefs AS (SELECT names, len(names)::INT AS n,
  list_transform(names, lambda x: (('0x' || substr(md5('offset:' || x), 1, 15))::BIGINT % {slots})::INT) AS off,
  list_transform(names, lambda x: (('0x' || substr(md5('skip:' || x), 1, 15))::BIGINT % ({slots} - 1) + 1)::INT) AS skip FROM {name}_shards),
{name}_claims AS (
  SELECT 1 AS s, list_transform(range(n), lambda x: 0::INT) AS nxt, repeat('0', {slots})::BIT AS taken, NULL::INT AS slot, NULL::INT AS owner,
    0 AS done, n FROM {name}_prefs
  UNION ALL
  SELECT CASE WHEN free THEN s % n + 1 ELSE s END, list_transform(nxt, lambda v, i: CASE WHEN i = s THEN v + 1 ELSE v END),
    CASE WHEN free THEN set_bit(taken, p, 1) ELSE taken END, CASE WHEN free THEN p END, s, done + free::INT, n
  FROM (SELECT c.*, get_bit(taken, p) = 0 AS free FROM (
    SELECT k.*, ((off[s] + nxt[s]::BIGINT * skip[s]) % {slots})::INT AS p FROM {name}_claims k, {name}_prefs WHERE done < {slots}) c)),
{name} AS (SELECT slot, names[owner] AS shard FROM {name}_claims, {name}_shards WHERE slot IS NOT NULL)"""

OP1_SQL = f"""
WITH RECURSIVE {CLAIMS.format(name='before', n=len(SHARDS), without=-1, slots=sharding.SLOTS)},
{CLAIMS.format(name='later', n=len(SHARDS), without=LEAVES, slots=sharding.SLOTS)}
SELECT doc_id, d.slot, b.shard, a.shard AS shard_after FROM (
  SELECT doc_id, (('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % {sharding.SLOTS})::INT AS slot FROM documents) d
JOIN before b ON b.slot = d.slot JOIN later a ON a.slot = d.slot"""


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), rule=jaccard_join.Rule(words=3, num=90, den=100))


OP2_SQL = r"""
WITH RECURSIVE w AS (SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT rid, doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' '))) END AS sh FROM w),
t AS (SELECT rid, len(sh) AS n, unnest(sh) AS token FROM s),
i AS (SELECT a.rid AS x, b.rid AS y, a.n + b.n AS n, count(*) AS shared FROM t a JOIN t b USING (token) WHERE a.rid <> b.rid GROUP BY ALL),
links AS (SELECT x, y FROM i WHERE 100 * shared >= 90 * (n - shared)),
reach AS (SELECT rid AS x, rid AS y FROM s UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT s.doc_id, len(s.sh)::BIGINT AS n_shingles, min(o.doc_id) AS component_id
FROM s JOIN reach ON reach.x = s.rid JOIN s o ON o.rid = reach.y GROUP BY s.rid, s.doc_id, s.sh"""


def op2_jaccard_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same join with the number of links of every document."""
    return jaccard_join.near_duplicates(read(spark, sf_dir, "documents"), rule=jaccard_join.Rule(words=3, num=90, den=100), links=True)


OP2_LINKS_SQL = OP2_SQL.replace("SELECT s.doc_id,", "SELECT s.doc_id, (SELECT count(*) FROM links WHERE links.x = s.rid) AS n_links,")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive_round_trip(read(spark, sf_dir, "pages"))
    return records.select(F.col("source_key").cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
                          F.col("refers_to").cast("long").alias("refers_to"), "record_id", "target_uri")


# The identifier and the address as they stand in the record are results too.
OP3_SQL = """
WITH p AS (SELECT page_id, url, encode(coalesce(html, '')) AS body FROM pages),
h AS (SELECT page_id, url, octet_length(body)::BIGINT AS payload_bytes, sha256(body) AS payload_digest FROM p),
o AS (SELECT payload_digest, min(page_id) AS first FROM h WHERE payload_bytes >= 100 GROUP BY payload_digest),
r AS (SELECT h.*, coalesce(page_id <> first AND payload_bytes >= 100, false) AS again, first,
    md5(concat_ws('|', coalesce(page_id::VARCHAR, 'null'), coalesce(url, ''), payload_digest)) AS m FROM h LEFT JOIN o USING (payload_digest))
SELECT page_id, payload_bytes, payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN again THEN first END AS refers_to,
  concat('<urn:uuid:', concat_ws('-', m[1:8], m[9:12], m[13:16], m[17:20], m[21:32]), '>') AS record_id,
  regexp_replace(replace(replace(coalesce(url, ''), chr(10), '%0A'), chr(13), '%0D'), '[\\x00-\\x20\\x7F]', '%20', 'g') AS target_uri
FROM r"""

def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 5) == 0
    model = quality.fit(docs, read(spark, sf_dir, "labels").where(~held))
    scored = quality.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", labelled.decide(F.col("score")).alias("predicted"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, held = read(spark, sf_dir, "documents").select("doc_id", "text"), fold(F.col("doc_id"), 4) == 2
    model = toxicity.fit(docs, read(spark, sf_dir, "labels").where(~held))
    scored = toxicity.score(docs, model)
    return scored.select("doc_id", held.alias("held_out"), "score", labelled.decide(F.col("score")).alias("predicted"))


def op6_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.with_edits(read(spark, sf_dir, "documents"))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = recompression.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
i AS (SELECT rid, doc_id, ws, unnest(range(1, greatest(len(ws) - 18, 1))) AS i FROM d),
m AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 19], ' ')) AS m FROM i),
f AS (SELECT rid, i, row_number() OVER w > 1 AS again FROM m WINDOW w AS (PARTITION BY m ORDER BY doc_id, i)),
p AS (SELECT rid, unnest(range(1, len(ws) + 1)) AS j, unnest(ws) AS word FROM d),
g AS (SELECT DISTINCT rid, unnest(range(i, i + 20)) AS j FROM f WHERE again),
k AS (SELECT rid, count(*) AS kept, string_agg(word, ' ' ORDER BY j) AS t FROM p ANTI JOIN g USING (rid, j) GROUP BY rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(kept, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM d LEFT JOIN k USING (rid)"""


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = radix_dedup.remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return cut.select("doc_id", "n_bytes", "n_removed", F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


OP8_SQL = """
WITH h AS (SELECT row_number() OVER () AS rid, doc_id, hex(encode(coalesce(text, ''))) AS x FROM documents),
w AS (SELECT rid, unnest(range(0, greatest(len(x) // 2 - 399, 0))) AS i, x FROM h),
m AS (SELECT rid, i, md5(substr(x, 2 * i + 1, 800)) AS m FROM w),
r AS (SELECT m FROM m GROUP BY m HAVING count(*) > 1),
s AS (SELECT rid, i, i > coalesce(lag(i) OVER (PARTITION BY rid ORDER BY i) + 400, -1) AS opens FROM m SEMI JOIN r USING (m)),
g AS (SELECT rid, i, sum(opens::INT) OVER (PARTITION BY rid ORDER BY i) AS n FROM s),
u AS (SELECT rid, n, min(i) AS a, max(i) + 400 AS b FROM g GROUP BY rid, n),
k AS (SELECT rid, n, a, b, coalesce(lag(b) OVER (PARTITION BY rid ORDER BY a), 0) AS before FROM u),
e AS (SELECT rid, count(*) AS n_spans, sum(b - a) AS n_removed, max(b) AS fin,
    string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS front FROM k JOIN h USING (rid) GROUP BY rid)
SELECT doc_id, (len(x) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(front, '') || substr(x, 2 * coalesce(fin, 0) + 1))) AS kept_sha256
FROM h LEFT JOIN e USING (rid)"""


def op9_sentencepiece(spark: SparkSession, sf_dir: str, model: str = transducer.MODEL) -> DataFrame:
    return transducer.round_trip(read(spark, sf_dir, "documents"), transducer.load(model))


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


# The checksum a byte at a time; words near each other are equal, or equal but for the place, after the loss of a letter.
OP11_SQL = """
WITH RECURSIVE crc AS (SELECT list_transform(range(256), lambda b: list_reduce(range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b)) AS t),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
counted AS (SELECT doc_id, run, count(*) AS n, hex(encode(coalesce(doc_id::VARCHAR, '') || ':' || run)) AS x FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(len(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM counted, crc),
kept AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, sum(n)::BIGINT AS n FROM kept WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
shorter AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM shorter a JOIN shorter b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT s.word, s.n, w.word, w.n FROM shorter s JOIN words w ON w.word = s.rest
  UNION SELECT w.word, w.n, s.word, s.n FROM shorter s JOIN words w ON w.word = s.rest),
best AS (SELECT word, n, count(*) AS n_near, min((-near_n, near)) AS b FROM near GROUP BY word, n),
found AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN -b[1] >= 10 * w.n THEN b[2] END AS form, CASE WHEN -b[1] >= 10 * w.n THEN -b[1] END AS form_n
  FROM words w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS reached, 0 AS step FROM found UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN found f ON f.word = c.reached WHERE f.form IS NOT NULL)
SELECT word, form, root, n, n_near, form_n FROM found JOIN (SELECT word, max_by(reached, step) AS root FROM chain GROUP BY word) USING (word)"""


def op12_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return block_search.search(read(spark, sf_dir, "embeddings"))


OP12_SQL = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_dot_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.rid <> c.rid WHERE q.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20"""


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


OP13_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
f AS (SELECT doc_id, part, (len(ws) < 50)::INT + 2 * (100 * len(list_distinct(ws)) < 65 * len(ws))::INT
  + 4 * (100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t))::INT + 8 * regexp_matches(t, '[#$%&*|]')::INT
  + 16 * coalesce(min(doc_id) OVER (PARTITION BY t) < doc_id, false)::INT AS mask FROM d),
l AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
c AS (SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
x AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM x a, x b, x c, x d, x e
  WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step, 1 << (ascii(substr(filter_order, step, 1)) - 65) AS bit,
  coalesce(list_sum(list_transform(range(1, step), lambda i: 1 << (ascii(substr(filter_order, i, 1)) - 65))), 0)::INT AS before
  FROM o, (SELECT unnest(range(1, 6))::INT AS step)),
r AS (SELECT part, filter_order, step, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & bit <> 0 AND mask & before = 0) AS removed,
  sum(n) FILTER (mask & bit <> 0 AND mask & before <> 0) AS redundant, sum(n) FILTER (mask = bit) AS unique_fails,
  sum(good) FILTER (mask & bit <> 0 AND mask & before = 0) AS good_lost, sum(toxic) FILTER (mask & bit <> 0 AND mask & before = 0) AS toxic_lost FROM c, s GROUP BY ALL),
h AS (SELECT part, substr(filter_order, step, 1) AS filter, sum(coalesce(removed, 0)) AS shapley FROM r GROUP BY ALL)
SELECT r.part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant,
  coalesce(unique_fails, 0)::BIGINT AS unique_fails, coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, shapley::BIGINT AS shapley
FROM r JOIN h ON h.part = r.part AND h.filter = substr(filter_order, step, 1)"""


QUERIES = {"op1_sharding": op1_sharding, "op2_jaccard_join": op2_jaccard_join, "op3_warc": op3_warc, "op4_decontamination": op4_decontamination,
           "op5_quality": op5_quality, "op6_fingerprints": op6_fingerprints, "op7_substring_dedup": op7_substring_dedup,
           "op8_suffix_dedup": op8_suffix_dedup, "op10_toxicity": op10_toxicity,
           "op9_sentencepiece": op9_sentencepiece, "op2_jaccard_links": op2_jaccard_links,
           "op11_spelling_variants": op11_spelling_variants, "op12_topk_search": op12_topk_search, "op13_filter_audit": op13_filter_audit}
SQL = {"op1_sharding": OP1_SQL, "op2_jaccard_join": OP2_SQL, "op2_jaccard_links": OP2_LINKS_SQL, "op3_warc": OP3_SQL, "op7_substring_dedup": OP7_SQL, "op8_suffix_dedup": OP8_SQL,
       "op11_spelling_variants": OP11_SQL, "op12_topk_search": OP12_SQL, "op13_filter_audit": OP13_SQL}
