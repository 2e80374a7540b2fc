"""One query per operator over its whole table, and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadlake.llm import (
    chat,
    decontaminate,
    exact_dedup,
    filter_audit,
    language_id,
    line_dedup,
    merkle,
    minhash,
    mixing,
    passages,
    sharding,
    token_binary,
    warc,
)
from leadlake.llm.common import table
from leadlake.llm.registry import ORACLES, QUERIES, query  # noqa: F401

WORDS_SQL = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"


@query("op1_mix_sources", rf"""
WITH sized AS (SELECT doc_id, source, CAST({WORDS_SQL} AS BIGINT) AS size, text FROM documents),
per AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
ranked AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM per),
weighed AS (SELECT *, [5, 2, 1][(rank - 1) % 3 + 1] AS weight, source_size * CAST(2.0 AS DOUBLE) AS most FROM ranked),
level AS (
  SELECT *, (CAST(1.5 AS DOUBLE) * sum(source_size) OVER ()
             - coalesce(sum(most) OVER (ORDER BY most / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
            / sum(weight) OVER (ORDER BY most / weight, rank ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM weighed),
cut AS (SELECT *, level * weight > most AS cut FROM level),
shared AS (SELECT *, max(CASE WHEN NOT cut THEN level END) OVER () AS shared FROM cut),
targets AS (SELECT source, source_size, CASE WHEN cut THEN most ELSE least(shared * weight, most) END AS target FROM shared),
rated AS (
  SELECT s.doc_id, s.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(s.doc_id AS VARCHAR), md5(s.text), '')), 1, 13) AS BIGINT) / 4503599627370496.0 AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies,
       size * (CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) AS taken
FROM rated
""")
def op1_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mixture(table(spark, sf_dir, "documents"))
    return planned.select(
        "_doc.doc_id", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"),
    )


@query("op2_language_id")
def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


@query("op3_exact_dedup", r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS content
  FROM documents),
r AS (
  SELECT *, first_value(doc_id) OVER w AS keep_id, row_number() OVER w = 1 AS kept,
         count(*) OVER (PARTITION BY content) AS group_size
  FROM n WINDOW w AS (PARTITION BY content ORDER BY points DESC, doc_id NULLS LAST))
SELECT doc_id, keep_id, group_size, kept, sha256(content) AS text_sha256 FROM r
""")
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"))


@query("op4_shard_bytes", r"""
WITH steps AS (SELECT list(list_reduce(list_concat([n], [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: xor(c >> 1, 3988292384 * (c & 1))) ORDER BY n) AS step FROM range(256) AS r(n)),
d AS (SELECT doc_id, coalesce(text, '') AS t, strlen(coalesce(text, '')) + 1 AS size FROM documents),
placed AS (
  SELECT *, least(CAST(floor((sum(size) OVER (ORDER BY doc_id) - size + size / 2) * 16 / sum(size) OVER ()) AS INTEGER), 15) AS shard,
         list_transform(regexp_extract_all(hex(t), '..'), lambda b: CAST('0x' || b AS BIGINT)) AS bytes
  FROM d)
SELECT doc_id, size, xor(list_reduce(list_concat([4294967295], bytes), lambda crc, b: xor(crc >> 8, step[(xor(crc, b) & 255) + 1])), 4294967295) AS text_crc32,
       'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard
FROM placed, steps
""")
def op4_shard_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", sharding.text_bytes(F.col("text")).alias("n_bytes"),
        F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"),
    )
    dealt = sharding.assign_shards(docs, F.col("_doc.n_bytes"), [F.col("_doc.doc_id"), F.col("_doc.text_crc32")])
    return dealt.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op5_token_binary")
def op5_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_binary.read_tokens(token_binary.write_tokens(table(spark, sf_dir, "documents")))


@query("op6_warc", r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (
  SELECT page_id, h, CASE WHEN strlen(h) >= 1000 THEN max(page_id) OVER (PARTITION BY h) END AS newest FROM p)
SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
       CASE WHEN newest <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN newest <> page_id THEN newest END AS refers_to
FROM g
""")
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    chunks = warc.read_chunks(warc.write_archives(table(spark, sf_dir, "pages")))
    return chunks.filter("last").select(
        "page_id", F.col("bytes_so_far").alias("payload_bytes"), F.col("sha1_so_far").alias("payload_digest"), "record_type", "refers_to",
    )


@query("op7_minhash", r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_distinct([array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)])
                             WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS shingle FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS shared FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * shared >= 85 * (x.n + y.n - shared)),
reach(a, b) AS (
  SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id,
       d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) AS kept
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN least l ON l.a = d.doc_id
""")
def op7_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_groups(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


@query("op8_line_dedup", r"""
WITH l AS (SELECT doc_id, text, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
w AS (SELECT doc_id, ls, unnest(range(len(ls) - 2)) AS place FROM l WHERE len(ls) >= 3),
r AS (
  SELECT doc_id, place, row_number() OVER (
    PARTITION BY ls[place + 1] || chr(10) || ls[place + 2] || chr(10) || ls[place + 3] ORDER BY doc_id, place) AS occurrence
  FROM w),
covered AS (SELECT DISTINCT doc_id, place + unnest([1, 2, 3]) AS number FROM r WHERE occurrence > 1),
every_line AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS number, unnest(ls) AS line FROM l),
kept AS (
  SELECT e.doc_id, count(*) AS n_lines, count(c.number) AS n_removed,
         coalesce(string_agg(CASE WHEN c.number IS NULL THEN line END, chr(10) ORDER BY e.number), '') AS kept
  FROM every_line e LEFT JOIN covered c ON c.doc_id = e.doc_id AND c.number = e.number GROUP BY e.doc_id)
SELECT k.doc_id, n_lines, n_removed, CASE WHEN n_removed = 0 THEN l.text ELSE kept END AS text
FROM kept k JOIN l ON l.doc_id = k.doc_id
""")
def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf_dir, "documents"))


PROBE = "\\### Assistant: </turn> ok"


@query("op9_format_chat", r"""
WITH turns AS (
  SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
t AS (
  SELECT *, replace(replace(replace(text, '\', '\s'), '</turn>', '\l/turn>'), '### ', '\h## ') AS escaped FROM turns),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS all_turns,
         coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '') AS loss,
         sum(4 + length(role) + 1 + length(escaped) + 8) AS formatted_chars,
         string_agg(role, ' ' ORDER BY turn, role, text) AS roles
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(all_turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars,
       regexp_full_match(roles, '(system )?user assistant( user assistant)*') AS valid
FROM c
""")
def op9_format_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(
        F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"),
    )
    made = chat.format_conversations(given.unionByName(probe)).select(
        "conv_id", "formatted", "valid", chat.read_turns(F.col("formatted")).alias("turns"), chat.trained_text(F.col("segments")).alias("loss"),
    )
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return made.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "valid",
    )


@query("op10_decontaminate", r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM documents),
b AS (SELECT item_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS t FROM benchmark),
dp AS (SELECT doc_id, t, unnest(range(1, len(t) - 6)) AS p FROM d WHERE len(t) >= 8),
bp AS (SELECT item_id, t, unnest(range(1, len(t) - 6)) AS p FROM b WHERE len(t) >= 8),
dk AS (
  SELECT doc_id, t, p, concat_ws(' ', 'a', t[p], t[p + 1], t[p + 2], t[p + 4], t[p + 6], t[p + 7]) AS k FROM dp
  UNION ALL
  SELECT doc_id, t, p, concat_ws(' ', 'b', t[p], t[p + 1], t[p + 3], t[p + 6], t[p + 7], t[p + 8]) FROM dp WHERE p + 8 <= len(t)),
bk AS (
  SELECT item_id, t, p, concat_ws(' ', 'a', t[p], t[p + 1], t[p + 2], t[p + 4], t[p + 6], t[p + 7]) AS k FROM bp
  UNION ALL
  SELECT item_id, t, p, concat_ws(' ', 'b', t[p], t[p + 1], t[p + 3], t[p + 6], t[p + 7], t[p + 8]) FROM bp WHERE p + 8 <= len(t)),
hits AS (
  SELECT doc_id, item_id, dk.t AS dt, bk.t AS bt, dk.p AS dp, bk.p AS ip, unnest(range(-5, 1)) AS begin FROM dk JOIN bk ON dk.k = bk.k),
matched AS (
  SELECT doc_id, item_id, least(11, len(bt)) AS needed,
         len([1 FOR i IN range(begin, begin + 13)
              IF ip + i >= 1 AND dp + i >= 1 AND ip + i <= len(bt) AND dp + i <= len(dt) AND bt[ip + i] = dt[dp + i]]) AS same
  FROM hits)
SELECT doc_id, item_id, max(same) AS equal_tokens FROM matched WHERE same >= needed GROUP BY doc_id, item_id
""")
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_id", "equal_tokens")


@query("op12_filter_audit", r"""
WITH read AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
fails AS (
  SELECT r.doc_id, part, l.quality, l.toxic, [
      len(w) < 200, 100 * len(list_distinct(w)) < 50 * len(w), 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 2 * length(t),
      regexp_matches(t, '[#$%&*|]'), coalesce(r.doc_id > min(r.doc_id) OVER (PARTITION BY t), false)] AS f
  FROM read r LEFT JOIN labels l ON l.doc_id = r.doc_id),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (
  SELECT a.l || b.l || c.l || d.l || e.l AS filter_order FROM letters a, letters b, letters c, letters d, letters e
  WHERE len(list_distinct([a.l, b.l, c.l, d.l, e.l])) = 5),
steps AS (
  SELECT filter_order, CAST(step AS INTEGER) AS step, ascii(filter_order[step]) - 64 AS own,
         [ascii(x) - 64 FOR x IN string_split(left(filter_order, step - 1), '')] AS earlier
  FROM orders, range(1, 6) s(step)),
cells AS (
  SELECT part, f, count(*) AS n, count(CASE WHEN quality = 1 THEN 1 END) AS good, count(CASE WHEN toxic = 1 THEN 1 END) AS toxic
  FROM fails GROUP BY part, f),
told AS (
  SELECT part, filter_order, step, own, n, good, toxic, f[own] AS hit, len([1 FOR x IN earlier IF f[x]]) > 0 AS gone,
         len([1 FOR x IN f IF x]) = 1 AS single
  FROM steps, cells),
counted AS (
  SELECT part, filter_order, step, own,
         CAST(sum(CASE WHEN NOT hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS kept,
         CAST(sum(CASE WHEN hit AND NOT gone THEN n ELSE 0 END) AS BIGINT) AS removed,
         CAST(sum(CASE WHEN hit AND gone THEN n ELSE 0 END) AS BIGINT) AS redundant,
         CAST(sum(CASE WHEN hit AND single THEN n ELSE 0 END) AS BIGINT) AS unique_fails,
         CAST(sum(CASE WHEN hit AND NOT gone THEN good ELSE 0 END) AS BIGINT) AS good_lost,
         CAST(sum(CASE WHEN hit AND NOT gone THEN toxic ELSE 0 END) AS BIGINT) AS toxic_lost
  FROM told GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       CAST(sum(removed) OVER (PARTITION BY part, own) AS BIGINT) AS shapley
FROM counted
""")
def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op11_merkle_manifest", r"""
WITH RECURSIVE coded AS (
  SELECT doc_id, lang, n_chars,
         coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-')
           || coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS head,
         coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_concat([4294967295], [ascii(x) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]),
           lambda crc, byte: list_reduce(list_concat([xor(crc, byte)], [0, 0, 0, 0, 0, 0, 0, 0]),
             lambda c, z: xor(c >> 1, 3988292384 * (c & 1)))) AS rest
  FROM documents),
leaves AS (
  SELECT doc_id, lang, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || CAST(n_chars AS VARCHAR), '-') || tail) AS leaf,
         CASE WHEN xor(rest, 4294967295) % 7 = 0 THEN
           sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || CAST(n_chars + 1 AS VARCHAR), '-') || tail) END AS other,
         row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY lang) AS n
  FROM coded),
low(lang, level, i, n, h) AS (
  SELECT lang, 0, i, n, leaf FROM leaves
  UNION ALL
  SELECT lang, level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM low WHERE n > 1 GROUP BY lang, level, i // 2, (n + 1) // 2),
subroots AS (SELECT lang, h AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS i, count(*) OVER () AS n FROM low WHERE n = 1),
high(level, i, n, h) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL
  SELECT level + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM high WHERE n > 1 GROUP BY level, i // 2, (n + 1) // 2),
walk(doc_id, lang, level, i, n, proof, node) AS (
  SELECT doc_id, lang, 0, i, n, '', coalesce(other, leaf) FROM leaves
  UNION ALL
  SELECT w.doc_id, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.i % 2 = 1 THEN s.h || node ELSE node || coalesce(s.h, '') END)
  FROM walk w LEFT JOIN low s ON s.lang IS NOT DISTINCT FROM w.lang AND s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1),
rise(doc_id, lang, level, i, n, proof, node) AS (
  SELECT w.doc_id, w.lang, 0, s.i, s.n, proof, node FROM walk w JOIN subroots s ON s.lang IS NOT DISTINCT FROM w.lang WHERE w.n = 1
  UNION ALL
  SELECT w.doc_id, w.lang, w.level + 1, w.i // 2, (w.n + 1) // 2, proof || coalesce(s.h, ''),
         sha256(CASE WHEN w.i % 2 = 1 THEN s.h || node ELSE node || coalesce(s.h, '') END)
  FROM rise w LEFT JOIN high s ON s.level = w.level AND s.i = xor(w.i, 1) WHERE w.n > 1)
SELECT l.doc_id, l.leaf, s.subroot, r.h AS root, sha256(w.proof) AS proof_sha256, w.node AS folded_root, w.node = r.h AS verified
FROM leaves l JOIN subroots s ON s.lang IS NOT DISTINCT FROM l.lang
JOIN rise w ON w.n = 1 AND w.doc_id IS NOT DISTINCT FROM l.doc_id CROSS JOIN (SELECT h FROM high WHERE n = 1) r
""")
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.prove_documents(docs, tampered=tampered, changed={"n_chars": F.col("n_chars") + 1})


@query("op13_substring_dedup", r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT r, w, unnest(range(1, len(w) - 33)) AS p FROM d WHERE len(w) >= 35),
c AS (SELECT r, p, count(*) OVER (PARTITION BY array_to_string(w[p:p + 34], ' ')) AS n FROM s),
covered AS (SELECT DISTINCT r, p + unnest(range(35)) AS at FROM c WHERE n > 1),
words AS (SELECT r, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS at FROM d),
kept AS (
  SELECT x.r, count(*) AS n_words, count(c.at) AS n_removed,
         string_agg(CASE WHEN c.at IS NULL THEN word END, ' ' ORDER BY x.at) AS kept
  FROM words x LEFT JOIN covered c ON c.r = x.r AND c.at = x.at GROUP BY x.r)
SELECT doc_id, coalesce(n_words, 0) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN kept k ON k.r = d.r
""")
def op13_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.passage_digests(passages.find_passages(table(spark, sf_dir, "documents")))
