"""The registered queries of this subpackage and, where SQL expresses them, their DuckDB texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gramforge.llm import audit, decontam, fingerprints, html, language, merkle, mixing, neardup, pii, quality, secrets, sharding, tokens

SHARDS = 40


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    network = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score_quality(docs, network).select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_classes(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    crc = F.crc32(F.coalesce("text", F.lit("")).cast("binary"))
    # taken from the text before the shuffle, which then carries no text
    dealt = sharding.assign_shards(documents(spark, sf_dir).withColumn("text_crc32", crc), SHARDS, "bytes")
    return dealt.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return language.identify(docs, language.train(docs)).select("doc_id", language.held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir)).select("doc_id", "source", "mix_block", "mix_release", "mix_deadline", "mix_slot", "mix_rank", "mixed")


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find_pii(documents(spark, sf_dir))


def op8_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(documents(spark, sf_dir))
    base = F.filter("found", lambda s: ~s["weak"])
    count = lambda kind: F.size(F.filter("found", lambda s: s["kind"] == kind)).cast("long")
    return found.select("doc_id", *[count(k).alias(f"n_{k}") for k in secrets.BASE], F.sha2(secrets.span_digest(base).cast("binary"), 256).alias("base_sha256"), secrets.span_digest(F.col("found")).alias("spans"))


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compare_neighbours(documents(spark, sf_dir))


def op10_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.tokenize(documents(spark, sf_dir))


def op11_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    return merkle.manifest(documents(spark, sf_dir), tampered)


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.filter_interactions(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op13_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return html.extract(pages, html.train(pages))


QUERIES = {
    f.__name__: f
    for f in (op1_quality, op2_decontamination, op3_sharding, op4_near_duplicates, op5_language, op6_mixing, op7_pii, op8_secrets, op9_fingerprints, op10_tokens, op11_manifest, op12_filter_audit, op13_html)
}
#: A table of the 256 byte steps of CRC-32, for the bytes of a text one after another.
_CRC = """steps(k, n, c) AS (SELECT k, 0, k::UBIGINT FROM range(256) r(k) UNION ALL
  SELECT k, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY k) AS tab FROM steps WHERE n = 8)"""
_FIELDS = " || ".join(f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}, '-')" for c in ("doc_id", "source", "lang", "n_chars"))
_TEXT = "coalesce(octet_length(encode({t})) || ':' || {t}, '-')"
#: Beyond SQL are trained models, fingerprints, tokens and links of the others; tests/llm hold them against brute force.
ORACLES: dict[str, str] = {
    # shards cut the order by digest
    "op3_sharding": """WITH RECURSIVE steps(k, n, c) AS (SELECT k, 0, k::UBIGINT FROM range(256) r(k) UNION ALL
  SELECT k, n + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END FROM steps WHERE n < 8),
crc AS (SELECT list(c ORDER BY k) AS tab FROM steps WHERE n = 8),
d AS (SELECT doc_id, coalesce(text, '') AS t, octet_length(encode(coalesce(text, ''))) + 16 AS size, md5(coalesce(text, '')) AS h FROM documents),
bytes AS (SELECT doc_id, h, size, t, hex(encode(t)) AS x FROM d),
p AS (SELECT *, 2 * sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS place, sum(size) OVER () AS total FROM bytes),
s AS (SELECT *, least(39, place * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, xor(list_reduce(list_transform(range(size - 16), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT), 4294967295::UBIGINT)::BIGINT AS text_crc32,
  'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard FROM s CROSS JOIN crc""",
    # both kinds of trees level by level; a row's path has what stands beside its nodes on each level
    "op11_manifest": f"""WITH RECURSIVE {_CRC},
d AS (SELECT doc_id, source, text, hex(encode(doc_id::VARCHAR)) AS x, sha256({_FIELDS} || {_TEXT.format(t="text")}) AS leaf, sha256({_FIELDS} || {_TEXT.format(t="replace(text, chr(10), '')")}) AS other FROM documents),
e AS (SELECT *, list_reduce(list_transform(range(length(x) // 2), lambda i: ('0x' || substr(x, 2 * i + 1, 2))::UBIGINT), lambda c, b: xor(c >> 8, tab[((xor(c, b) & 255) + 1)::BIGINT]), 4294967295::UBIGINT) AS sum FROM d CROSS JOIN crc),
l AS (SELECT doc_id, source IS NOT NULL AS known, coalesce(source, '') AS source, leaf, CASE WHEN xor(sum, 4294967295::UBIGINT) % 2 = 0 THEN other ELSE leaf END AS other, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, row_number() OVER () AS id FROM e),
up(known, source, lvl, pos, n, h) AS (SELECT known, source, 0, pos, count(*) OVER (PARTITION BY known, source), leaf FROM l UNION ALL
  SELECT known, source, lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM up WHERE n > 1 GROUP BY known, source, lvl, n, pos // 3),
sub AS (SELECT known, source, h, row_number() OVER (ORDER BY known, encode(source)) - 1 AS pos FROM up WHERE n = 1),
over(lvl, pos, n, h) AS (SELECT 0, pos, count(*) OVER (), h FROM sub UNION ALL
  SELECT lvl + 1, pos // 3, (n + 2) // 3, sha256(string_agg(h, '' ORDER BY pos)) FROM over WHERE n > 1 GROUP BY lvl, n, pos // 3),
beside AS (SELECT l.id, u.lvl AS ord, u.pos < l.pos // (3 ** u.lvl)::BIGINT AS before, u.pos, u.h FROM l JOIN up u ON u.known = l.known AND u.source = l.source AND u.n > 1 AND u.pos // 3 = l.pos // (3 ** (u.lvl + 1))::BIGINT AND u.pos <> l.pos // (3 ** u.lvl)::BIGINT
  UNION ALL SELECT l.id, 1000 + o.lvl, o.pos < s.pos // (3 ** o.lvl)::BIGINT, o.pos, o.h FROM l JOIN sub s ON s.known = l.known AND s.source = l.source JOIN over o ON o.n > 1 AND o.pos // 3 = s.pos // (3 ** (o.lvl + 1))::BIGINT AND o.pos <> s.pos // (3 ** o.lvl)::BIGINT),
-- a run of one has nothing beside it, but is hashed all the same
lvls AS (SELECT l.id, u.lvl AS ord FROM l JOIN (SELECT DISTINCT known, source, lvl FROM up WHERE n > 1) u ON u.known = l.known AND u.source = l.source UNION ALL SELECT id, 1000 + lvl FROM l CROSS JOIN (SELECT DISTINCT lvl FROM over WHERE n > 1) o),
runs AS (SELECT v.id, v.ord, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE b.before), '') AS lef, coalesce(string_agg(b.h, '' ORDER BY b.pos) FILTER (WHERE NOT b.before), '') AS rig FROM lvls v LEFT JOIN beside b ON b.id = v.id AND b.ord = v.ord GROUP BY v.id, v.ord),
paths AS (SELECT l.id, coalesce(string_agg(r.lef || r.rig, '' ORDER BY r.ord), '') AS proof, coalesce(list(r.lef || '|' || r.rig ORDER BY r.ord) FILTER (WHERE r.id IS NOT NULL), []) AS path FROM l LEFT JOIN runs r ON r.id = l.id GROUP BY l.id)
SELECT doc_id, leaf, s.h AS subroot, o.h AS root, sha256(proof) AS proof_sha256, list_reduce(path, lambda h, p: sha256(split_part(p, '|', 1) || h || split_part(p, '|', 2)), other) AS folded_root,
  list_reduce(path, lambda h, p: sha256(split_part(p, '|', 1) || h || split_part(p, '|', 2)), other) = o.h AS verified
FROM l JOIN paths USING (id) JOIN sub s ON s.known = l.known AND s.source = l.source CROSS JOIN (SELECT h FROM over WHERE n = 1) o""",
    # the definition, row by row and order by order
    "op12_filter_audit": r"""WITH RECURSIVE f AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws, min(doc_id) OVER (PARTITION BY t) AS least FROM f),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
v AS (SELECT row_number() OVER () AS id, part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, CASE WHEN len(ws) < 100 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(ws)) < 80 * len(ws) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN lab USING (doc_id)),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
perms(o) AS (SELECT '' UNION ALL SELECT o || c FROM perms CROSS JOIN letters WHERE NOT contains(o, c)),
orders AS (SELECT o FROM perms WHERE length(o) = 5),
gone AS (SELECT v.*, o, (SELECT min(instr(o, c)) FROM letters WHERE contains(fails, c)) AS first FROM v CROSS JOIN orders),
counted AS (SELECT part, o AS filter_order, step::INT AS step, substr(o, step, 1) AS c, count(*) FILTER (WHERE first IS NULL OR first > step) AS kept, count(*) FILTER (WHERE first = step) AS removed,
  count(*) FILTER (WHERE first < step AND contains(fails, substr(o, step, 1))) AS redundant, count(*) FILTER (WHERE fails = substr(o, step, 1)) AS unique_fails,
  count(*) FILTER (WHERE first = step AND good) AS good_lost, count(*) FILTER (WHERE first = step AND toxic) AS toxic_lost
  FROM gone CROSS JOIN range(1, 6) r(step) GROUP BY part, o, step)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (sum(removed) OVER (PARTITION BY part, c))::BIGINT AS shapley FROM counted""",
}
