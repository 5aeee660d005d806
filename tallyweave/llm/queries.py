"""Registered queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyweave.llm import (
    chat_format, decontaminate, ngram_join, packing, period_runs, quality_classifier, quality_rules, secret_scan, sequence_files, sharding, token_counts,
    turn_repair, warc_archive,
)
from tallyweave.session import scratch_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


@register
def op1_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base counts of every document and the verdict of its group's fences."""
    judged = quality_rules.quality_rules(_table(spark, folder, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "level"
    )


@register
def op2_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Digests read back from all formatted conversations and from one that quotes control strings."""
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat_format.digests(chat_format.format_chats(turns))


@register
def op3_trie_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Unigram token counts of every whole document."""
    return token_counts.token_counts(_table(spark, folder, "documents").select("doc_id", "text"))


@register
def op4_first_fit_decreasing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents packed into sequences of 4096 tokens."""
    packed = packing.pack_documents(_table(spark, folder, "documents").select("doc_id", "text"))
    return packed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


@register
def op5_warc_content_store(spark: SparkSession, folder: str) -> DataFrame:
    """Record facts of all pages, read back from their archive."""
    place = warc_archive.archive_folder(spark)
    warc_archive.write_archive(_table(spark, folder, "pages").select("page_id", "url", "html"), place)
    facts = warc_archive.read_archive(spark, place)
    return facts.select(
        F.col("page_id").cast("bigint").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast("bigint").alias("refers_to")
    )


@register
def op6_pigeonhole_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Every document and benchmark item that occurs in it within the error budget."""
    found = decontaminate.find_items(
        _table(spark, folder, "documents").select("doc_id", "text"), _table(spark, folder, "benchmark").select("item_id", "text")
    )
    hit = found.filter(F.size("items") > 0).select("doc_id", F.explode("items").alias("hit"))
    return hit.select("doc_id", F.col("hit.item_id").alias("item_id"), F.col("hit.distance").alias("distance"), F.col("hit.end").alias("match_end"))


@register
def op7_bayes_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    """Class and number of links of every document under 5-gram Jaccard similarity of 0.8 or more."""
    joined = ngram_join.jaccard_join(_table(spark, folder, "documents").select("doc_id", "text"))
    return joined.select("doc_id", "class_id", "n_links", "n_copies")


@register
def op8_crf_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Counts and digests of the secret spans of every document."""
    found = secret_scan.scan_secrets(_table(spark, folder, "documents").select("doc_id", "text"))

    def of(kind: str):  # noqa: ANN202
        return F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint")

    def joined(spans):  # noqa: ANN001, ANN202
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    base = F.filter("secrets", lambda s: s["kind"] != "crf")
    return found.select(
        "doc_id", of("assign").alias("n_assign"), of("access").alias("n_access"), of("hex").alias("n_hex"),
        F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"), of("crf").alias("n_crf"),
    )


@register
def op9_consistent_hash_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Shard and slot of every document on a ring of 24 shards with equal counts."""
    placed = sharding.shard_documents(_table(spark, folder, "documents").select("doc_id", "text"))
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), F.col("shard").cast("int").alias("shard"), "slot",
        F.lit(None).cast("int").alias("grown_shard"), F.col("home").cast("int").alias("home"),
    )


@register
def op10_neighbour_vote_quality(spark: SparkSession, folder: str) -> DataFrame:
    """Quality score of every document; the labels of a third of the keys are never learned."""
    docs = _table(spark, folder, "documents").select("doc_id", "text")
    space = quality_classifier.train(docs, _table(spark, folder, "labels"))
    scored = quality_classifier.score_quality(docs, space)
    return scored.select("doc_id", F.coalesce(quality_classifier.held_out(), F.lit(False)).alias("held_out"), "score", "predicted")


def damaged_conversations(turns: DataFrame) -> DataFrame:
    """Conversations with the faults that the contract of op11 plants by a checksum of conversation and turn."""
    space = F.lit(" ")
    name = F.concat(F.coalesce(F.col("conv_id").cast("string"), space), F.lit(":"), F.coalesce(F.col("turn").cast("string"), space))
    fault = F.crc32(name.cast("binary")) % 20
    role, text = (F.coalesce(F.col(c).cast("string"), space) for c in ("role", "text"))
    text = F.when(F.col("_f") == 1, "").when(F.col("_f") == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    copies = F.explode(F.array_repeat(F.lit(0), F.when(F.col("_f") == 3, 2).otherwise(1)))
    kept = turns.withColumn("_f", fault).filter("_f <> 0")
    return kept.select("conv_id", "turn", F.when(F.col("_f") == 4, "user").otherwise(role).alias("role"), text.alias("text"), copies.alias("_copy")).drop("_copy")


@register
def op11_run_length_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    """Faults, cheapest audit and repaired turns of every damaged conversation."""
    turns = _table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    found = turn_repair.digests(turn_repair.repair_conversations(damaged_conversations(turns)))
    every = turns.groupBy(F.col("conv_id").alias("_id")).agg(F.lit(1).alias("_one"))
    joined = every.join(found, every["_id"].eqNullSafe(found["conv_id"]), "left")
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    nothing = F.sha2(F.lit(""), 256)
    return joined.select(F.col("_id").alias("conv_id"), *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", nothing).alias("repaired_sha256"))


def planted_periods(docs: DataFrame) -> DataFrame:
    """Documents in which the contract of op12 makes a tenth of the texts periodic, by a checksum of their id."""
    checksum = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    g = F.call_function("div", F.col("_h"), F.lit(10))
    parts = F.filter(F.split(F.col("text"), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    chosen = (F.col("_h") % 10 == 0) & F.col("text").rlike("[^\\x20\\x09-\\x0D]")
    tagged = docs.withColumn("_h", checksum).withColumn("_w", F.when(chosen, parts)).withColumn("_a", g % F.size("_w"))
    tagged = tagged.withColumn("_p", F.lit(1) + F.call_function("div", F.size("_w") - F.col("_a"), F.lit(3) + g % 8))
    seat = F.transform(F.sequence(F.lit(0).cast("bigint"), (F.size("_w") - 1).cast("bigint")), lambda i: F.when(i < F.col("_a"), i).otherwise(F.col("_a") + (i - F.col("_a")) % F.col("_p")))
    made = F.array_join(F.transform(seat, lambda i: F.get("_w", i.cast("int"))), " ")
    return tagged.select("doc_id", F.when(F.col("_w").isNotNull(), made).otherwise(F.col("text")).alias("text"))


@register
def op12_basic_factor_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of words in every document, and its words without repeated periods."""
    docs = planted_periods(_table(spark, folder, "documents").select("doc_id", "text"))
    return period_runs.digests(period_runs.find_runs(docs))


@register
def op13_arrow_sequence_files(spark: SparkSession, folder: str) -> DataFrame:
    """Place, length and checksum of every document's ids, read back from sequence files."""
    place = scratch_folder(spark, "sequences")
    sequence_files.write_sequences(_table(spark, folder, "documents").select("doc_id", "text"), place)
    return sequence_files.read_documents(spark, place)


def _crc32(text: str) -> str:
    """SQL of the checksum of a short ASCII text, bit by bit."""
    return (
        f"xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split({text}, ''), lambda x: ascii(x)::BIGINT)),"
        " lambda c, b: list_reduce(list_prepend(xor(c, b), range(8)), lambda x, k: xor(x >> 1, 3988292384 * (x & 1)))))"
    )


def _edit(state: str, cost: str | int, letter: str) -> str:
    """SQL of a state's cost (eight digits) and audit behind one more edit."""
    return f"lpad(CAST(CAST(left({state}, 8) AS BIGINT) + {cost} AS VARCHAR), 8, '0') || substr({state}, 9) || '{letter}'"


_KEEPS = {"s1": ("s", ["s0"]), "s2": ("u", ["s0", "s1", "s3"]), "s3": ("a", ["s2"])}
_MOVES = {
    to: "least(" + ", ".join(
        [f"CASE WHEN who = '{who}' AND fault <> 'x' THEN {_edit(p, 'extra', 'K')} END" for p in froms]
        + ([f"CASE WHEN fault <> 'x' THEN {_edit(p, '1 + extra', 'R')} END" for p in froms] if to != "s1" else []) + [_edit(to, 2, "D")]
    ) + f") AS {to}"
    for to, (who, froms) in _KEEPS.items()
}
ORACLE["op11_run_length_turn_repair"] = f"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         {_crc32("(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS f
  FROM conversations),
hurt AS (
  SELECT conv_id, turn, CASE WHEN f = 4 THEN 'user' ELSE role END AS role,
         CASE WHEN f = 1 THEN '' WHEN f = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE WHEN f = 3 THEN 2 ELSE 1 END)) AS copy
  FROM src WHERE f <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS r FROM hurt),
rows AS (
  SELECT *, CASE WHEN left(role, 1) IN ('s', 'u', 'a') THEN left(role, 1) ELSE 'o' END AS who, left(lag(role) OVER (PARTITION BY conv_id ORDER BY r), 1) || left(role, 1) AS pair,
         NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY r) > 1 AS again,
         NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS cut
  FROM placed),
marked AS (SELECT *, CASE WHEN blank OR again THEN 'x' WHEN cut THEN 't' ELSE '.' END AS fault, CASE WHEN cut THEN 5 ELSE 0 END AS extra FROM rows),
facts AS (
  SELECT conv_id, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again AND NOT blank) AS duplicate,
         count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM marked GROUP BY conv_id),
path AS (
  SELECT conv_id, CAST(0 AS BIGINT) AS r, '00000000' AS s0, CAST(NULL AS VARCHAR) AS s1, CAST(NULL AS VARCHAR) AS s2, CAST(NULL AS VARCHAR) AS s3 FROM facts
  UNION ALL
  SELECT conv_id, r, {_edit("s0", 2, "D")} AS s0, {_MOVES["s1"]}, {_MOVES["s2"]}, {_MOVES["s3"]}
  FROM (SELECT * REPLACE (least(s3, {_edit("s2", 5, "I")}) AS s3)
        FROM (SELECT p.conv_id, m.r, m.who, m.fault, m.extra, p.s0, p.s1, p.s3, least(p.s2, {_edit("p.s0", 5, "I")}, {_edit("p.s1", 5, "I")}, {_edit("p.s3", 5, "I")}) AS s2
              FROM path p JOIN marked m ON m.conv_id IS NOT DISTINCT FROM p.conv_id AND m.r = p.r + 1))),
best AS (
  SELECT f.*, least(s0, s3, {_edit("s2", 5, "I")}, {_edit("(" + _edit("s1", 5, "I") + ")", 5, "I")}) AS found
  FROM facts f JOIN path p ON p.conv_id IS NOT DISTINCT FROM f.conv_id AND p.r = f.n),
letters AS (SELECT conv_id, unnest(range(1, length(found) - 7)) AS i, substr(found, 8 + i, 1) AS letter FROM best),
steps AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS r, count(*) FILTER (letter <> 'D') OVER w AS o FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY i)),
made AS (
  SELECT s.conv_id, s.i, s.letter, s.o, m.role, CASE WHEN s.letter = 'I' THEN '' ELSE m.text END AS text,
         max(CASE WHEN s.o = 1 AND s.letter = 'K' AND m.who = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY s.conv_id) AS headed
  FROM steps s LEFT JOIN marked m ON m.conv_id IS NOT DISTINCT FROM s.conv_id AND m.r = s.r),
whole AS (
  SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (o - headed) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || text, chr(10) ORDER BY i) AS t
  FROM made WHERE letter <> 'D' GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
       coalesce(CAST(left(found, 8) AS BIGINT), 0) AS cost, coalesce(substr(found, 9), '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN whole ON whole.conv_id IS NOT DISTINCT FROM c.conv_id"""

ORACLE["op12_basic_factor_runs"] = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws, {_crc32("CAST(doc_id AS VARCHAR)")} AS h FROM documents),
plan AS (SELECT *, len(ws) AS n, h // 10 AS g, h % 10 = 0 AND len(ws) > 0 AS hit FROM d),
seat AS (SELECT *, CASE WHEN hit THEN g % n END AS a, CASE WHEN hit THEN 1 + (n - g % n) // (3 + g % 8) END AS p FROM plan),
word AS (
  SELECT doc_id, i, ws[1 + CASE WHEN hit AND i >= a THEN a + (i - a) % p ELSE i END] AS w
  FROM (SELECT *, unnest(range(n)) AS i FROM seat)),
names AS (
  SELECT 1 AS len, doc_id, i, dense_rank() OVER (ORDER BY doc_id, w) AS nm, lead(i) OVER (PARTITION BY doc_id, w ORDER BY i) - i AS gap,
         count(*) OVER (PARTITION BY doc_id, w) AS copies
  FROM word
  UNION ALL
  SELECT 2 * len, doc_id, i, dense_rank() OVER (ORDER BY a, b), lead(i) OVER (PARTITION BY a, b ORDER BY i) - i, count(*) OVER (PARTITION BY a, b)
  FROM (SELECT x.len, x.doc_id, x.i, x.nm AS a, y.nm AS b FROM names x JOIN names y ON y.doc_id = x.doc_id AND y.i = x.i + x.len WHERE x.copies > 1 AND y.copies > 1)),
stretch AS (
  SELECT doc_id, len, gap, i, i - row_number() OVER (PARTITION BY doc_id, len, gap ORDER BY i) AS island FROM names WHERE gap <= len AND 2 * gap > len),
run AS (
  SELECT doc_id, CAST(min(i) AS BIGINT) AS start, CAST(max(i) + gap + len - min(i) AS BIGINT) AS length, CAST(gap AS BIGINT) AS period
  FROM stretch GROUP BY doc_id, len, gap, island HAVING max(i) + gap + len - min(i) >= greatest(6, 4 * gap)),
facts AS (
  SELECT doc_id, count(*) AS n_runs, arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) AS best,
         string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines
  FROM run GROUP BY doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM run),
kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_runs, 0) AS n_runs, best.s AS start, best.l AS length, best.p AS period, best.l * 1000 // best.p AS exponent_milli,
       sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM d LEFT JOIN facts ON facts.doc_id = d.doc_id LEFT JOIN kept ON kept.doc_id = d.doc_id"""

ORACLE["op5_warc_content_store"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
g AS (SELECT page_id, octet_length(encode(body)) AS n, sha1(body) AS d, max(page_id) OVER (PARTITION BY body) AS owner FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, d AS payload_digest,
       CASE WHEN n >= 1000 AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n >= 1000 AND page_id <> owner THEN owner END AS refers_to
FROM g"""

ORACLE["op2_chat_format"] = """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
c AS (
  SELECT conv_id, count(*) AS n_turns,
         sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
         coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS loss_chars,
         sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
         sum(length(text) + length(regexp_replace(text, '[^\\\\<\\[\\]]', '', 'g'))
             + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11
                    ELSE 16 + length(role) + length(regexp_replace(role, '[^\\\\<\\[\\]]', '', 'g')) END) + 3 AS formatted_chars
  FROM t GROUP BY conv_id)
SELECT conv_id, n_turns, turns_sha256, CAST(loss_chars AS BIGINT) AS loss_chars, loss_sha256,
       CAST(formatted_chars AS BIGINT) AS formatted_chars, CAST(0 AS BIGINT) AS n_rewrites
FROM c"""

_FENCED = ", ".join(
    f"max(q3 + {quality_rules.SPREADS} * greatest(q3 - q1, {least})) FILTER (measure = '{name}') AS {name}_hi,"
    f" max(q1 - {quality_rules.SPREADS} * greatest(q3 - q1, {least})) FILTER (measure = '{name}') AS {name}_lo"
    for name, (least, _) in quality_rules.MEASURES.items()
)
_WITHIN = " AND ".join(
    f"{name} <= coalesce({name}_hi, {name})" + (f" AND {name} >= coalesce({name}_lo, {name})" if low else "")
    for name, (_, low) in quality_rules.MEASURES.items()
)

ORACLE["op1_quality_rules"] = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, lang, source FROM documents),
w AS (
  SELECT *, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls
  FROM d),
win AS (SELECT doc_id, i, array_to_string(ws[i : i + 7], ' ') AS win FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
twice AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, win) > 1),
rep AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM twice) GROUP BY doc_id),
m AS (
  SELECT w.doc_id, lang, source, len(ws) AS n_words, length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(translate(t, '#*$%&|<>', '')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines,
         coalesce(rep.n, 0) AS n_repeat_words
  FROM w LEFT JOIN rep ON rep.doc_id = w.doc_id),
x AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         n_symbols * 1000000 // greatest(word_chars, 1) AS symbol_ppm, n_dup_lines * 1000000 // greatest(n_lines, 1) AS dup_line_ppm,
         n_repeat_words * 1000000 // greatest(n_words, 1) AS repeat_ppm, word_chars * 1000 // greatest(n_words, 1) AS word_length
  FROM m),
long AS (UNPIVOT (SELECT lang, source, symbol_ppm, dup_line_ppm, repeat_ppm, word_length FROM x WHERE NOT base_failed)
         ON symbol_ppm, dup_line_ppm, repeat_ppm, word_length INTO NAME measure VALUE v),
s AS (
  SELECT lang, source, measure, (v >> greatest(length(bin(v)) - 7, 0)) << greatest(length(bin(v)) - 7, 0) AS bucket, count(*) AS n
  FROM long GROUP BY ALL),
levels AS (
  SELECT 0 AS level, lang, source, measure, bucket, sum(n) AS n FROM s GROUP BY ALL
  UNION ALL SELECT 1, lang, NULL, measure, bucket, sum(n) FROM s GROUP BY ALL
  UNION ALL SELECT 2, NULL, NULL, measure, bucket, sum(n) FROM s GROUP BY ALL),
ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY bucket) AS upto,
         sum(n) OVER (PARTITION BY level, lang, source, measure) AS total
  FROM levels),
quart AS (
  SELECT level, lang, source, measure, max(total) AS n, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3
  FROM ranked GROUP BY ALL),
f AS (SELECT level, lang, source, max(n) AS n, {_FENCED} FROM quart GROUP BY ALL),
own AS (
  SELECT x.*, CASE WHEN f0.n >= {quality_rules.MIN_GROUP} THEN 0 WHEN f1.n >= {quality_rules.MIN_GROUP} THEN 1 ELSE 2 END AS level
  FROM x LEFT JOIN f f0 ON f0.level = 0 AND f0.lang IS NOT DISTINCT FROM x.lang AND f0.source IS NOT DISTINCT FROM x.source
         LEFT JOIN f f1 ON f1.level = 1 AND f1.lang IS NOT DISTINCT FROM x.lang)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND {_WITHIN} AS kept, own.level
FROM own LEFT JOIN f ON f.level = own.level
  AND (own.level = 2 OR f.lang IS NOT DISTINCT FROM own.lang) AND (own.level > 0 OR f.source IS NOT DISTINCT FROM own.source)"""
