"""The corpus queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import brown, chat, fim, fingerprints, line_dedup, mixing, packing, quality_model, quality_rules, repeats, resample, simhash, url_filter
from tidemark.llm.shared import table

RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: What both turns of the added conversation say.
CONTROL_TEXT = r"\### Assistant: </turn> ok"


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "expected", "copies")


def op2_line_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    done = line_dedup.dedup_lines(docs, rounds=None)
    return done.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), "removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op3_ffd_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.cut_documents(table(spark, sf_dir, "documents"), capacity=1024)
    digests = pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens")
    return packing.pack(digests, capacity=1024)


def op4_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(table(spark, sf_dir, "documents"), size=3, distance=2)


def op6_certified_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.apply_rules(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_edits(table(spark, sf_dir, "documents"))


def op8_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


def op9_brown_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return brown.score_documents(table(spark, sf_dir, "documents"))


def op10_repeated_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(table(spark, sf_dir, "documents"), length=200)
    gone = F.aggregate("removed", F.lit(0).cast("long"), lambda n, x: n + x["end"] - x["start"])
    return found.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fim.fill_in_middle(table(spark, sf_dir, "documents"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    again = fim.restored(F.col("output"), F.col("form"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", digest(F.col("output")).alias("output_sha256"), digest(again).alias("restored_sha256"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    role = F.when(F.col("id") == 0, "user").otherwise("assistant")
    made = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), role.alias("role"), F.lit(CONTROL_TEXT).alias("text"))
    out = chat.format_conversations(known.unionByName(made))
    read = out.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"), chat.loss_text(F.col("formatted"), F.col("loss")).alias("learnt"))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), chat.turns_digest(F.col("turns")).alias("turns_sha256"), F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2(F.col("learnt").cast("binary"), 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"),
    )


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pareto_mix, op2_line_alignment, op3_ffd_packing, op4_bradley_terry_quality, op5_simhash_ball, op6_certified_rules, op7_canonical_digest, op8_url_rules, op9_brown_scores, op10_repeated_bytes, op11_fill_in_middle, op12_importance_resampling, op13_chat_format]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op6_certified_rules": op6_sql(), "op8_url_rules": OP8_SQL, "op11_fill_in_middle": OP11_SQL, "op12_importance_resampling": OP12_SQL, "op13_chat_format": OP13_SQL}


def op6_sql(risk: float = 0.02, confidence: float = 0.95) -> str:
    """Base counts by regular expressions and unnested windows, cutoffs by binomial sums from logarithms of factorials."""
    cuts, n = quality_rules.CUTOFFS, quality_rules.LEVELS
    table = ", ".join(f"({i}, {', '.join(f'{c[i]!r}::DOUBLE' for c in cuts.values())})" for i in range(n))
    names = ", ".join(f"c_{m}" for m in cuts)
    above = " OR ".join(f"{m} > c_{m}" for m in cuts)
    by = ", ".join(f"CASE WHEN {m} > c_{m} THEN '{m}' END" for m in cuts)
    return rf"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, coalesce(text, '') AS t FROM documents
), split AS (
  SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4] AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 3)) AS i FROM split)
), twice AS (
  SELECT rid, i FROM (SELECT *, count(*) OVER (PARTITION BY rid, g) AS n FROM grams) WHERE n > 1
), covered AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS r(k) GROUP BY rid
), counts AS (
  SELECT s.rid, doc_id, lang, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
         coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, length(regexp_replace(t, '\P{{Lu}}', '', 'g')) AS upper, length(regexp_replace(t, '[^!?]', '', 'g')) AS marks
  FROM split s LEFT JOIN covered c ON c.rid = s.rid
), measured AS (
  SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed, n_symbols / greatest(word_chars, 1) AS symbol_share, upper / greatest(word_chars, 1) AS shout_share,
         marks / greatest(word_chars, 1) AS mark_share, n_dup_lines / greatest(n_words, 1) AS dup_line_share, n_repeat_words / greatest(n_words, 1) AS repeat_share,
         word_chars / greatest(n_words, 1) AS word_length
  FROM counts
), levels(level, {names}) AS (
  VALUES {table}
), clean AS (
  SELECT doc_id FROM labels GROUP BY doc_id HAVING min(quality) = 1 AND max(quality) = 1
), tried AS (
  SELECT lang, level, count(*) AS n, count(*) FILTER (WHERE {above}) AS k
  FROM measured, levels WHERE NOT base_failed AND doc_id IN (SELECT doc_id FROM clean) GROUP BY lang, level
), strata AS (
  SELECT false AS pooled, * FROM tried UNION ALL SELECT true, NULL, level, sum(n)::BIGINT, sum(k)::BIGINT FROM tried GROUP BY level
), tested AS (
  SELECT *, {1 - confidence!r} / (SELECT count(DISTINCT (lang,)) + 1 FROM tried) AS alpha,
         list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln({risk!r}) + (n - i) * ln(1 - {risk!r})))) AS tail
  FROM strata
), failing AS (
  SELECT pooled, lang, bool_or((1 - {risk!r}) ** n <= alpha) AS own, coalesce(min(level) FILTER (WHERE tail > alpha OR k > n * {risk!r}), {n}) - 1 AS level FROM tested GROUP BY pooled, lang
), judged AS (
  SELECT m.*, CASE WHEN f.own THEN f.level ELSE (SELECT level FROM failing WHERE pooled) END AS at
  FROM measured m LEFT JOIN failing f ON f.lang IS NOT DISTINCT FROM m.lang AND NOT f.pooled
), named AS (
  SELECT j.*, CASE WHEN base_failed THEN ['base'] ELSE list_filter([{by}], lambda x: x IS NOT NULL) END AS reasons FROM judged j LEFT JOIN levels l ON l.level = j.at
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, len(reasons) = 0 AS kept, array_to_string(reasons, ',') AS rejected_by FROM named
"""


OP8_SQL = r"""
WITH parts AS (
  SELECT page_id, coalesce(url, '') AS u FROM pages
), cut AS (
  SELECT page_id, CASE WHEN contains(u, '://') THEN substr(u, strpos(u, '://') + 3) ELSE '' END AS rest FROM parts
), split AS (
  SELECT row_number() OVER () AS rid, page_id,
         translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
  FROM cut
), rules(rhost, rpath, rverdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), fits AS (
  SELECT s.rid, r.rhost || r.rpath AS rule, r.rverdict,
         row_number() OVER (PARTITION BY s.rid ORDER BY length(r.rhost || r.rpath) DESC, length(r.rhost) DESC) AS nth
  FROM split s JOIN rules r ON (s.host = r.rhost OR ends_with(s.host, '.' || r.rhost)) AND starts_with(s.path, r.rpath)
)
SELECT s.page_id, s.host, s.path, f.rule, coalesce(f.rverdict, 'allow') AS verdict
FROM split s LEFT JOIN fits f ON f.rid = s.rid AND f.nth = 1
"""


#: Lines by string_split and their lengths; the outputs are cut out of the text by places, not joined from lists.
OP11_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS hex FROM documents
), split AS (
  SELECT *, string_split(t, chr(10)) AS raw FROM texts
), lines AS (
  SELECT *, CASE WHEN raw[-1] = '' THEN len(raw) - 1 ELSE len(raw) END::BIGINT AS n FROM split
), cuts AS (
  SELECT *, ('0x' || hex[1:8])::UBIGINT % (n + 1)::UBIGINT AS a, ('0x' || hex[9:16])::UBIGINT % (n + 1)::UBIGINT AS b FROM lines
), places AS (
  SELECT *, least(length(t), coalesce(list_sum(list_transform(raw[1:least(a, b)::BIGINT], lambda x: length(x) + 1)), 0))::BIGINT AS p,
         least(length(t), coalesce(list_sum(list_transform(raw[1:greatest(a, b)::BIGINT], lambda x: length(x) + 1)), 0))::BIGINT AS q,
         t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') AS plain, ('0x' || hex[25:32])::UBIGINT % 100 < 50 AS spm
  FROM cuts
)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN p END AS prefix_chars, CASE WHEN NOT plain THEN q - p END AS middle_chars,
       sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || substr(t, q + 1) || '<P>' || substr(t, 1, p) || '<M>' || substr(t, p + 1, q - p)
                   ELSE '<P>' || substr(t, 1, p) || '<S>' || substr(t, q + 1) || '<M>' || substr(t, p + 1, q - p) END) AS output_sha256, sha256(t) AS restored_sha256
FROM places
"""

#: DuckDB has no crc32: the table of its 256 steps is made by the rule, and bytes are folded by list_reduce, once per distinct word.
OP12_SQL = r"""
WITH tab AS (
  SELECT list(c ORDER BY i) AS k FROM (
    SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS c FROM (SELECT unnest(range(256)) AS i)
  )
), texts AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT rid, unnest(regexp_extract_all(translate(t, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM texts
), wanted AS (
  SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark
), vocabulary AS (
  SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM words UNION SELECT w FROM wanted)
), hashed AS (
  SELECT w, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, length(h), 2), lambda i: ('0x' || substr(h, i, 2))::BIGINT)),
                            lambda c, b: xor(c // 256, k[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket
  FROM vocabulary, tab
), s AS (
  SELECT bucket, count(*) AS s FROM words JOIN hashed USING (w) GROUP BY bucket
), t AS (
  SELECT bucket, count(*) AS t FROM wanted JOIN hashed USING (w) GROUP BY bucket
), totals AS (
  SELECT (SELECT count(*) FROM words)::DOUBLE + 10000 AS of_docs, (SELECT count(*) FROM wanted)::DOUBLE + 10000 AS of_target
), gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * of_docs / ((s + 1)::DOUBLE * of_target)))::BIGINT AS gain FROM s LEFT JOIN t USING (bucket), totals
), summed AS (
  SELECT rid, count(*)::BIGINT AS n, sum(gain)::BIGINT AS g FROM words JOIN hashed USING (w) JOIN gains USING (bucket) GROUP BY rid
), scored AS (
  SELECT rid, doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce(floor(g / n), 0)::BIGINT AS weight,
         floor(-1000 * ln(-ln((('0x' || sha256('2024:' || coalesce(doc_id::VARCHAR, ''))[1:8])::UBIGINT::DOUBLE + 0.5) / 4294967296.0)))::BIGINT AS noise
  FROM texts LEFT JOIN summed USING (rid)
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY weight + noise DESC, doc_id NULLS LAST, rid) AS nth, count(*) OVER (PARTITION BY n_features >= 20) AS able FROM scored
)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN n_features >= 20 AND nth <= able * 10 // 100 THEN nth END::BIGINT AS rank FROM placed
"""

OP13_SQL = rf"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL SELECT -7, unnest([0, 1]), unnest(['user', 'assistant']), '{CONTROL_TEXT}'
), beside AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, text) IS DISTINCT FROM role AS opens FROM turns
), sized AS (
  SELECT *, length(text) + length(text) - length(replace(text, chr(92), '')) + (length(text) - length(replace(text, '<turn:', ''))) // 6 + (length(text) - length(replace(text, '</turn>', ''))) // 7
            + (length(text) - length(replace(text, '<next>', ''))) // 6 + CASE WHEN opens THEN length('<turn:') + length(role) + 1 + length('</turn>') + 1 ELSE length('<next>') END AS chars
  FROM beside
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars, sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM sized GROUP BY conv_id
"""
