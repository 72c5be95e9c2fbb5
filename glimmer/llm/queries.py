"""The queries of this package's operators, on whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from glimmer.llm import chunks, decontamination, jaccard, lm, mixing, packing, quality, repeats, resampling, toxicity, url_rules, vector_codes, wrappers


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.benchmark_matches(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.drop("_rid")


def op2_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.suffix_dedup(_table(spark, sf_dir, "documents"))


def op3_wrappers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_text(_table(spark, sf_dir, "pages"))


def op4_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = chunks.substring_dedup(_table(spark, sf_dir, "documents"))
    return found.drop("spans")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_join(_table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op7_url_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(list(url_rules.RULES), "verdict string, host string, path string")
    return url_rules.judge_urls(_table(spark, sf_dir, "pages"), rules)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.quality_rules(_table(spark, sf_dir, "documents"))
    return judged.drop("removed_lines")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.lm_scores(_table(spark, sf_dir, "documents"), tokenizer())


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), tokenizer())


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.coded(_table(spark, sf_dir, "embeddings"))


def op12_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")).drop("n_words")


def op13_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(_table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_decontamination": op1_decontamination,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_wrappers": op3_wrappers,
        "op4_chunk_dedup": op4_chunk_dedup,
        "op5_jaccard_join": op5_jaccard_join,
        "op6_toxicity": op6_toxicity,
        "op7_url_rules": op7_url_rules,
        "op8_quality_rules": op8_quality_rules,
        "op9_lm_scores": op9_lm_scores,
        "op10_packing": op10_packing,
        "op11_vector_codes": op11_vector_codes,
        "op12_importance_resampling": op12_importance_resampling,
        "op13_source_mixing": op13_source_mixing,
    }


def oracle_sql() -> dict[str, str]:
    return {"op7_url_rules": OP7, "op8_quality_rules": OP8, "op11_vector_codes": _op11(), "op12_importance_resampling": OP12}


#: Every rule against every URL: the longest that fits.
OP7 = r"""
WITH u AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(verdict, rhost, rpath) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/'))
SELECT page_id, host, path,
  (SELECT max_by(rhost || rpath, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)) AS rule,
  coalesce((SELECT max_by(verdict, length(rhost || rpath)) FROM r WHERE (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)), 'allow') AS verdict
FROM u
"""

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
w AS (SELECT rid, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS w FROM d),
windows AS (SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM w, unnest(generate_series(1, len(w) - 2)) AS t(i)),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM windows) WHERE n > 1),
repeated AS (SELECT rid, count(DISTINCT i + j) AS n FROM twice, (VALUES (0), (1), (2)) AS o(j) GROUP BY rid),
raw AS (SELECT rid, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
lines AS (
  SELECT rid, source, i, line, len(ws) AS n, ('0x' || substr(md5(lower(array_to_string(ws, ' '))), 1, 15))::BIGINT AS h
  FROM (SELECT rid, source, i, line, list_filter(regexp_split_to_array(line, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') AS ws FROM raw) WHERE len(ws) > 0),
same AS (SELECT rid, source, list(h ORDER BY i) AS text FROM lines GROUP BY rid, source),
sizes AS (SELECT source, count(DISTINCT text) AS size FROM (SELECT source, text FROM same UNION ALL SELECT source, [] FROM d WHERE rid NOT IN (SELECT rid FROM lines)) GROUP BY source),
counted AS (SELECT l.source, l.h, count(DISTINCT s.text) AS n FROM lines l JOIN same s USING (rid) GROUP BY l.source, l.h),
frequent AS (SELECT c.source, h FROM counted c JOIN sizes s ON c.source IS NOT DISTINCT FROM s.source WHERE n > greatest(30, 0.001 * size)),
gone AS (SELECT l.rid, sum(l.n) AS n FROM lines l JOIN frequent f ON l.source IS NOT DISTINCT FROM f.source AND l.h = f.h GROUP BY l.rid),
dup AS (SELECT rid, count(*) - count(DISTINCT line) AS n FROM lines GROUP BY rid),
base AS (
  SELECT d.doc_id, len(w.w)::BIGINT AS n_words, length(array_to_string(w.w, ''))::BIGINT AS word_chars,
    (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(dup.n, 0)::BIGINT AS n_dup_lines,
    coalesce(repeated.n, 0)::BIGINT AS n_repeat_words, coalesce(gone.n, 0)::BIGINT AS n_removed_words
  FROM d JOIN w USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN repeated USING (rid) LEFT JOIN gone USING (rid)),
failed AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM base)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND n_words - n_removed_words >= 0.3 * n_words AS kept, n_removed_words
FROM failed
"""


def _op11(rounds: int = 6) -> str:
    """All entries against all parts, round by round."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS MATERIALIZED (
  SELECT rid, p.part, p.x, min({{'d': list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - c.x[i]) * (p.x[i] - c.x[i])))::BIGINT, 'e': c.entry}}) AS best
  FROM p JOIN c{k} c USING (part) GROUP BY rid, p.part, p.x)""")
        if k < rounds:
            steps.append(f"""
s{k} AS (SELECT part, best.e AS entry, i, sum(x[i])::BIGINT AS s, count(*) AS n FROM a{k}, (SELECT unnest(range(1, (SELECT max(len(x)) FROM p) + 1)) AS i) GROUP BY ALL),
m{k} AS (SELECT part, entry, list((s - (s % n + n) % n) // n ORDER BY i) AS x FROM s{k} GROUP BY ALL),
c{k + 1} AS MATERIALIZED (SELECT part, entry, coalesce(m.x, c.x) AS x FROM c{k} c LEFT JOIN m{k} m USING (part, entry))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS rid, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT rid, vec_id, part, q[part * len(q) // 8 + 1 : (part + 1) * len(q) // 8] AS x FROM kept, range(8) AS t(part)),
c0 AS (SELECT part, rid - 1 AS entry, x FROM p WHERE rid <= 16),{','.join(steps)},
codes AS (SELECT rid, string_agg(printf('%02x', best.e), '' ORDER BY part) AS code, sum(best.d)::BIGINT AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY part, entry)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN codes USING (rid)
"""


#: crc: the byte table of the polynomial 0xEDB88320, and the bytes of each different word through it.
OP12 = r"""
WITH words AS (
  SELECT 'd' AS side, row_number() OVER () AS rid, doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
  UNION ALL
  SELECT 't', row_number() OVER (), NULL, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') FROM benchmark),
bytes AS (SELECT list(list_reduce(range(8), lambda c, _k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i::BIGINT) ORDER BY i) AS t FROM range(256) AS r(i)),
each AS MATERIALIZED (SELECT side, rid, unnest(w) AS word FROM words),
crc AS MATERIALIZED (
  SELECT word, xor(list_reduce(list_transform(range(0, len(hex(word)) // 2), lambda i: ('0x' || substr(hex(word), 2 * i + 1, 2))::BIGINT), lambda c, b: xor(c // 256, t[xor(c % 256, b) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT word FROM each), bytes),
counts AS (SELECT bucket, count(*) FILTER (side = 'd') AS s, count(*) FILTER (side = 't') AS t FROM each JOIN crc USING (word) GROUP BY bucket),
sums AS (SELECT sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM counts),
gains AS (SELECT bucket, floor(1000 * ln((c.t + 1)::DOUBLE * (sums.s + 10000) / ((c.s + 1)::DOUBLE * (sums.t + 10000))))::BIGINT AS gain FROM counts c, sums),
weights AS (SELECT rid, count(*) AS n, sum(gain)::BIGINT AS g FROM each JOIN crc USING (word) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY rid),
scored AS (
  SELECT words.rid, doc_id, coalesce(n, 0) AS n_features, coalesce((g - (g % n + n) % n) // n, 0) AS weight,
    floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS noise
  FROM words LEFT JOIN weights USING (rid) WHERE side = 'd'),
top AS (
  SELECT rid, row_number() OVER (ORDER BY weight + noise DESC, doc_id) AS rank, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN rank <= 10 * n // 100 THEN rank END AS rank FROM scored LEFT JOIN top USING (rid)
"""
