"""The operators applied to the driver's tables: one query each, and SQL where SQL can express the result."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import bytebpe, exact, linefreq, mixing, outliers, periodic, pii, probminhash, quality_pu, repair, secrets, trie, warc
from graphloom.llm.common import GAP, shared_folder, table


def joined_spans(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    found = found.withColumn("_base", F.filter("spans", lambda s: s["base"]))
    return found.select("doc_id", *[count_kind(F.col("_base"), k).alias(f"n_{k}") for k in secrets.KINDS], F.sha2(joined_spans(F.col("_base")), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"), F.col("n_layers").cast("long").alias("n_layers"))


def op2_token_ids(spark: SparkSession, sf_dir: str, vocabulary: str = "word_bpe_49k.json") -> DataFrame:
    path = shared_folder(spark) + "-ids"
    repair.write_ids(table(spark, sf_dir, "documents"), path, public_tokenizers.path(vocabulary))
    return repair.read_ids(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = linefreq.drop_site_boilerplate(table(spark, sf_dir, "pages"))
    return out.select("page_id", "host", "n_lines", "n_dropped", F.sha2("text", 256).alias("text_sha256"))


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_dedup(table(spark, sf_dir, "documents"), keep="largest")


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_pu.quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probminhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), vocabulary)


def bpe_digests(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    out = bytebpe.encode(docs, public_tokenizers.path(vocabulary), public_tokenizers.PATTERN, decoded=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source")


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_personal_data(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["base"])
    return found.select("doc_id", *[count_kind(base, k).alias(f"n_{k}") for k in pii.KINDS], F.sha2(joined_spans(base), 256).alias("base_sha256"), joined_spans(F.col("spans")).alias("spans"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outliers.quality_rules(table(spark, sf_dir, "documents"))


def op11_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    archives = warc.write_archives(table(spark, sf_dir, "pages"), f"{folder}-whole")
    records = warc.normalise(archives, f"{folder}-whole", f"{folder}-members")
    out = warc.read_records(warc.read_index(spark, records, f"{folder}-members"), f"{folder}-members")
    digest, size = F.coalesce(F.sha2("payload", 256), F.col("digest")), F.coalesce(F.octet_length("payload").cast("long"), F.col("payload_bytes"))
    return out.select("page_id", size.alias("payload_bytes"), digest.alias("payload_digest"), "record_type", "refers_to")


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic.find_runs(periodic.with_planted_repeats(table(spark, sf_dir, "documents"))))


def run_digests(found: DataFrame) -> DataFrame:
    """Number of runs, the one with the greatest exponent, and digests of all runs and of the text without repeats."""

    def before(a: Column, b: Column) -> Column:
        # Lengths and periods are below 2^31, so the products are exact; runs come by start, then period.
        p, q = a["length"] * b["period"], b["length"] * a["period"]
        return F.when(p > q, -1).when(p < q, 1).when(a["start"] < b["start"], -1).when(a["start"] > b["start"], 1).when(a["period"] < b["period"], -1).when(a["period"] > b["period"], 1).otherwise(0)

    lines = F.transform("runs", lambda r: F.concat_ws(",", *[r[k].cast("string") for k in ("start", "length", "period")]))
    best = F.get(F.array_sort("runs", before), F.lit(0))
    found = found.select("doc_id", "runs", "text", best.alias("_best"))
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), *[F.col("_best")[k].alias(k) for k in ("start", "length", "period")],
        F.expr("_best.length * 1000 div _best.period").alias("exponent_milli"),
        F.sha2(F.concat(F.array_join(lines, "\n"), F.when(F.size("runs") > 0, "\n").otherwise("")), 256).alias("runs_sha256"), F.sha2("text", 256).alias("collapsed_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    sequences = trie.turn_sequences(table(spark, sf_dir, "conversations"))
    return trie.prefix_trie(trie.with_shared_openings(sequences)).drop("n_ends")


def crc32_sql(column: str) -> str:
    """SQL for the unsigned CRC-32 of a column's decimal text: each character is taken in and followed by eight bit steps."""
    steps = f"flatten(list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda c: list_prepend(CAST(ord(c) AS BIGINT), list_transform(range(8), lambda k: CAST(-1 AS BIGINT)))))"
    step = "CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END"
    return f"xor(list_reduce({steps}, lambda x, y: {step}, CAST(4294967295 AS BIGINT)), 4294967295)"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_secrets, op2_token_ids, op3_line_dedup, op4_exact_dedup, op5_quality, op6_near_dedup, op7_byte_bpe, op8_mixing, op9_personal_data, op10_quality_rules, op11_warc, op12_periodic_runs, op13_prefix_trie)}

ORACLES: dict[str, str] = {
    "op3_line_dedup": rf"""
WITH p AS (
  SELECT page_id, lower(coalesce(regexp_extract(url, '{linefreq.HOST}', 1), '')) AS host,
         list_filter(list_transform(string_split_regex(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''),
           '{linefreq.HIDDEN}', chr(10), 'g'), '{linefreq.BLOCK_TAG}', chr(10), 'g'), '{linefreq.ANY_TAG}', '', 'g'), '[\r\n]+'),
           lambda x: regexp_replace(x, '^[\t ]+|[\t ]+$', '', 'g')), lambda x: x <> '') AS lines
  FROM pages),
h AS (SELECT host, count(*) AS n_pages FROM p GROUP BY host),
k AS (SELECT host, line, count(*) AS n FROM (SELECT host, unnest(list_distinct(lines)) AS line FROM p) GROUP BY host, line),
c AS (SELECT k.host, list(line) AS common FROM k JOIN h USING (host) WHERE n >= 3 AND n > 0.2 * n_pages GROUP BY k.host),
o AS (SELECT page_id, p.host, lines, list_filter(lines, lambda x: NOT coalesce(list_contains(common, x), false)) AS kept FROM p LEFT JOIN c USING (host))
SELECT page_id, host, len(lines) AS n_lines, len(lines) - len(kept) AS n_dropped, sha256(array_to_string(kept, chr(10))) AS text_sha256 FROM o""",
    "op4_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op11_warc": """
SELECT page_id, octet_length(encode(payload)) AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN least_id END AS refers_to
FROM (SELECT *, octet_length(encode(payload)) >= 100 AND page_id <> least_id AS again
      FROM (SELECT page_id, coalesce(html, '') AS payload, min(page_id) OVER (PARTITION BY coalesce(html, '')) AS least_id FROM pages))""",
    "op12_periodic_runs": rf"""
WITH checked AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '{GAP}'), lambda x: x <> '') AS original, {crc32_sql("doc_id")} AS h FROM documents),
places AS (SELECT *, len(original) AS n, h // 10 AS g, CASE WHEN len(original) > 0 AND h % 10 = 0 THEN (h // 10) % len(original) END AS a FROM checked),
texts AS (
  SELECT doc_id, n, CASE WHEN a IS NULL THEN original
    ELSE list_transform(range(n), lambda i: original[(CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END) + 1]) END AS words FROM places),
words AS (SELECT doc_id, n, unnest(words) AS word, generate_subscripts(words, 1) - 1 AS i FROM texts),
matches AS (SELECT x.doc_id, y.i - x.i AS lag, x.i FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND 3 * (y.i - x.i) <= x.n),
islands AS (
  SELECT doc_id, lag, min(i) AS start, count(*) AS k FROM (SELECT *, i - row_number() OVER (PARTITION BY doc_id, lag ORDER BY i) AS island FROM matches)
  GROUP BY doc_id, lag, island HAVING count(*) >= greatest(24 - lag, 2 * lag)),
runs AS (SELECT doc_id, start, k + lag AS length, min(lag) AS period FROM islands GROUP BY doc_id, start, k + lag),
dropped AS (SELECT DISTINCT doc_id, unnest(range(start + period, start + length)) AS i FROM runs),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN dropped USING (doc_id, i) GROUP BY doc_id),
best AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY length / period DESC, start, period) = 1),
told AS (SELECT doc_id, count(*) AS n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' ORDER BY start, period) AS lines FROM runs GROUP BY doc_id)
SELECT doc_id, coalesce(n_runs, 0) AS n_runs, start, length, period, 1000 * length // period AS exponent_milli, sha256(coalesce(lines, '')) AS runs_sha256, sha256(coalesce(text, '')) AS collapsed_sha256
FROM texts LEFT JOIN told USING (doc_id) LEFT JOIN best USING (doc_id) LEFT JOIN kept USING (doc_id)""",
    "op13_prefix_trie": f"""
WITH own AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST) AS turns, {crc32_sql("conv_id")} % 9 AS h FROM conversations GROUP BY conv_id),
rebuilt AS (SELECT c.conv_id, list_concat(coalesce(b.turns[1:c.h], []), c.turns[c.h + 1:]) AS turns FROM own c LEFT JOIN own b ON b.conv_id = c.conv_id - c.conv_id % 5),
levels AS (SELECT conv_id, turns, unnest(range(len(turns) + 1)) AS depth FROM rebuilt),
prefixes AS (
  SELECT conv_id, depth, depth = len(turns) AS ends, sha256(CAST(to_json(turns[1:depth]) AS VARCHAR)) AS path, CASE WHEN depth > 0 THEN sha256(CAST(to_json(turns[1:depth - 1]) AS VARCHAR)) END AS above,
         CASE WHEN depth > 0 THEN octet_length(encode(turns[depth].text)) ELSE 0 END AS bytes FROM levels),
nodes AS (
  SELECT path, min(above) AS above, min(depth) AS depth, min(bytes) AS bytes, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM prefixes GROUP BY path),
counted AS (SELECT n.*, (SELECT count(*) FROM nodes c WHERE c.above = n.path) AS n_children FROM nodes n),
below AS (SELECT DISTINCT t.path AS top, s.path FROM prefixes t JOIN prefixes s ON s.conv_id = t.conv_id AND s.depth >= t.depth),
sums AS (SELECT top, count(*) FILTER (n_children = 0) AS n_leaves, CAST(sum((n_convs - 1) * bytes) AS BIGINT) AS saved_tokens FROM below JOIN counted USING (path) GROUP BY top)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, n.ends_sha256
FROM counted n JOIN sums ON sums.top = n.path LEFT JOIN nodes p ON p.path = n.above""",
}
