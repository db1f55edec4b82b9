"""One query per operator: it applies the operator, with its usual parameters, to its whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.llm import decontamination, drifted, language, licenses, neardup, packing, quality, rewrite, scoring, search, secrets, sharding, substrings, urls
from millrace.llm.common import table
from millrace.plans.storage import shared_folder


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def tokenizer_json() -> str:
    """Read on the driver and sent with the task (under 2 MB), so executors need no such file."""
    with open(tokenizer_path("word_bpe_49k.json"), encoding="utf-8") as f:
        return f.read()


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), tokenizer_json())
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def op2_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(neardup.numbered(table(spark, sf_dir, "documents").select("doc_id", "text")), words=4)
    return found.select("doc_id", F.col("n").alias("n_shingles"), F.col("component").alias("component_id"), F.col("doc_id").eqNullSafe(F.col("component")).alias("kept"))


def held_out(modulus: int):
    """Documents that a model doesn't learn from: crc32 of the id as text, remainder 2."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus)) == 2, F.lit(False))


def op3_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = scoring.vocabulary(tokenizer_path("piece_bpe_32k.model"))
    out = scoring.score(table(spark, sf_dir, "documents"), pieces, ~held_out(7))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per document and license notice found in it."""
    return licenses.scan(table(spark, sf_dir, "documents"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents"))
    count = lambda rank: F.size(F.filter("base", lambda s: s["rank"] == rank)).cast("long")
    own = F.sha2(secrets.named(F.col("base")).cast("binary"), 256)
    every = secrets.named(F.array_sort(F.concat("base", "more")))
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), own.alias("base_sha256"), every.alias("spans"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    filters = language.learn(docs, ~held_out(4))
    return language.identify(docs, filters).select("doc_id", held_out(4).alias("held_out"), "lang_pred", "score")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hit_words", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["first"])
    names = F.array_join(F.array_sort(F.transform("items", lambda x: x.cast("string"))), ",")
    return hits.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "anomaly")


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per span that stands before, in a document of a smaller id or further up in its own."""
    return substrings.spans(table(spark, sf_dir, "documents")).drop("copy")


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.shards(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


#: Host, path, verdict.
URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def op11_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return urls.judge(table(spark, sf_dir, "pages"), rules).select("page_id", "host", "path", "rule", "verdict", "by")


def op12_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


#: The evolved schema: the table's columns in order, with field ids from 1; nation_id is a long.
CLIENT_COLUMNS = ["client_id", "master_id", "source", "updated_at", "name", "email", "city", "nation_id", "segment", "balance"]
FILLS = {"nation_id": -1, "source": "none"}


def op13_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per final file; the files are in a new folder under spark.checkpoint.dir, and stay there."""
    clients = table(spark, sf_dir, "clients").select(*CLIENT_COLUMNS).withColumn("nation_id", F.col("nation_id").cast("long"))
    kinds = to_arrow_schema(clients.schema)
    target = [rewrite.Column(name, kinds.field(name).type, i, FILLS.get(name)) for i, name in enumerate(CLIENT_COLUMNS, 1)]
    root = f"{shared_folder(spark)}/rewrite-{uuid.uuid4().hex}"
    files = drifted.write_files(drifted.numbered(clients), target, f"{root}/files", f"{root}/attempts")
    done = rewrite.rewrite(files, target, f"{root}/attempts")
    out = files.join(done, files["path"] == done["source_path"]).drop(files["path"])
    return out.select("file_no", "version", "n_rows", "n_nulls", "ids_sha256", "rows_sha256", "start_columns", "columns", "path", "rewritten")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_packing": op1_packing,
    "op2_neardup": op2_neardup,
    "op3_scoring": op3_scoring,
    "op4_licenses": op4_licenses,
    "op5_secrets": op5_secrets,
    "op6_language": op6_language,
    "op7_decontamination": op7_decontamination,
    "op8_quality": op8_quality,
    "op9_substrings": op9_substrings,
    "op10_sharding": op10_sharding,
    "op11_urls": op11_urls,
    "op12_search": op12_search,
    "op13_rewrite": op13_rewrite,
}

_OP7_SQL = r"""
WITH doc AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), item AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM item, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), size AS (
  SELECT DISTINCT n FROM win
), hit AS (
  SELECT d.doc_id, d.i, d.n, win.item_id
  FROM (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS g FROM doc, size, unnest(generate_series(1, len(w) - n + 1)) AS t(i)) d
  JOIN win ON win.n = d.n AND win.g = d.g
), inside AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_hit FROM hit, unnest(generate_series(0, n - 1)) AS t(k) GROUP BY doc_id
), named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS names FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS x FROM hit) GROUP BY doc_id
)
SELECT doc.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN inside USING (doc_id) LEFT JOIN named USING (doc_id)
"""

_OP2_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(4, len(w)) - 1], ' ') AS g FROM d, unnest(generate_series(1, len(w) - least(4, len(w)) + 1)) AS t(i) WHERE len(w) > 0
), n AS (
  SELECT doc_id, count(*) AS n FROM s GROUP BY 1
), p AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), l AS (
  SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 80 * (x.n + y.n - i)
), e AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT doc_id AS node, doc_id AS c FROM d UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.node
), m AS (
  SELECT node, min(c) AS c FROM r GROUP BY 1
)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, m.c AS component_id, d.doc_id = m.c AS kept FROM d LEFT JOIN n USING (doc_id) JOIN m ON m.node = d.doc_id
"""

_OP11_SQL = r"""
WITH RECURSIVE page AS (
  SELECT page_id, url, coalesce(html, '') AS html, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages
), own AS (
  SELECT page_id, url, translate(regexp_extract(rest, '^([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^([^/?#]*)([^?#]*)', 2) AS path FROM page
), tag AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script|<style\b.*?</style', '', 'g'), '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM page WHERE html LIKE '%canonical%' OR html LIKE '%refresh%'
), link AS (
  SELECT url AS a, regexp_extract(t, '(?i)href="(https?://[^"]*)"', 1) AS b FROM tag WHERE regexp_matches(t, '(?i)^<link\b.*rel="canonical"')
  UNION SELECT url, regexp_extract(t, '(?i)content="[0-9]+; *url=(https?://[^"]*)"', 1) FROM tag WHERE regexp_matches(t, '(?i)^<meta\b.*http-equiv="refresh"')
), e AS (
  SELECT a, b FROM link WHERE b <> '' UNION SELECT b, a FROM link WHERE b <> ''
), r AS (
  SELECT DISTINCT a AS u, a AS v FROM e UNION SELECT r.u, e.b FROM r JOIN e ON e.a = r.v
), rules AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS t(rh, rp, verdict)
), fit AS (
  SELECT host, path, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(verdict, length(rh || rp)) AS verdict
  FROM (SELECT DISTINCT host, path FROM (SELECT host, path FROM own UNION ALL SELECT regexp_extract(v, '://([^/?#]*)([^?#]*)', 1), regexp_extract(v, '://([^/?#]*)([^?#]*)', 2) FROM r)), rules
  WHERE (host = rh OR host LIKE '%.' || rh) AND starts_with(path, rp) GROUP BY 1, 2
), reached AS (
  SELECT u, CASE WHEN bool_or(verdict = 'allow') THEN 'allow' ELSE 'block' END AS verdict
  FROM r JOIN fit ON host = regexp_extract(v, '://([^/?#]*)([^?#]*)', 1) AND path = regexp_extract(v, '://([^/?#]*)([^?#]*)', 2) GROUP BY 1
)
SELECT page_id, host, path, rule, coalesce(fit.verdict, reached.verdict, 'allow') AS verdict, CASE WHEN fit.verdict IS NOT NULL THEN 'rule' WHEN reached.verdict IS NOT NULL THEN 'alias' ELSE 'default' END AS by
FROM own LEFT JOIN fit USING (host, path) LEFT JOIN reached ON u = url
"""

_OP12_SQL = r"""
WITH doc AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM documents WHERE text IS NOT NULL
), item AS (
  SELECT row_number() OVER () AS q, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
  FROM (SELECT DISTINCT item_id, text FROM benchmark WHERE text IS NOT NULL)
), wanted AS (
  SELECT q, item_id, t, count(*) AS reps FROM (SELECT q, item_id, unnest(w) AS t FROM item) GROUP BY ALL
), total AS (
  SELECT count(*) AS nd, CAST(sum(len(w)) AS BIGINT) AS nt FROM doc WHERE len(w) > 0
), posting AS (
  SELECT r, doc_id, n, t, count(*) AS tf FROM (SELECT r, doc_id, CAST(len(w) AS BIGINT) AS n, unnest(w) AS t FROM doc) WHERE t IN (SELECT t FROM wanted) GROUP BY ALL
), weight AS (
  SELECT t, CAST(floor(1000 * ln((2 * nd + 2) / (2 * count(*) + 1))) AS BIGINT) AS w FROM posting, total GROUP BY t, nd
), scored AS (
  SELECT q, item_id, r, doc_id, CAST(sum(reps * w * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * n * nd) // nt)))) AS BIGINT) AS score
  FROM wanted JOIN weight USING (t) JOIN posting USING (t), total GROUP BY ALL
)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE score > 0) WHERE rank <= 10
"""

ORACLE_SQL: dict[str, str] = {"op2_neardup": _OP2_SQL, "op7_decontamination": _OP7_SQL, "op11_urls": _OP11_SQL, "op12_search": _OP12_SQL}
