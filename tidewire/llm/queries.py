"""Registered queries of the corpus operators: QUERIES name -> (spark, sf_dir) -> DataFrame, ORACLES name -> DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewire.llm import bpe, html_extract, line_dedup, ngram_join, packing, periodic, projections, quality, sharding, substring, topk, turns, url_filter
from tidewire.llm.common import read_table


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(read_table(spark, sf_dir, "documents"), n_shards=24)


def op4_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS c FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, x.vec_id, CAST(list_inner_product(q.c, x.c) AS BIGINT) AS score
      FROM v q JOIN v x ON q.vec_id % 20 = 0 AND x.vec_id <> q.vec_id),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def vocabulary() -> str:
    """Path of the vocabulary file that the contracts of encoding and packing name."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digest(read_table(spark, sf_dir, "documents"), vocabulary())


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), vocabulary())


def captures_and_entries(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The pages as dated captures, and a dated block list over their hosts (the tables hold neither dates nor a list).

    A capture of page_id p is of day (p * 37) mod 366 of 2024. A host is listed, taken off and listed again, and its
    section /de is listed, on days that a hash of its name gives; example.org as a whole is listed for the last weeks.
    """
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.pmod(F.col("page_id") * 37, F.lit(366)).cast("int"))
    captures = read_table(spark, sf_dir, "pages").select("page_id", "url", day.alias("fetched"))
    hosts = captures.select(url_filter.host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumn("h", F.conv(F.substring(F.md5("host"), 1, 6), 16, 10).cast("long"))

    def dated(when: str, key: str, action: str, at: str) -> DataFrame:
        return hosts.where(when).select(F.expr(key).alias("key"), F.lit(action).alias("action"), F.expr(f"date_add(date'2024-01-01', cast({at} as int))").alias("at"))

    entries = (
        dated("h % 3 = 0", "host", "add", "h % 200")
        .unionByName(dated("h % 3 = 0", "host", "remove", "h % 200 + 30 + h % 90"))
        .unionByName(dated("h % 6 = 0", "host", "add", "300 + h % 50"))
        .unionByName(dated("h % 5 = 1", "concat(host, '/de')", "add", "h % 366"))
        .unionByName(spark.createDataFrame([("example.org", "add", 340)], "key string, action string, d int").selectExpr("key", "action", "date_add(date'2024-01-01', d) as at"))
    )
    return captures, entries


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_captures(*captures_and_entries(spark, sf_dir)).withColumn("fetched", F.col("fetched").cast("string"))


URL_SQL = r"""
WITH c AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST((page_id * 37) % 366 AS INTEGER) AS DATE) AS fetched,
                  nullif(regexp_replace(regexp_extract(lower(url), '^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)', 1), '\.$', ''), '') AS host,
                  regexp_extract(url, '^[^:]+://[^/?#]*/([^/?#]+)', 1) AS seg FROM pages),
h AS (SELECT host, CAST(('0x' || substr(md5(host), 1, 6)) AS BIGINT) AS h FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)),
e AS (SELECT host AS key, 'add' AS action, h % 200 AS d FROM h WHERE h % 3 = 0 UNION ALL SELECT host, 'remove', h % 200 + 30 + h % 90 FROM h WHERE h % 3 = 0
      UNION ALL SELECT host, 'add', 300 + h % 50 FROM h WHERE h % 6 = 0 UNION ALL SELECT host || '/de', 'add', h % 366 FROM h WHERE h % 5 = 1
      UNION ALL SELECT 'example.org', 'add', 340),
l AS (SELECT key, d, max(action) AS action FROM e GROUP BY key, d),
i AS (SELECT key, action, d AS since, lead(d) OVER (PARTITION BY key ORDER BY d) AS until FROM l),
m AS (SELECT c.page_id, c.url, c.fetched, i.key FROM c JOIN i ON (i.key = c.host OR i.key = c.host || '/' || c.seg OR (c.host LIKE '%.' || i.key AND i.key LIKE '%.%'))
      AND i.action = 'add' AND date_diff('day', DATE '2024-01-01', c.fetched) >= i.since AND (i.until IS NULL OR date_diff('day', DATE '2024-01-01', c.fetched) < i.until)),
b AS (SELECT page_id, url, max(key) AS key FROM (SELECT *, length(key) = max(length(key)) OVER (PARTITION BY page_id, url) AS longest FROM m) WHERE longest GROUP BY ALL)
SELECT c.page_id, c.url, CAST(c.fetched AS VARCHAR) AS fetched, b.key AS matched_key, b.key IS NULL AS kept FROM c LEFT JOIN b ON b.page_id = c.page_id AND b.url = c.url
"""


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    return html_extract.extract(pages, html_extract.train(pages))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read_table(spark, sf_dir, "labels")))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.similar_components(read_table(spark, sf_dir, "documents"))


NGRAM_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                       '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i + 1:i + 5], ' ') AS g
      FROM (SELECT doc_id, ws, unnest(range(0, greatest(1, len(ws) - 4))) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS o FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT a, b FROM o JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * o >= 80 * (na.n + nb.n - o)),
r AS (SELECT doc_id AS node, doc_id AS seen FROM documents UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.seen),
c AS (SELECT node, min(seen) AS component_id FROM r GROUP BY node)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM documents d JOIN c ON c.node = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return line_dedup.drop_repeated_lines(docs).select("doc_id", "n_removed_lines", F.sha2(F.encode("text", "UTF-8"), 256).alias("text_sha256"))


LINE_DEDUP_SQL = """
WITH split AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS line FROM split),
w AS (SELECT doc_id, pos, line AS a, lead(line, 1) OVER d AS b, lead(line, 2) OVER d AS c FROM l WINDOW d AS (PARTITION BY doc_id ORDER BY pos)),
r AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, pos) AS nth FROM w WHERE c IS NOT NULL),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM r, (VALUES (0), (1), (2)) v(k) WHERE nth > 1),
kept AS (SELECT l.doc_id, count(g.pos) AS n, coalesce(string_agg(CASE WHEN g.pos IS NULL THEN line END, chr(10) ORDER BY l.pos), '') AS text
         FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.pos = g.pos GROUP BY l.doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_removed_lines, sha256(k.text) AS text_sha256 FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.removal_digest(read_table(spark, sf_dir, "documents"))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
win AS (SELECT doc_id, unnest(range(0, greatest(0, len(ws) - 12))) AS pos, ws FROM w WHERE len(ws) >= 13),
keyed AS (SELECT doc_id, pos, array_to_string(ws[pos + 1:pos + 13], ' ') AS key FROM win),
again AS (SELECT doc_id, pos FROM (SELECT doc_id, pos, min(doc_id) OVER (PARTITION BY key) AS low FROM keyed) WHERE low < doc_id),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM again, range(0, 13) r(k)),
each AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word FROM w),
kept AS (SELECT e.doc_id, count(*) AS n, count(g.pos) AS gone, string_agg(CASE WHEN g.pos IS NULL THEN word END, ' ' ORDER BY e.pos) AS text
         FROM each e LEFT JOIN gone g ON e.doc_id = g.doc_id AND e.pos = g.pos GROUP BY e.doc_id)
SELECT d.doc_id, coalesce(k.n, 0) AS n_words, coalesce(k.gone, 0) AS n_removed, sha256(coalesce(k.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept k ON d.doc_id = k.doc_id
"""


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.run_digest(periodic.repeat_tails(read_table(spark, sf_dir, "documents")))


def op12_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return projections.neighbours(read_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.repair_digest(read_table(spark, sf_dir, "conversations"))


def _repair_sql() -> str:
    """The same programme as a recursion from the last row to the first, with (cost, audit, lines) of each state as structs."""

    def least(*options: str) -> str:
        return f"list_sort(list_filter([{', '.join(options)}], lambda x: x IS NOT NULL))[1]"

    def edit(letter: str, cost: str, to: str, line: str | None = None, when: str | None = None) -> str:
        lines = f"{to}.l" if line is None else f"[{line}] || {to}.l"
        made = f"{{'c': {to}.c + {cost}, 'a': '{letter}' || {to}.a, 'l': {lines}}}"
        return f"CASE WHEN {when} THEN {made} END" if when else made

    own, rerole = "role || ':' || text", "(2 + broken)"
    keep = {0: [("s", "v1"), ("u", "v2")], 1: [("u", "v2")], 2: [("a", "v3")], 3: [("u", "v2")]}
    rows = ",\n       ".join(
        least(
            edit("D", "3", f"v{s}"),
            *(edit("K", "broken", to, own, f"NOT gone AND initial = '{i}'") for i, to in keep[s]),
            edit("R", rerole, "v3" if s == 2 else "v2", f"'{'assistant' if s == 2 else 'user'}:' || text", "NOT gone"),
        ) + f" AS e{s}"
        for s in range(4)
    )
    user, assistant = "'user:'", "'assistant:'"
    return rf"""
WITH RECURSIVE named AS (SELECT *, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS name FROM conversations),
hashed AS (SELECT *, xor(4294967295, list_reduce([4294967295::BIGINT] || range(8 * length(name)), lambda c, i:
  xor(CASE WHEN i % 8 = 0 THEN xor(c, ascii(name[i // 8 + 1])::BIGINT) ELSE c END >> 1,
      3988292384 * (CASE WHEN i % 8 = 0 THEN xor(c, ascii(name[i // 8 + 1])::BIGINT) ELSE c END & 1)))) % 20 AS h FROM named),
damaged AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, unnest(range(CASE WHEN h = 3 THEN 2 ELSE 1 END)) AS copy,
                   CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text FROM hashed WHERE h <> 0),
placed AS (SELECT *, coalesce(left(role, 1), '') AS initial, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, sha256(text) NULLS FIRST) AS pos,
                  right(rtrim(coalesce(text, ''), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 1) AS last FROM damaged),
judged AS (SELECT *, last = '' AS blank, last <> '' AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
                  coalesce(lag(initial) OVER (PARTITION BY conv_id ORDER BY pos) || initial NOT IN ('su', 'ua', 'au'), false) AS illegal FROM placed),
faults AS (SELECT *, blank OR again AS gone, CAST(NOT blank AND NOT again AND last NOT IN ('.', '!', '?') AS BIGINT) AS broken FROM judged),
figures AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (again) AS duplicate,
                   CAST(sum(broken) AS BIGINT) AS truncated, count(*) FILTER (illegal) AS illegal, max(pos) AS n FROM faults GROUP BY conv_id),
v AS (SELECT conv_id, n + 1 AS pos, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS v0, {{'c': 4::BIGINT, 'a': 'II', 'l': ['user:', 'assistant:']}} AS v1,
             {{'c': 2::BIGINT, 'a': 'I', 'l': ['assistant:']}} AS v2, {{'c': 0::BIGINT, 'a': '', 'l': []::VARCHAR[]}} AS v3 FROM figures
      UNION ALL
      SELECT conv_id, pos, {least("e0", edit("I", "2", "w2", user))} AS v0, {least("e1", edit("I", "2", "w2", user))} AS v1, w2 AS v2, w3 AS v3 FROM (
      SELECT *, {least("e2", edit("I", "2", "e3", assistant))} AS w2, {least("e3", edit("I", "2", "e2", user))} AS w3 FROM (
      SELECT v.conv_id, f.pos, {rows}
      FROM v JOIN faults f ON f.conv_id IS NOT DISTINCT FROM v.conv_id AND f.pos = v.pos - 1)))
SELECT i.conv_id, coalesce(f.gaps, 0) AS gaps, coalesce(f.blank, 0) AS blank, coalesce(f.duplicate, 0) AS duplicate, coalesce(f.truncated, 0) AS truncated,
       coalesce(f.illegal, 0) AS illegal, coalesce(v0.c, 0) AS cost, coalesce(v0.a, '') AS audit, sha256(coalesce(array_to_string(v0.l, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN figures f ON f.conv_id IS NOT DISTINCT FROM i.conv_id
LEFT JOIN v ON v.conv_id IS NOT DISTINCT FROM i.conv_id AND v.pos = 1
"""


REPAIR_SQL = _repair_sql()


QUERIES = {
    "op1_sharding": op1_sharding,
    "op2_ngram_join": op2_ngram_join,
    "op3_line_dedup": op3_line_dedup,
    "op4_topk": op4_topk,
    "op5_bpe": op5_bpe,
    "op6_packing": op6_packing,
    "op7_url_filter": op7_url_filter,
    "op8_quality_rules": op8_quality_rules,
    "op9_substring_dedup": op9_substring_dedup,
    "op10_html_extraction": op10_html_extraction,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_neighbours": op12_neighbours,
    "op13_turn_repair": op13_turn_repair,
}
ORACLES: dict[str, str] = {"op2_ngram_join": NGRAM_SQL, "op3_line_dedup": LINE_DEDUP_SQL, "op4_topk": TOPK_SQL, "op7_url_filter": URL_SQL, "op9_substring_dedup": SUBSTRING_SQL, "op13_turn_repair": REPAIR_SQL}
