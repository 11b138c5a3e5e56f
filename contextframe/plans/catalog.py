"""Registered queries of the content-processing operators, with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import paths as p
from ..operators import contentmap, html, inventory as inv
from ..sources.pages import page_items, read_table
from ..streaming import progress as pg
from . import files

INCLUDE = ("**/*.html", "**/*[0-4]")
EXCLUDE = ("**/*th*/**", "!**/*7*")

# ---- SQL fragments shared by several statements

REL_SQL = "regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '')"
EXT_SQL = f"lower(regexp_extract({REL_SQL}, '{p.EXTENSION}', 1))"
TYPE_SQL = "CASE " + EXT_SQL + " " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in p.MEDIA_TYPES.items()) + " END"


def q01_select_include_exclude(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.select_items(page_items(read_table(spark, sf_dir, "pages")), INCLUDE, EXCLUDE).select("list_seq", "relative_path")


def q02_exclude_anti_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = page_items(read_table(spark, sf_dir, "pages"))
    return inv.exclude_items(inv.select_items(items, INCLUDE[:1]), inv.select_items(items, ["**/*th*/**"])).select("list_seq", "relative_path")


def q03_media_type_classify(spark: SparkSession, sf_dir: str) -> DataFrame:
    rel = p.url_path(F.col("url"))
    return read_table(spark, sf_dir, "pages").select("page_id", p.extension(rel).alias("extension"), p.media_type(rel).alias("media_type"))


def q04_content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_table(spark, sf_dir, "documents").select("doc_id", p.content_hash(F.col("text")).alias("content_hash"))


def q05_inventory(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.inventory(page_items(read_table(spark, sf_dir, "pages")))


PATHS = ["a/b.txt", "./a.txt", "././a.txt", "a\\b.txt", "a\\..\\b", "../x", "/abs/x", "a/../b", "", ".", "./", ".\\x", "a/./b", "..a/b", "x/..", "ünïcode/ä.md"]
PATHS_SQL = "(VALUES " + ", ".join(f"({i}, '{x}')" for i, x in enumerate(PATHS)) + ") AS v(id, path)"


def q06_normalize_rel_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(list(enumerate(PATHS)), "id int, path string")
    c = F.col("path")
    out = rows.select("id", p.relative_path_error(c).alias("error"), p.relative_path_error(c, True).alias("manifest_error"), p.relative_path(c).alias("normalized"))
    return out.withColumn("normalized", F.when(F.col("error").isNull(), F.col("normalized")))


def q07_dedup_keep_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("source", "lang", "doc_id", "n_chars")
    return inv.keep_first(docs, ["source", "lang"], "doc_id")


def q07_dedup_on_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select(p.content_hash(F.col("text")).alias("content_hash"), "doc_id")
    return inv.keep_first(docs, ["content_hash"], "doc_id")


def _prior_and_current(spark: SparkSession, sf_dir: str, changed: bool) -> tuple[DataFrame, DataFrame]:
    docs = read_table(spark, sf_dir, "documents").select(
        F.format_string("%012d", "doc_id").alias("relative_path"),
        "doc_id",
        F.col("source"),
        F.col("lang").alias("local_path"),
        F.when(F.col("doc_id") % 3 > 0, F.col("lang")).alias("artifact_path"),
        F.when(F.col("doc_id") % 5 > 0, F.lit("text/plain")).alias("media_type"),
        p.content_hash(F.col("text")).alias("content_hash"),
    )
    if not changed:
        return docs, docs
    prior = docs.where("doc_id % 50 <> 0").withColumn("content_hash", F.when(F.col("doc_id") % 70 == 1, F.lit("old")).otherwise(F.col("content_hash")))
    return prior, docs.where("doc_id % 60 <> 7")


def q08_resume_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    same = inv.resume_verdict(*_prior_and_current(spark, sf_dir, False)).withColumn("case", F.lit("same"))
    return same.union(inv.resume_verdict(*_prior_and_current(spark, sf_dir, True)).withColumn("case", F.lit("changed")))


def q09_resume_item_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inv.compare_items(*_prior_and_current(spark, sf_dir, True))


def q10_manifest_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    rel = F.format_string("%012d.txt", "doc_id")
    items = docs.select(
        "doc_id",
        "source",
        rel.alias("relative_path"),
        F.concat(F.lit("/in/"), rel).alias("local_path"),
        p.media_type(rel).alias("media_type"),
        p.content_hash(F.col("text")).alias("content_hash"),
    )
    return inv.manifest_items(items, F.concat(F.lit("/cache/"), F.col("relative_path")), F.col("doc_id") % 10 == 3)


# One broken item for every rule; rule 15 by order alone; two broken items, of which the first counts.
_GOOD = ("s", "a.txt", "/in/a.txt", "/c/a.txt", "h", True, True, "h")


def _with(**change):
    names = ("source", "relative_path", "local_path", "artifact_path", "content_hash", "exists", "readable", "actual_hash")
    return tuple((dict(zip(names, _GOOD, strict=True)) | change).values())


_SECOND = {"relative_path": "b.txt", "artifact_path": "/c/b.txt"}
MANIFESTS = [
    [_GOOD, _with(**_SECOND)],
    [_GOOD, _with(source=" ")],
    [_GOOD, _with(relative_path="../b.txt")],
    [_GOOD, _with(relative_path="./b.txt")],
    [_with(artifact_path=None), _with(**_SECOND)],
    [_with(artifact_path="/c/x.txt")],
    [_with(artifact_path="/c//./a.txt")],
    [_with(exists=False, readable=False)],
    [_with(readable=False)],
    [_with(actual_hash="x"), _with(source="")],
    [_with(**_SECOND), _GOOD],
    [_GOOD, _GOOD],
]
MANIFEST_ROWS = [(m, pos, *item) for m, items in enumerate(MANIFESTS) for pos, item in enumerate(items)]


def _sql(v) -> str:
    return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, int) else f"'{v}'"


def q11_manifest_validate(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "manifest_id int, pos int, source string, relative_path string, local_path string, artifact_path string, content_hash string, exists boolean, readable boolean, actual_hash string"
    out = inv.validate_items(spark.createDataFrame(MANIFEST_ROWS, schema), F.lit(True), F.lit("/c"))
    return out.select("manifest_id", "n_items", F.coalesce("first_pos", F.lit(-1)).alias("first_pos"), F.coalesce("first_rule", F.lit(0)).alias("first_rule"))


def q12_strict_order_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("source", "lang", "doc_id", F.col("n_chars"))
    return inv.order_violations(docs, ["source", "lang"], "doc_id", "n_chars")


EVENT_KINDS = {"view": pg.ITEM_COMPLETED, "signup": pg.STARTED, "error": pg.ITEM_FAILED, "click": pg.ITEM_SKIPPED, "purchase": pg.COMPLETED}


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = F.create_map(*(F.lit(x) for pair in EVENT_KINDS.items() for x in pair))
    return read_table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_id").alias("seq"), F.try_element_at(kinds, "event_type").alias("kind"), F.concat(F.lit("stage"), (F.col("event_id") % 3).cast("string")).alias("stage")
    )


def q13_progress_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.snapshot_of(_events(spark, sf_dir))


def q14_lossy_channel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pg.lossy_channel(_events(spark, sf_dir)).select("run_id", "seq", "slot")


REQUEST_NAMES = "fetch sanitize ai_augment content_map is_website same_host_only source_exists cache_exists manifest_exists max_concurrency augment_provider augment_model map_provider map_model".split()
_REQUEST = dict(zip(REQUEST_NAMES, (True, False, False, False, False, False, True, False, False, 8, "p", "m", "p", "m"), strict=True))
REQUESTS = [
    {},
    {"fetch": False},
    {"fetch": False, "max_concurrency": 0},
    {"max_concurrency": -1},
    {"max_concurrency": 0, "is_website": True},
    {"is_website": True},
    {"is_website": True, "same_host_only": True},
    {"source_exists": False},
    {"source_exists": False, "ai_augment": True, "augment_provider": ""},
    {"ai_augment": True, "augment_model": " \t"},
    {"ai_augment": True, "content_map": True, "map_model": ""},
    {"content_map": True, "map_provider": "  "},
    {"fetch": False, "sanitize": True},
    {"fetch": False, "sanitize": True, "is_website": True},
    {"fetch": False, "sanitize": True, "is_website": True, "cache_exists": True},
    {"fetch": False, "sanitize": True, "manifest_exists": True},
    {"fetch": False, "ai_augment": True, "augment_provider": ""},
]
REQUEST_ROWS = [(i, *(_REQUEST | r).values()) for i, r in enumerate(REQUESTS)]


def q15_request_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    kinds = ["boolean"] * 9 + ["int"] + ["string"] * 4
    schema = "request_id int, " + ", ".join(f"{n} {k}" for n, k in zip(REQUEST_NAMES, kinds, strict=True))
    return spark.createDataFrame(REQUEST_ROWS, schema).select("request_id", inv.request_error().alias("error"))


def q16_stage_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("n_chars") % 11 == 0, "failed").when(F.col("n_chars") % 3 == 0, "skipped").otherwise("completed")
    return inv.outcome_counts(read_table(spark, sf_dir, "documents").select("source", "lang", status.alias("status")), ["source", "lang"])


def q17_source_identity(spark: SparkSession, sf_dir: str) -> DataFrame:
    windows = F.replace(F.col("url"), F.lit("/"), F.lit("\\"))
    return read_table(spark, sf_dir, "pages").select("page_id", p.slashes(windows).alias("identity"))


OUTPUTS = [(i, m, s, c) for i, (m, s, c) in enumerate((m, s, c) for m in (True, False) for s in (True, False) for c in (True, False))]


def q18_output_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.createDataFrame(OUTPUTS, "id int, manifest_exists boolean, map_selected boolean, map_exists boolean")
    made = lambda condition, name: F.when(condition, F.lit(name))
    return rows.select(
        "id",
        made(F.col("manifest_exists"), "manifest.json").alias("manifest_path"),
        made(F.col("map_selected") & F.col("map_exists"), "content-map.json").alias("content_map_path"),
    )


def q19_slim_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    slim = html.slim_html(F.col("html"))
    return read_table(spark, sf_dir, "pages").select("page_id", F.length(slim).cast("long").alias("n_chars"), p.content_hash(slim).alias("content_hash"))


def q20_html_to_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.html_to_markdown(read_table(spark, sf_dir, "pages"))


def q21_extract_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.links(read_table(spark, sf_dir, "pages")).select("page_id", "position", "href")


def q22_same_host(spark: SparkSession, sf_dir: str) -> DataFrame:
    links = html.links(read_table(spark, sf_dir, "pages"))
    same = html.host(html.resolve(F.col("url"), F.col("href"))) == html.host(F.col("url"))
    return links.groupBy(html.host(F.col("url")).alias("host")).agg(F.count(F.lit(1)).alias("n_links"), F.count_if(same).alias("n_same_host"))


# A literal graph: a chain, a cycle, a diamond and a part that no seed reaches.
GRAPH = [("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("d", "e"), ("a", "f"), ("f", "e"), ("e", "g"), ("g", "h"), ("x", "y")]


def q23_crawl_frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = spark.createDataFrame(GRAPH, "src string, dst string")
    return html.crawl(edges, spark.createDataFrame([("a",)], "url string"), 3)


def q23_crawl_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    links = html.links(pages)
    edges = links.select(F.col("url").alias("src"), html.resolve(F.col("url"), F.col("href")).alias("dst")).distinct()
    return html.crawl(edges, pages.select("url"), 2).groupBy("depth").agg(F.count(F.lit(1)).alias("n_urls"))


def q24_folder_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.folder_rollup(read_table(spark, sf_dir, "pages"))


def q25_file_map_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    items = docs.select(F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt"))).alias("relative_path"), "text")
    out = contentmap.file_map(items, contentmap.StubProvider())
    return out.withColumns({c: F.array_join(c, " ") for c in ("public_types", "public_functions", "topics")})


QUERIES = {name: f for name, f in sorted(globals().items()) if name.startswith("q") and name[1:3].isdigit()} | files.QUERIES

_KINDS_SQL = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in EVENT_KINDS.items()) + " END"
_EVENTS_SQL = f"SELECT user_id AS run_id, event_id AS seq, {_KINDS_SQL} AS kind, 'stage' || (event_id % 3) AS stage FROM events"
_DOC_ITEMS = """SELECT printf('%012d', doc_id) AS relative_path, doc_id, source, lang AS local_path, CASE WHEN doc_id % 3 > 0 THEN lang END AS artifact_path,
 CASE WHEN doc_id % 5 > 0 THEN 'text/plain' END AS media_type, sha256(text) AS content_hash FROM documents"""
_PRIOR = "SELECT * REPLACE (CASE WHEN doc_id % 70 = 1 THEN 'old' ELSE content_hash END AS content_hash) FROM items WHERE doc_id % 50 <> 0"
_STATUS = """SELECT coalesce(a.relative_path, b.relative_path) AS relative_path, CASE WHEN a.relative_path IS NULL THEN 'added' WHEN b.relative_path IS NULL THEN 'removed'
 WHEN a.source IS NOT DISTINCT FROM b.source AND a.local_path IS NOT DISTINCT FROM b.local_path AND a.artifact_path IS NOT DISTINCT FROM b.artifact_path
 AND a.media_type IS NOT DISTINCT FROM b.media_type AND a.content_hash IS NOT DISTINCT FROM b.content_hash THEN 'unchanged' ELSE 'changed' END AS status
 FROM prior a FULL JOIN cur b ON a.relative_path = b.relative_path"""
_SAME = " AND ".join(f"a.{c} IS NOT DISTINCT FROM b.{c}" for c in ("relative_path", "source", "local_path", "artifact_path", "media_type", "content_hash"))
_ERROR = "CASE WHEN starts_with({0}, '/') OR regexp_matches({0}, '(^|/)[.][.](/|$)') THEN 'not_relative' WHEN {1} IN ('', '.') THEN 'empty' END"
_SLASHED = "replace(path, '\\', '/')"
_NORMAL = f"regexp_replace({_SLASHED}, '^[.]/', '')"
_BLANK = "({0} IS NULL OR trim({0}, ' ' || chr(9)) = '')"
_TIDY = "regexp_replace(regexp_replace(regexp_replace({0}, '/+', '/', 'g'), '/[.]/', '/', 'g'), '(.)/$', '\\1')"
_SLIM = r"""regexp_replace(regexp_replace(html, '(?is)<!--.*?-->|<script[^>]*>.*?</script>|<style[^>]*>.*?</style>|<(?:meta|link|base)[^>]*>|<nav[^>]*>.*?</nav>|<footer[^>]*>.*?</footer>', '', 'g'),
 '[ \t\r\n]+', ' ', 'g')"""
_HOST = "lower(regexp_extract({0}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1))"
_LINKS = f"""SELECT page_id, url, CAST(i - 1 AS INTEGER) AS position, hrefs[i] AS href FROM
 (SELECT page_id, url, hrefs, unnest(range(1, len(hrefs) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)href="([^"]*)"', 1) AS hrefs FROM pages))"""
_TARGET = "regexp_replace(href, '#.*$', '')"
_RESOLVED = f"""CASE WHEN regexp_matches({_TARGET}, '^[A-Za-z][A-Za-z0-9+.-]*:') THEN {_TARGET}
 WHEN starts_with({_TARGET}, '//') THEN regexp_replace(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1), '//$', '') || {_TARGET}
 WHEN starts_with({_TARGET}, '/') THEN regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*://)', 1) || {_HOST.format('url')} || {_TARGET}
 WHEN {_TARGET} = '' THEN regexp_replace(url, '#.*$', '')
 ELSE regexp_replace(regexp_replace(url, '[?#].*$', ''), '(://[^/]*)?/?[^/]*$', '\\1') || '/' || {_TARGET} END"""

ORACLE_SQL: dict[str, str] = files.ORACLE_SQL | {
    "q01_select_include_exclude": f"""SELECT page_id AS list_seq, {REL_SQL} AS relative_path FROM pages WHERE regexp_matches({REL_SQL}, '^([^/]*/)*[^/]*([.]html|[0-4])$')
 AND NOT regexp_matches({REL_SQL}, '^([^/]*/)*[^/]*th[^/]*/.*$') AND NOT regexp_matches({REL_SQL}, '^([^/]*/)*[^/]*7[^/]*$')""",
    "q02_exclude_anti_join": f"""WITH items AS (SELECT page_id AS list_seq, {REL_SQL} AS relative_path FROM pages)
 SELECT * FROM items a WHERE regexp_matches(relative_path, '^([^/]*/)*[^/]*[.]html$') AND NOT EXISTS
 (SELECT 1 FROM items b WHERE b.relative_path = a.relative_path AND regexp_matches(b.relative_path, '^([^/]*/)*[^/]*th[^/]*/.*$'))""",
    "q03_media_type_classify": f"SELECT page_id, {EXT_SQL} AS extension, {TYPE_SQL} AS media_type FROM pages",
    "q04_content_hash": "SELECT doc_id, sha256(text) AS content_hash FROM documents",
    "q05_inventory": f"""SELECT source, relative_path, media_type, content_hash FROM (SELECT url AS source, {REL_SQL} AS relative_path, {TYPE_SQL} AS media_type, sha256(html) AS content_hash,
 row_number() OVER (PARTITION BY {REL_SQL} ORDER BY page_id) AS nth FROM pages) WHERE nth = 1 ORDER BY relative_path""",
    "q06_normalize_rel_path": f"""SELECT id, {_ERROR.format('path', _NORMAL)} AS error, {_ERROR.format(_SLASHED, _NORMAL)} AS manifest_error,
 CASE WHEN {_ERROR.format('path', _NORMAL)} IS NULL THEN {_NORMAL} END AS normalized FROM {PATHS_SQL}""",
    "q07_dedup_keep_first": "SELECT source, lang, doc_id, n_chars FROM (SELECT *, row_number() OVER (PARTITION BY source, lang ORDER BY doc_id) AS nth FROM documents) WHERE nth = 1",
    "q07_dedup_on_hash": "SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id FROM documents GROUP BY 1",
    "q08_resume_verdict": f"""WITH items AS ({_DOC_ITEMS}), numbered AS (SELECT *, row_number() OVER (ORDER BY relative_path) AS pos FROM items),
 old AS (SELECT *, row_number() OVER (ORDER BY relative_path) AS pos FROM ({_PRIOR})), new AS (SELECT *, row_number() OVER (ORDER BY relative_path) AS pos FROM items WHERE doc_id % 60 <> 7)
 SELECT coalesce(bool_and({_SAME}), true) AS reusable, 'changed' AS "case" FROM old a FULL JOIN new b ON a.pos = b.pos
 UNION ALL SELECT coalesce(bool_and({_SAME}), true), 'same' FROM numbered a FULL JOIN numbered b ON a.pos = b.pos""",
    "q09_resume_item_status": f"WITH items AS ({_DOC_ITEMS}), prior AS ({_PRIOR}), cur AS (SELECT * FROM items WHERE doc_id % 60 <> 7) {_STATUS}",
    "q10_manifest_items": """SELECT source, printf('%012d.txt', doc_id) AS relative_path, '/in/' || printf('%012d.txt', doc_id) AS local_path,
 CASE WHEN doc_id % 10 <> 3 THEN '/cache/' || printf('%012d.txt', doc_id) END AS artifact_path, 'text/plain' AS media_type, sha256(text) AS content_hash FROM documents""",
    "q11_manifest_validate": f"""WITH rows AS (SELECT * FROM (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in MANIFEST_ROWS)})
 AS v(manifest_id, pos, source, relative_path, local_path, artifact_path, content_hash, is_there, readable, actual_hash)),
 judged AS (SELECT *, lag(relative_path) OVER (PARTITION BY manifest_id ORDER BY pos) >= relative_path AS falls,
 CASE WHEN {_BLANK.format('source')} OR {_BLANK.format('local_path')} OR {_BLANK.format('content_hash')} THEN 8
 WHEN starts_with(relative_path, '/') OR regexp_matches(relative_path, '(^|/)[.][.](/|$)') OR regexp_replace(relative_path, '^[.]/', '') IN ('', '.') OR starts_with(relative_path, './') THEN 9
 WHEN {_BLANK.format('artifact_path')} THEN 10
 WHEN {_TIDY.format('artifact_path')} <> {_TIDY.format("'/c/' || relative_path")} THEN 11
 WHEN NOT is_there THEN 12 WHEN NOT readable THEN 13 WHEN actual_hash <> content_hash THEN 14 END AS rule FROM rows)
 SELECT manifest_id, count(*) AS n_items, coalesce(min(pos) FILTER (rule IS NOT NULL), -1) AS first_pos,
 coalesce(arg_min(rule, pos) FILTER (rule IS NOT NULL), CASE WHEN bool_or(falls) THEN 15 END, 0) AS first_rule FROM judged GROUP BY manifest_id""",
    "q12_strict_order_check": """SELECT source, lang, count(*) FILTER (before >= n_chars) AS violations, count(*) AS n_items FROM
 (SELECT *, lag(n_chars) OVER (PARTITION BY source, lang ORDER BY doc_id) AS before FROM documents) GROUP BY source, lang""",
    "q13_progress_snapshot": f"""WITH e AS ({_EVENTS_SQL}), s AS (SELECT run_id, arg_max(stage, seq) AS stage, max(seq) AS seq FROM e WHERE kind = '{pg.STARTED}' GROUP BY run_id),
 open AS (SELECT s.run_id, s.stage FROM s WHERE NOT EXISTS (SELECT 1 FROM e WHERE e.run_id = s.run_id AND e.stage = s.stage AND e.kind = '{pg.COMPLETED}' AND e.seq > s.seq)),
 n AS (SELECT run_id, count(*) FILTER (kind = '{pg.ITEM_COMPLETED}') AS n_completed, count(*) FILTER (kind = '{pg.ITEM_SKIPPED}') AS n_skipped,
 count(*) FILTER (kind = '{pg.ITEM_FAILED}') AS n_failed, count(*) AS n_events FROM e GROUP BY run_id)
 SELECT n.run_id, open.stage AS current_stage, n_completed, n_skipped, n_failed, n_events FROM n LEFT JOIN open ON n.run_id = open.run_id""",
    "q14_lossy_channel": f"SELECT run_id, seq, CAST(slot AS INTEGER) AS slot FROM (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY seq) AS slot FROM ({_EVENTS_SQL})) WHERE slot <= 64",
    "q15_request_validation": f"""SELECT request_id, CASE WHEN NOT "fetch" AND NOT (sanitize OR ai_augment OR content_map) THEN 'InvalidConfiguration: no stage is enabled'
 WHEN max_concurrency <= 0 THEN 'InvalidConfiguration: max_concurrency must be over 0'
 WHEN "fetch" AND is_website AND NOT same_host_only THEN 'InvalidConfiguration: fetching a website needs same_host_only'
 WHEN "fetch" AND NOT is_website AND NOT source_exists THEN 'InvalidConfiguration: the source is neither a file nor a directory'
 WHEN ai_augment AND ({_BLANK.format('augment_provider')} OR {_BLANK.format('augment_model')}) THEN 'InvalidConfiguration: AI augment needs a provider and a model'
 WHEN content_map AND ({_BLANK.format('map_provider')} OR {_BLANK.format('map_model')}) THEN 'InvalidConfiguration: the content map needs a provider and a model'
 WHEN NOT "fetch" AND (sanitize OR ai_augment OR content_map) AND NOT cache_exists AND NOT manifest_exists THEN 'MalformedState: there is no prior fetch at the destination'
 WHEN is_website AND NOT "fetch" THEN 'InvalidConfiguration: a website needs the fetch stage'
 WHEN is_website THEN 'Unsupported: websites are not fetched; use the page operators on a table of pages' END AS error
 FROM (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in REQUEST_ROWS)}) AS v(request_id, {", ".join(f'"{n}"' for n in REQUEST_NAMES)})""",
    "q16_stage_outcomes": """SELECT source, lang, count(*) FILTER (status = 'completed') AS n_completed, count(*) FILTER (status = 'skipped') AS n_skipped, count(*) FILTER (status = 'failed') AS n_failed,
 count(*) FILTER (status = 'failed') = 0 AS complete FROM (SELECT source, lang, CASE WHEN n_chars % 11 = 0 THEN 'failed' WHEN n_chars % 3 = 0 THEN 'skipped' ELSE 'completed' END AS status FROM documents) GROUP BY source, lang""",
    "q17_source_identity": "SELECT page_id, replace(replace(url, '/', '\\'), '\\', '/') AS identity FROM pages",
    "q18_output_projection": f"""SELECT id, CASE WHEN manifest_exists THEN 'manifest.json' END AS manifest_path, CASE WHEN map_selected AND map_exists THEN 'content-map.json' END AS content_map_path
 FROM (VALUES {", ".join("(" + ", ".join(map(_sql, r)) + ")" for r in OUTPUTS)}) AS v(id, manifest_exists, map_selected, map_exists)""",
    "q19_slim_html": f"SELECT page_id, length(slim) AS n_chars, sha256(slim) AS content_hash FROM (SELECT page_id, {_SLIM} AS slim FROM pages)",
    "q21_extract_links": f"SELECT page_id, position, href FROM ({_LINKS})",
    "q22_same_host": f"SELECT {_HOST.format('url')} AS host, count(*) AS n_links, count(*) FILTER ({_HOST.format(_RESOLVED)} = {_HOST.format('url')}) AS n_same_host FROM ({_LINKS}) GROUP BY 1",
    "q23_crawl_frontier": f"""WITH RECURSIVE edges(src, dst) AS (VALUES {", ".join(map(str, GRAPH))}), walk(url, depth) AS
 (SELECT 'a', 0 UNION SELECT dst, depth + 1 FROM walk JOIN edges ON url = src WHERE depth < 3) SELECT url, min(depth) AS depth FROM walk GROUP BY url""",
    "q23_crawl_pages": f"""WITH edges AS (SELECT DISTINCT url AS src, {_RESOLVED} AS dst FROM ({_LINKS})), d0 AS (SELECT DISTINCT url FROM pages),
 d1 AS (SELECT DISTINCT dst AS url FROM edges JOIN d0 ON src = url WHERE dst NOT IN (SELECT url FROM d0)),
 d2 AS (SELECT DISTINCT dst AS url FROM edges JOIN d1 ON src = url WHERE dst NOT IN (SELECT url FROM d0 UNION SELECT url FROM d1))
 SELECT * FROM (SELECT 0 AS depth, count(*) AS n_urls FROM d0 UNION ALL SELECT 1, count(*) FROM d1 UNION ALL SELECT 2, count(*) FROM d2) WHERE n_urls > 0""",
    "q25_file_map_stub": f"""SELECT source || '/' || lang || '/' || doc_id || '.txt' AS path, {files.SUMMARY_SQL.format("coalesce(text, '')")} AS summary, 'when reading ' || source || '/' || lang || '/' || doc_id || '.txt' AS when_to_use,
 '' AS public_types, '' AS public_functions, array_to_string({files.TOPICS_SQL.format("coalesce(text, '')")}, ' ') AS topics FROM documents""",
    "q24_folder_rollup": f"""WITH f AS (SELECT regexp_replace({REL_SQL}, '/?[^/]*$', '') AS folder, length(html) AS chars FROM pages), parts AS (SELECT string_split(folder, '/') AS p, chars FROM f WHERE folder <> '')
 SELECT array_to_string(p[1:i], '/') AS folder, count(*) AS n_items, CAST(sum(chars) AS BIGINT) AS n_chars FROM (SELECT p, chars, unnest(range(1, len(p) + 1)) AS i FROM parts) GROUP BY 1""",
}
