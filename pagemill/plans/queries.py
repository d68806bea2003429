"""One query for each operator, over the driver's tables, with its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions import regex as X
from pagemill.functions import scalars as S
from pagemill.operators import admission, evaluate, extract, features, judge, parts, store
from pagemill.sources import tables
from pagemill.sources.specs import Attribute, Entity, Feature, FeatureRule, Rule

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tables.parquet(spark, sf_dir, name)


# -- relations that stand for the store's tables

SNAPSHOT_SQL = """snap AS (
  SELECT page_id AS id, url, CASE WHEN page_id % 3 = 1 THEN md5(html) ELSE 'old' END AS content_hash,
         CAST(page_id % 4 - 1 AS INTEGER) AS is_target, md5(split_part(url, '/', 4)) AS layout_hash FROM pages WHERE page_id % 3 <> 0)"""
RESPONSES_SQL = """resp AS (
  SELECT page_id, url, CAST(CASE WHEN page_id % 17 = 0 THEN 404 ELSE 200 END AS INTEGER) AS status,
         CASE WHEN page_id % 29 = 5 THEN 'application/pdf' WHEN page_id % 29 = 6 THEN NULL ELSE 'text/html; charset=utf-8' END AS content_type,
         html AS body FROM pages)"""
ACTION_SQL = f"""{SNAPSHOT_SQL}, {RESPONSES_SQL}, why AS (
  SELECT *, CASE WHEN length(url) > 60 THEN 'url_too_long'
    WHEN content_type IS NULL OR split_part(content_type, ';', 1) <> 'text/html' THEN 'content_type'
    WHEN contains(url, 'ref=x') THEN 'denied_domain' END AS w FROM resp), acted AS (
  SELECT r.page_id, r.url, s.id AS known_id, CASE WHEN w IS NOT NULL THEN w
    WHEN r.status = 404 AND s.id IS NOT NULL THEN 'gone' WHEN r.status = 404 THEN 'missing'
    WHEN s.id IS NULL THEN 'new' WHEN md5(r.body) = s.content_hash THEN 'unchanged' ELSE 'changed' END AS action
  FROM why r LEFT JOIN snap s ON r.url = s.url AND r.w IS NULL)"""
POLICY = admission.Policy(max_url=60, deny_domains=("ref=x",))


def snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    return read(spark, sf_dir, "pages").filter(i % 3 != 0).select(
        i.alias("id"), "url", F.when(i % 3 == 1, S.text_hash(F.col("html"))).otherwise("old").alias("content_hash"),
        (i % 4 - 1).cast("int").alias("is_target"), F.md5(F.split_part("url", F.lit("/"), F.lit(4)).cast("binary")).alias("layout_hash"),
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    kind = F.when(i % 29 == 5, "application/pdf").when(i % 29 == 6, F.lit(None)).otherwise("text/html; charset=utf-8")
    return read(spark, sf_dir, "pages").select("page_id", "url", F.when(i % 17 == 0, 404).otherwise(200).alias("status"), kind.alias("content_type"), F.col("html").alias("body"))


def decided(spark: SparkSession, sf_dir: str) -> DataFrame:
    """labels as url_lib: toxic is no, quality 1 single, the rest unknown."""
    d = F.when(F.col("toxic") == 1, -1).when(F.col("quality") == 1, 1).otherwise(0)
    return read(spark, sf_dir, "labels").select(F.col("doc_id").alias("id"), d.alias("is_target"))


DECIDED_SQL = "dec AS (SELECT doc_id AS id, CASE WHEN toxic = 1 THEN -1 WHEN quality = 1 THEN 1 ELSE 0 END AS is_target FROM labels)"


# -- relational reads and writes


@query("SELECT url FROM pages")
def url_projection(spark, sf_dir):
    return store.all_urls(read(spark, sf_dir, "pages"))


@query(f"WITH {DECIDED_SQL} SELECT id FROM dec WHERE is_target <> 0")
def known_ids(spark, sf_dir):
    return store.known(decided(spark, sf_dir))


@query(f"WITH {DECIDED_SQL} SELECT id FROM dec WHERE is_target IN (0, -1)")
def non_targets(spark, sf_dir):
    return store.non_targets(decided(spark, sf_dir))


@query(f"WITH {DECIDED_SQL} SELECT id FROM dec WHERE is_target IN (1, 2)")
def targets(spark, sf_dir):
    return store.targets(decided(spark, sf_dir))


@query("SELECT page_id AS id, url FROM pages WHERE page_id = 7")
def lookup_id(spark, sf_dir):
    return store.by_id(read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"), 7)


@query("SELECT page_id, url FROM pages WHERE url = 'http://ththre.example.com/fr/825?page=2&ref=x'")
def lookup_url(spark, sf_dir):
    return store.by_url(read(spark, sf_dir, "pages").select("page_id", "url"), "http://ththre.example.com/fr/825?page=2&ref=x")


@query(f"WITH {RESPONSES_SQL} SELECT page_id, url FROM pages WHERE url IN (SELECT url FROM resp WHERE status = 404)")
def lookup_batch(spark, sf_dir):
    return store.lookup(read(spark, sf_dir, "pages").select("page_id", "url"), responses(spark, sf_dir).filter("status = 404"))


@query(f"WITH {SNAPSHOT_SQL}, {RESPONSES_SQL} SELECT page_id, url, status FROM resp WHERE url IN (SELECT url FROM snap WHERE is_target IN (1, 2))")
def revisit_targets(spark, sf_dir):
    return store.revisits(snapshot(spark, sf_dir), responses(spark, sf_dir).select("page_id", "url", "status"))


@query(f"WITH {ACTION_SQL} SELECT id, url FROM snap WHERE id NOT IN (SELECT known_id FROM acted WHERE action IN ('gone', 'changed') AND known_id IS NOT NULL)")
def delete_changed(spark, sf_dir):
    acted = admission.crawl_action(responses(spark, sf_dir), snapshot(spark, sf_dir), POLICY)
    gone = acted.filter(F.col("action").isin("gone", "changed")).select("known_id")
    return store.without(snapshot(spark, sf_dir).select("id", "url"), gone, "id")


@query(f"""WITH {SNAPSHOT_SQL}, fresh AS (SELECT page_id AS id, url, md5(html) AS content_hash FROM pages WHERE page_id % 5 = 0)
  SELECT id, url, content_hash FROM snap WHERE id NOT IN (SELECT id FROM fresh) UNION ALL SELECT id, url, content_hash FROM fresh""")
def upsert_pages(spark, sf_dir):
    fresh = read(spark, sf_dir, "pages").filter("page_id % 5 = 0").select(F.col("page_id").alias("id"), "url", S.text_hash(F.col("html")).alias("content_hash"))
    return store.upserted(snapshot(spark, sf_dir).select("id", "url", "content_hash"), fresh)


@query(f"""WITH {SNAPSHOT_SQL} SELECT (SELECT max(id) FROM snap) + row_number() OVER (ORDER BY md5(url), url) AS id, url, CAST(0 AS INTEGER) AS is_target,
  '' AS content_hash, '' AS layout_hash, '[-1]' AS extractor FROM (SELECT DISTINCT url FROM pages WHERE url NOT IN (SELECT url FROM snap))""")
def insert_stubs(spark, sf_dir):
    old = snapshot(spark, sf_dir)
    largest = old.agg(F.max("id")).first()[0] or 0
    new = store.stubs(read(spark, sf_dir, "pages").join(old.select("url"), "url", "left_anti"), largest)
    return new.select("id", "url", "is_target", "content_hash", "layout_hash", S.from_extractor(F.col("extractor")).alias("extractor"))


@query(f"WITH {SNAPSHOT_SQL} SELECT id, CASE WHEN id % 6 = 1 THEN TIMESTAMP '2024-01-01 00:00:00' END AS last_access_ts FROM snap")
def touch_access(spark, sf_dir):
    table = snapshot(spark, sf_dir).select("id", F.lit(None).cast("timestamp_ntz").alias("last_access_ts"))
    return store.touched(table, table.filter("id % 6 = 1"), "last_access_ts", F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))


@query("SELECT url FROM pages WHERE false")
def reset_tables(spark, sf_dir):
    own = store.Store(spark, tables.scratch(spark, "store"))
    own.reset()
    return store.all_urls(own.read("url_lib"))


@query("SELECT o_orderkey, o_orderdate, c_name FROM orders JOIN customer ON o_custkey = c_custkey")
def result_join_orders(spark, sf_dir):
    orders, customer = read(spark, sf_dir, "orders"), read(spark, sf_dir, "customer")
    found = store.results(orders.select(F.col("o_custkey").alias("url_id"), "o_orderkey", "o_orderdate"), customer.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("url")))
    return found.select("o_orderkey", "o_orderdate", F.col("url").alias("c_name"))


@query("SELECT page_id * 10 AS id, page_id AS url_id, coalesce(CASE WHEN page_id % 2 = 0 THEN 'A' END, '') AS title, url FROM pages WHERE page_id % 4 < 3")
def result_join(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    made = store.record({"title": F.when(F.col("page_id") % 2 == 0, "A")})
    sem = pages.filter("page_id % 4 < 3").select((F.col("page_id") * 10).alias("id"), F.col("page_id").alias("url_id"), *made)
    return store.results(sem, pages.select(F.col("page_id").alias("id"), "url"))


# -- admission


@query("SELECT page_id FROM pages WHERE length(url) <= 40")
def admit_url_len(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter(admission.url_fits(F.col("url"), 40)).select("page_id")


@query(f"WITH {RESPONSES_SQL} SELECT page_id FROM resp WHERE split_part(content_type, ';', 1) = 'text/html'")
def admit_content_type(spark, sf_dir):
    return responses(spark, sf_dir).filter(admission.type_allowed(F.col("content_type"), ("text/html",))).select("page_id")


@query("SELECT page_id FROM pages WHERE NOT contains(url, 'ref=x') AND NOT contains(url, '.net')")
def admit_deny_substr(spark, sf_dir):
    return read(spark, sf_dir, "pages").filter(~admission.mentions_denied(F.col("url"), ("ref=x", ".net"))).select("page_id")


HOST_SQL = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://(?:[^/?#@]*@)?([^/:?#]*)', 1))"
LINKED_SQL = """linked AS (SELECT page_id, url || CASE page_id % 8 WHEN 0 THEN '/a.pdf' WHEN 1 THEN '/News/' WHEN 2 THEN '/x.php?edit=1' WHEN 3 THEN '/past-x/'
  WHEN 4 THEN '/roombooking' WHEN 5 THEN '/m.HTML' WHEN 6 THEN '/learning/' ELSE '' END AS url FROM (SELECT page_id, split_part(split_part(url, '?', 1), '#', 1) AS url FROM pages))"""


def linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs of pages with endings that the link filters know."""
    i, ends = F.col("page_id") % 8, ["/a.pdf", "/News/", "/x.php?edit=1", "/past-x/", "/roombooking", "/m.HTML", "/learning/"]
    end = F.lit("")
    for k, e in enumerate(ends):
        end = F.when(i == k, e).otherwise(end)
    return read(spark, sf_dir, "pages").select("page_id", F.concat(F.regexp_replace("url", "[?#].*", ""), end).alias("url"))


@query(f"SELECT page_id, h AS host FROM (SELECT page_id, {HOST_SQL} AS h FROM pages) WHERE (h = 'example.com' OR ends_with(h, '.example.com')) AND NOT (h = 'm.example.com' OR ends_with(h, '.m.example.com'))")
def link_host_filter(spark, sf_dir):
    u = F.col("url")
    keep = admission.in_domains(u, ("example.com",)) & ~admission.in_domains(u, ("m.example.com",))
    return read(spark, sf_dir, "pages").filter(keep).select("page_id", S.host(u).alias("host"))


DENIED_EXT = ", ".join(f"'{e}'" for e in admission.DENY_EXTENSIONS)
EXT_SQL = r"lower(regexp_extract(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]*([^?#]*)', 1), '\.([^./]+)$', 1))"


@query(f"WITH {LINKED_SQL} SELECT page_id, {EXT_SQL} AS ext FROM linked WHERE {EXT_SQL} NOT IN ({DENIED_EXT})")
def link_ext_filter(spark, sf_dir):
    return linked(spark, sf_dir).select("page_id", S.extension(F.col("url")).alias("ext")).filter(~F.col("ext").isin(*admission.DENY_EXTENSIONS))


DENIED_RE = "|".join(f"(?:{p})" for p in admission.DENY_PATTERNS)


@query(f"WITH {LINKED_SQL} SELECT page_id, url FROM linked WHERE NOT regexp_matches(url, '{DENIED_RE}')")
def link_deny_regex(spark, sf_dir):
    return linked(spark, sf_dir).filter(~X.any_of(F.col("url"), admission.DENY_PATTERNS))


@query(f"""WITH {LINKED_SQL} SELECT page_id, url FROM (SELECT *, {HOST_SQL} AS h, {EXT_SQL} AS ext FROM linked)
  WHERE (h = 'example.com' OR ends_with(h, '.example.com')) AND ext NOT IN ({DENIED_EXT}) AND NOT regexp_matches(url, '{DENIED_RE}')""")
def link_admitted(spark, sf_dir):
    policy = admission.Policy(allow_domains=("example.com",))
    return linked(spark, sf_dir).filter(admission.link_admitted(F.col("url"), policy))


HREFS_SQL = "hrefs AS (SELECT DISTINCT page_id, unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=\"([^\"]*)\"', 1)) AS href FROM pages)"


@query(f"WITH {HREFS_SQL} SELECT page_id, href FROM hrefs")
def link_unique(spark, sf_dir):
    return admission.links(read(spark, sf_dir, "pages"))


@query(f"""WITH {SNAPSHOT_SQL}, {HREFS_SQL}, u AS (SELECT DISTINCT regexp_extract(p.url, '^[a-z]+://[^/?#]*', 0) || h.href AS url FROM hrefs h JOIN pages p USING (page_id) WHERE h.href LIKE '/%')
  SELECT url FROM u WHERE (regexp_extract(url, '://([^/]*)', 1) = 'example.com' OR ends_with(regexp_extract(url, '://([^/]*)', 1), '.example.com'))
  AND NOT regexp_matches(url, '{DENIED_RE}') AND {EXT_SQL} NOT IN ({DENIED_EXT}) AND length(url) <= 512 AND url NOT IN (SELECT url FROM snap)""")
def link_frontier(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    found = admission.links(pages).filter(F.startswith("href", F.lit("/"))).join(pages.select("page_id", "url"), "page_id")
    found = found.select(F.concat(F.regexp_extract("url", "^[a-z]+://[^/?#]*", 0), "href").alias("url"))
    return admission.frontier(found, snapshot(spark, sf_dir), admission.Policy(allow_domains=("example.com",)))


@query(f"WITH {ACTION_SQL} SELECT page_id, url, known_id, action FROM acted")
def crawl_action(spark, sf_dir):
    return admission.crawl_action(responses(spark, sf_dir), snapshot(spark, sf_dir), POLICY).select("page_id", "url", "known_id", "action")


@query(f"WITH {ACTION_SQL} SELECT action, count(*) AS n FROM acted GROUP BY action")
def crawl_action_counts(spark, sf_dir):
    return crawl_action(spark, sf_dir).groupBy("action").agg(F.count("*").alias("n"))


# -- parts


def unescaped(sql: str) -> str:
    for name, char in parts.ENTITIES.items():
        sql = f"replace({sql}, '{name}', '{char.replace(chr(39), chr(39) * 2)}')"
    return sql


TITLE_SQL = unescaped("array_to_string(regexp_extract_all(html, '(?is)<title[^>]*>(.*?)</title>', 1), ' ')")


@query(f"SELECT page_id, {TITLE_SQL} AS title FROM pages")
def title_part(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", parts.native_title(F.col("html")).alias("title"))


@query(f"SELECT page_id, substring({TITLE_SQL}, 1, 128) AS title FROM pages")
def short_title(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", parts.short_title(parts.native_title(F.col("html"))).alias("title"))


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '<.*?>', 0), ' ') AS tag FROM pages")
def tag_part(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", parts.native_tags(F.col("html")).alias("tag"))


@query("SELECT page_id, regexp_replace(html, '<[^>]*>', chr(10), 'g') AS text FROM pages")
def text_native(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", parts.native_text(F.col("html")).alias("text"))


@query("""SELECT page_id, array_to_string(list_concat(regexp_extract_all(m, '<meta\\s[^>]*?name="Keywords"[^>]*?content="([^"]*)"', 1),
  regexp_extract_all(m, '<meta\\s[^>]*?name="keywords"[^>]*?content="([^"]*)"', 1)), ' ') AS keyword
  FROM (SELECT page_id, html || '<meta name="keywords" content="k' || page_id || '"/><meta name="Keywords" content="K"/>' AS m FROM pages)""")
def meta_part(spark, sf_dir):
    more = F.concat("html", F.lit('<meta name="keywords" content="k'), F.col("page_id").cast("string"), F.lit('"/><meta name="Keywords" content="K"/>'))
    return read(spark, sf_dir, "pages").select("page_id", parts.native_meta(more, "keywords").alias("keyword"))


@query("SELECT page_id, md5(html) AS content_hash FROM pages")
def content_hash(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.text_hash(F.col("html")).alias("content_hash"))


#: A paragraph's end inside a script is no tag; comments are no text.
NODES_SQL = """array_to_string(list_filter(regexp_split_to_array(regexp_replace(regexp_replace(html, '<script>var t="</p>";', '<script>var t="' || chr(1) || '";', 'g'), '<!--.*?-->', '', 'gs'), '<[^>]*>'), lambda x: x <> ''), chr(10))"""
LAYOUT = "<body><nav><ul></ul></nav><div class=\"ad\"></div><article></article><footer></footer></body>"


@query(f"SELECT page_id, replace({unescaped(NODES_SQL)}, chr(1), '</p>') AS text, {TITLE_SQL} AS title, '' AS keyword, '' AS description FROM pages")
def html_parts(spark, sf_dir):
    out = parts.with_parts(read(spark, sf_dir, "pages"), ["text", "title", "keyword", "description"])
    return out.select("page_id", "parts.*")


@query(f"SELECT page_id, substring({TITLE_SQL}, 1, 128) AS title, md5(html) AS content_hash, md5('{LAYOUT}') AS layout_hash FROM pages")
def layout_hash_udf(spark, sf_dir):
    return parts.hashed(read(spark, sf_dir, "pages")).select("page_id", "title", "content_hash", "layout_hash")


# -- scalars


@query(f"WITH {RESPONSES_SQL} SELECT page_id, split_part(content_type, ';', 1) AS media_type FROM resp")
def media_type(spark, sf_dir):
    return responses(spark, sf_dir).select("page_id", S.media_type(F.col("content_type")).alias("media_type"))


@query("SELECT page_id, page_id || '.html' AS filename FROM pages")
def file_name(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", S.file_name(F.col("page_id"), F.lit("text/html; charset=utf-8")).alias("filename"))


@query("""SELECT l_orderkey, '[' || array_to_string(list(CAST(l_linenumber AS VARCHAR) ORDER BY l_linenumber), ', ') || ']' AS extractor, CAST(count(*) AS INTEGER) AS n
  FROM lineitem GROUP BY l_orderkey""")
def extractor_roundtrip(spark, sf_dir):
    lists = read(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list("l_linenumber")).alias("a"))
    parsed = S.to_extractor(S.from_extractor(F.col("a")))
    return lists.select("l_orderkey", S.from_extractor(parsed).alias("extractor"), F.size(parsed).alias("n"))


@query("SELECT page_id, CASE WHEN length(u) >= 100 THEN substr(u, 1, 46) || '......' || right(u, 46) ELSE u END AS short FROM (SELECT page_id, url || repeat('x', CAST(page_id % 120 AS INTEGER)) AS u FROM pages)")
def short_url(spark, sf_dir):
    long = F.concat("url", F.repeat(F.lit("x"), (F.col("page_id") % 120).cast("int")))
    return read(spark, sf_dir, "pages").select("page_id", S.short_url(long).alias("short"))


@query("SELECT doc_id, replace(text, chr(10), '\\ ') AS js FROM documents")
def js_string(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.js_string(F.col("text")).alias("js"))


@query("""SELECT o_orderkey, CAST(CASE s WHEN 'M' THEN 2 WHEN 'S' THEN 1 WHEN 'N' THEN -1 END AS INTEGER) AS decision,
  CASE s WHEN 'S' THEN 'success' WHEN 'M' THEN 'info' WHEN 'N' THEN 'danger' END AS style
  FROM (SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN 'M' WHEN 'O' THEN 'S' WHEN 'P' THEN 'N' END AS s FROM orders)""")
def decision_map(spark, sf_dir):
    s = F.when(F.col("o_orderstatus") == "F", "M").when(F.col("o_orderstatus") == "O", "S").when(F.col("o_orderstatus") == "P", "N")
    d = S.decision_value(s)
    return read(spark, sf_dir, "orders").select("o_orderkey", d.alias("decision"), S.decision_style(d).alias("style"))


@query("SELECT doc_id, substring(text, 1, 32) AS cut FROM documents")
def truncate(spark, sf_dir):
    return read(spark, sf_dir, "documents").select("doc_id", S.cut(F.col("text"), 32).alias("cut"))


@query("SELECT l_orderkey, l_linenumber, round(100 * l_discount, 2) AS confidence, printf('%.2f%%', l_discount * 100) AS shown FROM lineitem")
def rounded_percent(spark, sf_dir):
    d = F.col("l_discount")
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(100 * d, 2).alias("confidence"), S.percent(d).alias("shown"))


# -- features


def hits(column: str, pattern: str) -> str:
    return f"len(regexp_extract_all({column}, '(?i){pattern}'))"


COMMON = (r"\bof\b", r"\band\b", r"ing\b", "tion")
COUNTS_SQL = "c AS (SELECT doc_id, text, " + ", ".join(f"{hits('text', p)} AS c{i}" for i, p in enumerate(COMMON)) + " FROM documents)"


def one_feature(spark: SparkSession, sf_dir: str, feature: Feature, table: str = "documents", key: str = "doc_id", text: str = "text") -> DataFrame:
    df = read(spark, sf_dir, table)
    return df.select(key, features.feature_value(feature, {"text": F.col(text)}).alias("value"))


def listed(policy: str, weight: int = 1) -> Feature:
    return Feature("1", policy, (FeatureRule("list", COMMON, weight=weight, policy=policy),))


@query(rf"SELECT doc_id, CAST(2 * {hits('text', chr(92) + 'bthe' + chr(92) + 'b')} AS BIGINT) AS value FROM documents")
def feat_count(spark, sf_dir):
    return one_feature(spark, sf_dir, Feature("1", "the", (FeatureRule("reg", (r"\bthe\b",), weight=2),)))


@query(rf"SELECT page_id, CAST({hits('html', chr(92) + 'bthe' + chr(92) + 'b')} AS BIGINT) AS value FROM pages")
def feat_count_pages(spark, sf_dir):
    return one_feature(spark, sf_dir, Feature("1", "the", (FeatureRule("reg", (r"\bthe\b",)),)), "pages", "page_id", "html")


@query("SELECT doc_id, CAST(CASE WHEN regexp_matches(text, '(?i)tion') THEN 3 ELSE 0 END AS BIGINT) AS value FROM documents")
def feat_exist(spark, sf_dir):
    return one_feature(spark, sf_dir, Feature("1", "tion", (FeatureRule("reg", ("tion",), weight=3, policy="exist"),)))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, CAST(c0 + c1 + c2 + c3 AS BIGINT) AS value FROM c")
def feat_list_sum(spark, sf_dir):
    return one_feature(spark, sf_dir, listed("sum"))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, CAST(greatest(c0, c1, c2, c3) AS BIGINT) AS value FROM c")
def feat_list_max(spark, sf_dir):
    return one_feature(spark, sf_dir, listed("max"))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, CAST(least(c0, c1, c2, c3) AS BIGINT) AS value FROM c")
def feat_list_min(spark, sf_dir):
    return one_feature(spark, sf_dir, listed("min"))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, CAST(-3 * floor((c0 + c1 + c2 + c3) / 4) AS BIGINT) AS value FROM c")
def feat_list_avg(spark, sf_dir):
    return one_feature(spark, sf_dir, listed("avg", -3))


@query(f"WITH {COUNTS_SQL} SELECT doc_id, CAST(floor((c0 + c1 + c2 + c3) / 4) AS BIGINT) AS value FROM c")
def feat_list_prod(spark, sf_dir):
    return one_feature(spark, sf_dir, listed("prod"))


@query(f"""WITH {COUNTS_SQL} SELECT doc_id, CAST(CASE WHEN d = 0 THEN -5 * c3 ELSE floor(-5 * c3 / d) END AS BIGINT) AS value
  FROM (SELECT doc_id, c3, floor((c0 - c1) / 2.0) AS d FROM c)""")
def feat_div(spark, sf_dir):
    reg = lambda p, w=1: FeatureRule("reg", (p,), weight=w)
    return one_feature(spark, sf_dir, Feature("1", "ratio", (reg("tion", -5), reg(COMMON[0]), reg(COMMON[1], -1)), "div"))


SPACE = [
    Feature("2", "tions", (FeatureRule("reg", ("tion",)),)),
    Feature("10", "common", (FeatureRule("list", COMMON, policy="sum"), FeatureRule("reg", ("qu",), weight=2))),
    Feature("1", "ending", (FeatureRule("reg", (r"ing\b",), policy="exist"), FeatureRule("reg", ("tion",), policy="exist")), "max"),
]
SPACE_SQL = f"{COUNTS_SQL}, f AS (SELECT doc_id, c3 AS f_2, c0 + c1 + c2 + c3 + 2 * {hits('text', 'qu')} AS f_10, CAST(c2 > 0 OR c3 > 0 AS BIGINT) AS f_1 FROM c)"


def featured(spark: SparkSession, sf_dir: str) -> DataFrame:
    return features.with_features(read(spark, sf_dir, "documents"), SPACE, {"text": F.col("text")})


@query(f"WITH {SPACE_SQL} SELECT doc_id, CAST(f_2 AS BIGINT) AS f_2, CAST(f_10 AS BIGINT) AS f_10, f_1 FROM f")
def feature_row(spark, sf_dir):
    return featured(spark, sf_dir).select("doc_id", "f_2", "f_10", "f_1")


@query(f"WITH {SPACE_SQL} SELECT doc_id, f_1 || ',' || f_10 || ',' || f_2 AS line FROM f")
def feature_vector(spark, sf_dir):
    return featured(spark, sf_dir).select("doc_id", features.vector_line(SPACE).alias("line"))


@query("SELECT 'tions,common,ending' AS in_document_order, 'ending,common,tions' AS in_vector_order")
def feature_header(spark, sf_dir):
    row = (",".join(features.names_in_document_order(SPACE)), ",".join(features.names_in_vector_order(SPACE)))
    return spark.createDataFrame([row], "in_document_order string, in_vector_order string")


@query("SELECT * FROM (VALUES ('2', 'tions', 'sum', 'n/a'), ('10', 'common', 'sum', 'n/a'), ('1', 'ending', 'max', 'n/a')) t(id, name, policy, description)")
def feature_catalogue(spark, sf_dir):
    return features.described(spark, SPACE)


# -- judging

TREE_SQL = f"""{SPACE_SQL}, j AS (SELECT doc_id, f_10, CASE WHEN f_10 > 40 THEN 2 WHEN f_10 > 12 THEN 1 WHEN f_2 > 0 THEN 0 ELSE -1 END AS decision,
  CASE WHEN f_10 > 12 THEN 90.0 WHEN f_2 > 3 THEN 70.0 WHEN f_2 > 0 THEN 55.5 ELSE 70.1 END AS confidence FROM f)"""
ROUTE_SQL = "CASE WHEN confidence > 70 THEN CASE WHEN decision IN (1, 2) THEN 'extract' ELSE 'discard' END ELSE 'review' END"


def fixed_tree(df: DataFrame) -> DataFrame:
    a, b = F.col("f_10"), F.col("f_2")
    return df.withColumns({
        "decision": F.when(a > 40, 2).when(a > 12, 1).when(b > 0, 0).otherwise(-1),
        "confidence": F.when(a > 12, 90.0).when(b > 3, 70.0).when(b > 0, 55.5).otherwise(70.1),
    })


def tree_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixed_tree(featured(spark, sf_dir))


@query(f"WITH {TREE_SQL} SELECT doc_id, CAST(decision AS INTEGER) AS decision, CAST(confidence AS DOUBLE) AS confidence, {ROUTE_SQL} AS route FROM j")
def judge_fixed_tree(spark, sf_dir):
    return tree_judged(spark, sf_dir).select("doc_id", "decision", "confidence", judge.route(F.col("decision"), F.col("confidence")).alias("route"))


@query(f"WITH {TREE_SQL} SELECT {ROUTE_SQL} AS route, count(*) AS n FROM j GROUP BY 1")
def route_counts(spark, sf_dir):
    return judge_fixed_tree(spark, sf_dir).groupBy("route").agg(F.count("*").alias("n"))


@query(f"""WITH {TREE_SQL}, h AS (SELECT j.doc_id, CAST(coalesce(l.quality, decision) AS INTEGER) AS decision,
  CAST(CASE WHEN l.quality IS NOT NULL THEN 100.0 ELSE confidence END AS DOUBLE) AS confidence FROM j LEFT JOIN labels l USING (doc_id))
  SELECT doc_id, decision, confidence, {ROUTE_SQL} AS route FROM h""")
def human_override(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    out = judge.with_human(tree_judged(spark, sf_dir).select("doc_id", "decision", "confidence"), labels, "doc_id")
    return out.withColumn("route", judge.route(F.col("decision"), F.col("confidence")))


@query(f"""WITH {TREE_SQL} SELECT j.doc_id AS id, source AS title, lang AS url, j.doc_id || '.html' AS filename, CAST(round(confidence, 2) AS DOUBLE) AS confidence,
  CAST(decision AS INTEGER) AS decision, f_10 || '' AS feature FROM j JOIN documents USING (doc_id) WHERE {ROUTE_SQL} = 'review'""")
def review_queue(spark, sf_dir):
    named = tree_judged(spark, sf_dir).select(
        F.col("doc_id").alias("id"), F.col("source").alias("title"), F.col("lang").alias("url"), S.file_name(F.col("doc_id"), F.lit("text/html")).alias("filename"), "decision", "confidence", "f_10"
    )
    return judge.queue_rows(named, F.col("f_10").cast("string"))


@query(None)
def tree_fit(spark, sf_dir):
    """The tree learned from labels, applied to every document."""
    columns = [features.column_name(f) for f in features.ordered(SPACE)]
    made = featured(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in columns})
    labels = read(spark, sf_dir, "labels").select(F.col("doc_id"), F.col("quality").alias("label"))
    tree = judge.learn(evaluate.feature_table(made, labels, columns, "doc_id"), columns)
    out = judge.judged(made.select("doc_id", *columns), tree)
    return out.select("doc_id", "decision", "confidence", judge.route(F.col("decision"), F.col("confidence")).alias("route"))


# -- extraction


@query("SELECT page_id, array_to_string(regexp_extract_all(html, '(?is)<h1>(.*?)</h1>', 1), ' ') AS found FROM pages")
def match_join(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.found_joined(F.col("html"), "<h1>(.*?)</h1>").alias("found"))


@query("SELECT page_id, array_to_string(regexp_extract_all(url, '(?is)[a-z]+\\.example', 0), ' ') AS found FROM pages")
def match_join_whole(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.found_joined(F.col("url"), r"[a-z]+\.example").alias("found"))


@query("SELECT page_id, regexp_extract(html, '(?s)<footer>(.*?)</footer>', 1) AS between FROM pages")
def substring_between(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.between(F.col("html"), "<footer>", "</footer>").alias("between"))


@query("SELECT page_id, regexp_extract(url, '(?s)(//)(.*?)$', 2) AS between FROM pages")
def substring_open_end(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.between(F.col("url"), "(//)", "").alias("between"))


@query("SELECT page_id, regexp_replace(html, '<.*?>', '', 'g') AS text FROM pages")
def action_removehtml(spark, sf_dir):
    return read(spark, sf_dir, "pages").select("page_id", X.without_tags(F.col("html")).alias("text"))


@query("SELECT doc_id, regexp_replace(chr(10) || ' ' || text || ' ' || chr(9), '^\\s+|\\s+$', '', 'g') AS text FROM documents")
def action_strip(spark, sf_dir):
    padded = F.concat(F.lit("\n "), "text", F.lit(" \t"))
    return read(spark, sf_dir, "documents").select("doc_id", X.stripped(padded).alias("text"))


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 3 THEN 'None' ELSE strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders""")
def action_parsedate(spark, sf_dir):
    d, k = F.col("o_orderdate"), F.col("o_orderkey")
    shown = F.when(k % 7 == 3, "no date").when(k % 3 == 0, F.date_format(d, "d MMM yyyy")).when(k % 3 == 1, F.date_format(d, " EEEE, d MMMM yyyy ")).otherwise(F.date_format(d, "MMMM d, yyyy"))
    return read(spark, sf_dir, "orders").select("o_orderkey", extract.compatible(extract.parsed_date(shown)).alias("day"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN strftime(ts, '%H:%M:%S') ELSE strftime(ts, '%H:%M:00') END AS at FROM events")
def action_parsetime(spark, sf_dir):
    t, k = F.col("ts"), F.col("event_id")
    shown = F.when(k % 3 == 0, F.date_format(t, "HH:mm:ss")).when(k % 3 == 1, F.date_format(t, "h:mm a")).otherwise(F.date_format(t, "HH:mm"))
    return read(spark, sf_dir, "events").select("event_id", extract.compatible(extract.parsed_time(shown)).alias("at"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders")
def action_parsedate_any(spark, sf_dir):
    return read(spark, sf_dir, "orders").select("o_orderkey", extract.parsed_any()(F.date_format("o_orderdate", "EEE d MMM yyyy, HH:mm")).alias("day"))


ENTITY = Entity("page", {
    1: Attribute(1, "Title", "title", 24, "title.xml", rules={1: Rule("html", (1, 2), match="<h1>(.*?)</h1>"), 2: Rule("title", (2,))}),
    2: Attribute(2, "Place", "place", 12, "place.xml", rules={1: Rule("url", after="//", before="/"), 2: Rule("url", match="[0-9]+"), 3: Rule("url", match="(")}),
})


@query(f"""SELECT page_id, substring(CASE page_id % 3 WHEN 0 THEN regexp_replace(regexp_replace(array_to_string(regexp_extract_all(html, '(?is)<h1>(.*?)</h1>', 1), ' '), '<.*?>', '', 'g'), '^\\s+|\\s+$', '', 'g')
  WHEN 1 THEN {TITLE_SQL} ELSE '' END, 1, 24) AS title,
  substring(CASE page_id % 4 WHEN 1 THEN regexp_extract(url, '(?s)//(.*?)/', 1) WHEN 2 THEN array_to_string(regexp_extract_all(url, '[0-9]+', 0), ' ') ELSE '' END, 1, 12) AS place FROM pages""")
def extract_record(spark, sf_dir):
    i = F.col("page_id")
    chosen = F.array(F.when(i % 3 == 0, 1).when(i % 3 == 1, 2).otherwise(0), (i % 4).cast("int"))
    out = extract.with_records(read(spark, sf_dir, "pages"), ENTITY, chosen, parts.native(F.col("html"), F.col("url")))
    return out.select("page_id", "title", "place")


H1_SQL = unescaped("array_to_string(regexp_extract_all(html, '(?s)<article><h1>(.*?)</h1>', 1), ' ')")


def escaped(sql: str) -> str:
    """Decoded, then written as the tree writes text."""
    return f"replace(replace(replace({unescaped(sql)}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


@query(f"""SELECT page_id, regexp_replace({H1_SQL}, '^\\s+|\\s+$', '', 'g') AS heading,
  array_to_string(list_transform(regexp_extract_all(html, '(?s)<div class="ad">(.*?)</div>', 1), lambda x: '<div class="ad">' || {escaped('x')} || '</div>'), ' ') AS ads,
  {unescaped("array_to_string(regexp_extract_all(regexp_extract(html, '(?s)<nav>.*?</nav>', 0), '(?s)<a [^>]*>(.*?)</a>', 1), ' ')")} AS links FROM pages""")
def css_scope(spark, sf_dir):
    rules = {"heading": Rule("content", (2,), "article > h1"), "ads": Rule("content", (), "div.ad", "html"), "links": Rule("content", (), "nav ul li a")}
    pages = read(spark, sf_dir, "pages")
    return extract.with_rule_values(pages, rules, parts.native(F.col("html"), F.col("url"))).select("page_id", *rules)


VOTE_SQL = f"""{SNAPSHOT_SQL}, v AS (SELECT layout_hash, CASE id % 4 WHEN 0 THEN '[1, 0, 3]' WHEN 1 THEN '[-1]' WHEN 2 THEN '[1, 2]' ELSE '[2, 2]' END AS extractor FROM snap),
  g AS (SELECT layout_hash, extractor, count(*) AS n FROM v WHERE extractor <> '[-1]' GROUP BY ALL),
  e AS (SELECT * FROM g QUALIFY row_number() OVER (PARTITION BY layout_hash ORDER BY n DESC, extractor) = 1)"""


def voted_lib(spark: SparkSession, sf_dir: str) -> DataFrame:
    i, of = F.col("id") % 4, lambda *x: F.array(*map(F.lit, x))
    return snapshot(spark, sf_dir).withColumn("extractor", F.when(i == 0, of(1, 0, 3)).when(i == 1, of(-1)).when(i == 2, of(1, 2)).otherwise(of(2, 2)))


@query(f"WITH {VOTE_SQL} SELECT layout_hash, extractor, n FROM g")
def layout_counts(spark, sf_dir):
    return extract.votes(voted_lib(spark, sf_dir))


@query(f"WITH {VOTE_SQL} SELECT layout_hash, extractor, n FROM e")
def layout_vote(spark, sf_dir):
    return extract.elected(voted_lib(spark, sf_dir))


@query(f"WITH {VOTE_SQL} SELECT p.page_id, e.extractor AS voted FROM (SELECT page_id, md5(split_part(url, '/', 4)) AS layout_hash FROM pages) p LEFT JOIN e USING (layout_hash)")
def vote_applied(spark, sf_dir):
    queue = read(spark, sf_dir, "pages").select("page_id", F.md5(F.split_part("url", F.lit("/"), F.lit(4)).cast("binary")).alias("layout_hash"))
    return extract.by_vote(queue, voted_lib(spark, sf_dir)).select("page_id", S.from_extractor(F.col("voted")).alias("voted"))


# -- learning and evaluation

SCORED_SQL = f"{TREE_SQL}, s AS (SELECT j.doc_id, source, quality AS label, decision FROM j JOIN labels USING (doc_id))"
CONFUSION_SQL = """CAST(count(*) FILTER (label IN (1, 2) AND decision IN (1, 2)) AS BIGINT) AS tp, CAST(count(*) FILTER (label NOT IN (1, 2) AND decision NOT IN (1, 2)) AS BIGINT) AS tn,
  CAST(count(*) FILTER (label NOT IN (1, 2) AND decision IN (1, 2)) AS BIGINT) AS fp, CAST(count(*) FILTER (label IN (1, 2) AND decision NOT IN (1, 2)) AS BIGINT) AS fn"""


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return tree_judged(spark, sf_dir).join(labels, "doc_id")


@query(f"WITH {SPACE_SQL} SELECT doc_id, quality AS label, f_1, CAST(f_10 AS BIGINT) AS f_10 FROM f JOIN labels USING (doc_id)")
def feature_table(spark, sf_dir):
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    return evaluate.feature_table(featured(spark, sf_dir), labels, ["f_1", "f_10"], "doc_id")


@query(f"WITH {SCORED_SQL.replace('SELECT doc_id, f_10, CASE', 'SELECT f.doc_id, d.source, f_10, CASE').replace('AS confidence FROM f)', 'AS confidence FROM f JOIN documents d USING (doc_id))')} SELECT {CONFUSION_SQL} FROM s")
def confusion(spark, sf_dir):
    return evaluate.confusion(scored(spark, sf_dir))


@query(f"""WITH {SCORED_SQL.replace('SELECT doc_id, f_10, CASE', 'SELECT f.doc_id, d.source, f_10, CASE').replace('AS confidence FROM f)', 'AS confidence FROM f JOIN documents d USING (doc_id))')},
  c AS (SELECT source, {CONFUSION_SQL} FROM s GROUP BY source) SELECT source, tp, tn, fp, fn, round(tp / nullif(tp + fn, 0), 9) AS recall, round(tp / nullif(tp + fp, 0), 9) AS precision,
  round(2 * (tp / nullif(tp + fn, 0)) * (tp / nullif(tp + fp, 0)) / nullif(tp / nullif(tp + fn, 0) + tp / nullif(tp + fp, 0), 0), 9) AS f FROM c""".replace("c AS (SELECT source", "k AS (SELECT source").replace("AS f FROM c", "AS f FROM k"))
def prf(spark, sf_dir):
    out = evaluate.rates(evaluate.confusion(scored(spark, sf_dir), "label", "decision", "source"))
    return out.withColumns({c: F.round(c, 9) for c in ("recall", "precision", "f")})


@query("SELECT doc_id, quality, CAST((row_number() OVER (PARTITION BY quality ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 10 AS INTEGER) AS fold FROM labels")
def stratified_folds(spark, sf_dir):
    return evaluate.with_fold(read(spark, sf_dir, "labels").select("doc_id", "quality"), "quality", "doc_id")


@query(None)
def cv_report(spark, sf_dir):
    columns = [features.column_name(f) for f in features.ordered(SPACE)]
    made = featured(spark, sf_dir).withColumns({c: F.col(c).cast("double") for c in columns})
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    table = evaluate.feature_table(made, labels, columns, "doc_id")
    return evaluate.report(evaluate.cross_validated(table, columns, "doc_id"))


# -- sources, sinks, streams


@query("SELECT doc_id AS id, lang AS url, CAST(length(source) AS INTEGER) AS label FROM documents")
def csv_roundtrip(spark, sf_dir):
    rows = read(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("url"), F.length("source").alias("label"))
    path = tables.scratch(spark, "csv")
    tables.write_csv(rows, path)
    return tables.labelled_csv(spark, path)


@query("SELECT page_id, length(html) AS n FROM pages")
def landed_stream(spark, sf_dir):
    """Pages as a stream, taken batch by batch."""
    from pagemill.streaming import ingest

    out = tables.scratch(spark, "stream")
    pages = read(spark, sf_dir, "pages")
    stream = spark.readStream.schema(pages.schema).parquet(f"{sf_dir}/pages.parquet*")
    take = lambda batch, epoch: batch.select("page_id", F.length("html").cast("long").alias("n")).write.mode("overwrite").parquet(f"{out}/epoch={epoch}")
    ingest.each_batch(stream, take, f"{out}-checkpoint").awaitTermination()
    return spark.read.parquet(f"{out}/epoch=*")


@query(None)
def engine_session(spark, sf_dir):
    """Pages through the whole engine: ingest, human decisions, extractors by hand and by vote, results."""
    from pagemill.plans.engine import Engine

    space = [Feature("1", "the", (FeatureRule("reg", (r"\bthe\b",)),)), Feature("2", "tags", (FeatureRule("reg", ("<p>",), sel="html"),))]
    entity = Entity(ENTITY.name, {k: Attribute(a.id, a.name, a.db_col, a.max_len, a.file, a.description, dict(a.rules)) for k, a in ENTITY.attributes.items()})
    own = Engine(spark, tables.scratch(spark, "engine"), space, entity, admission.Policy(allow_domains=("example.com",)))
    own.ingest(tables.responses(read(spark, sf_dir, "pages")), 0)
    queue = own.judge_list()
    own.judge(queue.select("id", F.when(F.col("feature")["1"] > 0, 1).otherwise(-1).alias("decision")))
    layouts = own.extract_list().join(own.table("url_lib").select("id", "layout_hash"), "id").groupBy("layout_hash").agg(F.min("id").alias("id"))
    own.apply(own.store.write("chosen", layouts.select("id", F.array(F.lit(1), F.lit(1)).alias("extractor"))))
    own.extract_refresh()
    return own.results()


@query("SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'new title' ELSE url END AS title, CAST(CASE WHEN page_id % 3 = 0 THEN -1 ELSE 0 END AS INTEGER) AS is_target FROM pages")
def update_urls(spark, sf_dir):
    table = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.col("url").alias("title"), F.lit(0).alias("is_target"))
    return store.updated(table, F.col("id") % 3 == 0, title=F.lit("new title"), is_target=F.lit(-1))


@query(f"WITH {TREE_SQL}, l AS (SELECT j.*, f.f_1, f.f_2 FROM j JOIN f USING (doc_id)) SELECT doc_id, quality AS label, CAST(decision AS INTEGER) AS judge, CAST(confidence AS DOUBLE) AS prob, f_1, CAST(f_10 AS BIGINT) AS f_10, CAST(f_2 AS BIGINT) AS f_2 FROM l JOIN labels USING (doc_id)")
def score_table(spark, sf_dir):
    """Labelled documents with the tree's decision, its confidence and the features."""
    return evaluate.score_table(scored(spark, sf_dir), "doc_id", [features.column_name(f) for f in features.ordered(SPACE)])


@query("SELECT n_name AS name, CAST(n_nationkey AS VARCHAR) AS label FROM nation")
def sql_export(spark, sf_dir):
    """Any SQL to CSV, read back."""
    read(spark, sf_dir, "nation").createOrReplaceTempView("pagemill_nation")
    path = tables.scratch(spark, "export")
    tables.exported(spark, "SELECT n_name AS name, n_nationkey AS label FROM pagemill_nation", path)
    return tables.labelled_csv(spark, path, "name string, label string")


@query(f"WITH {HREFS_SQL} SELECT page_id, regexp_extract(p.url, '^[a-z]+://[^/?#]*', 0) || h.href AS link FROM hrefs h JOIN pages p USING (page_id)")
def absolute_links(spark, sf_dir):
    pages = read(spark, sf_dir, "pages")
    both = admission.links(pages).join(pages.select("page_id", "url"), "page_id")
    return both.select("page_id", S.absolute(F.col("url"), F.col("href")).alias("link"))


@query("SELECT * FROM (VALUES (1, 'Title', 1, 'html', ''), (1, 'Title', 2, 'title', ''), (2, 'Place', 1, 'url', ''), (2, 'Place', 2, 'url', ''), (2, 'Place', 3, 'url', '')) t(attribute, name, rule, on_part, description)")
def rule_catalogue(spark, sf_dir):
    return extract.rule_catalogue(spark, ENTITY)


@query("SELECT * FROM (VALUES (1, 'Title', 'title', 24, 'title.xml', ''), (2, 'Place', 'place', 12, 'place.xml', '')) t(attribute, name, db_col, max_len, file, description)")
def attribute_catalogue(spark, sf_dir):
    return extract.attribute_catalogue(spark, ENTITY)


@query("SELECT * FROM (VALUES (1, 'removeHTML', 'tags go'), (2, 'strip', 'white space at both ends goes'), (3, 'parseDate', 'a date as yyyy-MM-dd'), (4, 'parseTime', 'a time as HH:mm:ss')) t(action, name, description)")
def action_catalogue(spark, sf_dir):
    return extract.action_catalogue(spark)


@query(None)
def queue_refresh(spark, sf_dir):
    """Queued documents judged anew by the tree learned from labels, with their routes."""
    columns = [features.column_name(f) for f in features.ordered(SPACE)]
    made = featured(spark, sf_dir)
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    tree = judge.learn(evaluate.feature_table(made, labels, columns, "doc_id"), columns)
    queue = fixed_tree(made).filter(judge.route(F.col("decision"), F.col("confidence")) == "review").select(
        F.col("doc_id").alias("id"), "decision", "confidence", F.create_map(*(x for f in SPACE for x in (F.lit(f.id), F.col(features.column_name(f))))).alias("feature")
    )
    return judge.refreshed(queue, tree, columns).select("id", "decision", "confidence", "route")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages -> title -> features -> decision -> targets, all in SQL functions."""
    space = [Feature("10", "the", (FeatureRule("list", COMMON),)), Feature("2", "tion", (FeatureRule("reg", ("tion",)),))]
    pages = read(spark, sf_dir, "pages")
    made = features.with_features(pages, space, parts.native(F.col("html"), F.col("url")))
    out = fixed_tree(made).filter(F.col("decision").isin(*S.TARGETS))
    return out.select("page_id", parts.short_title(parts.native_title(F.col("html"))).alias("title"), "decision", "confidence")
