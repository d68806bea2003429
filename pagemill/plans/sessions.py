"""Queries for the verbs of a running installation, its sources and its models, each with its SQL.

They run on a small site whose pages are made from the keys of ``pages``, so that SQL can
tell what titles, parts, layouts, features and routes they have: odd keys announce
something, layouts go by the key modulo 3.
"""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.scalars import text_hash
from pagemill.operators import admission, evaluate, extract, features, judge, parts, store
from pagemill.plans.engine import Engine
from pagemill.plans.queries import SPACE, SPACE_SQL, Query, featured, read
from pagemill.sources import specs, tables
from pagemill.sources.specs import Attribute, Entity, Feature, FeatureRule, Rule

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f: Query) -> Query:
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


URL_SQL = "'http://talks.ox.ac.uk/' || page_id"
BODY_SQL = """'<html><head><title>T' || page_id || ' &amp; more</title><meta content="D' || page_id || '" name="description"><meta name="Keywords" content="K"></head><body><div class="k' || page_id % 3
  || '"><h1>H' || page_id || '</h1><p>' || repeat('seminar ', CAST(page_id % 2 AS INTEGER)) || 'on 3 May ' || 2000 + page_id % 20 || '</p><img src="a.png"></div></body></html>'"""
SITE_SQL = f"site AS (SELECT page_id, {URL_SQL} AS url, {BODY_SQL} AS html FROM pages)"
SPACE_OF_SITE = [Feature("1", "seminar", (FeatureRule("reg", ("seminar",)),)), Feature("2", "paragraphs", (FeatureRule("reg", ("<p>",), sel="tag"),))]


def site(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    text = lambda *x: F.concat(*(F.lit(v) if isinstance(v, str) else v.cast("string") for v in x))
    body = text(
        "<html><head><title>T", i, ' &amp; more</title><meta content="D', i, '" name="description"><meta name="Keywords" content="K"></head><body><div class="k', i % 3, '"><h1>H', i, "</h1><p>",
        F.repeat(F.lit("seminar "), (i % 2).cast("int")), "on 3 May ", 2000 + i % 20, '</p><img src="a.png"></div></body></html>',
    )
    return read(spark, sf_dir, "pages").select("page_id", text("http://talks.ox.ac.uk/", i).alias("url"), body.alias("html"))


def entity() -> Entity:
    return Entity("talk", {
        1: Attribute(1, "Title", "title", 64, "title.xml", rules={1: Rule("title"), 2: Rule("content", (2,), "div > h1")}),
        2: Attribute(2, "Start", "start_time", 24, "start.xml", rules={1: Rule("text", (3,), after="on ", before="$")}),
        3: Attribute(3, "Description", "description", 24, "description.xml", rules={1: Rule("description"), 2: Rule("layout", (), match="k[0-9]")}),
    })


def engine(spark: SparkSession, at: str | None = None) -> Engine:
    return Engine(spark, at or tables.scratch(spark, "engine"), SPACE_OF_SITE, entity(), admission.Policy())


def key(url: str = "url"):
    return F.element_at(F.split(url, "/"), -1).cast("long")


def landed(spark: SparkSession, sf_dir: str, at: str | None = None) -> Engine:
    own = engine(spark, at)
    own.ingest(tables.responses(site(spark, sf_dir)), 0)
    return own


def decided(own: Engine) -> DataFrame:
    """A human's decisions on all that waits: what announces something is a target."""
    return own.store.write("chosen", own.judge_list().select("id", F.when(F.col("feature")["1"] > 0, 1).otherwise(-1).alias("decision")))


# -- parts, on the site and on the pages

LAYOUT_SQL = """'<body><div class="k' || page_id % 3 || '"></div></body>'"""


@query(f"""WITH {SITE_SQL} SELECT page_id, 'T' || page_id || ' & more' || chr(10) || 'H' || page_id || chr(10) || repeat('seminar ', CAST(page_id % 2 AS INTEGER)) || 'on 3 May ' || 2000 + page_id % 20 AS text,
  '<html><head><title>T' || page_id || ' &amp; more</title><meta content="D' || page_id || '" name="description"/><meta name="Keywords" content="K"/></head><body><div class="k' || page_id % 3
  || '"><h1>H' || page_id || '</h1><p>' || repeat('seminar ', CAST(page_id % 2 AS INTEGER)) || 'on 3 May ' || 2000 + page_id % 20 || '</p><img src="http://talks.ox.ac.uk/a.png"/></div></body></html>' AS html,
  '<html> <head> <title> </title> <meta content="D' || page_id || '" name="description"/> <meta name="Keywords" content="K"/> </head> <body> <div class="k' || page_id % 3
  || '"> <h1> </h1> <p> </p> <img src="http://talks.ox.ac.uk/a.png"/> </div> </body> </html>' AS tag,
  'T' || page_id || ' & more' AS title, 'K' AS keyword, 'D' || page_id AS description, url, {LAYOUT_SQL} AS layout FROM site""")
def site_parts(spark, sf_dir):
    """Every part of a page, from the tree."""
    return parts.with_parts(site(spark, sf_dir), list(parts.NAMES)).select("page_id", "parts.*")


@query(f"WITH {SITE_SQL} SELECT page_id, 'T' || page_id || ' & more' AS title, md5(html) AS content_hash, md5({LAYOUT_SQL}) AS layout_hash FROM site")
def site_hashes(spark, sf_dir):
    return parts.hashed(site(spark, sf_dir)).select("page_id", "title", "content_hash", "layout_hash")


@query(f"WITH {SITE_SQL} SELECT page_id, 'D' || page_id AS description, 'K' AS keyword FROM site")
def description_part(spark, sf_dir):
    return parts.with_parts(site(spark, sf_dir), ["description", "keyword"]).select("page_id", "parts.*")


# -- verbs


@query("""SELECT 'http://talks.ox.ac.uk/' || page_id AS url, CASE WHEN page_id % 5 = 0 AND page_id % 4 <> 0 THEN 'gone' WHEN page_id % 5 = 0 THEN 'missing' WHEN page_id % 4 = 0 THEN 'new'
  WHEN page_id % 7 = 0 THEN 'changed' ELSE 'unchanged' END AS action FROM pages""")
def engine_ingest(spark, sf_dir):
    """A second visit: pages that are gone, missing, new, changed and unchanged."""
    own, pages = engine(spark), site(spark, sf_dir)
    own.ingest(tables.responses(pages.filter("page_id % 4 <> 0")), 0)
    i = F.col("page_id")
    again = pages.select("url", F.when(i % 5 == 0, 404).otherwise(200).alias("status"), F.lit("text/html").alias("content_type"), F.when(i % 7 == 0, F.concat("html", F.lit("!"))).otherwise(F.col("html")).alias("body"))
    return own.ingest(again, 1)


@query("SELECT 'http://talks.ox.ac.uk/' || page_id AS url, CASE WHEN page_id % 2 = 0 THEN 'gone' ELSE 'changed' END AS action FROM pages")
def engine_latest_response(spark, sf_dir):
    """Of several responses of a URL the latest decides."""
    own, pages = landed(spark, sf_dir), site(spark, sf_dir)
    one = lambda status, body, at: pages.select("url", F.lit(status).alias("status"), F.lit("text/html").alias("content_type"), body.alias("body"), at.cast("timestamp").alias("fetched_at"))
    even = F.col("page_id") % 2 == 0
    return own.ingest(one(404, F.lit(""), F.when(even, 20).otherwise(10)).unionByName(one(200, F.concat("html", F.lit("!")), F.lit(15))), 1)


@query(f"""WITH {SITE_SQL} SELECT url, 'T' || page_id || ' & more' AS title, CAST(0 AS DOUBLE) AS confidence, CAST(-1 AS INTEGER) AS decision, page_id % 2 AS seminar, CAST(1 AS BIGINT) AS paragraphs FROM site""")
def engine_queue(spark, sf_dir):
    """Without a tree every page waits for a human."""
    return landed(spark, sf_dir).judge_list().select("url", "title", "confidence", "decision", F.col("feature")["1"].alias("seminar"), F.col("feature")["2"].alias("paragraphs"))


@query("""SELECT 'http://talks.ox.ac.uk/' || page_id AS url, CAST(CASE WHEN page_id % 2 = 1 THEN 1 ELSE -1 END AS INTEGER) AS is_target, CASE WHEN page_id % 2 = 1 THEN 'extract' END AS stage FROM pages""")
def engine_judged(spark, sf_dir):
    """Human decisions: targets wait for an extractor, the raw pages of the others are dropped."""
    own = landed(spark, sf_dir)
    own.judge(decided(own))
    return own.table("url_lib").select("id", "url", "is_target").join(own.table("inbox").select("id", "stage"), "id", "left").drop("id")


def extracted(spark: SparkSession, sf_dir: str) -> Engine:
    """One page of each layout has an extractor by hand, the others get theirs by vote."""
    own = landed(spark, sf_dir)
    own.judge(decided(own))
    waiting = own.extract_list().join(own.table("url_lib").select("id", "layout_hash"), "id")
    by_hand = waiting.groupBy("layout_hash").agg(F.min("id").alias("id")).select("id", F.array(F.lit(1), F.lit(1), F.lit(2)).alias("extractor"))
    own.apply(own.store.write("by_hand", by_hand))
    own.extract_refresh()
    return own


@query("""SELECT 'http://talks.ox.ac.uk/' || page_id AS url, 'T' || page_id || ' & more' AS title, (2000 + page_id % 20) || '-05-03' AS start_time, 'k' || page_id % 3 AS description FROM pages WHERE page_id % 2 = 1""")
def engine_results(spark, sf_dir):
    """Records of all targets: by hand for one page of each layout, by vote for the rest."""
    return extracted(spark, sf_dir).results().select("url", "title", "start_time", "description")


@query("SELECT count(*) FILTER (page_id % 2 = 1) AS extracted, CAST(0 AS BIGINT) AS waiting, CAST(0 AS BIGINT) AS raw FROM pages")
def engine_emptied(spark, sf_dir):
    """What is extracted leaves queue, inbox and raw pages, and is stamped."""
    own = extracted(spark, sf_dir)
    count = lambda df: df.agg(F.count("*")).first()[0]
    row = (count(own.table("url_lib").filter("extractor[0] = 1")), count(own.extract_list()), count(own.pages(own.table("inbox"))))
    return spark.createDataFrame([row], "extracted long, waiting long, raw long")


@query("""SELECT 'http://talks.ox.ac.uk/' || page_id AS url, CAST(CASE WHEN page_id % 2 = 1 THEN 1 ELSE -1 END AS INTEGER) AS is_target FROM pages""")
def engine_restart(spark, sf_dir):
    """A new process takes the tree that the last one fitted, and judges the pages that land then by it."""
    at, pages = tables.scratch(spark, "engine"), site(spark, sf_dir)
    first = engine(spark, at)
    first.ingest(tables.responses(pages.filter("page_id % 3 > 0")), 0)
    first.judge(decided(first))
    second = engine(spark, at)
    second.ingest(tables.responses(pages.filter("page_id % 3 = 0")), 1)
    return second.table("url_lib").select("url", "is_target")


@query("SELECT 'http://talks.ox.ac.uk/' || page_id AS url, 'T' || page_id || ' & more' AS title, CAST(0 AS INTEGER) AS is_target, page_id % 2 AS seminar FROM pages")
def engine_stream(spark, sf_dir):
    """Landed pages taken by the engine as a stream, in four batches."""
    from pagemill.streaming import ingest

    at = tables.scratch(spark, "landing")
    tables.responses(site(spark, sf_dir)).repartition(4, "url").write.parquet(at)
    own = engine(spark)
    ingest.ingest(own, ingest.landed(spark, at, files=1), tables.scratch(spark, "landing-checkpoint")).awaitTermination()
    queue = own.judge_list().select("id", F.col("feature")["1"].alias("seminar"))
    return own.table("url_lib").select("id", "url", "title", "is_target").join(queue, "id").drop("id")


@query("SELECT page_id, 'H' || page_id AS title, (2000 + page_id % 20) || '-05-03' AS start_time, 'D' || page_id AS description FROM pages WHERE page_id % 2 = 1")
def engine_preview(spark, sf_dir):
    """What an extractor would give, without saving it."""
    own = landed(spark, sf_dir)
    own.judge(decided(own))
    made = own.preview(own.extract_list().select("id", F.array(F.lit(2), F.lit(1), F.lit(1)).alias("extractor")))
    return made.join(own.table("url_lib").select("id", "url"), "id").select(key().alias("page_id"), "title", "start_time", "description")


@query("SELECT 'http://talks.ox.ac.uk/' || page_id AS url, CAST(-1 AS INTEGER) AS is_target FROM pages")
def engine_rejudge(spark, sf_dir):
    """Targets sent back from the extractor's queue as no targets."""
    own = landed(spark, sf_dir)
    own.judge(decided(own))
    own.rejudge(own.store.write("back", own.extract_list().select("id", F.lit(-1).alias("decision"))))
    return own.table("url_lib").join(own.non_targets().select("id"), "id").select("url", "is_target")


@query("""SELECT 'May ' || 2000 + page_id % 20 AS tried, 2 AS number, 'T' || page_id || ' & more' AS raw FROM pages WHERE page_id = 7""")
def engine_rule(spark, sf_dir):
    """A rule tried on a waiting page, then added; and the page's raw file, of which the title is read."""
    own = landed(spark, sf_dir)
    (at,) = own.table("url_lib").filter(key() == 7).select("id").first()
    rule = Rule("content", (2,), "div p", match="May [0-9]+")
    tried, number = own.test_rule(at, rule), own.add_rule(2, rule)
    raw = spark.createDataFrame([(own.raw_file("judge", at),)], "html string")
    return raw.select(F.lit(tried).alias("tried"), F.lit(number).alias("number"), parts.native_title(F.col("html")).alias("raw"))


@query("SELECT * FROM (VALUES ('1', 'seminar', 'sum', 2, 4, 5), ('2', 'paragraphs', 'sum', 2, 4, 5)) t(id, name, policy, features, actions, rules)")
def engine_maps(spark, sf_dir):
    """The catalogues that the pages of a user interface show."""
    maps = engine(spark).maps()
    counts = {n: F.lit(maps[n].count()).cast("int") for n in ("features", "actions", "rules")}
    return maps["features"].select("id", "name", "policy", *(c.alias(n) for n, c in counts.items()))


# -- sources


@query(f"WITH {SITE_SQL} SELECT page_id, md5(html) AS content_hash FROM site")
def raw_files(spark, sf_dir):
    """Pages as files named by their ids, read back."""
    at = tables.scratch(spark, "raw-files")
    Path(at).mkdir(parents=True, exist_ok=True)

    def put(rows) -> None:
        for r in rows:
            Path(at, f"{r.page_id}.html").write_text(r.html)

    site(spark, sf_dir).foreachPartition(put)
    return tables.raw_pages(spark, at).select("page_id", text_hash(F.col("html")).alias("content_hash"))


SPACE_XML = """<featurespace name="s" version="1">
  <feature id="2" name="tions" policy="sum"><reg policy="count">tion</reg></feature>
  <feature id="10" name="common" policy="sum"><list policy="sum">common.wd</list><reg weight="2">qu</reg></feature>
  <feature id="1" name="ending" policy="max"><reg policy="exist">ing\\b</reg><reg policy="exist">tion</reg></feature>
</featurespace>"""


def files(spark: SparkSession, label: str, **made: str) -> str:
    at = tables.scratch(spark, label)
    Path(at).mkdir(parents=True, exist_ok=True)
    for name, text in made.items():
        Path(at, name.replace("__", ".")).write_text(text)
    return at


@query(f"WITH {SPACE_SQL} SELECT doc_id, CAST(f_2 AS BIGINT) AS f_2, CAST(f_10 AS BIGINT) AS f_10, f_1 FROM f")
def space_from_xml(spark, sf_dir):
    """A feature space and its lexicon from files, computed over all documents."""
    at = files(spark, "space", space__xml=SPACE_XML, common__wd="\n".join(SPACE[1].rules[0].patterns) + "\n")
    made = features.with_features(read(spark, sf_dir, "documents"), specs.feature_space(f"{at}/space.xml"), {"text": F.col("text")})
    return made.select("doc_id", "f_2", "f_10", "f_1")


@query("SELECT page_id, 'H' || page_id AS title, 'k' || page_id % 3 AS place FROM pages")
def rules_from_xml(spark, sf_dir):
    """An entity and its rules from files; a rule is added, its file written and read again."""
    at = files(
        spark, "rules", entity__xml='<entity name="talk"><attribute id="1" name="Title" db-col="title" max-len="64">title.xml</attribute><attribute id="2" name="Place" db-col="place" max-len="8">place.xml</attribute></entity>',
        title__xml='<ruleset><rule id="1" description="heading" on="content"><scope sel="div h1" target="html"/><actions><action id="1"/><action id="2"/></actions></rule></ruleset>',
    )
    specs.add_rule(specs.entity(f"{at}/entity.xml", at).attributes[2], Rule("tag", after='class="', before='"'), at)
    pages = site(spark, sf_dir)
    return extract.with_records(pages, specs.entity(f"{at}/entity.xml", at), F.array(F.lit(1), F.lit(1)), parts.native(F.col("html"), F.col("url"))).select("page_id", "title", "place")


@query("SELECT page_id, 'May ' || 2000 + page_id % 20 AS value FROM pages")
def rule_from_form(spark, sf_dir):
    rule = specs.rule_from_form({"on": "text", "match": "May [0-9]+", "after": "", "before": "", "actions": ["2"]})
    pages = site(spark, sf_dir)
    return extract.with_rule_values(pages, {"value": rule}, parts.native(F.col("html"), F.col("url"))).select("page_id", "value")


@query("SELECT n_nationkey, n_name, n_regionkey FROM nation WHERE n_regionkey = 2")
def database_table(spark, sf_dir):
    """Rows put into a database in the driver's process and read back; the filter goes to the database."""
    at = "jdbc:derby:memory:pagemill;create=true"
    tables.write_jdbc(read(spark, sf_dir, "nation"), at, "nation", driver="org.apache.derby.iapi.jdbc.AutoloadedDriver")
    return tables.jdbc(spark, at, "nation", where='"n_regionkey" = 2', driver="org.apache.derby.iapi.jdbc.AutoloadedDriver").select("n_nationkey", "n_name", "n_regionkey")


# -- stamps


@query("SELECT page_id AS id, page_id % 3 = 0 AS stamped FROM pages")
def touch_extract(spark, sf_dir):
    """The time of the last extraction, set to now."""
    table = read(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), F.lit(None).cast("timestamp").alias("last_extract_ts"))
    out = store.touched(table, table.filter("id % 3 = 0"), "last_extract_ts")
    recent = F.abs(F.unix_timestamp(F.current_timestamp()) - F.unix_timestamp("last_extract_ts")) < 3600
    return out.select("id", F.coalesce(recent, F.lit(False)).alias("stamped"))


# -- trees, on one feature of two values: its groups are the leaves that SQL can make too. The label is quality,
# turned round where the feature is 0, so that the groups have different majorities.

ONE = ["f_1"]
LEAF_SQL = f"""{SPACE_SQL}, t AS (SELECT f.doc_id, f_1, (quality + 1 - f_1) % 2 AS label FROM f JOIN labels USING (doc_id)),
  d AS (SELECT *, (row_number() OVER (PARTITION BY label ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) - 1) % 10 AS fold FROM t),
  g AS (SELECT f_1, count(*) AS n, count(*) FILTER (label = 1) AS ones FROM t GROUP BY f_1),
  leaf AS (SELECT f_1, CAST(CASE WHEN 2 * ones > n THEN 1 ELSE 0 END AS INTEGER) AS decision, 100.0 * greatest(ones, n - ones) / n AS confidence FROM g)"""
ROUTE_SQL = "CASE WHEN confidence > 70 THEN CASE WHEN decision IN (1, 2) THEN 'extract' ELSE 'discard' END ELSE 'review' END"


def labelled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    made = featured(spark, sf_dir).withColumn("f_1", F.col("f_1").cast("double"))
    labels = read(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label"))
    table = evaluate.feature_table(made, labels, ONE, "doc_id")
    return made, table.withColumn("label", ((F.col("label") + 1 - F.col("f_1")) % 2).cast("int"))


@query(f"WITH {LEAF_SQL} SELECT doc_id, decision, round(confidence, 6) AS confidence, {ROUTE_SQL} AS route FROM f JOIN leaf USING (f_1)")
def tree_of_one_feature(spark, sf_dir):
    made, table = labelled(spark, sf_dir)
    out = judge.judged(made.select("doc_id", *ONE), judge.learn(table, ONE))
    return out.select("doc_id", "decision", F.round("confidence", 6).alias("confidence"), judge.route(F.col("decision"), F.col("confidence")).alias("route"))


@query(f"WITH {LEAF_SQL} SELECT doc_id, decision, round(confidence, 6) AS confidence FROM f JOIN leaf USING (f_1)")
def tree_saved(spark, sf_dir):
    """A tree saved, loaded and used."""
    made, table = labelled(spark, sf_dir)
    at = tables.scratch(spark, "tree")
    judge.learn(table, ONE).save(at)
    return judge.judged(made.select("doc_id", *ONE), judge.Judge.load(at)).select("doc_id", "decision", F.round("confidence", 6).alias("confidence"))


@query(f"WITH {LEAF_SQL} SELECT doc_id AS id, decision, round(confidence, 6) AS confidence, {ROUTE_SQL} AS route FROM f JOIN leaf USING (f_1) WHERE f_10 > 5")
def queue_judged_anew(spark, sf_dir):
    """A queue judged by a tree learned after it was filled."""
    made, table = labelled(spark, sf_dir)
    queue = made.filter("f_10 > 5").select(F.col("doc_id").alias("id"), F.lit(0).alias("decision"), F.lit(50.0).alias("confidence"), F.create_map(F.lit("1"), F.col("f_1").cast("long")).alias("feature"))
    out = judge.refreshed(queue, judge.learn(table, ONE), ONE)
    return out.select("id", "decision", F.round("confidence", 6).alias("confidence"), "route")


@query(f"""WITH {LEAF_SQL}, r AS (SELECT k.fold AS out, t.f_1, count(*) AS n, count(*) FILTER (label = 1) AS ones FROM d t JOIN (SELECT DISTINCT fold FROM d) k ON t.fold <> k.fold GROUP BY ALL),
  p AS (SELECT t.fold, label = 1 AS yes, 2 * r.ones > r.n AS said FROM d t JOIN r ON t.fold = r.out AND t.f_1 = r.f_1)
  SELECT s.theta, CAST(fold AS INTEGER) AS fold, count(*) FILTER (yes AND said) AS tp, count(*) FILTER (NOT yes AND NOT said) AS tn, count(*) FILTER (NOT yes AND said) AS fp, count(*) FILTER (yes AND NOT said) AS fn
  FROM p, (VALUES {', '.join(f"('{s}')" for s in evaluate.SETTINGS)}) s(theta) GROUP BY ALL""")
def cv_of_one_feature(spark, sf_dir):
    """Ten folds under all settings; with one feature of two values they come to the same."""
    _, table = labelled(spark, sf_dir)
    return evaluate.cross_validated(table, ONE, "doc_id")
