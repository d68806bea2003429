"""The verbs together, in batches and as a stream."""

import re

from pyspark.sql import functions as F

from pagemill.operators.admission import Policy
from pagemill.plans.engine import Engine
from pagemill.sources.specs import Attribute, Entity, Feature, FeatureRule, Rule
from pagemill.streaming import ingest

BODY = "<html><head><title>{t}</title></head><body><div class='{c}'><h1>{t}</h1><p>{n}</p></div></body></html>"
SCHEMA = "url string, status int, content_type string, body string"


def engine(spark, root):
    space = [Feature("1", "talk", (FeatureRule("reg", ("talk",)),)), Feature("2", "p", (FeatureRule("reg", ("<p>",), sel="html"),))]
    entity = Entity("e", {1: Attribute(1, "Title", "title", 32, rules={1: Rule("title")})})
    return Engine(spark, str(root), space, entity, Policy())


def page(i, kind="a", word="talk"):
    return (f"http://x/{i}", 200, "text/html", BODY.format(t=f"T{i}", c=kind, n=word * (i % 3 + 1)))


def test_session(spark, tmp_path):
    e = engine(spark, tmp_path)
    rows = [page(i, "a" if i < 6 else "b", "talk" if i < 6 else "none") for i in range(8)]
    acted = e.ingest(spark.createDataFrame(rows, SCHEMA))
    assert {r.action for r in acted.collect()} == {"new"} and e.judge_list().count() == 8 and e.table("url_lib").count() == 8
    ids = {r.url: r.id for r in e.table("url_lib").collect()}
    e.judge(spark.createDataFrame([(ids["http://x/0"], 1), (ids["http://x/1"], 1), (ids["http://x/7"], -1)], "id long, decision int"))
    assert e.extract_list().count() == 2 and e.judge_list().count() == 5 and e.raw_file("judge", ids["http://x/7"]) is None
    one = spark.createDataFrame([(ids["http://x/0"], [1])], "id long, extractor array<int>")
    assert e.preview(one).first().title == "T0" and e.results().count() == 0
    assert e.test_rule(ids["http://x/1"], Rule("title", match="[0-9]")) == "1"
    e.apply(one)
    assert e.extract_refresh().count() == 0  # the other page has the same layout
    assert {r.title for r in e.results().collect()} == {"T0", "T1"}
    again = {r.url: r.action for r in e.ingest(spark.createDataFrame([rows[0], page(1, "a", "new"), ("http://x/2", 404, "text/html", "")], SCHEMA)).collect()}
    assert again == {"http://x/0": "unchanged", "http://x/1": "changed", "http://x/2": "gone"}
    assert {r.title for r in e.results().collect()} == {"T0"}
    e.judge_refresh()
    assert e.table("training").count() == 3
    assert e.add_rule(1, Rule("url")) == 2 and e.maps()["rules"].count() == 2


def test_rejudge(spark, tmp_path):
    e = engine(spark, tmp_path)
    e.ingest(spark.createDataFrame([page(0)], SCHEMA))
    i = e.table("url_lib").first().id
    e.judge(spark.createDataFrame([(i, 2)], "id long, decision int"))
    assert e.extract_list().count() == 1
    e.rejudge(spark.createDataFrame([(i, -1)], "id long, decision int"))
    assert e.extract_list().count() == 0 and e.table("inbox").count() == 0 and e.non_targets().count() == 1


def test_stream(spark, tmp_path):
    e = engine(spark, tmp_path / "store")
    for k in range(2):
        spark.createDataFrame([page(k), page(k + 10)], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    ingest.ingest(e, ingest.landed(spark, str(tmp_path / "in"), files=1), str(tmp_path / "cp")).awaitTermination()
    assert e.table("url_lib").count() == 4 and e.table("epochs").count() == 2
    assert e.ingest(spark.createDataFrame([page(5)], SCHEMA), 0).count() == 0  # a repeated batch
    assert e.table("url_lib").filter(F.col("url") == "http://x/5").count() == 0


def test_pages_are_parsed_in_small_batches(spark):
    from pagemill.operators import extract, parts

    pages = spark.range(20).selectExpr("'u' AS url", "'<title>t</title>' AS html").coalesce(1)
    one = parts.with_parts(pages, ["title", "html"])
    two = extract.with_scopes(pages, [Rule("content", sel="title")])
    for df in (one, two):  # Arrow takes ten thousand pages at a time
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan and df.count() == 20


def test_pages_are_dealt_over_tasks_and_parsed_once(spark, tmp_path, monkeypatch):
    from pagemill.operators import parts
    from pagemill.plans import engine as verbs

    monkeypatch.setattr(verbs, "TASK_PAGES", 2)
    parsed = spark.sparkContext.accumulator(0)

    def counting(*a, f=parts.page_parts):
        parsed.add(1)
        return f(*a)

    monkeypatch.setattr(parts, "page_parts", counting)
    e = engine(spark, tmp_path)
    e.ingest(spark.createDataFrame([page(i) for i in range(20)], SCHEMA).coalesce(1))
    assert parsed.value == 20  # for hashes, title and features
    assert e.pages(e.table("inbox")).rdd.getNumPartitions() >= 10


def test_decisions_use_the_features_kept_at_ingestion(spark, tmp_path, monkeypatch):
    from pagemill.operators import parts

    e = engine(spark, tmp_path)
    e.ingest(spark.createDataFrame([page(i) for i in range(6)], SCHEMA))
    other = Engine(spark, str(tmp_path), [Feature("1", "T", (FeatureRule("reg", ("T",), sel="title"),)), Feature("2", "p", (FeatureRule("reg", ("<p>",), sel="html"),))], e.entity, Policy())
    chosen = e.table("inbox").filter("id < 3").selectExpr("id", "1 AS decision")
    other.judge(e.store.write("c", chosen))  # another space: its features are made anew
    assert {(r.f_1, r.f_2) for r in other.table("training").collect()} == {(1.0, 1.0)}
    monkeypatch.setattr(parts, "page_parts", None)  # the one space: no page is parsed
    later = engine(spark, tmp_path)
    waiting = later.table("inbox").join(later.table("url_lib").select("id", "url"), ["id", "url"])
    assert sorted(r.f_1 for r in later._vectors_of(waiting.filter("id >= 3")).collect()) == sorted(float(int(r.url[-1]) % 3 + 1) for r in waiting.filter("id >= 3").collect())


def test_extraction_parses_a_page_once_for_parts_and_scopes(spark, tmp_path):
    rules = {1: Rule("title"), 2: Rule("content", sel="div > h1", target="html"), 3: Rule("content", sel="p", target="text"), 4: Rule("content", sel="p:x"), 5: Rule("layout", match="class")}
    entity = Entity("e", {1: Attribute(1, "Title", "title", 32, rules=rules), 2: Attribute(2, "Place", "place", 32, rules={1: Rule("content", sel="img"), 2: Rule("text", match="talk")})})
    e = Engine(spark, str(tmp_path), engine(spark, tmp_path).space, entity, Policy())
    e.ingest(spark.createDataFrame([page(i) for i in range(6)], SCHEMA))
    chosen = e.store.write("c", e.table("inbox").selectExpr("id", "array(int(id), 2) AS extractor"))
    made = e.preview(chosen)
    (udfs,) = re.findall(r"BatchEvalPython \[(.*?)\], \[", made._jdf.queryExecution().executedPlan().toString())
    assert udfs.count("run(") == 1
    rows = made.join(e.table("url_lib").select("id", F.element_at(F.split("url", "/"), -1).alias("n")), "id").collect()
    for r in rows:
        n = int(r.n)
        assert r.title == {1: f"T{n}", 2: f"<h1>T{n}</h1>", 3: "talk" * (n % 3 + 1), 4: "", 5: "class", 6: ""}[r.id] and r.place == " ".join(["talk"] * (n % 3 + 1))


def test_decisions_without_a_vote_leave_records_alone(spark, tmp_path):
    e = engine(spark, tmp_path / "a")
    e.ingest(spark.createDataFrame([page(i) for i in range(3)], SCHEMA))
    kept, ids = e.store._versions("sem_info"), sorted(r.id for r in e.table("url_lib").collect())
    e.judge(spark.createDataFrame([(ids[0], 1), (ids[1], -1)], "id long, decision int"))
    assert e.store._versions("sem_info") == kept and [r.id for r in e.extract_list().collect()] == ids[:1]
    e.judge(spark.createDataFrame([(ids[0], -1), (ids[2], -1)], "id long, decision int"))
    assert e.store.batch_numbers("raw") == []  # nothing waits: raw pages go all the same
    other = Engine(spark, str(tmp_path / "b"), e.space, Entity("e", {1: Attribute(1, "Venue", "venue", 32)}), Policy())
    other.ingest(spark.createDataFrame([page(0)], SCHEMA))
    assert "venue" in other.results().columns
