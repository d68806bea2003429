"""Corner cases of the operators on rows made by hand."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from pagemill.functions import html as H
from pagemill.functions import regex as X
from pagemill.functions import scalars as S
from pagemill.operators import admission, evaluate, extract, features, judge, parts, store
from pagemill.sources import specs
from pagemill.sources.specs import Attribute, Entity, Feature, FeatureRule, Rule


def value(spark, column, **given_):
    row = spark.createDataFrame([tuple(given_.values()) or (0,)], ", ".join(f"{k} {'string' if isinstance(v, str) else 'long'}" for k, v in given_.items()) or "x int")
    return row.select(column.alias("v")).first().v


TEXTS = ["Drévillo et al", "a\rb <a\rb> <c\nd>", "et_ et éet et", "ſeminar seminar", "", "x y", "Ab aB\nab$", "line\r"]


@pytest.mark.parametrize("pattern", [r"\bet\b", r"\w+", r"a.b", r"^a", "seminar", r"(?:b)$", r"[\b]", r"\\b", r"\Bet", r"[]a[&&b]", r"[^]\]b]+", r"\be?t", r"\be+t", r"\w+\b", r"a?\b", r"\x62\b", r"(?:a|e)\bt?", r"\ba|\bb", r"\b\w\b"])
def test_regex_counts_like_ascii_python(spark, pattern):
    df = spark.createDataFrame([(t,) for t in TEXTS], "t string")
    ours = [r.n for r in df.select(X.match_count(F.col("t"), pattern).alias("n")).collect()]
    assert ours == [len(re.findall(pattern, t, re.IGNORECASE | re.ASCII)) for t in TEXTS]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="abé<>\r\n_ \t.1", max_size=12), min_size=1, max_size=20))
def test_regex_property(spark, texts):
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select(X.match_count(F.col("t"), r"\ba.").alias("a"), X.without_tags(F.col("t")).alias("b"), X.between(F.col("t"), "", "b").alias("c")).collect()
    for t, r in zip(texts, got):
        m = re.search("^(.*?)b", t, re.DOTALL)
        assert (r.a, r.b, r.c) == (len(re.findall(r"\ba.", t, re.ASCII | re.I)), re.sub("<.*?>", "", t), m[1] if m else "")


def test_match_groups_and_bad_patterns(spark):
    c = F.col("t")
    assert value(spark, X.found_joined(c, "[a-c]"), t="abz") == "a b"
    assert value(spark, X.found_joined(c, "(?P<n_1>[a-c])z"), t="abz cz") == "b c"
    assert value(spark, X.found_joined(c, "("), t="abz") == ""
    with pytest.raises(ValueError):
        X.found_joined(c, "(a)(b)")
    assert value(spark, X.between(c, "", ""), t="abc") == "abc"
    assert value(spark, X.between(c, "(x)(y)", "z"), t="xy1z") == "1"
    assert value(spark, X.between(c, "(", "z"), t="xy1z") == ""
    assert value(spark, X.between(c, "q", "z"), t="xy1z") == ""
    assert value(spark, X.match_count(c, ""), t="x" * 29) == 30


def lits(*v):
    return [F.lit(x).cast("long") for x in v]


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.integers(-20, 20), min_size=2, max_size=5))
def test_policies(spark, v):
    below = sum(v[1:]) // len(v[1:])
    want = {"sum": sum(v), "max": max(v), "min": min(v), "avg": sum(v) // len(v), "prod": sum(v) // len(v), "div": v[0] if below == 0 else v[0] // below}
    row = spark.range(1).select(*(features.POLICIES[p](lits(*v)).alias(p) for p in want)).first()
    assert row.asDict() == want


def test_policy_errors():
    for p in ("max", "min", "avg"):
        with pytest.raises(ValueError):
            features.POLICIES[p]([])
    with pytest.raises(ValueError):
        features.POLICIES["div"](lits(1))
    with pytest.raises(ValueError):
        FeatureRule("reg", ("a",), policy="sum")
    with pytest.raises(ValueError):
        FeatureRule("xml", ("a",))
    with pytest.raises(KeyError):
        features.feature_value(Feature("1", "a", (FeatureRule("reg", ("a",), sel="nope"),)), {"text": F.lit("")})


def test_vector_order():
    space = [Feature("2", "b", ()), Feature("10", "a", ())]
    assert features.names_in_document_order(space) == ["b", "a"] and features.names_in_vector_order(space) == ["a", "b"]


def test_specs_from_xml(tmp_path, spark):
    (tmp_path / "w.wd").write_text("\\bthe\\b\nof\n\n")
    (tmp_path / "empty.wd").write_text("")
    (tmp_path / "space.xml").write_text(
        '<featurespace><feature id="1" name="n" policy="div"><reg sel="text" weight="2">a&lt;b</reg>\n<list policy="max">w.wd</list></feature>'
        '<feature id="2" name="m"><list>gone.wd</list><list>empty.wd</list></feature></featurespace>'
    )
    space = specs.feature_space(str(tmp_path / "space.xml"))
    assert [r.kind for r in space[0].rules] == ["reg", "list"] and space[0].rules[0].patterns == ("a<b",) and space[0].rules[1].patterns == (r"\bthe\b", "of")
    assert space[1].rules[0].patterns == () and space[1].rules[1].patterns == ("",)
    assert value(spark, features.feature_value(space[1], {"text": F.col("t")}), t="abc") == 4
    (tmp_path / "e.xml").write_text('<entity name="s"><attribute id="1" name="Title" description="d" db-col="title" max-len="5">t.xml</attribute></entity>')
    (tmp_path / "t.xml").write_text(
        '<ruleset><rule id="1" description="x" on="content"><scope sel="h1" target="text"/><match reg="a"/><substring after="" before="b"/><actions><action id="2"/></actions></rule></ruleset>'
    )
    e = specs.entity(str(tmp_path / "e.xml"), str(tmp_path))
    rule = e.attributes[1].rules[1]
    assert rule == Rule("content", (2,), "h1", "text", "a", "", "b", "x")
    assert specs.add_rule(e.attributes[1], Rule("title", (1,)), str(tmp_path)) == 2
    again = specs.entity(str(tmp_path / "e.xml"), str(tmp_path))
    assert again.attributes[1].rules == e.attributes[1].rules
    with pytest.raises(ValueError):
        Entity("s", {2: Attribute(2, "", "", 1)})


PAGE = """<!DOCTYPE html><html><head><title>A &amp; B</title><title>C</title><meta name="Keywords" content="k1"><meta name="keywords" content="k2">
<meta name="description" content="d"><link href="s.css"><script src="x.js">var t="</p>";</script></head><body class="main" data-x="1"><!-- c --><p>one<p>two <b>bold
<ul><li>1<li>2</ul><div id="d" class="ad big" title="t">in<img src="/i.png"><a href="rel">l</a><input type=text class=q></div></body></html>"""


def test_html_parts():
    p = parts.page_parts(PAGE, "http://h.org/a/b", ["text", "html", "tag", "title", "keyword", "description", "layout", "url"])
    assert p["title"] == "A & B C" and p["keyword"] == "k1 k2" and p["description"] == "d"
    assert 'href="http://h.org/a/s.css"' in p["html"] and 'src="http://h.org/i.png"' in p["html"] and 'href="rel"' in p["html"]
    assert "one\ntwo " in p["text"] and 'var t="</p>";' in p["text"] and "c" not in p["text"].split("\n")
    assert p["layout"] == '<body class="main"><ul></ul><div class="ad big" title=""><input></div></body>'
    assert 'var t' not in parts.page_parts(PAGE, "", ["text"], script_text=False)["text"]
    assert H.layout("no body at all") == "" and H.layout(PAGE.replace("one", "other words")) == p["layout"]


def test_selectors():
    root = H.parse(PAGE)
    pick = lambda s: [n.tag for n in H.select(root, H.compiled_selector(s))]
    assert pick("body > p") == ["p", "p"] and pick("div.ad") == ["div"] and pick("#d input.q") == ["input"] and pick('[title="t"]') == ["div"] and pick("ul li, title") == ["title", "title", "li", "li"]
    for bad in ("p:first-child", "p +", ">", "a ~ b"):
        with pytest.raises(ValueError):
            H.compiled_selector(bad)


def test_truncated_and_odd_html(spark):
    rows = [(1, "u", "<p><b>cut <i"), (2, "u", ""), (3, "u", None), (4, None, "<![broken <p>x</p>"), (5, "u", "plain")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert parts.with_parts(df, ["text", "layout"]).count() == 5
    assert parts.hashed(df).filter("layout_hash is null").count() == 0


def test_extraction_pipeline(spark):
    df = spark.createDataFrame([(1, "http://h.org/x", PAGE), (2, "http://h.org/y", None)], "page_id long, url string, html string")
    rules = {
        "a": Rule("content", (2,), "li"), "b": Rule("content", (), "div", "html"), "c": Rule("content", (), "p:bad"), "d": Rule("title", (), match="(a)|b"),
        "e": Rule("title", (), match="(", after="x"), "f": Rule("title", (3,)), "g": Rule("content", (1,), "", "html", match="<li>.*?</li>"),
    }
    row = extract.with_rule_values(df, rules, parts.native(F.col("html"), F.col("url"))).orderBy("page_id").first()
    assert row.a == "1 2" and row.b.startswith('<div id="d"') and row.c == "" and row.e == "" and row.f == "None" and row.g == "1 2"
    with pytest.raises(KeyError):
        extract.attribute_value(Rule("title", (9,)), F.lit("x"))


def test_records_truncate_characters_and_blank(spark):
    df = spark.createDataFrame([(1, "http://h.org/x", "<title>ééééé</title>")], "page_id long, url string, html string")
    e = Entity("e", {1: Attribute(1, "t", "title", 3, rules={1: Rule("title")}), 2: Attribute(2, "p", "place", 9, rules={1: Rule("url")})})
    r = extract.with_records(df, e, F.array(F.lit(1), F.lit(0)), parts.native(F.col("html"), F.col("url"))).first()
    assert (r.title, r.place) == ("ééé", "")
    r = extract.with_records(df, e, F.lit(None).cast("array<int>"), parts.native(F.col("html"), F.col("url"))).first()
    assert (r.title, r.place) == ("", "")


def test_dates(spark):
    for text, day in {" Monday, 3rd March 2015 ": "2015-03-03", "March 3, 2015": "2015-03-03", "2015-03-03": "2015-03-03", "soon": "None", "": "None"}.items():
        assert value(spark, extract.compatible(extract.parsed_date(F.col("t"))), t=text) == day
    for text, at in {"4:30 pm": "16:30:00", "16:30": "16:30:00", "4pm": "16:00:00", "noonish": "None"}.items():
        assert value(spark, extract.compatible(extract.parsed_time(F.col("t"))), t=text) == at
    for number, text, want in ((3, "Tue 3 Mar 2015 at 5pm", "2015-03-03"), (3, "3-Mar-15", "2015-03-03"), (3, "soon", "None"), (4, "Tue 3 Mar 2015 at 5pm", "17:00:00"), (4, "16:30", "16:30:00")):
        assert value(spark, extract.attribute_value(Rule("title", (number,)), F.col("t")), t=text) == want


def test_vote_ties_and_unknown(spark):
    rows = [(1, "L", [2]), (2, "L", [1]), (3, "L", [-1]), (4, "L", [-1]), (5, "M", [-1])]
    lib = spark.createDataFrame(rows, "id long, layout_hash string, extractor array<int>")
    assert [tuple(r) for r in extract.elected(lib).collect()] == [("L", "[1]", 1)]
    out = extract.by_vote(lib.select("id", "layout_hash"), lib).orderBy("id").collect()
    assert out[0].voted == [1] and out[4].voted is None


def test_extractor_text(spark):
    for text in ("[1, 0, 3]", "[]", "[-1]"):
        assert value(spark, S.from_extractor(S.to_extractor(F.col("t"))), t=text) == text


def test_scalars(spark):
    assert value(spark, S.short_url(F.col("t")), t="x" * 99) == "x" * 99
    assert value(spark, S.short_url(F.col("t")), t="a" * 50 + "b" * 50) == "a" * 46 + "......" + "b" * 46
    assert value(spark, S.js_string(F.col("t")), t="a\nb") == "a\\ b"
    assert value(spark, S.absolute(F.col("t"), F.lit("../c")), t="http://h/a/b") == "http://h/c"
    assert value(spark, S.host(F.col("t")), t="http://u:p@H.Org:80/x") == "h.org"


def test_admission(spark):
    p = admission.Policy()
    cases = {
        "http://www.ox.ac.uk/a": True, "http://ox.ac.uk/": True, "http://box.ac.uk/": False, "http://webauth.ox.ac.uk/": False, "http://a.ox.ac.uk/x.PDF": False,
        "http://a.ox.ac.uk/x.com": False, "http://a.ox.ac.uk/News/": False, "http://a.ox.ac.uk/?a=1": True, "http://a.ox.ac.uk/learning/": True,
        "http://a.ox.ac.uk/podcasts./learning/": False, "http://a.ox.ac.uk/p.php?x": False, "http://a.ox.ac.uk/past-x/": False, "http://a.ox.ac.uk/past-xy/": True,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string")
    assert {r.url: r.ok for r in df.select("url", admission.link_admitted(F.col("url"), p).alias("ok")).collect()} == cases


def test_crawl_actions(spark):
    lib = spark.createDataFrame([(1, "http://a/1", "x"), (2, "http://a/2", None)], "id long, url string, h string").select("id", "url", F.coalesce(F.md5(F.col("h").cast("binary")), F.lit("")).alias("content_hash"))
    rows = [
        ("http://a/1", 200, "text/html", "x"), ("http://a/2", 200, "text/html; charset=x", "y"), ("http://a/3", 200, "text/html", "z"), ("http://a/1", 404, "text/html", ""),
        ("http://a/4", 404, "text/html", ""), ("http://a/5", 200, "application/pdf", ""), ("http://a/6", 200, None, ""), ("http://" + "a" * 505, 200, "text/html", ""),
        ("http://" + "a" * 506, 200, "text/html", ""), ("http://a/?u=facebook.com", 200, "text/html", ""),
    ]
    df = spark.createDataFrame(rows, "url string, status int, content_type string, body string")
    got = sorted(r.action for r in admission.crawl_action(df, lib).collect())
    assert got == sorted(["unchanged", "changed", "new", "gone", "missing", "content_type", "content_type", "new", "url_too_long", "denied_domain"])


def test_routes_and_overrides(spark):
    df = spark.createDataFrame([(1, 1, 70.0), (2, 2, 70.1), (3, -1, 99.0), (4, 0, 99.0)], "id long, decision int, confidence double")
    assert [r.r for r in df.orderBy("id").select(judge.route(F.col("decision"), F.col("confidence")).alias("r")).collect()] == ["review", "extract", "discard", "discard"]
    human = spark.createDataFrame([(1, -1)], "id long, label int")
    first = judge.with_human(df, human).orderBy("id").first()
    assert (first.decision, first.confidence) == (-1, 100.0)
    none = judge.judged(df.select("id"), None).first()
    assert (none.decision, none.confidence) == (-1, 0.0)


def test_tree_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(i, float(i % 7), 1 if i % 7 > 3 else -1) for i in range(100)], "id long, f_1 double, label int")
    tree = judge.learn(df, ["f_1"])
    out = tree.judged(df)
    assert out.filter("decision <> label").count() == 0 and "If" in tree.text()
    assert tree.dot().startswith("digraph tree {") and "f_1 <= 3.5" in tree.dot() and tree.dot().count("shape=box") == 2
    tree.save(str(tmp_path / "t"))
    assert judge.Judge.load(str(tmp_path / "t")).judged(df.drop("label")).count() == 100
    assert judge.learn(df.limit(0), ["f_1"]) is None


def test_rates_without_zero_division(spark):
    df = spark.createDataFrame([(1, 1), (0, 1), (-1, -1)], "label int, decision int")
    r = evaluate.rates(evaluate.confusion(df)).first()
    assert (r.tp, r.tn, r.fp, r.fn, r.recall, r.precision) == (1, 1, 1, 0, 1.0, 0.5)
    r = evaluate.rates(evaluate.confusion(df.limit(0))).first()
    assert (r.tp, r.recall, r.f) == (0, None, None)


def test_folds_are_stratified(spark):
    df = spark.createDataFrame([(i, i % 3) for i in range(90)], "id long, label int")
    assert {r["count"] for r in evaluate.with_fold(df, "label", "id").groupBy("label", "fold").count().collect()} == {3}


def test_numbers_do_not_depend_on_slices(spark, monkeypatch):
    df = spark.createDataFrame([(f"u{i % 300}-{i}", i % 2) for i in range(500)], "url string, kind int")
    few = {r.url: r.id for r in store.numbered(df, 7).collect()}
    within = {r.url: r.id for r in store.numbered(df, 0, within="kind").collect()}
    assert sorted(few.values()) == [*range(8, 508)] and sorted(within.values()) == sorted([*range(1, 251)] * 2)
    monkeypatch.setattr(store, "SLICE_ROWS", 0.1)
    assert {r.url: r.id for r in store.numbered(df, 7).collect()} == few and {r.url: r.id for r in store.numbered(df, 0, within="kind").collect()} == within


def test_store_versions(spark, tmp_path):
    s = store.Store(spark, str(tmp_path), keep=1)
    s.reset()
    lib = s.read("url_lib")
    rows = store.stubs(spark.createDataFrame([(u,) for u in ("b", "a", "c", "a")], "url string"), 10)
    s.write("url_lib", lib.unionByName(rows))
    got = s.read("url_lib")
    assert sorted(r.id for r in got.collect()) == [11, 12, 13] and got.filter("extractor = array(-1)").count() == 3
    assert s._versions("url_lib") == [1, 2]
    s.write("url_lib", store.upserted(got, got.filter("url = 'a'").withColumn("title", F.lit("t"))))
    assert s.read("url_lib").filter("title = 't'").count() == 1 and s.read("url_lib").count() == 3
    with pytest.raises(FileNotFoundError):
        s.read("nothing")


def test_raw_page_files(spark, tmp_path):
    from pagemill.sources import tables

    for name, body in {"7": "<p>é</p>", "8.html": "<p>8</p>", "notes.txt": "x"}.items():
        (tmp_path / name).write_text(body)
    assert {r.page_id: r.html for r in tables.raw_pages(spark, str(tmp_path)).collect()} == {7: "<p>é</p>", 8: "<p>8</p>"}


def test_csv_quotes(spark, tmp_path):
    from pagemill.sources import tables

    rows = spark.createDataFrame([(1, 'a,"b"', 2), (2, None, None)], tables.LABELS)
    tables.write_csv(rows, str(tmp_path / "c"))
    assert {tuple(r) for r in tables.labelled_csv(spark, str(tmp_path / "c")).collect()} >= {(1, 'a,"b"', 2)}


def test_rule_from_form():
    form = {"on": "content", "sel": "h1", "target": "html", "match": "", "after": "", "before": "x", "actions": ["1", "2"]}
    assert specs.rule_from_form(form) == Rule("content", (1, 2), "h1", "html", None, "", "x", "")


def test_frontier_depth_and_known(spark):
    lib = spark.createDataFrame([("http://ox.ac.uk/a",)], "url string")
    found = spark.createDataFrame([("http://ox.ac.uk/a",), ("http://ox.ac.uk/b",), ("http://ox.ac.uk/b",), ("http://else.org/",)], "url string")
    assert [r.url for r in admission.frontier(found, lib).collect()] == ["http://ox.ac.uk/b"]
    assert admission.frontier(found, lib, depth=4).count() == 0


def test_cv_report_is_the_whole_report(spark, sf_dir, monkeypatch):
    from pagemill.operators import evaluate
    from pagemill.plans import queries

    learned = []
    monkeypatch.setattr(evaluate, "learn", lambda rows, columns, **named: learned.append((named["impurity"], named["min_leaf"], named["depth"])))
    assert {r.theta for r in queries.cv_report(spark, sf_dir).collect()} == set(evaluate.SETTINGS)
    assert learned == [s for s in evaluate.SETTINGS.values() for _ in range(10)]


CUT = '<html><body><title>a &amp; b&&&amp</title><article><h1>h&amp</h1></article><div class="ad" title="x&lt">&amp;lt; &lt &notit; &#65; &eacute;</div><script>a&amp&b</script></body></html>'


def test_cut_references_in_scopes(spark):
    pages = spark.createDataFrame([("u", CUT)], "url string, html string")
    rules = {"heading": Rule("content", (), "article > h1"), "ad": Rule("content", (), "div.ad"), "ads": Rule("content", (), "div.ad", "html")}
    row = extract.with_rule_values(pages, rules, {"url": F.col("url")}).first()
    assert (row.heading, row.ad) == ("h&amp", "&lt; &lt &notit; A é")
    assert row.ads == '<div class="ad" title="x&amp;lt">&amp;lt; &amp;lt &amp;notit; A é</div>'


def test_cut_references_in_parts():
    p = parts.page_parts(CUT, "", ["text", "title", "html"])
    assert p["title"] == "a & b&&&amp" and p["text"].split("\n")[:2] == ["a & b&&&amp", "h&amp"]
    assert "<script>a&amp&b</script>" in p["html"] and "<h1>h&amp;amp</h1>" in p["html"] and parts.page_parts("&", "", ["text"])["text"] == "&"


def test_parts_of_references_cut_anywhere_are_those_of_sql(spark, tmp_path):
    """Titles and texts end at any character of any reference that the SQL knows, numbers too."""
    import duckdb

    from pagemill.plans import queries

    cuts = ["a" + r[:n] for r in [*parts.ENTITIES, "&amp;#39;", "&amp;amp;", "&#39;&#39;"] for n in range(1, len(r) + 1)]
    rows = [(i, "u", f"<html><head><title>{c}</title></head><body><article><h1>{c}</h1><p>{c}</p></article></body></html>") for i, c in enumerate(cuts)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    for name, columns in (("html_parts", "page_id, title, text"), ("layout_hash_udf", "page_id, title, content_hash")):
        ours = queries.QUERIES[name](spark, str(tmp_path)).select(*columns.split(", ")).collect()
        assert sorted(map(tuple, ours)) == sorted(db.execute(f"SELECT {columns} FROM ({queries.ORACLES[name]})").fetchall())


def test_titles_hold_no_tags_as_in_sql(spark, tmp_path):
    """What looks like a tag in a title is text: it neither shortens the title nor changes the layout."""
    import duckdb

    from pagemill.plans import queries

    titles = ["a <b>c</b> d", "a &lt;b&gt; &amp;lt; &am", "List<int> & x<y", '<body class="x">', "</head><p>", "<!-- a -->", "a\nb", "", "<", "</titles>", "x</TITLE><title>y &middot;"]
    rows = [(i, "u", f"<html><head><title lang=en>{t}</title></head>{queries.LAYOUT}</html>") for i, t in enumerate(titles)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    ours = queries.layout_hash_udf(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, ours)) == sorted(db.execute(queries.ORACLES["layout_hash_udf"]).fetchall())
    p = parts.page_parts("<title>a <b>&lt;</title><p>&lt;<textarea><p>&amp;</textarea><title>open<p>x", "", ["html"])
    assert p["html"] == "<title>a &lt;b&gt;&lt;</title><p>&lt;<textarea>&lt;p&gt;&amp;</textarea><title>open</title></p><p>x</p>"


def test_cut_references_in_titles_of_hashed_pages(spark):
    pages = spark.createDataFrame([("u", CUT), ("v", CUT.replace("&&&amp<", "&amp;<"))], "url string, html string")
    rows = {r.url: r for r in parts.hashed(pages).collect()}
    assert rows["u"].title == "a & b&&&amp" and rows["v"].title == "a & b&" and rows["u"].layout_hash == rows["v"].layout_hash


def test_embedded_database(spark, monkeypatch):
    from pagemill.sources import tables

    at, driver = "jdbc:derby:memory:semantics;create=true", "org.apache.derby.iapi.jdbc.AutoloadedDriver"
    monkeypatch.setattr(tables, "BATCH_ROWS", 7)
    rows = spark.sql("select id, cast(id as int) n, if(id % 3 = 0, null, 't' || id) t, id / 4D d, cast(id as decimal(9, 2)) m, date'2024-01-01' + cast(id as int) day, timestamp'2024-01-01 10:00:00' at, id % 2 = 0 even from range(0, 40, 1, 3)")
    plans = []
    monkeypatch.setattr(type(rows.write), "save", lambda self, *a, f=type(rows.write).save: (plans.append(self._df.count()), f(self, *a)))
    for _ in range(2):  # made anew
        tables.write_jdbc(rows, at, "kinds", driver=driver)
    assert plans == [0, 0]  # tasks write nothing: another process would have a database of its own
    back = tables.jdbc(spark, at, "kinds", driver=driver)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, rows.collect()))
    assert "JDBC" not in back._jdf.queryExecution().toString()
    assert [r.id for r in tables.jdbc(spark, at, "kinds", where='"t" IS NULL AND "n" > 30', driver=driver).orderBy("id").collect()] == [33, 36, 39]
    assert tables.jdbc(spark, at, "kinds", where='"n" < 0', driver=driver).count() == 0
    assert [bool(tables.EMBEDDED.match(u)) for u in ("jdbc:derby://h:1527/x", "jdbc:postgresql://h/x", "jdbc:h2:tcp://h/x", "jdbc:h2:mem:x", "jdbc:derby:/x")] == [False, False, False, True, True]


@pytest.mark.parametrize("min_leaf", [1, 10, 40])
def test_tree_of_counted_rows_is_that_of_the_rows(spark, min_leaf):
    from pyspark.ml.classification import DecisionTreeClassifier
    from pyspark.ml.feature import VectorAssembler

    rows = [(float(i * i % 11), float(i % 5 % 3), (i * 7 % 13 > 5) + (i % 4 == 0)) for i in range(300)]
    df = spark.createDataFrame(rows, "f_1 double, f_2 double, label int").coalesce(1)
    plain = DecisionTreeClassifier(labelCol="label", featuresCol="v", impurity="entropy", maxDepth=30, minInstancesPerNode=min_leaf, seed=7)
    tree = plain.fit(VectorAssembler(inputCols=["f_1", "f_2"], outputCol="v").transform(df))
    body = lambda text: text.split("\n", 1)[1]
    assert body(judge.learn(df, ["f_1", "f_2"], min_leaf=min_leaf).text()) == body(tree.toDebugString)
    assert judge.learn(df.limit(2 * min_leaf - 1), ["f_1", "f_2"], min_leaf=min_leaf).model.stages[-1].depth == 0


def test_folds_are_fitted_together_on_distinct_rows(spark, monkeypatch):
    from threading import Barrier

    together, seen = Barrier(10, timeout=60), []

    def learn(rows, columns, **named):
        together.wait()
        seen.append((rows.count(), rows.agg(F.sum(named["weight"])).first()[0]))

    monkeypatch.setattr(evaluate, "learn", learn)
    df = spark.range(400).selectExpr("id", "int(id % 2) AS label", "double(id % 4) AS f_1")
    out = evaluate.cross_validated(df, ["f_1"], settings={"a": ("gini", 1, 3)}).collect()
    assert [sum(r[2:]) for r in out] == [40] * 10 and max(n for n, _ in seen) <= 9 * 4 and {w for _, w in seen} == {360}


def test_fits_read_few_parts_however_many_the_shuffle_has(spark, monkeypatch):
    parts, fitted = [], []

    def learn(rows, columns, **named):
        leaves = rows._jdf.queryExecution().optimizedPlan().collectLeaves()
        parts.append(leaves.apply(0).cacheBuilder().cachedColumnBuffers().getNumPartitions())
        fitted.append(rows.groupBy("label").count()._jdf.queryExecution().executedPlan().toString())

    monkeypatch.setattr(evaluate, "learn", learn)
    kept = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "7")
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        df = spark.range(400).selectExpr("id", "int(id % 2) AS label", "double(id % 4) AS f_1")
        out = evaluate.cross_validated(df, ["f_1"], k=2, settings={"a": ("gini", 1, 3)}).collect()
    finally:
        for c, v in kept.items():
            spark.conf.set(c, v)
    assert parts == [1, 1] and [sum(r[2:]) for r in out] == [200, 200]
    assert not any("Exchange" in plan.split("InMemoryTableScan")[0] for plan in fitted)


def test_cross_validation_computes_features_once(spark):
    rows = spark.sparkContext.accumulator(0)

    def seen(i):
        rows.add(1)
        return float(i % 4)

    f = F.udf(seen, "double")("id")
    df = spark.range(100).select("id", f.alias("f_1")).withColumn("label", (F.col("f_1") % 2).cast("int"))
    evaluate.cross_validated(df, ["f_1"], k=2, settings={"a": ("gini", 1, 3)})
    assert rows.value == 100
