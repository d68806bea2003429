"""The verbs of a running installation: ingest pages, judge, extract, review, correct.

State is kept in a ``Store``: url_lib, sem_info, inbox (id, url, stage, batch), the raw
pages in batches that are only appended to, judge_queue, extract_queue, training, epochs,
and the fitted tree. A verb reads snapshots, makes new ones and returns DataFrames;
nothing is collected but what a caller asks for by id. Moving pages between stages
rewrites the narrow inbox, never the pages.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pagemill.functions.scalars import NO, NO_EXTRACTOR, TARGETS, UNKNOWN, file_name, media_type, text_hash
from pagemill.operators import admission, extract, features, judge, parts, store
from pagemill.sources import specs
from pagemill.sources.specs import Entity, Feature, Rule

#: Pages that one task parses.
TASK_PAGES = 1000
INBOX = "id long, url string, stage string, batch long"
RAW = "id long, html string"
JUDGE_QUEUE = "id long, title string, url string, filename string, confidence double, decision int, feature map<string,long>"
EXTRACT_QUEUE = "id long, title string, url string, filename string, decision int, extractor array<int>"


class Engine:
    def __init__(self, spark: SparkSession, root: str, space: list[Feature], entity: Entity, policy: admission.Policy = admission.Policy(), rules_dir: str | None = None):
        self.spark, self.space, self.entity, self.policy, self.rules_dir = spark, space, entity, policy, rules_dir
        self.store = store.Store(spark, root)
        self.columns = [features.column_name(f) for f in features.ordered(space)]
        self._fitted: judge.Judge | None = None

    # -- tables

    def table(self, name: str) -> DataFrame:
        training = "id long, label int, " + ", ".join(f"{c} double" for c in self.columns)
        schema = {
            "url_lib": store.URL_LIB, "sem_info": store.SEM_INFO, "inbox": INBOX, "judge_queue": JUDGE_QUEUE,
            "extract_queue": EXTRACT_QUEUE, "training": training, "epochs": "epoch long",
        }
        return self.store.read(name, schema[name])

    def results(self) -> DataFrame:
        return store.results(self.table("sem_info"), self.table("url_lib"))

    def judge_list(self) -> DataFrame:
        return self.table("judge_queue")

    def extract_list(self) -> DataFrame:
        return self.table("extract_queue")

    def maps(self) -> dict[str, DataFrame]:
        return {
            "attributes": extract.attribute_catalogue(self.spark, self.entity), "rules": extract.rule_catalogue(self.spark, self.entity),
            "actions": extract.action_catalogue(self.spark), "features": features.described(self.spark, self.space),
        }

    def raw_file(self, stage: str, page_id: int) -> str | None:
        if stage not in ("judge", "extract"):
            raise ValueError(f"no such stage: {stage}")
        row = self.pages(self.table("inbox").filter((F.col("stage") == stage) & (F.col("id") == page_id))).select("html").first()
        return row and row[0]

    def pages(self, waiting: DataFrame) -> DataFrame:
        """Rows of the inbox with their html, dealt over tasks by their number: bodies are small on disk and dear to parse."""
        live = waiting.groupBy("batch").agg(F.count("*").alias("n")).collect()
        raw = self.store.batches("raw", RAW).filter(F.col("batch").isin([r.batch for r in live]))
        n = max(1, -(-sum(r.n for r in live) // TASK_PAGES))
        # One key of both, so that the join keeps this dealing and bodies move once.
        dealt = lambda df: df.withColumn("__key", F.concat_ws(":", "id", "batch")).drop("batch").repartition(n, "__key")
        return dealt(waiting).join(dealt(raw).drop("id"), "__key").drop("__key")

    def vacuum(self) -> None:
        """Drop batches of raw pages, and their features, of which none waits any more."""
        live = {r[0] for r in self.table("inbox").select("batch").distinct().collect()}
        for name in ("raw", self._vectors()):
            self.store.drop_batches(name, live)

    # -- steps

    def _with_parts(self, pages: DataFrame, also: tuple[str, ...] = (), scopes: list[parts.Scope] = []) -> tuple[DataFrame, dict[str, Column]]:
        """``pages`` with __parts, from the tree, and the parts as columns: those that features or rules ask for; a page is parsed once for all of them, and for scopes."""
        asked = {r.sel for f in self.space for r in f.rules} | {r.on for a in self.entity.attributes.values() for r in a.rules.values()} | {*also}
        names = [n for n in parts.NAMES if n in asked and n != "url"]
        made = {"url": F.col("url")}
        if names or scopes:
            pages = parts.with_parts(pages, names, into="__parts", scopes=scopes)
            made |= {n: F.col(f"__parts.{n}") for n in names}
        return pages, made

    def _featured(self, pages: DataFrame, also: tuple[str, ...] = ()) -> DataFrame:
        pages, own = self._with_parts(pages, also)
        out = features.with_features(pages, self.space, own)
        return out.withColumns({c: F.col(c).cast("double") for c in self.columns})

    def _vectors(self) -> str:
        """The name of the table of features of raw pages: one for each feature space, as another space gives other features."""
        return "vectors-" + hashlib.md5(repr(self.space).encode()).hexdigest()

    def _vectors_of(self, waiting: DataFrame) -> DataFrame:
        """Rows of the inbox with their features: those kept at ingestion; pages of a batch that came in under another space are parsed."""
        kept = self.store.batches(self._vectors(), "id long, " + ", ".join(f"{c} double" for c in self.columns))
        known = self.store.batch_numbers(self._vectors())
        rest = waiting.filter(~F.col("batch").isin(known))
        found = waiting.join(kept, ["id", "batch"]).drop("batch")
        if rest.isEmpty():
            return found
        return found.unionByName(self._featured(self.pages(rest)).select(*found.columns))

    def _feature_map(self) -> Column:
        return F.create_map(*(x for f in features.ordered(self.space) for x in (F.lit(f.id), F.col(features.column_name(f)).cast("long"))))

    def learn(self) -> judge.Judge | None:
        """The tree of all labels so far, fitted anew and kept beside the tables."""
        self._fitted = judge.learn(self.table("training"), self.columns)
        if self._fitted is not None:
            self._fitted.save(self._tree_path())
        return self._fitted

    def _tree_path(self) -> str:
        return f"{self.store.root}/tree"

    def model(self) -> judge.Judge | None:
        """The tree in use: after a restart the one that was kept, or one learned from the labels at hand."""
        if self._fitted is None and self.store.exists("tree"):
            kept = judge.Judge.load(self._tree_path())
            if kept.columns == self.columns:  # the feature space is the one that it was fitted on
                self._fitted = kept
        return self.learn() if self._fitted is None else self._fitted

    def _decide(self, ids: DataFrame) -> None:
        """Write decisions (id, decision) to url_lib."""
        own = ids.select(F.col("id").alias("__id"), F.col("decision").cast("int").alias("__decision"))
        table = self.table("url_lib").join(own, F.col("id") == F.col("__id"), "left")
        table = table.withColumn("is_target", F.coalesce("__decision", "is_target")).drop("__id", "__decision")
        self.store.write("url_lib", table)

    def _stage(self, ids: DataFrame, stage: str | None) -> None:
        """Move raw pages to a stage, or drop them."""
        inbox = self.table("inbox")
        rest = inbox.join(ids.select("id"), "id", "left_anti")
        if stage is None:
            self.store.write("inbox", rest)
        else:
            moved = inbox.join(ids.select("id").distinct(), "id", "left_semi").withColumn("stage", F.lit(stage))
            self.store.write("inbox", rest.unionByName(moved))

    def _send_to_extractor(self, ids: DataFrame) -> None:
        """Pages whose layout has an elected extractor are extracted, the others queued."""
        pages = self.table("url_lib").join(ids.select("id").distinct(), "id", "left_semi")
        # Counted once: what follows reads the outcome many times.
        voted = extract.by_vote(pages, self.table("url_lib")).select("id", "title", "url", "content_type", "is_target", "voted")
        voted = self.store.write("voted", voted)
        chosen = voted.filter("voted is not null").select("id", F.col("voted").alias("extractor"))
        if chosen.isEmpty() and {a.db_col for a in self.entity.attributes.values()} <= {*self.table("sem_info").columns}:
            self.vacuum()
        else:
            self.apply(chosen)
        waiting = voted.filter("voted is null").select(
            "id", "title", "url", file_name(F.col("id"), F.col("content_type")).alias("filename"), F.col("is_target").alias("decision"), F.array(*map(F.lit, NO_EXTRACTOR)).alias("extractor")
        )
        self.store.write("extract_queue", store.upserted(self.table("extract_queue"), waiting))

    def _settle(self, decided: DataFrame) -> None:
        """decided: id, decision, route of pages."""
        self._decide(decided.withColumn("decision", F.when(F.col("route") == "review", F.lit(UNKNOWN)).otherwise(F.col("decision"))))
        self._stage(decided.filter("route = 'discard'"), None)
        go = decided.filter("route = 'extract'").select("id")
        self._stage(go, "extract")
        self._send_to_extractor(go)

    # -- verbs

    def ingest(self, responses: DataFrame, epoch: int | None = None) -> DataFrame:
        """Admit responses (url, status, content_type, body), judge what is new or changed, extract from targets.

        responses may have a column fetched_at. Returns url, action. A batch whose epoch is on record is not taken again.
        """
        if epoch is not None and not self.table("epochs").filter(F.col("epoch") == epoch).isEmpty():
            return self.spark.createDataFrame([], "url string, action string")
        # Bodies stay where they are: what decides is a hash. The latest response of a URL counts, by fetched_at if there is
        # such a column, then by hash, so that the order of rows is no matter.
        when = F.col("fetched_at").cast("double") if "fetched_at" in responses.columns else F.lit(0.0)
        slim = responses.select("url", "status", "content_type", text_hash(F.col("body")).alias("content_hash"), when.alias("when"))
        one = slim.groupBy("url").agg(F.max_by(F.struct("status", "content_type", "content_hash"), F.struct("when", "content_hash", "status")).alias("r"))
        seen = admission.crawl_action(one.select("url", "r.*"), self.table("url_lib"), self.policy)
        seen = self.store.write("landing", seen)
        gone = seen.filter(F.col("action").isin("gone", "changed")).select(F.col("known_id").alias("url_id"))
        self.store.write("sem_info", store.without(self.table("sem_info"), gone))
        known = self.table("url_lib")
        known = store.touched(known, seen.filter("action = 'unchanged'").select(F.col("known_id").alias("id")), "last_extract_ts")
        largest = known.agg(F.max("id")).first()[0] or 0
        known = self.store.write("url_lib", known.unionByName(store.stubs(seen.filter("action = 'new'"), largest)))
        fresh = seen.filter(F.col("action").isin("new", "changed")).select("url", "content_type", "content_hash")
        bodies = responses.select("url", text_hash(F.col("body")).alias("content_hash"), F.col("body").alias("html"))
        found = bodies.join(fresh, ["url", "content_hash"]).dropDuplicates(["url"]).join(known.select("id", "url"), "url")
        batch = (self.table("inbox").agg(F.max("batch")).first()[0] or 0) + 1 if epoch is None else epoch + (1 << 32)
        self.store.append("raw", batch, found.select("id", "html"))
        raw = self.pages(fresh.join(known.select("id", "url"), "url").select("id", "url", "content_type", F.lit(batch).cast("long").alias("batch")))
        # Parsed once, for hashes, title and features.
        pages = self.store.write("fresh", parts.hashed(self._featured(raw, ("title", "layout")), "__parts").drop("html", "__parts"))
        self.store.append(self._vectors(), batch, pages.select("id", *self.columns))
        rows = known.join(pages.select("id"), "id", "left_semi").drop("content_hash", "layout_hash", "title", "content_type", "last_access_ts")
        update = pages.select("id", "content_hash", "layout_hash", "title", media_type(F.col("content_type")).alias("content_type"), F.current_timestamp().alias("last_access_ts"))
        self.store.write("url_lib", store.upserted(known, rows.join(update, "id").select(*known.columns)))
        inbox = store.upserted(self.table("inbox"), pages.select("id", "url", F.lit("judge").alias("stage"), F.lit(batch).cast("long").alias("batch")))
        self.store.write("inbox", inbox)
        named = pages.select("id", "url", *self.columns).join(self.table("url_lib").select("id", "title", "content_type"), "id")
        judged = judge.judged(named, self.model()).withColumn("filename", file_name(F.col("id"), F.col("content_type")))
        judged = judged.withColumn("route", judge.route(F.col("decision"), F.col("confidence")))
        judged = self.store.write("judged", judged.withColumn("feature", self._feature_map()))
        self.store.write("judge_queue", store.upserted(self.table("judge_queue"), judge.queue_rows(judged, F.col("feature"))))
        self._settle(judged.select("id", "decision", "route"))
        if epoch is not None:
            self.store.write("epochs", self.table("epochs").unionByName(self.spark.createDataFrame([(epoch,)], "epoch long")))
        return seen.select("url", "action")

    def judge(self, decisions: DataFrame) -> None:
        """Human decisions (id, decision): they teach the tree and send the pages on."""
        pages = self._vectors_of(self.table("inbox").join(decisions, "id"))
        taught = pages.select("id", F.col("decision").cast("int").alias("label"), *self.columns)
        self.store.write("training", store.upserted(self.table("training"), taught))
        self.learn()
        route = F.when(F.col("decision").isin(*TARGETS), "extract").otherwise("discard")
        decided = self.store.write("decided", pages.select("id", F.col("decision").cast("int").alias("decision"), route.alias("route")))
        self.store.write("judge_queue", store.without(self.table("judge_queue"), decided.select("id"), "id"))
        self._settle(decided)

    def judge_refresh(self) -> DataFrame:
        """Judge the queue anew by the tree of all labels; sure ones leave it. Returns the queue."""
        self.learn()
        again = self.store.write("decided", judge.refreshed(self.table("judge_queue"), self.model(), self.columns))
        self.store.write("judge_queue", again.filter("route = 'review'").select(*(c.split()[0] for c in JUDGE_QUEUE.replace("map<string,long>", "map").split(", "))))
        self._settle(again.filter("route <> 'review'").select("id", "decision", "route"))
        return self.judge_list()

    def preview(self, chosen: DataFrame) -> DataFrame:
        """id and the attributes that the extractor (id, extractor) of each page gives; nothing is saved."""
        scopes = extract.scopes(extract.rules_of(self.entity).values())
        pages, own = self._with_parts(self.pages(self.table("inbox").join(chosen, "id")), scopes=scopes)
        scoped = F.col("__parts.scopes") if scopes else None
        return extract.with_records(pages, self.entity, F.col("extractor"), own, scoped=scoped).drop("url", "html", "stage", "extractor", "__parts")

    def apply(self, chosen: DataFrame) -> None:
        """Extract and save with the extractors given (id, extractor); the pages leave queue and inbox."""
        made = self.preview(chosen).withColumnRenamed("id", "url_id")
        old = store.without(self.table("sem_info"), chosen.select("id"))
        largest = self.table("sem_info").agg(F.max("id")).first()[0] or 0
        self.store.write("sem_info", old.unionByName(store.numbered(made, largest, "url_id"), allowMissingColumns=True))
        own = chosen.select(F.col("id").alias("__id"), F.col("extractor").alias("__extractor"))
        table = self.table("url_lib").join(own, F.col("id") == F.col("__id"), "left")
        self.store.write("url_lib", table.withColumn("extractor", F.coalesce("__extractor", "extractor")).drop("__id", "__extractor"))
        self.store.write("extract_queue", store.without(self.table("extract_queue"), chosen.select("id"), "id"))
        self._stage(chosen, None)
        self.vacuum()

    def extract_refresh(self) -> DataFrame:
        """Vote again for every page that waits. Returns the queue."""
        self._send_to_extractor(self.store.write("decided", self.table("extract_queue").select("id")))
        return self.extract_list()

    def rejudge(self, decisions: DataFrame) -> None:
        """Back from the extractor's queue to the judge, with a decision (id, decision)."""
        self.store.write("extract_queue", store.without(self.table("extract_queue"), decisions.select("id"), "id"))
        self._stage(decisions, "judge")
        self.judge(decisions)

    def test_rule(self, page_id: int, rule: Rule) -> str | None:
        pages = self.pages(self.table("inbox").filter(F.col("id") == page_id))
        own = {"url": F.col("url")}
        if rule.on not in ("content", "url"):
            pages = parts.with_parts(pages, [rule.on], into="__parts")
            own[rule.on] = F.col(f"__parts.{rule.on}")
        row = extract.with_rule_values(pages, {"value": rule}, own).select("value").first()
        return row and row[0]

    def add_rule(self, attribute: int, rule: Rule) -> int:
        return specs.add_rule(self.entity.attributes[attribute], rule, self.rules_dir)

    def non_targets(self) -> DataFrame:
        return self.table("url_lib").filter(F.col("is_target") == NO)
