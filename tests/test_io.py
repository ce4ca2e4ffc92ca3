"""Uploads, the model source, sinks, races and percentiles beyond what the queries show."""

import os
import tempfile
import time

import pyspark.sql.functions as F
import pytest

from hushframe import queries_io, tables
from hushframe.operators import reports, vault
from hushframe.sources import model, uploads
from hushframe.streaming import sinks


def folder():
    return "file://" + tempfile.mkdtemp(prefix="spark-")


# ---- uploads ----
def test_uploads_keep_ids_and_refuse_two_manifests(spark):
    good = '{"purpose": "p", "model": "m", "messages": [{"role": "user", "content": [{"type": "file", "item_id": "a", "file_field": "f"}]}]}'
    rows = [("007", "manifest", good), ("007", "f", "text"), ("7", "manifest", good), ("8", "manifest", "{"), ("9", "manifest", good), ("9", "manifest", good), ("10", "f", "alone"), ("11", "manifest", " " * 300_000 + good)]
    to = folder()
    for i, row in enumerate(rows):
        uploads.write_texts(spark.createDataFrame([row], "request_id string, part string, value string"), to)
    read = uploads.parts(spark, to)
    manifests, files = uploads.requests(read)
    assert {r.request_id: r.error_code for r in manifests.collect()} == {"007": None, "7": None, "8": "manifest_not_json", "9": "manifest_twice", "11": "manifest_too_large"}
    assert {(r.request_id, r.file_field, bytes(r.data)) for r in files.collect()} == {("007", "f", b"text\n"), ("10", "f", b"alone\n")}
    assert [r.request_id for r in uploads.items(manifests).collect()].count("007") == 1
    plan = read.filter("request_id = '007'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(request_id" in plan


def test_many_uploads_are_listed_by_few_tasks_and_odd_ids_stay(spark):
    ids = ["a/b", "a=b", "c d%", "é{1}", *(str(i) for i in range(200))]
    rows = spark.createDataFrame([(i, p, f"{i} {p}") for i in ids for p in ("manifest", "f:1")] + [("a=b", "two", "x"), ("a=b", "two", None)], "request_id string, part string, value string")
    to = folder()
    uploads.write_texts(rows.repartition(3, "request_id"), to)
    assert not [f for f in os.listdir(to.removeprefix("file://") + "/request_id=a%3Db/part=two") if not f.startswith("part-")]
    spark.sparkContext.setJobGroup("listing", "listing")
    read = uploads.parts(spark, to)
    spark.sparkContext.setJobGroup("rest", "rest")
    said = spark.sparkContext.statusTracker()
    tasks = [said.getStageInfo(s).numTasks for j in said.getJobIdsForGroup("listing") for s in said.getJobInfo(j).stageIds]
    assert tasks and max(tasks) < len(ids)
    got = {(r.request_id, r.part, bytes(r.content).decode()) for r in read.collect()}
    assert got - {("a=b", "two", "x\n\n"), ("a=b", "two", "\nx\n")} == {(i, p, f"{i} {p}\n") for i in ids for p in ("manifest", "f:1")}


def test_waves_of_uploads_give_the_rows_of_one_and_leave_no_folder(spark, monkeypatch, tmp_path):
    spark.createDataFrame([(i, f"u{i}" if i % 3 else None, None if i % 4 == 0 else "<p>" * (i * 60)) for i in range(12)], "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    whole = {tuple(r) for r in queries_io.upload_folder(spark, str(tmp_path)).collect()}
    monkeypatch.setattr(queries_io, "WAVE", 4)
    assert {tuple(r) for r in queries_io.upload_folder(spark, str(tmp_path)).collect()} == whole and len(whole) == 24
    assert not [f for f in os.listdir(tables.shared_dir(spark).removeprefix("file://") + "/hushframe") if f.endswith(("-uploads", "-uploads-sent"))]
    spark.createDataFrame([], "page_id long, url string, html string").write.mode("overwrite").parquet(f"{tmp_path}/pages.parquet")
    assert queries_io.upload_folder(spark, str(tmp_path)).collect() == []


# ---- model ----
class Clock:
    def __init__(self):
        self.now = 0.0

    def __call__(self):
        return self.now

    def sleep(self, seconds):
        self.now += seconds


@pytest.mark.parametrize(
    ("said", "want"),
    [
        ([200], (200, "b", 1, None)),
        ([503, 429, 200], (200, "b", 3, None)),
        ([503] * 9, (503, None, 3, "model_unavailable")),
        ([404, 200], (404, None, 1, "model_refused")),
        ([ConnectionError(), 200], (200, "b", 2, None)),
        ([TimeoutError()] * 3, (None, None, 3, "model_deadline")),
    ],
)
def test_calls_are_tried_again_only_where_that_may_help(said, want):
    clock = Clock()

    def client(text, attempt, left):
        x = said[attempt - 1]
        if isinstance(x, Exception):
            raise x
        return x, "b"

    assert model.call(client, "t", 3, 10.0, 0.1, clock, clock.sleep) == want


def test_no_call_outlives_its_deadline():
    clock = Clock()

    def slow(text, attempt, left):
        clock.now += 6.0
        return 503 if attempt == 1 else 200, "b"

    assert model.call(slow, "t", 5, 10.0, 1.0, clock, clock.sleep) == (200, None, 2, "model_deadline")
    assert model.call(slow, "t", 5, 0.0, 1.0, clock, clock.sleep) == (None, None, 0, "model_deadline")


def test_answers_come_concurrently_and_faults_stay_in_their_row(spark):
    def client():
        import time

        def ask(text, attempt, left):
            if text == "bad":
                raise KeyError(text)
            time.sleep(0.3)
            return 200, '{"choices": [{"finish_reason": "stop", "message": {"content": "{\\"entities\\": []}"}}]}'

        return ask

    items = spark.createDataFrame([(str(i), f"t{i % 20}") for i in range(40)] + [("n", None), ("b", "bad")], "item_id string, text string").coalesce(1)
    model.answered(items.limit(1), client).collect()
    began = time.time()
    got = {r.item_id: r for r in model.answered(items, client, workers=20).collect()}
    assert time.time() - began < 5.5  # 20 texts of 0.3 s each, one after the other, take 6
    assert got["n"].error_code == "no_text" and got["b"].error_code == "model_client_error" and got["3"].error_code is None
    said = {r.item_id: (r.spans, r.error_code) for r in model.claims_of(model.answered(items.filter("item_id <> '5'"), client, workers=20), items).collect()}
    assert said["3"] == ([], None) and said["b"][0] is None and said["5"] == (None, "model_not_asked")


def test_scripted_answers_are_found_by_content(spark):
    items = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "y"), ("d", None)], "item_id string, text string")
    script = spark.createDataFrame([("x",), ("x",)], "t string").select(F.sha2("t", 256).alias("text_sha256"), F.lit("body").alias("body"))
    got = {r.item_id: (r.body, r.error_code) for r in model.scripted(items, script).collect()}
    assert got == {"a": ("body", None), "b": ("body", None), "c": (None, "model_unavailable"), "d": (None, "model_unavailable")}


# ---- sinks ----
def test_a_replayed_batch_leaves_one_copy_and_no_other_columns(spark):
    to = folder() + "/sent"
    rows = lambda *ids: spark.createDataFrame([(i, "s", f"text {i}", "raw secret") for i in ids], "request_id string, scope_id string, text string, raw_text string")
    sinks.write_once(rows("a", "b", "b"), to, 0)
    sinks.write_once(rows("b", "c"), to, 1)
    sinks.write_once(rows("a", "b", "b"), to, 0)  # replayed
    sinks.write_once(rows("b", "c"), to, 1)
    there = spark.read.parquet(to)
    assert sorted((r.request_id, r.batch) for r in there.collect()) == [("a", 0), ("b", 0), ("c", 1)]
    assert set(there.columns) == {"request_id", "scope_id", "text", "batch"}
    with pytest.raises(ValueError, match="text"):
        sinks.write_once(rows("d").drop("text"), to, 2)


# ---- races ----
def test_rules_of_uniqueness(spark):
    v = "tenant_id string, scope_id string, entity_type string, digest string, token string, created_at int"
    held = spark.createDataFrame([("t", "s", "E", "d1", "T1", 1), ("t", "s", "E", "d1", "T2", 0), ("t", "s", "E", "d2", "T1", 3), ("t", "u", "E", "d1", "T1", 1), ("t", "gone", "E", "d1", "T9", 1)], v)
    scopes = spark.createDataFrame([("t", "s"), ("t", "u"), ("t", "u")], "tenant_id string, scope_id string")
    assert {tuple(r) for r in vault.uniqueness_errors(held, scopes).collect()} == {("scope_twice", "t", "u", 2), ("value_twice", "t", "s", 2), ("token_twice", "t", "s", 2), ("mapping_without_scope", "t", "gone", 1)}
    one = vault.settled(held)
    assert {(r.scope_id, r.digest, r.token) for r in one.collect()} == {("s", "d1", "T2"), ("s", "d2", "T1"), ("u", "d1", "T1"), ("gone", "d1", "T9")}
    asked = held.select("tenant_id", "scope_id", "entity_type", "digest", "token").union(spark.createDataFrame([("t", "s", "E", "d9", "T5")], "tenant_id string, scope_id string, entity_type string, digest string, token string"))
    assert {(r.digest, r.token) for r in vault.confirmed(one, asked).filter("error_code = 'mapping_lost'").collect()} == {("d1", "T1"), ("d9", "T5")}


# ---- percentiles ----
def test_merged_sketches_are_near_exact_percentiles(spark):
    rows = spark.range(200_000).select((F.col("id") % 10).alias("day"), F.lit("p").alias("path"), F.pow(F.rand(5), F.lit(3)).alias("s"))
    daily = reports.sketched(rows, "s", "path", "day")
    assert daily.agg(F.max(F.length("sketch"))).first()[0] < 20_000
    got = reports.percentiles(daily, "path").first()
    assert got.n == 200_000
    for p, r in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)):
        assert abs(rows.filter(F.col("s") <= got[p]).count() / 200_000 - r) < 0.02
    assert reports.percentiles(daily.limit(0), "path").count() == 0
