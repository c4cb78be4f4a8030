"""Tests of the second round: blank nodes, language BOUND, locators, scratch folder, scope exclusion."""

import os

import pytest
from pyspark.sql import functions as F

from claimweave.functions import vocabulary as voc
from claimweave.operators import scope
from claimweave.operators import substrate as sub
from claimweave.plans import runtime
from claimweave.query import run
from claimweave.query.plan import Store
from claimweave.sources import readers

DATA = "/root/testdata/sf0.001"


def test_blank_nodes_of_several_files_stay_apart(spark, tmp_path):
    for name in ("a.ttl", "b.ttl"):
        (tmp_path / name).write_text("@prefix ex: <http://e/> .\nex:%s ex:q [ ex:r ex:c ] .\n" % name[0])
    rows = readers.read_document(spark, str(tmp_path), "turtle").collect()
    inner = {r["subject"] for r in rows if r["predicate"] == "http://e/r"}
    outer = {r["object_iri"] for r in rows if r["predicate"] == "http://e/q"}
    assert len(inner) == 2 and inner == outer and all(x.startswith("_:") for x in inner)


def test_bound_and_its_errors(spark):
    claims = spark.createDataFrame(
        [("1", "a", "p", "b", None, "c", "asserted", 1), ("2", "a", "p", None, None, "c", "asserted", 1)],
        "statement_id string, subject string, predicate string, object_iri string, object_lit string, context string, polarity string, maturity int",
    ).withColumns({c: F.lit(None).cast(k) for c, k in (("valid_lo", "date"), ("valid_hi", "date"), ("tx_lo", "timestamp"), ("tx_hi", "timestamp"))})
    store = Store(claims)
    assert [r["o"] for r in run(store, "MATCH ?s <p> ?o FILTER BOUND(?o) PROJECT ?o").collect()] == ["b"]
    assert run(store, "MATCH ?s <p> ?o FILTER BOUND ?x").count() == 0
    with pytest.raises(SyntaxError):
        run(store, "MATCH ?s <p> ?o FILTER BOUND(<x>)")


def test_locators_and_vocabularies(spark):
    rows = [("char_span", '{"start": 1, "end": 2}', True), ("char_span", '{"start": 1}', False), ("char_span", None, False), ("char_span", "broken", False), ("whole_source", "{}", True), ("odd", "{}", None), (None, None, None)]
    df = spark.createDataFrame(rows, "k string, l string, want boolean")
    assert df.where(~voc.valid_locator(F.col("k"), F.col("l")).eqNullSafe(F.col("want"))).count() == 0
    assert voc.vocabulary(spark, "modality").count() == 15 and voc.maturity_ladder(spark).count() == 6


def test_exclusion_leaves_what_lies_below(spark):
    ctx = spark.createDataFrame([("a", "source", None), ("b", "source", "a"), ("c", None, "b")], "iri string, kind string, parent string")
    assert {r["context"] for r in scope.resolve_scope(ctx, exclude=["b"]).collect()} == {"a", "c"}


def test_revisions_are_numbered_on_and_not_repeated(spark):
    old = spark.createDataFrame([("d", 4, None)], "document_id string, revision_number long, content_hash string")
    new = spark.createDataFrame([("d", "x", 2), ("d", "y", 1), ("d", "x", 3), ("e", "x", 1), ("e", None, 2)], "document_id string, body string, arrival long")
    got = {(r["document_id"], r["revision_number"]) for r in sub.add_revisions(old, new).where("content_hash is not null").collect()}
    assert got == {("d", 5), ("d", 6), ("e", 1)}


def test_meaning_clusters_follow_chains_and_loops(spark):
    pairs = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "x"), ("y", "z")], "a string, b string")
    seeds = spark.createDataFrame([("a",), ("x",), ("z",)], "n string")
    got = {}
    for r in sub.meaning_cluster(sub.align_meaning(pairs), seeds).collect():
        got.setdefault(r["seed"], set()).add(r["node"])
    assert got == {"a": {"a", "b", "c"}, "x": {"x"}, "z": {"y", "z"}}


def test_scratch_tables_go_at_the_end(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(runtime, "shared_dir", lambda _: f"file://{tmp_path}")
    monkeypatch.setattr(runtime, "_ROOTS", [])
    scratch = runtime.Scratch(spark, "t")
    frame, n = scratch.keep_counting(spark.range(10), "id > 6")
    assert n == 3 and frame.count() == 10 and os.listdir(tmp_path / "claimweave")
    runtime.remove_scratch()
    assert not os.listdir(tmp_path / "claimweave")
