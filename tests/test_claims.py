"""Claim store properties, query language, readers, streams."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from claimweave.functions import scalars as s
from claimweave.operators import align, browse, claims as cl, detect, evidence, fixpoint, policy, scope, store
from claimweave.query import Store, parse, run
from claimweave.sources import readers
from claimweave.sources.release import manifest, release_rows
from claimweave.streaming import feeds

SCHEMA = "statement_id string, subject string, predicate string, object_iri string, object_lit string, context string, polarity string, maturity int, valid_lo date, valid_hi date, tx_lo timestamp, tx_hi timestamp"
T0 = dt.datetime(2026, 1, 1)


def lit(v, dtype="xsd:integer"):
    return json.dumps({"v": v, "dt": dtype})


@pytest.fixture(scope="module")
def rows(spark):
    d = [
        ("1", "ex:a", "ex:knows", "ex:b", None, "ctx:x", "asserted", 0), ("2", "ex:b", "ex:knows", "ex:c", None, "ctx:x", "asserted", 2),
        ("3", "ex:c", "ex:knows", "ex:a", None, "ctx:y", "asserted", 3), ("4", "ex:a", "ex:age", None, lit(30), "ctx:x", "asserted", 1),
        ("5", "ex:b", "ex:age", None, lit(20), "ctx:y", "asserted", 1), ("6", "ex:c", "ex:age", None, lit("40", "xsd:string"), "ctx:y", "asserted", 1),
        ("7", "ex:a", "ex:age", None, lit(30), "ctx:x", "negated", 1), ("8", "ex:b", "ex:knownBy", "ex:z", None, "ctx:x", "asserted", 1),
    ]
    return spark.createDataFrame([(*r, None, None, T0, None) for r in d], SCHEMA).cache()


def ids(df, column="statement_id"):
    return sorted(r[column] for r in df.collect())


def test_assert_is_idempotent_and_retract_keeps_history(spark, rows):
    at = F.lit("2026-02-01").cast("timestamp")
    again = rows.drop("statement_id", "tx_lo", "tx_hi").withColumn("maturity", F.lit(5))
    added, bad = cl.assert_batch(rows, again.unionByName(again), at)
    assert added.count() == 0 and bad.count() == 0
    shut = cl.retract(rows, rows.where("statement_id in ('1', '2')"), at)
    assert shut.count() == rows.count() and ids(cl.open_at(shut)) == ["3", "4", "5", "6", "7", "8"]
    assert ids(cl.open_at(shut, "2026-01-15")) == ids(rows)
    reopened, _ = cl.assert_batch(shut, again.where("subject = 'ex:a' and predicate = 'ex:knows'"), F.lit("2026-03-01").cast("timestamp"))
    assert reopened.count() == 1 and reopened.first()["statement_id"] != "1"
    twice = rows.limit(1).withColumn("object_lit", F.lit("{}")).drop("statement_id", "tx_lo", "tx_hi")
    assert cl.assert_batch(rows, twice, at)[1].count() == 1  # two objects
    members = cl.snapshot(rows)
    assert ids(cl.match_in_snapshot(shut, members, polarity=None)) == ids(rows)


def test_correct_inherits_what_is_not_changed(spark, rows):
    change = spark.createDataFrame([("4", lit(31))], "statement_id string, object_lit string")
    shut, new = cl.correct(rows, change, F.lit("2026-02-01").cast("timestamp"))
    r = new.first()
    assert (r["subject"], r["predicate"], r["object_lit"], r["maturity"]) == ("ex:a", "ex:age", lit(31), 1)
    assert "4" not in ids(cl.open_at(shut))


def test_curated_context_rejects_unregistered(spark, rows):
    new = spark.createDataFrame([("ex:q", "ex:new", "ex:r", "ctx:cur"), ("ex:q", "ex:knows", "ex:r", "ctx:cur"), ("ex:q", "ex:new", "ex:r", "ctx:x")], "subject string, predicate string, object_iri string, context string")
    new = new.withColumns({"object_lit": F.lit(None).cast("string"), "polarity": F.lit(None).cast("string"), "maturity": F.lit(None).cast("int"), "valid_lo": F.lit(None).cast("date"), "valid_hi": F.lit(None).cast("date")})
    good, bad = cl.assert_batch(rows, new, F.lit("2026-02-01").cast("timestamp"), spark.createDataFrame([("ctx:cur",)], "context string"), spark.createDataFrame([("ex:knows",)], "predicate string"))
    assert good.count() == 2 and bad.count() == 1


def test_effective_polarity_and_scope(spark, rows):
    got = {r["statement_id"]: r["effective"] for r in cl.effective_polarity(rows).collect()}
    assert got["4"] == got["7"] == "conflicting" and got["5"] == "asserted"
    ctx = spark.createDataFrame([("r", "source", None), ("a", "source", "r"), ("b", "hypothesis", "a"), ("l", "x", "m"), ("m", "x", "l")], "iri string, kind string, parent string")
    assert ids(scope.resolve_scope(ctx, ["r"]), "context") == ["a", "b", "r"]
    assert ids(scope.resolve_scope(ctx, ["r"], exclude=["b"]), "context") == ["a", "r"]  # exclude wins
    assert ids(scope.resolve_scope(ctx, ["l"], ancestors=True), "context") == ["l", "m"]
    assert ids(scope.resolve_scope(ctx, ["none"]), "context") == []
    assert ids(scope.resolve_scope(ctx, ["b"], descendants=False, ancestors=True, exclude_kinds=["hypothesis"]), "context") == ["a", "r"]
    env = spark.createDataFrame([("a", "k", "1"), ("a", "j", "2"), ("b", "k", "1")], "context string, key string, value string")
    assert ids(scope.contexts_with_env(ctx, env, {"k": "1", "j": "2"}), "context") == ["a"]


def test_registers_fold_versions(spark):
    log = spark.createDataFrame([("a", "x", None, 1), ("a", None, "y", 2), ("b", "z", None, 3)], "iri string, label string, description string, seq int")
    assert store.REGISTERS["predicate"].read(log).where("iri = 'a'").first()[1:3] == ("x", "y")
    assert store.latest(log, ["iri"]).where("iri = 'a'").first()["label"] is None
    assert store.first_wins(log, ["iri"]).where("iri = 'a'").first()["label"] == "x"
    bad = spark.createDataFrame([("1", "s", "s", "rebuts", 0.5), ("2", "s", "t", "rebuts", 1.5), ("3", "s", "t", "rebuts", None)], "argument_id string, source string, target string, relation string, strength double")
    good, rejected = store.write("argument", bad)
    assert ids(good, "argument_id") == ["3"] and rejected.count() == 2


def test_closure_aligned_match_and_fixpoints(spark, rows):
    preds = spark.createDataFrame([("ex:knows", "active", None, None), ("ex:k2", "active", "ex:knows", None)], "iri string, status string, canonical_of string, inverse_of string")
    al = spark.createDataFrame([("ex:knows", "ex:knownBy", "inverse_equivalent", 0.9, None), ("ex:knows", "ex:low", "close_match", 0.5, None)], "source string, target string, relation string, confidence double, tx_hi timestamp")
    closure = align.closure(preds, al)
    assert {(r["predicate"], r["equivalent"], r["swap"]) for r in closure.collect()} == {
        ("ex:knows", "ex:knows", False), ("ex:k2", "ex:k2", False), ("ex:knows", "ex:knownBy", True), ("ex:knownBy", "ex:knows", True), ("ex:knows", "ex:k2", False), ("ex:k2", "ex:knows", False),
    }
    got = {(r["subject"], r["object_iri"]) for r in cl.match_aligned(rows, closure, "ex:knows").collect()}
    assert ("ex:z", "ex:b") in got and len(got) == 4
    pairs = fixpoint.transitive_closure(rows.where("predicate = 'ex:knows'").select(F.col("subject").alias("src"), F.col("object_iri").alias("dst")))
    assert pairs.count() == 9  # a loop of three
    assert browse.shortest_paths(rows, "ex:a", "ex:c").first()["path"] == "ex:a > ex:b > ex:c"
    assert align.match_canonical(rows, preds, "ex:k2").count() == 3


def test_query_language(spark, rows):
    args = spark.createDataFrame([("2", "1", "rebuts", "ctx:x"), ("3", "1", "undercuts", "ctx:x"), ("3", "2", "supports", "ctx:x")], "source string, target string, relation string, context string")
    st = Store(rows, arguments=args, contexts=spark.createDataFrame([("ctx:x", "source", None)], "iri string, kind string, parent string"))
    two = run(st, "MATCH ?x ex:knows ?y, ?y ex:knows ?z PROJECT ?x, ?z")
    assert {tuple(r) for r in two.collect()} == {("ex:a", "ex:c"), ("ex:b", "ex:a"), ("ex:c", "ex:b")}
    assert ids(run(st, "match ?x ex:age ?n filter ?n > 25 # comment"), "x") == ["ex:a"]  # a text is no number
    assert ids(run(st, 'MATCH ?x ex:age ?n FILTER ?n != 20, ?n != "40"'), "x") == ["ex:a"]
    assert ids(run(st, "MATCH ?x ex:knows ?x"), "x") == []
    assert run(st, "MATCH ?x ex:age ?n POLARITY negated").count() == 1
    assert ids(run(st, "MATCH ?x ex:knows ?y PRESET curated"), "x") == ["ex:b", "ex:c"]
    assert ids(run(st, "MATCH ?x ex:knows ?y IN ctx:y"), "x") == ["ex:c"]
    assert ids(run(st, "MATCH ?x ex:knows ?y SCOPE include ctx:x"), "x") == ["ex:a", "ex:b"]
    assert run(st, "MATCH ?x ex:knows ?y ORDER BY contradiction_pressure LIMIT 1").first()["x"] == "ex:a"
    assert run(st, "MATCH ?x ex:knows ?y ORDER BY contradiction_pressure OFFSET 1 LIMIT 5").count() == 2
    assert run(st, "MATCH ?x ex:knows ?y AS_OF \"2025-01-01T00:00:00Z\"").count() == 0
    assert run(st, "SELECT ?x WHERE { ?x <ex:age> ?n . FILTER (?n < 25) } LIMIT 3").first()["x"] == "ex:b"
    assert run(st, "PROJECT ?x").count() == 0
    for bad in ("MATCH ?x ex:p", "FILTER ?x ~ 1", "POLARITY maybe", "PRESET mythical MATCH ?s ex:p ?o", "NONSENSE", "PREDICATES EXPAND_ABOVE 101"):
        with pytest.raises(SyntaxError):
            parse(bad)
    with pytest.raises(ValueError):
        run(st, "MATCH ?a ex:knows ?b, ?c ex:age ?d")


def test_policies(spark):
    caps = spark.createDataFrame([("p", "active", None, {"quote": True}), ("q", "active", None, {"quote": False}), ("dead", "revoked", None, {"quote": True})], "policy_iri string, status string, expiry timestamp, allowed map<string,boolean>")
    asg = spark.createDataFrame([("d", "1", "p"), ("d", "2", "p"), ("d", "2", "q"), ("d", "3", "dead")], "target_kind string, target_id string, policy_iri string")
    eff = {r["target_id"] for r in policy.effective_actions(asg, caps).where("action = 'quote' and allowed").collect()}
    assert eff == {"1"}
    att = spark.createDataFrame([("h", "q", ["all"], None, None), ("g", "q", ["quote"], None, T0)], "holder string, policy_iri string, actions array<string>, expires_at timestamp, revoked_at timestamp")
    req = spark.createDataFrame([("h", "d", "2", "quote"), ("g", "d", "2", "quote"), ("g", "d", "1", "quote"), ("h", "d", "9", "quote")], "holder string, target_kind string, target_id string, action string")
    got = {(r["holder"], r["target_id"]): r["authorised"] for r in policy.authorise(req, asg, caps, att).collect()}
    assert got == {("h", "2"): True, ("g", "2"): False, ("g", "1"): True, ("h", "9"): False}


def test_detectors_and_scalars(spark):
    runs = [("r", i, T0 + dt.timedelta(hours=i), 10.0 + (i % 3)) for i in range(20)] + [("r", 99, T0 + dt.timedelta(hours=21), 500.0), ("r", 100, T0 + dt.timedelta(hours=22), None)]
    df = spark.createDataFrame(runs, "rule string, report_id int, evaluated_at timestamp, duration double")
    got = detect.rule_duration(df).collect()
    assert [(r["report_id"], r["severity"]) for r in got] == [(99, "critical")]
    e = spark.range(1).select(detect.normalised_entropy(F.array(F.lit(5), F.lit(5), F.lit(0))).alias("a"), detect.normalised_entropy(F.array(F.lit(7))).alias("b")).first()
    assert (e["a"], e["b"]) == (1.0, 0.0)
    x = spark.createDataFrame([("ex:bornIn", "12 percent", "1998-10?"), (None, None, None)], "iri string, p string, t string")
    t = s.time_expression(F.col("t"))
    r = x.select(s.local_words(F.col("iri")).alias("w"), s.normalize_percent(F.col("p")).alias("p"), t["lo"].alias("lo"), t["hi"].alias("hi"), t["edtf"].alias("e"), t["uncertain"].alias("u")).first()
    assert r["w"] == "born in" and abs(r["p"] - 0.12) < 1e-9 and (str(r["lo"]), str(r["hi"]), r["e"], r["u"]) == ("1998-10-01", "1998-11-01", "1998-10?", True)
    b = spark.createDataFrame([(dt.date(1969, 12, 25),)], "d date").select(s.bucket_date(F.col("d"), days=7).alias("w"), s.bucket_date(F.col("d"), months=12).alias("y")).first()
    assert (b["w"], b["y"]) == (dt.date(1969, 12, 25), dt.date(1969, 1, 1))
    flags = spark.createDataFrame([(p, m) for p in s.POLARITIES for m in range(8)], "p string, m int").withColumn("f", s.pack_flags(F.col("p"), F.col("m")))
    assert flags.where((s.flag_polarity(F.col("f")) != F.col("p")) | (s.flag_maturity(F.col("f")) != F.col("m"))).count() == 0


def test_readers(spark, tmp_path):
    nq = tmp_path / "a.nq"
    nq.write_text('<ex:s> <ex:p> <ex:o> <ctx:g> .\n# c\n\n_:b1 <ex:p> "a \\"q\\""@en-GB .\n<ex:s> <ex:n> "5"^^<xsd:integer> .\n<ex:s> <ex:p> broken .\n')
    good, bad = readers.read_nquads(spark, str(nq))
    got = good.collect()
    assert len(got) == 3 and bad.count() == 1 and got[0]["context"] == "ctx:g"
    assert json.loads(got[1]["object_lit"]) == {"v": 'a "q"', "dt": "rdf:langString", "lang": "en-gb"} and json.loads(got[2]["object_lit"])["v"] == "5"
    with pytest.raises(ValueError):
        readers.read_nquads(spark, str(nq), strict=True)
    jl = tmp_path / "a.jsonl"
    jl.write_text('{"s":"a","p":"b","o":{"iri":"c"},"pol":"odd"}\n# x\n{"s":"a","p":"b","o":{"v":1,"dt":"xsd:integer"},"c":"k","maturity":2}\n{"s":1')
    good, bad = readers.read_jsonl(spark, str(jl), strict=False)
    assert [(r["object_iri"], r["polarity"], r["context"], r["maturity"]) for r in good.collect()] == [("c", "asserted", "ctx:default", 0), (None, "asserted", "k", 2)] and bad.count() == 1
    cs = tmp_path / "a.csv"
    cs.write_text("id,n,x\n1,5,u\n2,five,\n")
    got = readers.read_csv(spark, str(cs), {"subject": {"template": "ex:{id}"}, "columns": [{"column": "n", "predicate": "ex:n", "datatype": "xsd:integer"}, {"column": "x", "predicate": "ex:x", "iri": True, "iri_prefix": "ex:"}]})
    assert {(r["subject"], r["object_iri"], r["object_lit"] and json.loads(r["object_lit"])["dt"]) for r in got.collect()} == {("ex:1", None, "xsd:integer"), ("ex:2", None, "xsd:string"), ("ex:1", "ex:u", None)}
    ttl = tmp_path / "a.trig"
    ttl.write_text('@prefix ex: <http://e/> .\nex:a a ex:C ; ex:p "x"@EN, 5, true . ex:g { ex:b ex:q [ ex:r ex:c ] . }\n')
    got = {(r["subject"], r["predicate"], r["object_iri"], r["context"]) for r in readers.read_document(spark, str(ttl), "trig").collect()}
    assert ("http://e/a", "rdf:type", "http://e/C", "ctx:default") in got and ("_:b1", "http://e/r", "http://e/c", "http://e/g") in got and len(got) == 4
    um = tmp_path / "um.tsv"
    um.write_text("run\tran\tV;PST\nbad\tline\nx\ty\tV;\n")
    good, bad = readers.read_unimorph(spark, str(um))
    assert good.count() == 4 and bad.count() == 2
    cu = tmp_path / "a.conllu"
    cu.write_text("# sent_id = s1\n1\tA\ta\tDET\t_\t_\t2\tdet\t_\t_\n1-2\tAb\t_\t_\t_\t_\t_\t_\t_\t_\n2\tb\tb\tNOUN\t_\t_\t0\troot\t_\t_\n\n# sent_id = s2\n1\tC\tc\tX\t_\t_\t0\troot\t_\t_\n")
    good, bad = readers.read_conllu(spark, str(cu))
    assert bad.count() == 1 and {"ud:s1/t1", "ud:s1/t2", "ud:s2/t1"} == {r["subject"] for r in good.select("subject").distinct().collect()}
    assert readers.parse_jsonld('{"@context": {"e": "http://e/"}, "@id": "e:a", "@type": "e:T", "e:n": [1, {"@value": "x", "@language": "de"}]}')[0][2] == "http://e/T"
    xml = f'<rdf:RDF xmlns:rdf="{readers.RDF}" xmlns:e="http://e/"><rdf:Description rdf:about="a"><e:p>v</e:p><e:q rdf:resource="b"/></rdf:Description></rdf:RDF>'
    assert [r[2] for r in readers.parse_rdfxml(xml)] == [None, "b"]
    pg = tmp_path / "g.json"
    pg.write_text(json.dumps({"nodes": [{"id": "1", "labels": ["P"], "props": {"k": "v"}}], "edges": [{"id": "e", "from": "1", "to": "1", "type": "T", "props": {}}]}))
    assert readers.read_property_graph(spark, str(pg)).count() == 5


def test_release_and_streams(spark, rows, tmp_path):
    r = release_rows(rows, ["ctx:x"])
    assert manifest(r).first() == manifest(r.repartition(3)).first() and manifest(r).first()["statements"] == 5
    src = str(tmp_path / "in")
    spark.range(100).select((F.timestamp_seconds(F.col("id") * 10)).alias("ts"), F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("event_type")).write.parquet(src)
    stream = spark.readStream.schema("ts timestamp, event_type string").parquet(src)
    q = feeds.audit_per_minute(stream).writeStream.format("memory").queryName("audit").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.table("audit").agg(F.sum("n")).first()[0] == 100


def test_spans_and_lifecycle(spark):
    sp = spark.createDataFrame([(1, "r", 0, 10), (2, "r", 10, 5000), (3, "q", 0, 10)], "span_id int, revision_id string, start_offset long, end_offset long")
    q = spark.createDataFrame([(7, "r", 5, 12)], "query_id int, revision_id string, start_offset long, end_offset long")
    assert ids(evidence.spans_overlapping(sp, q), "span_id") == [1, 2]
    c = spark.createDataFrame([("1", "c"), ("2", "c"), ("3", "c")], "statement_id string, context string")
    got = {r["stage"]: r["coverage"] for r in evidence.lifecycle_stages(c, {"anchored": c.limit(1)}, {"clear": c.where("statement_id = '2'")}).collect()}
    assert got == {"anchored": "33.3%", "clear": "66.7%"}
