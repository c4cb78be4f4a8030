"""Tests of what the first advice found missing."""

from pyspark.sql import functions as F

from claimweave.operators import wide
from claimweave.plans import training_core as t
from claimweave.plans.runtime import table
from claimweave.query.plan import Store, run

DATA = "/root/testdata/sf0.001"


def test_wide_holds_the_values_of_many_valued_predicates(spark):
    v = lambda x: '{"v": %s}' % x
    rows = [("a", "n", None, v(10)), ("a", "n", None, v('"9"')), ("a", "n", None, v('"9.0"')), ("a", "n", None, v('"x"'))]
    rows += [("b", "n", None, v(i)) for i in range(4)] + [("c", "m", None, v('"one"')), ("d", "n", None, v('"x"'))]
    df = spark.createDataFrame([(*r, "asserted") for r in rows], "subject string, predicate string, object_iri string, object_lit string, polarity string")
    attributes = [("m", "string", True), ("n", "integer", True)]
    got = wide.pivot_typed(df, attributes, lists=True, most=3)
    assert dict(got.dtypes) == {"subject": "string", "m": "array<string>", "n": "array<bigint>"}
    cells = {r["subject"]: (r["m"], r["n"]) for r in got.collect()}
    assert cells == {"a": ([], [9, 10]), "b": ([], None), "c": (["one"], []), "d": ([], [])}
    over = wide.overflow_values(df, attributes, most=3).collect()
    assert sorted((r["subject"], r["predicate"], r["value"]) for r in over) == [("b", "n", str(i)) for i in range(4)]


def test_p2_wide_and_overflow_hold_every_value(spark):
    attributes = wide.attribute_list(table(spark, DATA, "predicate_types"))
    got = t.p2_wide(spark, DATA)
    kinds = [k for _, k in got.dtypes][1:]
    many = [i for i, a in enumerate(attributes) if a[2]]
    assert all(kinds[i] == f"array<{wide.COLUMN_TYPES[attributes[i][1]]}>" for i in many)
    values = {(r[0], attributes[i][0], str(x)) for r in got.collect() for i in many for x in r[i + 1] or ()}
    values |= {tuple(r) for r in t.p2_overflow(spark, DATA).select("subject", "predicate", "value").collect()}
    want = wide.many_values_long(table(spark, DATA, "statements"), [attributes[i] for i in many])
    assert values == {tuple(r) for r in want.select("subject", "predicate", "value").collect()} and values


def test_under_hypothesis_sees_every_seed(spark):
    n = 10_050
    contexts = spark.range(n).select(F.concat(F.lit("h"), "id").alias("iri"), F.lit("hypothesis").alias("kind"), F.lit(None).cast("string").alias("parent"))
    more = spark.createDataFrame([("below", "source", "h7"), ("aside", "source", None)], "iri string, kind string, parent string")
    contexts = contexts.unionByName(more)
    claims = contexts.select(
        F.col("iri").alias("statement_id"), F.col("iri").alias("subject"), F.lit("ex:p").alias("predicate"), F.lit("ex:o").alias("object_iri"),
        F.lit(None).cast("string").alias("object_lit"), F.col("iri").alias("context"), F.lit("asserted").alias("polarity"), F.lit(1).alias("maturity"),
        *[F.lit(None).cast(kind).alias(c) for c, kind in (("valid_lo", "date"), ("valid_hi", "date"), ("tx_lo", "timestamp"), ("tx_hi", "timestamp"))],
    )
    text = "PRESET under_hypothesis MATCH ?x ex:p ?o PROJECT ?x"
    got = {r["x"] for r in run(Store(claims, contexts=contexts), text).collect()}
    assert len(got) == n + 1 and "below" in got and "aside" not in got
    assert run(Store(claims, contexts=more), text).count() == 0  # no hypothesis: nothing, not everything


def test_p4_descendants_lists_every_pair(spark, tmp_path):
    rows = [("a", None, 1), ("b", "a", 2), ("c", " b ", 3), ("d", "a", 4), ("x", "y", 5), ("y", "x", 6), ("z", "x", 7), ("b", "d", 9)]
    spark.createDataFrame(rows, "iri string, parent string, req_id long").write.parquet(f"{tmp_path}/contexts.parquet")
    got = sorted((r["ancestor"], r["node"]) for r in t.p4_descendants(spark, str(tmp_path)).collect())
    assert got == [("a", "b"), ("a", "c"), ("a", "d"), ("b", "c")]
