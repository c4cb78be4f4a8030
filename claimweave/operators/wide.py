"""Attribute-value rows to one typed row per entity.

The entity-by-attribute grid is completed inside each entity's row: the cells that
have rows are collected with their attribute position, and the fixed list of positions
takes each its cell or an empty one, which is the left join of the values to the grid.
Column i of the wide table is then fixed index i put through the try cast of its
type. So the grid never exists as rows and no cross join is made; an entity's array
is as long as the attribute list, whatever the number of its rows, because the rows of
a cell are reduced to its distinct typed values before shuffling.

Defined cases: a cell without rows is null and no failure; a cell whose rows have no
value that fits, or fitting values that differ, is null and listed by
``unfilled_cells``; a many-valued cell is the sorted array of its distinct typed values,
empty without any, and null only if it has more than ``MOST_VALUES``: exactly those cells
are in ``overflow_values``, all values, one per row; repeated rows change nothing; null subjects or predicates, and
predicates missing from the register, are left out; empty input gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimweave.plans.runtime import Scratch

# Declared value types and the column types they become.
COLUMN_TYPES = {"integer": "bigint", "double": "double", "boolean": "boolean", "iri": "string", "string": "string", "instant": "string"}
# A many-valued cell with more distinct values goes to the overflow table, so that no row grows with the input.
MOST_VALUES = 1_000
_GROUPED = r"^[+-]?(?:\d+|\d{1,3}(?:,\d{3})+)(?:\.\d*)?(?:[eE][+-]?\d{1,3})?$"
_SHORT = r"^[+-]?\d{1,18}$"
_BARE = r"^[+-]?\.\d+(?:[eE][+-]?\d{1,3})?$"
_DECIMAL = r"^[+-]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][+-]?\d{1,3})?$"
_IRI = r"^[A-Za-z][A-Za-z0-9+.-]*:[^\s<>\"{}|^`\\]+$"


def trimmed(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def short_iri(x: Column, prefix: str = "ex:", full: str = "http://example.org/") -> Column:
    """An IRI in short form, or null if the text is none; ``<...>`` and a prefix in full are accepted."""
    bare = F.regexp_extract(trimmed(x), r"^(?:<([^<>]*)>|([^<>]*))$", 0)
    bare = F.regexp_replace(bare, r"^<|>$", "")
    short = F.when(bare.startswith(full), F.concat(F.lit(prefix), F.substr(bare, F.lit(len(full) + 1)))).otherwise(bare)
    return F.when(short.rlike(_IRI), short)


def typed_key(kind: Column, text: Column, iri: Column) -> Column:
    """Canonical text of a value as its declared type, null if it doesn't fit.

    Equal keys mean equal typed values. Whole numbers of any length fit, as digits without
    rounding (the wide table's 64-bit column is null beyond its range); numbers beyond a
    double don't.
    """
    v = trimmed(text)
    integer = F.when(v.rlike(_SHORT), v.cast("bigint").cast("string")).when(v.rlike(_GROUPED) | v.rlike(_BARE), _whole_number(v))
    real = F.when(v.rlike(_DECIMAL), F.regexp_replace(v, ",", ".").try_cast("double") + F.lit(0.0))
    double = F.when(F.abs(real) < float("inf"), real.cast("string"))
    low = F.lower(v)
    boolean = F.when(low.isin("true", "yes", "y", "1"), "true").when(low.isin("false", "no", "n", "0"), "false")
    return (
        F.when(kind == "integer", integer)
        .when(kind == "double", double)
        .when(kind == "boolean", boolean)
        .when(kind == "iri", F.coalesce(short_iri(iri), short_iri(text)))
        .otherwise(F.when(v != "", v))
    )


def _whole_number(v: Column) -> Column:
    """Digits of a number in any notation, null unless it is whole; nothing is rounded."""
    pieces = F.split(F.regexp_replace(F.regexp_replace(v, ",", ""), r"^([+-]?)(\d*)\.?(\d*)(?:[eE]([+-]?\d+))?$", "$1|$2|$3|$4"), r"\|", -1)

    def build(p: Column) -> Column:
        digits = F.concat(p[1], p[2])
        shift = F.coalesce(F.nullif(p[3], F.lit("")).cast("int"), F.lit(0)) - F.length(p[2])  # zeros to add, or digits to cut
        cut = F.greatest(F.length(digits) + shift, F.lit(0))
        whole = F.when(shift >= 0, F.rpad(digits, F.length(digits) + shift, F.lit("0"))).otherwise(F.substring(digits, F.lit(1), cut))
        rest = F.when(shift >= 0, F.lit("")).otherwise(F.substring(digits, cut + 1, F.length(digits)))
        bare = F.regexp_replace(whole, "^0+", "")
        signed = F.when(bare == "", F.lit("0")).otherwise(F.concat(F.when(p[0] == "-", F.lit("-")).otherwise(F.lit("")), bare))
        return F.when(rest.rlike("^0*$"), signed)

    return F.get(F.transform(F.array(pieces), build), F.lit(0))  # the pieces are computed once


def attribute_list(types: DataFrame) -> list[tuple[str, str, bool]]:
    """The attribute register as (predicate, type, many), sorted: the columns of the result, so a list whatever its length."""
    rows = types.where("predicate is not null").groupBy("predicate").agg(
        F.max("value_type").alias("t"), F.max("many_values").alias("m")
    ).orderBy("predicate").collect()
    return [(r["predicate"], r["t"], bool(r["m"])) for r in rows]


def typed_rows(statements: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """``subject, pos, many, key`` of the asserted rows: the typed value as canonical text, null if it doesn't fit."""
    register = statements.sparkSession.createDataFrame([(p, t, i, m) for i, (p, t, m) in enumerate(attributes)], "predicate string, kind string, pos int, many boolean")
    rows = statements.where("polarity = 'asserted' and subject is not null").select("subject", "predicate", "object_iri", "object_lit")
    return rows.join(F.broadcast(register), "predicate").select(  # register: one row per column of the result
        "subject", "pos", "many", typed_key(F.col("kind"), F.get_json_object("object_lit", "$.v"), F.col("object_iri")).alias("key")
    )


def cells(statements: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """``subject, pos, n, fits, lo, hi`` per subject and attribute that has asserted rows."""
    return typed_rows(statements, attributes).groupBy("subject", "pos").agg(
        F.count("*").alias("n"), F.count("key").alias("fits"), F.min("key").alias("lo"), F.max("key").alias("hi")
    )


def grid(cell_rows: DataFrame, width: int) -> DataFrame:
    """``subject, cells``: the completed grid, all ``width`` cells of a subject in the order of their positions.

    The values are joined to the positions inside the subject's row: position i takes the
    cell of that number, or an empty one.
    """
    rest = [c for c in cell_rows.columns if c not in ("subject", "pos")]
    have = cell_rows.groupBy("subject").agg(F.collect_list(F.struct("pos", *rest)).alias("have"))  # at most width entries
    have = have.select("subject", "have", F.col("have.pos").alias("at"))
    joined = F.transform(F.sequence(F.lit(0), F.lit(width - 1)), lambda i: F.get("have", (F.array_position("at", i) - 1).cast("int")))
    return have.select("subject", joined.alias("cells"))


def pivot_typed(statements: DataFrame, attributes: list[tuple[str, str, bool]], lists: bool = False, most: int = MOST_VALUES) -> DataFrame:
    """One row per subject, one column of the declared type per attribute.

    Column names are the predicates with everything but letters and digits as ``_``,
    numbered where that makes two of them equal. Many-valued attributes become arrays of
    the declared type with ``lists`` (cells of more than ``most`` values: null, see
    ``overflow_values``), else the number of their distinct values. The statements are
    read once; a subject's cells come together in one shuffle of distinct values.
    """
    rows = typed_rows(statements, attributes).distinct()
    if lists:
        rows = Scratch(statements.sparkSession, "wide").keep(rows)
        huge = rows.where("many and key is not null").groupBy("subject", "pos").agg(F.count("*").alias("k")).where(F.col("k") > most)
        huge = huge.select("subject", "pos", F.lit(True).alias("huge"))
        # cells that hold too many values keep a mark only, so that no row grows with the input
        mark = huge.withColumns({"many": F.lit(True), "key": F.lit(None).cast("string")})
        rows = rows.join(huge.drop("huge"), ["subject", "pos"], "left_anti").withColumn("huge", F.lit(False)).unionByName(mark)
    else:
        rows = rows.withColumn("huge", F.lit(False))
    values = F.collect_list(F.when(F.col("many"), F.col("key"))) if lists else F.lit(None).cast("array<string>")
    cell_rows = rows.repartition("subject").groupBy("subject", "pos").agg(
        F.min("key").alias("lo"), F.max("key").alias("hi"), F.count("key").alias("k"), values.alias("values"), F.max("huge").alias("huge")
    )
    wide = grid(cell_rows, len(attributes))
    out, used = [F.col("subject")], {"subject"}
    for i, (predicate, kind, is_many) in enumerate(attributes):
        name = base = "".join(c if c.isalnum() else "_" for c in predicate)
        k = 1
        while name.lower() in used:
            k += 1
            name = f"{base}_{k}"
        used.add(name.lower())
        cell, target = F.get("cells", F.lit(i)), COLUMN_TYPES.get(kind, "string")
        if is_many and lists:
            typed = cell["values"] if target == "string" else F.transform(cell["values"], _try_cast(target))
            empty = F.array().cast(f"array<{target}>")
            out.append(F.when(cell["huge"], F.lit(None)).otherwise(F.coalesce(F.sort_array(typed), empty)).alias(name))
        elif is_many:
            out.append(F.coalesce(cell["k"], F.lit(0).cast("long")).alias(name))
        else:
            out.append(F.when(cell["lo"] == cell["hi"], cell["lo"].try_cast(target)).alias(name))
    return wide.select(*out)


def _try_cast(target: str):
    return lambda x: x.try_cast(target)


def _huge_cells(values: DataFrame, most: int) -> DataFrame:
    return values.groupBy("subject", "predicate").agg(F.count("*").alias("n")).where(F.col("n") > most).select("subject", "predicate")


def overflow_values(statements: DataFrame, attributes: list[tuple[str, str, bool]], most: int = MOST_VALUES) -> DataFrame:
    """``subject, predicate, value`` (canonical text) of all many-valued cells with more than ``most`` distinct values."""
    values = Scratch(statements.sparkSession, "wide").keep(many_values_long(statements, [a for a in attributes if a[2]]))
    return values.join(_huge_cells(values, most), ["subject", "predicate"], "left_semi")


def many_values_long(statements: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """Distinct ``subject, predicate, value`` of the given attributes, typed as canonical text."""
    register = statements.sparkSession.createDataFrame([(p, t) for p, t, _ in attributes], "predicate string, kind string")
    rows = statements.where("polarity = 'asserted' and subject is not null").join(F.broadcast(register), "predicate")
    key = typed_key(F.col("kind"), F.get_json_object("object_lit", "$.v"), F.col("object_iri"))
    return rows.select("subject", "predicate", key.alias("value")).where("value is not null").distinct()


def unfilled_cells(wide: DataFrame, attributes: list[tuple[str, str, bool]]) -> DataFrame:
    """``subject, predicate, reason`` of the grid's single-valued cells that have rows but can't be filled.

    Fixed index i of the grid goes through the try cast of its type; a cell with rows is
    unfilled if its smallest or largest value casts to nothing or the two differ. Whole
    numbers beyond 64 bits are compared as digits.
    """
    failures = []
    for i, (predicate, kind, many) in enumerate(attributes):
        if many:
            continue
        cell, target = F.get("cells", F.lit(i)), COLUMN_TYPES.get(kind, "string")
        lo, hi = (cell[c].try_cast(target) for c in ("lo", "hi"))
        if kind == "integer":
            same = lo.eqNullSafe(hi) & (cell["lo"] == cell["hi"])
        else:
            same = lo == hi
        reason = F.when(cell["fits"] == 0, "no value fits").when(~F.coalesce(same, F.lit(False)), "values differ")
        failures.append(F.when(cell["n"] > 0, F.struct(F.lit(predicate).alias("predicate"), reason.alias("reason"))))
    bad = F.filter(F.array(*failures), lambda c: c["reason"].isNotNull())
    return wide.select("subject", F.inline(bad))
