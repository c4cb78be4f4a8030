"""Scalar functions of the claim model as column expressions (no Python at run time)."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

STATEMENT_PREFIX = "claim:stmt/"  # our own prefix for IRIs of statements

# Code lists of the claim model.
POLARITIES = ["asserted", "negated", "absent", "unknown"]
MATURITY_LABELS = {0: "E0", 1: "E1", 2: "E2", 3: "E3", 4: "E5", 5: "E4"}
MATURITY_FROM_LABEL = {"E0": 0, "E1": 1, "E2": 2, "E3": 3, "E4": 5, "E5": 4, "L0": 0, "L1": 1, "L2": 2, "L3": 3, "L4": 4}
MAX_AUTO_MATURITY = {
    "quoted": 2, "table_read": 2, "example_observed": 2, "source_generalization": 2, "cross_source_inference": 1,
    "model_hypothesis": 1, "human_hypothesis": 1, "manual_entry": 2, "registry_import": 2, "adapter_import": 2,
}
TEXT_CONFIGS = {
    "en": "english", "de": "german", "fr": "french", "es": "spanish", "it": "italian", "pt": "portuguese", "nl": "dutch",
    "ru": "russian", "sv": "swedish", "no": "norwegian", "da": "danish", "fi": "finnish",
}


def lookup(table: dict, key: Column, default: Column | None = None) -> Column:
    got = F.create_map(*[F.lit(x) for x in chain(*table.items())])[key]
    return F.coalesce(got, default) if default is not None else got


def polarity_code(name: Column) -> Column:
    return lookup({p: i for i, p in enumerate(POLARITIES)}, F.lower(name))


def pack_flags(polarity: Column, maturity: Column) -> Column:
    """Polarity in the two low bits, maturity in the next three; null for an unknown polarity."""
    return polarity_code(polarity).bitwiseOR(F.shiftleft(maturity.bitwiseAND(F.lit(7)), 2))


def flag_polarity(flags: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, POLARITIES)), flags.bitwiseAND(F.lit(3)) + 1)


def flag_maturity(flags: Column) -> Column:
    return F.shiftright(flags, 2).bitwiseAND(F.lit(7))


def is_polarity(name: Column) -> Column:
    return F.coalesce(F.lower(name).isin(POLARITIES), F.lit(False))


def maturity_label(stored: Column) -> Column:
    """Stored number to ladder label; 4 and 5 are stored in swapped order."""
    return lookup(MATURITY_LABELS, stored)


def maturity_from_label(label: Column) -> Column:
    return lookup(MATURITY_FROM_LABEL, F.upper(label))


def max_auto_maturity(level: Column) -> Column:
    return lookup(MAX_AUTO_MATURITY, level, F.lit(1))


# Least confidence for each maturity, highest first.
MATURITY_FLOORS = [(0.95, 4), (0.8, 3), (0.6, 2), (0.4, 1)]


def confidence_to_maturity(c: Column) -> Column:
    out = F.lit(0)
    for floor, maturity in reversed(MATURITY_FLOORS):
        out = F.when(c >= floor, maturity).otherwise(out)
    return out


def text_config(lang: Column) -> Column:
    """Language tag to text-search configuration; no tag means English, an unlisted one ``simple``."""
    tag = F.lower(F.coalesce(F.split(lang, "-")[0], F.lit("")))
    return F.when(tag == "", "english").otherwise(lookup(TEXT_CONFIGS, tag, F.lit("simple")))


def statement_iri(statement_id: Column) -> Column:
    return F.concat(F.lit(STATEMENT_PREFIX), statement_id.cast("string"))


def statement_id_of(iri: Column) -> Column:
    return F.when(iri.startswith(STATEMENT_PREFIX), F.substr(iri, F.lit(len(STATEMENT_PREFIX) + 1)))


def bucket_date(day: Column, months: int = 0, days: int = 0, epoch: str = "1970-01-01") -> Column:
    """Floor of a date on a lattice of whole months or whole days; mixed widths are an error.

    Months are floored by month number alone, so the day of month of both dates is ignored.
    """
    if (months > 0) == (days > 0):
        raise ValueError("a bucket is a number of months or a number of days")
    start = F.lit(epoch).cast("date")
    if days:
        n = F.datediff(day, start)
        return F.date_add(start, n - F.pmod(n, F.lit(days)))
    n = (F.year(day) - F.year(start)) * 12 + F.month(day) - F.month(start)
    return F.add_months(start, n - F.pmod(n, F.lit(months)))


def next_bucket(start: Column, months: int = 0, days: int = 0) -> Column:
    return F.date_add(start, days) if days else F.add_months(start, months)


def local_words(iri: Column) -> Column:
    """Local name of an IRI as lower-case words: camel case and punctuation become spaces."""
    local = F.regexp_extract(iri, r"([^/#:]*)$", 1)
    split = F.regexp_replace(local, r"([a-z0-9])([A-Z])", "$1 $2")
    return F.trim(F.regexp_replace(F.lower(split), r"[^a-z0-9]+", " "))


def trigrams(words: Column) -> Column:
    """Set of 3-grams of each word, padded with two blanks before and one after."""
    padded = F.transform(F.filter(F.split(words, " "), lambda w: w != ""), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda i: F.substring(w, i, F.lit(3))))
    return F.array_distinct(F.flatten(grams))


def trigram_similarity(a: Column, b: Column) -> Column:
    """Shared 3-grams over all 3-grams of two word strings; 0 when both are empty."""
    x, y = trigrams(a), trigrams(b)
    return F.coalesce(F.size(F.array_intersect(x, y)) / F.nullif(F.size(F.array_union(x, y)), F.lit(0)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors in doubles; null on different lengths, empty or zero vectors."""
    dot = lambda x, y: F.aggregate(
        F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v
    )
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when((F.size(a) == F.size(b)) & (F.size(a) > 0), dot(a, b) / F.nullif(norm, F.lit(0.0)))


def normalize_percent(raw: Column) -> Column:
    """``12%`` or ``12 percent`` to 0.12, a plain number as it is, anything else null."""
    number = F.regexp_extract(raw, r"^\s*([+-]?[0-9]*\.?[0-9]+)\s*(%|percent)?\s*$", 1)
    value = F.when(number != "", number).try_cast("double")
    return F.when(raw.rlike(r"(%|percent)\s*$"), value / 100).otherwise(value)


def content_hash(subject: Column, predicate: Column, object_iri: Column, object_lit: Column, context: Column, polarity: Column, valid_lo: Column, valid_hi: Column) -> Column:
    """Identity of a claim: everything but its maturity; absent parts count as empty."""
    parts = [subject, predicate, object_iri, object_lit, context, polarity, valid_lo.cast("string"), valid_hi.cast("string")]
    return F.sha2(F.concat_ws("\x1f", *[F.coalesce(p, F.lit("")) for p in parts]), 256)


# Words and signs that mark a time as approximate, at its start.
APPROXIMATE = ["circa", "c.", "ca.", "about", "abt", "abt.", "approximately", "approx", "approx."]
_GRAINS = {"year": 4, "month": 7, "day": 10}  # length of the ISO text of each grain


def time_expression(raw: Column) -> dict[str, Column]:
    """Range, grain and flags of ``1998``, ``c. 1998``, ``1998-10?``, ``1998-10-03``; other texts have grain ``unknown`` and no range."""
    text = F.lower(F.trim(raw))
    longest = F.lit("")
    for word in sorted(APPROXIMATE, key=len):
        longest = F.when(text.startswith(word), word).otherwise(longest)
    approximate, uncertain = longest != "", text.contains("?")
    core = F.trim(F.replace(F.ltrim(F.substring(text, F.length(longest) + 1, F.length(text))), F.lit("?"), F.lit("")))
    digits = F.translate(core, "0123456789", "0000000000")
    grain = F.lit(None).cast("string")
    for name, n in _GRAINS.items():
        grain = F.when(digits == "0000-00-00"[:n], name).otherwise(grain)
    lo = F.when(grain.isNotNull(), F.concat(core, F.substring(F.lit("0000-01-01"), F.length(core) + 1, F.lit(10)))).try_cast("date")
    months = F.when(grain == "year", 12).when(grain == "month", 1).otherwise(0)
    hi = F.when(grain.isNotNull(), F.date_add(F.add_months(lo, months), F.when(grain == "day", 1).otherwise(0)))
    marks = F.concat(F.when(approximate, "~").otherwise(""), F.when(uncertain, "?").otherwise(""))
    edtf = F.concat(F.when(grain.isNotNull(), core).otherwise(raw), marks)
    return {"lo": lo, "hi": hi, "grain": F.coalesce(grain, F.lit("unknown")), "approximate": approximate, "uncertain": uncertain, "edtf": edtf}


def overlaps(lo: Column, hi: Column, a: Column, b: Column) -> Column:
    """Half-open overlap with null as an open end."""
    return (lo.isNull() | b.isNull() | (lo < b)) & (hi.isNull() | a.isNull() | (a < hi))


def contains_point(lo: Column, hi: Column, t: Column) -> Column:
    return (lo.isNull() | (lo <= t)) & (hi.isNull() | (t < hi))
