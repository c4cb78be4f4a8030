"""Readers: files to statement frames ``subject, predicate, object_iri, object_lit, context``.

Line formats are parsed by column expressions over ``spark.read.text`` and split like any
text input. Whole-document formats (one tree per file) are parsed file by file in Arrow
batches; a single file is then the unit of work. Bad input is returned beside the good
rows, so one bad line does not fail a load; ``strict=True`` raises instead.
"""

from __future__ import annotations

import json
import re
import zlib
import xml.etree.ElementTree as ET
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

RDF = "http://www.w3.org/1999/02/22-rdf-syntax-ns#"
SCHEMA = "subject string, predicate string, object_iri string, object_lit string, context string"


def literal(value: Column, datatype: Column | str = "xsd:string", lang: Column | None = None) -> Column:
    """Literal JSON from column values; a null value gives null."""
    dt = F.lit(datatype) if isinstance(datatype, str) else datatype
    parts = [value.alias("v"), dt.alias("dt")] + ([lang.alias("lang")] if lang is not None else [])
    return F.when(value.isNotNull(), F.to_json(F.struct(*parts)))


def _unescape(x: Column) -> Column:
    for a, b in ((r"\\n", "\n"), (r"\\r", "\r"), (r"\\t", "\t"), (r'\\"', '"'), (r"\\\\", "\\\\")):
        x = F.regexp_replace(x, a, b)
    return x


_NODE = r"(<[^<>\s]*>|_:[\w.-]+)"
_QUAD = rf'^\s*{_NODE}\s+(<[^<>\s]*>)\s+(?:{_NODE}|"((?:[^"\\]|\\.)*)"(?:@([A-Za-z0-9-]+)|\^\^<([^<>]*)>)?)\s*{_NODE}?\s*\.\s*(?:#.*)?$'


def read_nquads(spark: SparkSession, path: str, context: str = "ctx:default", strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """N-Quads and N-Triples: (statements, bad lines). Typed values stay text; language tags are lower-cased."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    g = lambda i: F.nullif(F.regexp_extract("value", _QUAD, i), F.lit(""))
    ok = F.col("value").rlike(_QUAD)
    bare = lambda c: F.regexp_replace(c, "^<|>$", "")
    text = _unescape(F.regexp_extract("value", _QUAD, 4))
    dt = F.when(g(5).isNotNull(), "rdf:langString").otherwise(F.coalesce(g(6), F.lit("xsd:string")))
    rows = lines.where(ok).select(
        bare(g(1)).alias("subject"), bare(g(2)).alias("predicate"), bare(g(3)).alias("object_iri"),
        F.when(g(3).isNull(), literal(text, dt, F.lower(g(5)))).alias("object_lit"), F.coalesce(bare(g(7)), F.lit(context)).alias("context"),
    )
    return rows, _bad(lines.where(~ok), strict)


def _bad(bad: DataFrame, strict: bool) -> DataFrame:
    if strict and not bad.isEmpty():
        raise ValueError("unreadable input: " + str(bad.first()[0])[:200])
    return bad


def read_jsonl(spark: SparkSession, path: str, context: str = "ctx:default", strict: bool = True) -> tuple[DataFrame, DataFrame]:
    """Statement lines {s, p, o: {iri} or {v, dt, lang}, c, pol, maturity, valid_lo, valid_hi}; blank and # lines are skipped."""
    lines = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#.*)?$"))
    get = lambda p: F.get_json_object("value", p)
    ok = get("$.s").isNotNull() & get("$.p").isNotNull() & get("$.o").isNotNull()
    polarity = F.lower(F.coalesce(get("$.pol"), F.lit("asserted")))
    rows = lines.where(ok).select(
        get("$.s").alias("subject"), get("$.p").alias("predicate"), get("$.o.iri").alias("object_iri"),
        F.when(get("$.o.iri").isNull(), get("$.o")).alias("object_lit"), F.coalesce(get("$.c"), F.lit(context)).alias("context"),
        F.when(polarity.isin("asserted", "negated", "absent", "unknown"), polarity).otherwise("asserted").alias("polarity"),
        F.coalesce(get("$.maturity").try_cast("int"), F.lit(0)).alias("maturity"),
        get("$.valid_lo").try_cast("date").alias("valid_lo"), get("$.valid_hi").try_cast("date").alias("valid_hi"),
    )
    return rows, _bad(lines.where(~F.coalesce(ok, F.lit(False))), strict)


def read_csv(spark: SparkSession, path: str, mapping: dict) -> DataFrame:
    """CSV by a mapping: subject (``column`` with ``prefix``, or ``template`` with {column}), columns, default_context, skip_blank."""
    table = spark.read.option("header", True).csv(path)
    subject = mapping["subject"]
    if "template" in subject:
        parts = re.split(r"\{([^{}]+)\}", subject["template"])
        made = F.concat(*[F.col(f"`{p}`") if i % 2 else F.lit(p) for i, p in enumerate(parts)])
    else:
        made = F.concat(F.lit(subject.get("prefix", "")), F.col(f"`{subject['column']}`"))
    cells = []
    for c in mapping["columns"]:
        v = F.col(f"`{c['column']}`")
        if c.get("iri"):
            iri, lit = F.concat(F.lit(c.get("iri_prefix", "")), v), F.lit(None).cast("string")
        else:
            iri, kind = F.lit(None).cast("string"), c.get("datatype", "xsd:string")
            typed = {"xsd:integer": "bigint", "xsd:boolean": "boolean"}.get(kind)
            lit = F.coalesce(literal(v.try_cast(typed), kind), literal(v, "xsd:string")) if typed else literal(v, kind)
        cells.append(F.struct(F.lit(c["predicate"]).alias("predicate"), iri.alias("object_iri"), lit.alias("object_lit"), v.alias("raw")))
    rows = table.select(made.alias("subject"), F.inline(F.array(*cells))).withColumn("context", F.lit(mapping.get("default_context", "ctx:default")))
    blank = F.col("raw").isNull() | ((F.trim("raw") == "") if mapping.get("skip_blank", True) else F.lit(False))
    return rows.where(~blank).drop("raw")


def read_property_graph(spark: SparkSession, path: str, prefix: str = "ex:", context: str = "ctx:default") -> DataFrame:
    """Property graph JSON: labels to rdf:type, properties to literals, edges to nodes of their own with from and to."""
    nodes = "array<struct<id:string,labels:array<string>,props:map<string,string>>>"
    edges = "array<struct<id:string,from:string,to:string,type:string,props:map<string,string>>>"
    g = spark.read.schema(f"nodes {nodes}, edges {edges}").option("multiLine", True).json(path)
    iri = lambda c: F.concat(F.lit(prefix), c)
    none = F.lit(None).cast("string")
    n = g.select(F.inline("nodes"))
    e = g.select(F.inline("edges"))
    parts = [
        n.select("id", F.explode("labels").alias("label")).select(
            iri(F.col("id")).alias("subject"), F.lit("rdf:type").alias("predicate"), iri(F.col("label")).alias("object_iri"), none.alias("object_lit")
        ),
        n.select("id", F.explode("props")).select(iri(F.col("id")), iri(F.col("key")), none, literal(F.col("value"))),
        e.select(iri(F.col("id")), F.lit("rdf:type"), iri(F.col("type")), none),
        e.select(iri(F.col("id")), F.lit(prefix + "from"), iri(F.col("from")), none),
        e.select(iri(F.col("id")), F.lit(prefix + "to"), iri(F.col("to")), none),
        e.select("id", F.explode("props")).select(iri(F.col("id")), iri(F.col("key")), none, literal(F.col("value"))),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.withColumn("context", F.lit(context))


# The ten columns of CoNLL-U.
CONLLU = "id form lemma upos xpos feats head deprel deps misc".split()


def read_conllu(spark: SparkSession, path: str, prefix: str = "ud:", context: str = "ctx:ud") -> tuple[DataFrame, DataFrame]:
    """CoNLL-U: (statements, losses). Tokens are ``<file>#s<sentence>t<id>``; ranges and empty nodes are losses.

    A sentence is a block between blank lines, so the reader splits at blank lines and a
    sentence is parsed whole wherever the file was split.
    """
    blocks = spark.read.option("lineSep", "\n\n").text(path).where("trim(value) <> ''")
    sent = blocks.select(F.col("_metadata.file_name").alias("file"), "value")
    name = F.regexp_extract("value", r"(?m)^# sent_id = (.*)$", 1)
    key = F.when(name != "", name).otherwise(F.substring(F.sha2("value", 256), 1, 12))
    rows = sent.select(key.alias("sentence"), F.explode(F.split("value", "\n")).alias("line")).where("line <> '' and not startswith(line, '#')")
    cols = rows.select("sentence", "line", F.split("line", "\t").alias("c"))
    good = (F.size("c") == 10) & F.get("c", F.lit(0)).rlike(r"^\d+$")
    token = lambda i: F.concat(F.lit(prefix), "sentence", F.lit("/t"), i)
    base = cols.where(good).select(token(F.get("c", F.lit(0))).alias("subject"), "sentence", "c")
    cells = [
        F.struct(F.lit(prefix + n).alias("predicate"), F.lit(None).cast("string").alias("object_iri"), literal(F.get("c", F.lit(i))).alias("object_lit"), F.get("c", F.lit(i)).alias("raw"))
        for i, n in enumerate(CONLLU) if n not in ("id", "head")
    ]
    head = F.get("c", F.lit(6))
    cells.append(F.struct(F.lit(prefix + "head").alias("predicate"), F.when(head != "0", token(head)).alias("object_iri"), F.when(head == "0", literal(F.lit("root"))).alias("object_lit"), head.alias("raw")))
    out = base.select("subject", F.inline(F.array(*cells))).where("raw <> '_'").drop("raw").withColumn("context", F.lit(context))
    return out, cols.where(~good).select("line")


def read_unimorph(spark: SparkSession, path: str, prefix: str = "um:", context: str = "ctx:unimorph") -> tuple[DataFrame, DataFrame]:
    """UniMorph TSV (lemma, form, tags by ;): (statements, losses)."""
    lines = spark.read.text(path).where("trim(value) <> ''").select("value", F.split("value", "\t").alias("c"))
    good = (F.size("c") == 3) & ~F.col("value").rlike(r";\s*$")
    form = lines.where(good).select(
        F.concat(F.lit(prefix + "form/"), F.substring(F.sha2("value", 256), 1, 16)).alias("subject"),
        F.get("c", F.lit(0)).alias("lemma"), F.get("c", F.lit(1)).alias("form"), F.split(F.get("c", F.lit(2)), ";").alias("tags"),
    )
    pair = lambda p, v: F.struct(F.lit(prefix + p).alias("predicate"), literal(v).alias("object_lit"))
    cells = F.concat(F.array(pair("lemma", F.col("lemma")), pair("form", F.col("form"))), F.transform("tags", lambda t: pair("tag", t)))
    out = form.select("subject", F.inline(cells))
    return out.select("subject", "predicate", F.lit(None).cast("string").alias("object_iri"), "object_lit", F.lit(context).alias("context")), lines.where(~good).select("value")


def read_cldf(spark: SparkSession, folder: str, prefix: str = "cldf:", context: str = "ctx:cldf") -> DataFrame:
    """CLDF tables languages, parameters, codes, values: a value points to its code where one is known, else to its text."""
    load = lambda n: spark.read.option("header", True).csv(f"{folder}/{n}.csv")
    codes = load("codes").select(F.col("ID").alias("code"), F.col("Parameter_ID").alias("p"), F.col("Name").alias("name"))
    values = load("values")
    met = values.join(codes, (F.col("Parameter_ID") == F.col("p")) & (F.col("Value") == F.col("name")), "left")
    iri = lambda kind, c: F.concat(F.lit(f"{prefix}{kind}/"), c)
    none = F.lit(None).cast("string")
    facts = met.select(
        iri("language", F.col("Language_ID")).alias("subject"), iri("parameter", F.col("Parameter_ID")).alias("predicate"),
        F.when(F.col("code").isNotNull(), iri("code", F.col("code"))).alias("object_iri"), F.when(F.col("code").isNull(), literal(F.col("Value"))).alias("object_lit"),
    )
    labels = [load(n).select(iri(k, F.col("ID")), F.lit(prefix + "name"), none, literal(F.col("Name"))) for n, k in (("languages", "language"), ("parameters", "parameter"), ("codes", "code"))]
    out = facts
    for t in labels:
        out = out.union(t)
    return out.where("object_iri is not null or object_lit is not null").withColumn("context", F.lit(context))


def read_whole(spark: SparkSession, path: str, parse: Callable[[str], list[tuple]], context: str) -> DataFrame:
    """One parser call per file: ``parse`` returns (subject, predicate, iri, literal JSON, context or None)."""

    alone = path.rstrip("/").rsplit("/", 1)[-1]

    def own(term: str | None, file: str) -> str | None:
        """Blank nodes belong to their file: of several files read together, each gets its own names."""
        return f"_:{file}{term[2:]}" if term is not None and term.startswith("_:") and file else term

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for text, name in zip(b["value"], b["file"]):
                file = "" if name.rsplit("/", 1)[-1] == alone else f"f{zlib.crc32(name.encode()):08x}{len(name)}x"
                rows += [(own(r[0], file), r[1], own(r[2], file), r[3], r[4] or context) for r in parse(text)]
            yield pd.DataFrame(rows, columns=["subject", "predicate", "object_iri", "object_lit", "context"])

    return spark.read.text(path, wholetext=True).select("value", F.input_file_name().alias("file")).mapInPandas(run, SCHEMA)


def lit(value, dt: str = "xsd:string", lang: str | None = None) -> str:
    return json.dumps({"v": value, "dt": dt, **({"lang": lang} if lang else {})}, ensure_ascii=False)


_TTL = re.compile(
    r"""\s+|\#[^\n]*|(?P<long>\"\"\".*?\"\"\")|(?P<str>"(?:[^"\\\n]|\\.)*")|(?P<at>@[A-Za-z]+(?:-[A-Za-z0-9]+)*)|(?P<iri><[^<>\s]*>)|(?P<num>[+-]?\d+(?:\.\d+)?(?:[eE][+-]?\d+)?)"""
    r"""|(?P<name>[A-Za-z_][\w.-]*:[\w.%-]*[\w%-]|[A-Za-z_][\w-]*:|:[\w-]+|_:[\w-]+|[A-Za-z]+)|(?P<mark>\^\^|[.;,{}\[\]()])""",
    re.S,
)


def parse_turtle(text: str) -> list[tuple]:
    """Turtle and TriG: prefixes, base, a, ; and , lists, typed and tagged literals, blank nodes, named graphs."""
    tokens = []
    at = 0
    while at < len(text):
        m = _TTL.match(text, at)
        if not m:
            raise ValueError(f"unreadable Turtle near {text[at : at + 30]!r}")
        if m.lastgroup:
            tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    prefixes, base, out, pos, blank = {}, "", [], 0, 0

    def peek() -> str:
        return tokens[pos][1] if pos < len(tokens) else ""

    def name(kind: str, t: str) -> str:
        if kind == "iri":
            return t[1:-1] if ":" in t else base + t[1:-1]
        if t.startswith("_:"):
            return t
        if t == "a":
            return "rdf:type"
        head, _, tail = t.partition(":")
        return prefixes[head] + tail if head in prefixes else t

    def node(graph):
        nonlocal pos, blank
        kind, t = tokens[pos]
        pos += 1
        if t == "[":
            blank += 1
            me = f"_:b{blank}"
            if peek() != "]":
                properties(me, graph, "]")
            pos += 1
            return me, None
        if kind in ("str", "long"):
            value = json.loads(t) if kind == "str" else t[3:-3]
            if peek() == "^^":
                pos += 2
                return None, lit(value, name(*tokens[pos - 1]))
            if pos < len(tokens) and tokens[pos][0] == "at":
                pos += 1
                return None, lit(value, "rdf:langString", tokens[pos - 1][1][1:].lower())
            return None, lit(value)
        if kind == "num":
            return None, lit(float(t) if re.search(r"[.eE]", t) else int(t), "xsd:decimal" if "." in t else "xsd:integer")
        if t in ("true", "false"):
            return None, lit(t == "true", "xsd:boolean")
        return name(kind, t), None

    def properties(subject: str, graph, end: str) -> None:
        nonlocal pos
        while peek() not in (end, ""):
            predicate = name(*tokens[pos])
            pos += 1
            while True:
                iri, value = node(graph)
                out.append((subject, predicate, iri, value, graph))
                if peek() != ",":
                    break
                pos += 1
            while peek() == ";":
                pos += 1

    def statements(graph, end: str) -> None:
        nonlocal pos, base
        while peek() not in (end, ""):
            word = peek().lower()
            if word in ("@prefix", "prefix"):
                prefixes[tokens[pos + 1][1][:-1]] = tokens[pos + 2][1][1:-1]
                pos += 3
            elif word in ("@base", "base"):
                base = tokens[pos + 1][1][1:-1]
                pos += 2
            elif word == ".":
                pos += 1
            elif word == "{" or word == "graph" or (pos + 1 < len(tokens) and tokens[pos + 1][1] == "{"):
                pos += word == "graph"
                inner = None if peek() == "{" else node(None)[0]
                pos += 1
                statements(inner, "}")
                pos += 1
            else:
                subject, _ = node(graph)
                properties(subject, graph, "." if end != "}" else ("." if "." in (x[1] for x in tokens[pos:]) else "}"))
                if peek() == ".":
                    pos += 1

    statements(None, "\x00")
    return out


def parse_rdfxml(text: str) -> list[tuple]:
    """RDF/XML descriptions with resource, literal and typed properties."""
    root = ET.fromstring(text)
    full = lambda tag: "rdf:type" if tag == f"{{{RDF}}}type" else tag[1:].replace("}", "")
    out = []
    for n, d in enumerate(root):
        me = d.get(f"{{{RDF}}}about") or f"_:{d.get(f'{{{RDF}}}nodeID') or n}"
        if d.tag != f"{{{RDF}}}Description":
            out.append((me, "rdf:type", full(d.tag), None, None))
        for p in d:
            res, dt, lang = p.get(f"{{{RDF}}}resource"), p.get(f"{{{RDF}}}datatype"), p.get("{http://www.w3.org/XML/1998/namespace}lang")
            value = None if res else lit(p.text or "", "rdf:langString" if lang else dt or "xsd:string", lang)
            out.append((me, full(p.tag), res, value, None))
    return out


def parse_jsonld(text: str) -> list[tuple]:
    """JSON-LD with a prefix context, @id, @type, @graph, @value and arrays."""
    doc = json.loads(text)
    context = {k: v for k, v in (doc.get("@context") or {}).items() if isinstance(v, str)} if isinstance(doc, dict) else {}
    out: list[tuple] = []
    count = 0

    def full(name: str) -> str:
        head, colon, tail = name.partition(":")
        return context[head] + tail if colon and head in context else context.get(name, name)

    def walk(node: dict) -> str:
        nonlocal count
        count += 1
        me = full(node["@id"]) if "@id" in node else f"_:n{count}"
        for key, values in node.items():
            for v in values if isinstance(values, list) else [values]:
                if key == "@type":
                    out.append((me, "rdf:type", full(v), None, None))
                elif key == "@graph":
                    walk(v)
                elif not key.startswith("@"):
                    if isinstance(v, dict) and "@value" in v:
                        lang = v.get("@language")
                        out.append((me, full(key), None, lit(v["@value"], "rdf:langString" if lang else v.get("@type", "xsd:string"), lang), None))
                    elif isinstance(v, dict):
                        out.append((me, full(key), walk(v) if set(v) != {"@id"} else full(v["@id"]), None, None))
                    else:
                        kind = "xsd:boolean" if isinstance(v, bool) else "xsd:integer" if isinstance(v, int) else "xsd:decimal" if isinstance(v, float) else "xsd:string"
                        out.append((me, full(key), None, lit(v, kind), None))
        return me

    for node in doc if isinstance(doc, list) else [doc]:
        walk(node)
    return out


def parse_lift(text: str) -> list[tuple]:
    """LIFT lexicons: entries with their forms, senses with glosses and definitions."""
    out = []
    for e in ET.fromstring(text).iter("entry"):
        me = "lift:" + (e.get("id") or e.get("guid") or "")
        out += [(me, "lift:form", None, lit(f.findtext("text") or "", "rdf:langString", f.get("lang")), None) for f in e.findall("lexical-unit/form")]
        for n, s in enumerate(e.findall("sense")):
            sense = f"{me}/{s.get('id') or n}"
            out.append((me, "lift:sense", sense, None, None))
            out += [(sense, "lift:gloss", None, lit(g.findtext("text") or "", "rdf:langString", g.get("lang")), None) for g in s.findall("gloss")]
            out += [(sense, "lift:definition", None, lit(f.findtext("text") or "", "rdf:langString", f.get("lang")), None) for f in s.findall("definition/form")]
    return out


def parse_eaf(text: str) -> list[tuple]:
    """EAF annotations: aligned ones with times from the slots, referring ones with their target."""
    root = ET.fromstring(text)
    slots = {s.get("TIME_SLOT_ID"): s.get("TIME_VALUE") for s in root.iter("TIME_SLOT")}
    out = []
    for tier in root.iter("TIER"):
        for a in tier.iter():
            if a.tag not in ("ALIGNABLE_ANNOTATION", "REF_ANNOTATION"):
                continue
            me = "eaf:" + a.get("ANNOTATION_ID", "")
            out.append((me, "eaf:tier", None, lit(tier.get("TIER_ID", "")), None))
            out.append((me, "eaf:value", None, lit(a.findtext("ANNOTATION_VALUE") or ""), None))
            for attr, p in (("TIME_SLOT_REF1", "eaf:begin"), ("TIME_SLOT_REF2", "eaf:end")):
                if slots.get(a.get(attr)):
                    out.append((me, p, None, lit(int(slots[a.get(attr)]), "xsd:integer"), None))
            if a.get("ANNOTATION_REF"):
                out.append((me, "eaf:refersTo", "eaf:" + a.get("ANNOTATION_REF"), None, None))
    return out


PARSERS = {"turtle": parse_turtle, "trig": parse_turtle, "rdfxml": parse_rdfxml, "jsonld": parse_jsonld, "lift": parse_lift, "eaf": parse_eaf}


def read_document(spark: SparkSession, path: str, kind: str, context: str = "ctx:default") -> DataFrame:
    return read_whole(spark, path, PARSERS[kind], context)


def quarantine(rows: DataFrame, valid: Column, reason: str) -> DataFrame:
    """Rows that fail a check moved to a quarantine context of their own; nothing is dropped."""
    place = F.concat(F.lit("ctx:quarantine/"), F.regexp_replace(F.lit(reason), r"[^A-Za-z0-9_-]+", "_"))
    return rows.withColumn("context", F.when(F.coalesce(valid, F.lit(False)), F.col("context")).otherwise(place))
