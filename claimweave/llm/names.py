"""Variant spellings of typed names: merge-and-rematch resolution.

A name is read into a profile: kind, main name (surname or place, folded), first name
(nicknames and abbreviations resolved) or only its initial, further initials. What a
comma or a known word doesn't decide, the corpus does: words that stand in many
different names are first names or kinds of body, and a first name that keeps standing
beside the same rare main names as a commoner one is its short form. Equal
profiles are one node. Profiles meet in blocks of one initial and one spelling with a
letter deleted, so a pair at one typing error shares a block. Then rounds: clusters hold
the union of their spellings, first names and initials; every candidate pair between
clusters is judged again with what the clusters know by now, accepted pairs are merged by
the grouping operator, clusters that grew enter blocking again under all the initials
they know, and rounds end when nothing merges. A cluster that only knows an initial joins
the one fuller cluster that fits best, and none if two fit equally well.

Fixed values in this module: titles, suffixes, words for nobody, first names with
their usual short forms, words of institutions.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from claimweave.llm.groups import connected_groups
from claimweave.plans.runtime import Scratch

TITLES = "mr mrs miss ms dr rev revd capt captain sir lady prof fr sr st master madam hon col maj lt sgt".split()
SUFFIXES = "jun junr jnr jr junior sen senr snr senior widow elder younger sic est inc ltd assoc association dec decd esq the of and".split()
NOBODY = "unknown unnamed illegible infant anon anonymous nn n.n. child male female none null na unidentified stranger".split()
FIRST_NAMES = {
    "frederick": "fred freddie freddy fredk fritz", "matthew": "matt matty mat", "elizabeth": "betty lizzie eliza bess beth eliz liz bessie",
    "nathaniel": "nat nate nathl", "zachary": "zac zach zack", "benjamin": "ben benny benj", "isabella": "bella izzy isab bell",
    "charlotte": "lottie charley charl lotte", "catherine": "kate cathy cath kitty katie cathe", "robert": "bob rob robt bobby robbie",
    "william": "bill will wm billy willie willm", "thomas": "tom tommy thos", "james": "jim jimmy jas jamie", "wilhelmina": "mina minnie wilh",
    "abigail": "abby gail abig", "quentin": "quin quent", "archibald": "archie baldie archd arch", "victoria": "tori vicky vict",
    "kenneth": "ken kenny kenn", "gilbert": "gil bertie gilb", "yolanda": "landa yola yol", "oliver": "ollie noll olivr",
    "leonard": "len lenny leond leo", "susannah": "sue sukie sus susan", "jonathan": "jon jonny jonn", "samuel": "sam sammy saml",
    "theodora": "thea theo theod dora", "lawrence": "larry laurie lawr", "ursula": "ulla ursie urs", "edward": "ned ted edwd teddy eddie",
    "henrietta": "hettie etta hen", "dorothy": "dolly dot dor", "patrick": "paddy pat patk", "penelope": "penny nell penel",
    "rebecca": "becky reba reb", "margaret": "peggy maggie margt meg", "john": "jack johnny jno", "joseph": "joe jos", "george": "geo georgie",
    "mary": "polly molly may", "alexander": "alex sandy alexr", "henry": "harry hy hal", "richard": "dick rich richd", "charles": "chas charlie",
    "michael": "mick mike michl", "daniel": "dan danl", "ann": "annie nan anne", "sarah": "sally sadie", "hannah": "hanna", "jane": "jenny janey",
    "albert": "bert alb", "alfred": "alf alfie", "walter": "wally walt", "harriet": "hattie", "ellen": "nellie", "emily": "emmy", "emma": "em",
}
FIELD_WORDS = "county shire mining mission historical botanical records language university parish town city state national public trading medical".split()
BODY_WORDS = "archive library company school society institute office centre press council museum hospital church college bank club mill union".split()
ORG_CLAIMS = "ex:employer ex:heldBy ex:memberOf".split()
PERSON_CLAIMS = "ex:witness ex:neighbourOf ex:informant ex:heirOf".split()

_SHORT = {s: full for full, forms in FIRST_NAMES.items() for s in forms.split()} | {n: n for n in FIRST_NAMES}


def plain(text: str) -> str:
    text = unicodedata.normalize("NFKD", text)
    return "".join(c for c in text if not unicodedata.combining(c)).lower()


def fold(word: str) -> str:
    """One spelling for usual variants of the same sound."""
    w = word.replace("ck", "k").replace("ph", "f").replace("y", "i")
    return re.sub(r"(.)\1+", r"\1", w)


def near(a: str, b: str) -> bool:
    """At most one letter inserted, deleted, replaced, or two neighbours swapped."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def abbreviates(short: str, full: str) -> bool:
    if not short or short[0] != full[0] or len(short) >= len(full):
        return False
    rest = iter(full)
    return all(c in rest for c in short)


@lru_cache(maxsize=100_000)
def first_name(token: str) -> tuple[str, int]:
    """The full first name a token stands for, and how sure: 0 known, 1 abbreviation, 2 typing error, 9 none."""
    if token in _SHORT:
        return _SHORT[token], 0
    if len(token) >= 3:
        hits = {full for full in FIRST_NAMES if full.startswith(token)}
        if len(hits) == 1:
            return hits.pop(), 1
        hits = {full for full in FIRST_NAMES if len(token) >= 5 and near(token, full)}
        hits |= {_SHORT[s] for s in _SHORT if len(token) >= 4 and len(s) >= 4 and near(token, s)}
        if len(hits) == 1:
            return hits.pop(), 2
    return token, 9


@lru_cache(maxsize=100_000)
def _word(token: str, words: tuple[str, ...]) -> str | None:
    if token in words:
        return token
    hits = [w for w in words if len(token) >= 5 and near(token, w)] or [w for w in words if len(token) < 8 and abbreviates(token, w)]
    prefix = [w for w in hits if w.startswith(token)]
    hits = prefix or hits
    return hits[0] if len(hits) == 1 else None


def read_org(tokens: list[str]) -> tuple[str, str] | None:
    """(place, 'field body') of an institution's words, or None."""
    tokens = [t for t in tokens if t not in SUFFIXES]
    if len(tokens) < 3:
        return None
    for i in range(len(tokens) - 1):
        field, body = _word(tokens[i], tuple(FIELD_WORDS)), _word(tokens[i + 1], tuple(BODY_WORDS))
        if field and body:
            rest = tokens[:i] + tokens[i + 2 :]
            return (max(rest, key=len), f"{field} {body}") if rest else None
    return None


def read_parts(name: str | None, hint: str, lists: bool = True) -> tuple[str, ...] | None:
    """(kind, main name, first name or '', initial, further initials, written initial, loose words) of a typed name, None for nobody.

    ``hint``: ``person``, ``org`` or ``any``. Words whose part in the name neither a comma
    nor (with ``lists``) a known word decides come back as loose words, and the corpus decides.
    """
    if name is None:
        return None
    text = plain(name)
    if text.startswith(("ex:person/", "ex:org/")):
        hint = "person" if text.startswith("ex:person/") else "org"
        text = text.split("/", 1)[1].replace("-", " ")
    bare = re.sub(r"\([^)]*\)|\[sic\]", " ", text)
    words = re.findall(r"[^\W\d_]+", bare)
    if not words or all(w in NOBODY for w in words) or re.sub(r"[\s.]", "", bare) == "nn":
        return None
    if hint != "person":
        org = read_org(words) if lists else None
        if org:
            return "o", fold(org[0]), org[1], org[1][0], "", "", ""
        if hint == "org":
            rest = [fold(w) for w in words if w not in SUFFIXES and len(w) > 1]
            if not rest:
                return None
            return ("o", rest[0], "", "", "", "", "") if len(rest) == 1 else ("o", "", "", "", "", "", " ".join(sorted(set(rest))))
    head, comma, tail = bare.partition(",")
    strip = lambda ws: [w for w in ws if w not in SUFFIXES and w not in TITLES]
    before, after = strip(re.findall(r"[^\W\d_]+", head)), strip(re.findall(r"[^\W\d_]+", tail))
    tokens = before + after
    long = [w for w in tokens if len(w) > 1]
    initials = [w for w in tokens if len(w) == 1]
    known = first_name if lists else lambda w: (w, 9)
    if not long:
        return None
    if len(long) == 1:
        sur, given = long[0], None
        if not initials and known(sur)[1] == 0:
            return None  # a first name alone names nobody in particular
    elif comma and after and before and any(len(w) > 1 for w in before):
        sur = max(before, key=len)
        given = next((w for w in after if len(w) > 1), None)
        if given is None:
            given = next((w for w in before if w != sur and len(w) > 1), None)
    else:
        sure = [known(w)[1] for w in long]
        at = min(range(len(long)), key=lambda i: (sure[i], i))
        if sure[at] == 9:
            return "p", "", "", "", "".join(sorted(set(initials))), "", " ".join(sorted(set(long)))
        given = long[at]
        others = long[:at] + long[at + 1 :]
        sur = max(others, key=len)
    full = known(given)[0] if given else ""
    initial = full[:1] or (initials[0] if initials else "")
    written = given[:1] if given else ""
    if not given:
        initials = initials[1:]
    return "p", fold(sur), full, initial, "".join(sorted(set(initials))), written, ""


def read_name(name: str | None, hint: str) -> tuple[str, ...] | None:
    """Kind, main name, first name, initial and further initials, as far as the name alone tells them."""
    got = read_parts(name, hint)
    return got[:5] if got else None


PARTS = ["kind", "main", "given", "initial", "more", "written", "loose"]
PROFILE = ", ".join(f"{c} string" for c in PARTS)


def _read(lists: bool):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            got = [read_parts(n, h, lists) for n, h in zip(b["name"], b["hint"])]
            keep = [g is not None for g in got]
            out = pd.DataFrame([g for g in got if g], columns=PARTS)
            out.insert(0, "key", b["key"][keep].reset_index(drop=True))
            yield out

    return run


def place_loose(parsed: DataFrame) -> DataFrame:
    """``parsed`` with the loose words of each name given their parts by what the corpus shows.

    A word is the more of a first name (or of a body's kind) the more different names it
    stands in, and what a comma or a list fixed elsewhere counts before that; ties go by
    the alphabet, so the order of the words never matters. The rest's longest word is the
    main name; of a body it is the word found in the fewest names.
    """
    words = F.explode(F.split("loose", " "))
    open_ = parsed.where("loose <> ''").select("key", "kind", words.alias("w"), "loose")
    uses = open_.select("kind", "w", F.xxhash64(F.array_remove(F.split("loose", " "), F.col("w"))).alias("rest"), F.lit(0).alias("sign"))
    fixed = parsed.where("loose = '' and given <> ''")
    for c, sign in (("given", 1), ("main", -1)):
        other = "main" if c == "given" else "given"
        uses = uses.unionByName(fixed.select("kind", F.col(c).alias("w"), F.xxhash64(F.array(other)).alias("rest"), F.lit(sign).alias("sign")))
    known = uses.groupBy("kind", "w").agg(F.count_distinct("rest").alias("names"), F.signum(F.sum("sign")).alias("role"))
    told = open_.join(known, ["kind", "w"])
    size = F.length("w")
    first = told.groupBy("key", "kind").agg(F.sort_array(F.collect_list(F.struct((-F.col("role")).alias("r"), (-F.col("names")).alias("n"), "w", size.alias("size")))).alias("ws"))
    given = F.get("ws", F.lit(0))["w"]
    others = F.slice("ws", 2, 1_000_000)
    long = F.element_at(F.sort_array(F.transform(others, lambda x: F.struct(x["size"], x["w"]))), -1)["w"]
    rare = F.get("ws", F.size("ws") - 1)["w"]
    kinds = F.array_join(F.sort_array(F.filter("ws.w", lambda w: w != rare)), " ")
    person = F.col("kind") == "p"
    placed = first.select(
        "key", F.when(person, fold_column(long)).otherwise(rare).alias("main2"), F.when(person, given).otherwise(kinds).alias("given2")
    )
    out = parsed.join(placed, "key", "left").withColumns({"main": F.coalesce("main2", "main"), "given": F.coalesce("given2", "given")})
    fresh = F.col("given2").isNotNull()
    return out.withColumns({
        "initial": F.when(fresh, F.substring("given2", 1, 1)).otherwise(F.col("initial")),
        "written": F.when(fresh, F.substring("given2", 1, 1)).otherwise(F.col("written")),
    }).drop("main2", "given2", "loose")


def fold_column(x):
    """``fold`` as an expression."""
    w = F.regexp_replace(F.regexp_replace(F.regexp_replace(x, "ck", "k"), "ph", "f"), "y", "i")
    return F.regexp_replace(w, r"(.)\1+", "$1")


def learn_short_forms(people: DataFrame, least: int = 3, share: float = 0.3) -> DataFrame:
    """``given, full``: first names that stand beside the same main names as another, commoner one.

    All main names count. Under a common one first names meet by chance, so from the main
    names that two first names share goes the number expected by chance: the other places
    beside the rarer name, each with the commoner one's share of all places, one per main
    name at most. What is left must be ``least`` main names (rounded up) and a ``share``
    of those of the rarer name that chance doesn't fill, and so many meetings must by
    chance (Chernoff's bound for Poisson counts) be rarer than one in the number of first
    names that have ``least`` main names; the commonest partner wins.
    """
    both = people.where("given <> '' and main <> ''").select("main", "given").distinct()
    # a first name of fewer main names can't share enough of them, so it is no partner and takes no place
    alone = both.groupBy("given").agg(F.count("*").alias("n")).where(F.col("n") >= least)
    able = both.join(alone, "given")
    under = able.groupBy("main").agg(F.count("*").alias("d"))
    total = alone.agg(F.sum("n").alias("places"), F.count("*").alias("names"))
    able = able.join(under.where("d > 1"), "main")
    # pairs under a main name of very many are made in slices of the rarer name's side
    slices = F.ceil(F.col("d") / 1024).cast("int")
    a = able.select("main", "given", "n", F.pmod(F.xxhash64("given"), slices).cast("int").alias("slice"))
    b = able.select("main", F.col("given").alias("full"), F.col("n").alias("m"), F.explode(F.sequence(F.lit(0), slices - 1)).alias("slice"))
    rarer = (F.col("n") < F.col("m")) | ((F.col("n") == F.col("m")) & (F.col("given") > F.col("full")))
    met = a.join(b, ["main", "slice"]).where(rarer).groupBy("given", "full", "n", "m").agg(F.count("*").alias("k")).where((F.col("k") >= least) & (F.col("k") >= share * F.col("n")))
    places = able.groupBy("given", "d").agg(F.count("*").alias("c")).groupBy("given").agg(F.collect_list(F.struct("d", "c")).alias("beside"))  # one entry per size
    scored = met.join(places, "given").crossJoin(F.broadcast(total))
    part = F.col("m") / (F.col("places") - F.col("n"))
    chance = F.aggregate("beside", F.lit(0.0), lambda acc, x: acc + x["c"] * F.least(F.lit(1.0), (x["d"] - 1) * part))
    scored = scored.withColumn("e", chance)
    left = F.col("k") - F.col("e")
    clear = F.col("k") * F.log(F.col("k") / F.col("e")) - left > F.log("names")
    scored = scored.where((F.ceil(left) >= least) & (left >= share * (F.col("n") - F.col("e"))) & clear)
    return scored.groupBy("given").agg(F.max_by("full", F.struct("k", "m", "full")).alias("full"))


def fits(a, b):
    """Whether two first names, or two kinds of body, can be the same: equal, one typing error, or one shortened."""
    near = (F.length(a) >= 5) & (F.length(b) >= 5) & (F.levenshtein(a, b, 1) == 1)
    short = (F.length(a) >= 3) & b.startswith(a) | (F.length(b) >= 3) & a.startswith(b)
    letters = lambda x: F.concat(F.lit("^"), F.regexp_replace(x, "(.)", "$1.*"))
    word = lambda x, y: (x == y) | (F.substring(x, 1, 1) == F.substring(y, 1, 1)) & (F.rlike(y, letters(x)) | F.rlike(x, letters(y)) | (F.levenshtein(x, y, 1) == 1))
    xs, ys = F.split(a, " "), F.split(b, " ")
    bodies = (F.size(xs) == F.size(ys)) & (F.size(xs) <= 8) & F.forall(F.zip_with(xs, ys, word), lambda ok: ok)
    return (a == b) | near | short | (F.contains(a, F.lit(" ")) & bodies)


def link_names(records: DataFrame, lists: bool = True) -> DataFrame:
    """``key, cluster`` for records ``key, name, hint``.

    ``lists`` false leaves the lists of first names and institution words out, so that
    only the corpus tells what a word is.

    Defined cases: null, blank and nobody names give no row; a key with several rows
    keeps its smallest profile; equal spellings always share a cluster; extra columns
    are ignored; an empty table gives no rows.
    """
    spark = records.sparkSession
    scratch = Scratch(spark, "names")
    keep, sized = scratch.keep, scratch.sized  # no table that grows with the corpus is joined through the driver
    names = records.select("name", "hint").where("name is not null").distinct()
    read = names.select(F.to_json(F.struct("name", "hint")).alias("key"), "name", "hint")
    parsed = keep(read.mapInPandas(_read(lists), f"key string, {PROFILE}"))
    placed = keep(place_loose(sized(parsed)))
    scratch.drop(parsed)
    full = learn_short_forms(placed.where("kind = 'p'"))
    placed = placed.join(full, "given", "left").withColumns({
        "given": F.coalesce("full", "given"), "initial": F.when(F.col("full").isNotNull(), F.substring("full", 1, 1)).otherwise(F.col("initial")),
    }).drop("full")
    placed = keep(placed.withColumn("pid", F.concat_ws("|", "kind", "main", "given", "initial", "more")))
    tagged = records.select("key", F.to_json(F.struct("name", "hint")).alias("spelling"))
    members = keep(tagged.join(sized(placed).select(F.col("key").alias("spelling"), "pid"), "spelling").groupBy("key").agg(F.min("pid").alias("pid")))
    profiles = keep(placed.groupBy("pid", "kind", "main", "given", "initial", "more").agg(F.collect_set("written").alias("written")))
    blocks = keep(blocking_keys(profiles, F.col("initial")))
    every = sized(blocks)
    pairs = keep(candidate_pairs(every, every))
    cluster = sized(profiles).select("pid", F.col("pid").alias("cid"))
    while True:
        # what each cluster knows by now: unions over its profiles
        known = sized(profiles).join(cluster, "pid").groupBy("cid").agg(
            F.collect_set(F.nullif("given", F.lit(""))).alias("givens"),
            F.array_distinct(F.flatten(F.collect_set(F.split(F.col("more"), "")))).alias("more"),
        ).withColumn("more", F.array_remove("more", ""))
        known = keep(known)
        between = (
            sized(pairs).join(cluster.select(F.col("pid").alias("p"), F.col("cid").alias("c1")), "p")
            .join(cluster.select(F.col("pid").alias("q"), F.col("cid").alias("c2")), "q").where("c1 <> c2")
            .select(F.least("c1", "c2").alias("c1"), F.greatest("c1", "c2").alias("c2"), "far")
            .groupBy("c1", "c2").agg(F.min("far").alias("far"))
        )
        side = lambda n: sized(known).select(F.col("cid").alias(f"c{n}"), F.col("givens").alias(f"g{n}"), F.col("more").alias(f"m{n}"))
        judged = between.join(side(1), "c1").join(side(2), "c2")
        clash = (F.size("m1") > 0) & (F.size("m2") > 0) & ~F.arrays_overlap("m1", "m2")
        judged = keep(judged.where(~clash).withColumns({"n1": F.size("g1"), "n2": F.size("g2")}))
        agreeing = F.exists("g1", lambda x: F.exists("g2", lambda y: fits(x, y)))
        same = judged.where("n1 > 0 and n2 > 0").where(F.arrays_overlap("g1", "g2") | agreeing).select("c1", "c2")
        # a cluster with only an initial: the one best fuller cluster, or none
        agree = F.when(F.arrays_overlap("m1", "m2"), 0).otherwise(1)
        half = sized(judged).where("(n1 > 0) <> (n2 > 0)").select(
            F.when(F.col("n1") == 0, F.col("c1")).otherwise(F.col("c2")).alias("x"),
            F.when(F.col("n1") == 0, F.col("c2")).otherwise(F.col("c1")).alias("y"),
            (2 * F.col("far") + agree).alias("rank"),
        )
        # enough is kept to see whether the best is unique: smallest and largest cluster per rank
        best = half.groupBy("x", "rank").agg(F.min("y").alias("lo"), F.max("y").alias("hi")).groupBy("x").agg(
            F.min(F.struct("rank", "lo", "hi")).alias("b")
        )
        joined = best.where("b.lo = b.hi").select(F.col("x").alias("c1"), F.col("b.lo").alias("c2"))
        waiting = half.select("x").distinct()
        bare = sized(judged).where("n1 = 0 and n2 = 0").select("c1", "c2")
        bare = bare.join(waiting.select(F.col("x").alias("c1")), "c1", "left_anti").join(waiting.select(F.col("x").alias("c2")), "c2", "left_anti")
        accepted = keep(same.unionByName(joined).unionByName(bare))
        scratch.drop(judged, known)
        if accepted.isEmpty():
            break
        merged = connected_groups(accepted, "c1", "c2")
        grown = keep(merged.select("group_id").distinct())
        cluster = sized(keep(
            cluster.join(merged.select(F.col("node").alias("cid"), "group_id"), "cid", "left")
            .select("pid", F.coalesce("group_id", "cid").alias("cid"))
        ))
        # clusters that grew enter blocking again: every spelling of theirs under every initial they know by now
        inside = sized(profiles).join(cluster.join(sized(grown).select(F.col("group_id").alias("cid")), "cid", "left_semi"), "pid")
        initials = inside.select("cid", F.explode(F.array_distinct(F.concat("written", F.array("initial")))).alias("i")).where("i <> ''").distinct()
        richer = inside.join(initials, "cid").where("i <> initial").drop("initial")
        fresh = blocking_keys(richer, F.col("i"))
        fresh = keep(fresh.join(sized(blocks).select("pid", "initial", "cut"), ["pid", "initial", "cut"], "left_anti"))
        if not fresh.isEmpty():
            blocks = keep(blocks.unionByName(fresh.select(*blocks.columns)))
            pairs = keep(pairs.unionByName(candidate_pairs(sized(fresh), sized(blocks))).groupBy("p", "q").agg(F.min("far").alias("far")))
    return sized(members).join(cluster, "pid").select("key", F.col("cid").alias("cluster"))


def blocking_keys(profiles: DataFrame, initial) -> DataFrame:
    """``pid, kind, main, given, initial, cut``: a profile under one initial, once per spelling of its main name with a letter cut."""
    n = F.length("main")
    cuts = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring("main", F.lit(1), i - 1), F.substring("main", i + 1, n)))
    keys = F.array_distinct(F.concat(F.array("main"), F.when(n.between(4, 200), cuts).otherwise(F.array().cast("array<string>"))))
    return profiles.where("main <> ''").select("pid", "kind", "main", "given", initial.alias("initial"), F.explode(keys).alias("cut"))


def candidate_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``p, q, far``: profiles of one kind and initial whose main names are equal (far 0) or one typing error apart (far 1).

    Pairs whose first names are both known and can't be the same are left out; main names
    under six letters may differ only where the first names are known and equal.
    """
    a = left.select(F.col("pid").alias("p"), "kind", "initial", "cut", F.col("main").alias("m1"), F.col("given").alias("g1"))
    b = right.select(F.col("pid").alias("q"), "kind", "initial", "cut", F.col("main").alias("m2"), F.col("given").alias("g2"))
    # a table against itself shows every pair in both orders: one is enough
    met = a.join(b, ["kind", "initial", "cut"]).where("p < q" if left is right else "p <> q")
    met = met.where("abs(length(m1) - length(m2)) <= 1").where((F.col("g1") == "") | (F.col("g2") == "") | fits(F.col("g1"), F.col("g2")))
    far = F.levenshtein("m1", "m2", 2)
    swapped = (far == 2) & (F.length("m1") == F.length("m2")) & (F.array_sort(F.split("m1", "")) == F.array_sort(F.split("m2", "")))
    sure = ((F.length("m1") >= 6) & (F.length("m2") >= 6)) | ((F.col("g1") == F.col("g2")) & (F.col("g1") != ""))
    return met.where((F.col("m1") == F.col("m2")) | sure & ((far == 1) | swapped)).select(
        F.least("p", "q").alias("p"), F.greatest("p", "q").alias("q"), F.when(F.col("m1") == F.col("m2"), 0).otherwise(1).alias("far")
    ).distinct()


def linked_pairs(linked: DataFrame) -> DataFrame:
    """``key_a, key_b`` of every two records in one cluster, smaller key first."""
    a, b = linked.select("cluster", F.col("key").alias("key_a")), linked.select("cluster", F.col("key").alias("key_b"))
    return a.join(b, "cluster").where("key_a < key_b").select("key_a", "key_b")
