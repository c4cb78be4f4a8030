"""The operators of the llm subpackage: brute force, round trips, held-out accuracy, edge cases."""

import os
import random
import sys

import numpy as np
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
from brute import groups as brute_groups

from claimweave.llm import boosting, groups, leaks, names, packing, queries, reading
from claimweave.plans.runtime import Scratch

DATA = "/root/testdata/sf0.001"


def test_groups_equal_brute_force(spark):
    rng = random.Random(2)
    pairs = [(f"a{rng.randrange(300)}", f"a{rng.randrange(300)}") for _ in range(170)]
    pairs += [(f"c{i:03d}", f"c{i + 1:03d}") for i in range(200)] + [(f"c{i:03d}", f"c{i - 1:03d}") for i in range(1, 50)]
    pairs += [("hub", f"h{i}") for i in range(150)] + [(None, "x"), ("x", None), ("self", "self"), ("z", "y"), ("z", "y")]
    rng.shuffle(pairs)
    df = spark.createDataFrame(pairs, "s string, t string").withColumns({"node": F.lit(1), "u": F.lit(1), "group_id": F.lit("q")})
    got = {r["node"]: r["group_id"] for r in groups.connected_groups(df, "s", "t").collect()}
    assert got == brute_groups(pairs)
    assert groups.connected_groups(df.limit(0), "s", "t").count() == 0


def test_names_are_read():
    r = names.read_name
    assert r("Dr. Elizabeth Shehuflibrer", "person")[:3] == ("p", "shehuflibrer", "elizabeth")
    assert r("Kofinodrri, Susannah E", "person") == ("p", "kofinodri", "susannah", "s", "e")
    assert r("Greprugiben Matthew", "any")[1:3] == ("greprugiben", "matthew")
    assert r("ex:person/capt-tom-krakloojaife-the-elder", "any")[2] == "thomas"
    assert r("K. D Mveiyiten?", "person")[2:] == ("", "k", "d")
    assert r("Laikobafus Co. Arch.", "org")[:3] == r("County Archive, Laikobafus", "any")[:3] == r("The County Archive of Laikobafus", "org")[:3]
    for nobody in (None, "", "  ", "N.N.", "unknown", "[illegible]", "Unnamed male", "infant", "?", "123"):
        assert r(nobody, "any") is None
    assert r("x" * 50_000 + " Robert", "person")[2] == "robert"


def test_names_are_linked_and_rematched(spark):
    rows = [
        ("1", "Robert Kelmanostu"), ("2", "Bob Kelmanostu"), ("3", "KELMANOSTU, ROBERT"), ("4", "Robert Kelmanotsu"), ("5", "R. Kelmanostu"),
        ("6", "Rebecca Dramopiste"), ("7", "Robert Dramopiste"), ("8", "R. Dramopiste"), ("9", "Robert Zulpenwaro"), ("10", "unknown"), ("11", None),
        ("12", "Ropert Kelmanostu"), ("13", "R. Kelmanotsu"),
    ]
    df = spark.createDataFrame([(*r, "person", 1, "x") for r in rows + rows[:2]], "key string, name string, hint string, pid int, cid string")
    linked = names.link_names(df)
    got = {}
    for r in linked.collect():
        got.setdefault(r["cluster"], set()).add(r["key"])
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, [{"1", "2", "3", "4", "5", "12", "13"}, {"6"}, {"7"}, {"8"}, {"9"}]))
    pairs = {(r["key_a"], r["key_b"]) for r in names.linked_pairs(linked).collect()}
    assert len(pairs) == 21 and all(a < b for a, b in pairs)
    assert names.link_names(df.limit(0)).count() == 0


def test_names_off_every_list_are_linked(spark):
    rng = random.Random(12)
    given = dict(zip("Giovanni Katarzyna Hiroshi Oluwaseun Ignatius Svetlana Mehmet Chukwuemeka Aurelio Xiomara".split(), "Gianni Kasia Hiro Seun Iggy Lana Memo Emeka Lelo Xio".split()))
    part = "ba do ge ku li mo ne pra sti vu wel zo".split()
    rows, truth = [], {}

    def add(name, who, hint):
        rows.append((str(len(rows)), name, hint))
        truth[str(len(rows) - 1)] = who

    for k in range(240):
        first = rng.choice(sorted(given))
        last = "".join(rng.choice(part) for _ in range(4)).capitalize() + "rn"
        spoilt = last[:3] + last[4:]
        forms = [f"{first} {last}", f"{last} {first}", f"{last}, {first}", f"{given[first]} {last}", f"{first[0]}. {last}", f"{first} {spoilt}", f"Dr {first.upper()}  {last}"]
        for name in rng.sample(forms, 4):
            add(name, ("p", first, last), "person")
    for k in range(60):
        place = "".join(rng.choice(part) for _ in range(3)).capitalize() + "mund"
        for name in rng.sample([f"{place} Foundation", f"Foundation of {place}", f"{place} Fdn.", f"The {place} Foundation"], 3):
            add(name, ("o", place), "org")
    df = spark.createDataFrame(rows, "key string, name string, hint string")
    got = {(r["key_a"], r["key_b"]) for r in names.linked_pairs(names.link_names(df)).collect()}
    keys = sorted(truth)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if truth[a] == truth[b]}
    assert len(got & want) >= 0.9 * len(want) and len(got & want) >= 0.9 * len(got)
    few = [("a", "Hans Müller", "person"), ("b", "Müller Hans", "person"), ("c", "Maria Child", "person"), ("d", "Child, Maria", "person"), ("e", "infant", "person"), ("f", "Smith John", "any"), ("g", "John Smth", "any")]
    linked = {(r["key_a"], r["key_b"]) for r in names.linked_pairs(names.link_names(spark.createDataFrame(few, "key string, name string, hint string"))).collect()}
    assert linked == {("a", "b"), ("c", "d"), ("f", "g")}


def test_short_forms_are_learned_under_common_main_names(spark):
    rng = random.Random(3)
    rows = []
    for k in range(120):
        firsts = rng.sample([f"f{i:02d}" for i in range(50)], 14)  # more than 12 beside every main name
        firsts += ["short"] * ("f00" in firsts and rng.random() < 0.7)
        rows += [(f"m{k}", f) for f in firsts]
    rows += [("all", f"f{i:02d}") for i in range(50)] + [("all", "short")] + [("all", f"x{i}") for i in range(3000)]
    learned = names.learn_short_forms(spark.createDataFrame(rows, "main string, given string"))
    assert [tuple(r) for r in learned.collect()] == [("short", "f00")]


def test_grown_clusters_enter_blocking_again(spark):
    rows = [("1", "Robert Kelmanostu"), ("2", "Bob Kelmanostu"), ("3", "Robert Kelmanotstu"), ("4", "B. Kelmanotstus"), ("5", "Z. Kelmanotstus")]
    df = spark.createDataFrame([(k, n, "person") for k, n in rows], "key string, name string, hint string")
    got = {}
    for r in names.link_names(df).collect():
        got.setdefault(r["cluster"], set()).add(r["key"])
    # 4 shares no block with any single record: only the cluster knows that Robert is also B.
    assert {"1", "2", "3", "4"} in got.values() and {"5"} in got.values()


def test_tables_of_the_corpus_are_not_joined_through_the_driver(spark):
    scratch = Scratch(spark, "sized")
    large, small = scratch.keep(spark.range(200_000).select(F.sha2(F.col("id").cast("string"), 256).alias("k"))), scratch.keep(spark.range(5).select(F.col("id").cast("string").alias("k")))
    plan = lambda a, b: a.join(b, "k")._jdf.queryExecution().sparkPlan().toString()
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "1g")
    try:
        assert "Broadcast" in plan(large, large.select("k"))  # what Spark does by itself
        assert "Broadcast" not in plan(scratch.sized(large), scratch.sized(large).select("k").distinct())
        assert "Broadcast" in plan(scratch.sized(large), scratch.sized(small))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_packing_is_tight_and_whole(spark):
    rng = random.Random(4)
    rows = [(i, 0, rng.choice([0, 3, 700, 700, rng.randrange(1, 1500), rng.randrange(1, 9000)])) for i in range(1500)]
    rows += [(9_000, 1, None), (9_001, 1, 2_048), (9_002, 1, 4_096)]
    df = spark.createDataFrame(rows + rows[:30], "doc_id long, version long, n_tokens long").withColumn("size", F.lit("x"))
    got = packing.pack(df, 2_048).collect()
    pieces, fill = {}, {}
    for r in got:
        pieces.setdefault(r["doc_id"], []).append(r["n_tokens"])
        if r["n_tokens"]:
            fill.setdefault(r["container"], []).append((r["n_tokens"], r["doc_id"]))
        else:
            assert r["container"] is None
    for i, _, n in rows:
        assert sum(pieces[i]) == (n or 0)
        assert (n or 0) > 2_048 or len(pieces[i]) == 1
    assert all(sum(n for n, _ in v) <= 2_048 for v in fill.values())
    assert sorted(fill) == list(range(len(fill)))
    whole = sum((n or 0) // 2_048 for _, _, n in rows if (n or 0) > 2_048)
    rest = [n if n <= 2_048 else n % 2_048 for n in ((n or 0) for _, _, n in rows) if n % 2_048 or n == 2_048]
    assert len(fill) <= 1.005 * (whole + len(packing.best_fit(*np.unique(rest, return_counts=True), 2_048))) + 1
    even = spark.range(4_000).select(F.col("id").alias("doc_id"), F.lit(0).cast("long").alias("version"), (F.col("id") % 400 + 1).alias("n_tokens"))
    used = packing.pack(even, 2_048).agg(F.max("container") + 1).first()[0]
    assert 4_000 * 200.5 / 2_048 / used > 0.99
    assert packing.pack(df.limit(0), 2_048).count() == 0
    assert packing.pack(df.where("n_tokens = 0"), 2_048).where("container is not null").count() == 0


def test_packing_program_places_nearly_everything():
    rng = np.random.default_rng(0)
    documents = np.concatenate([rng.integers(3, 900, 8_000), rng.integers(900, 2_049, 600)])
    for items, over in ((documents, 1.001), (rng.integers(1, 1_500, 20_000), 1.001), (rng.integers(400, 1_000, 20_000), 1.02), (rng.integers(600, 1_100, 20_000), 1.09)):
        for times in (1, 50):
            sizes, counts = np.unique(items, return_counts=True)
            counts = counts * times
            prices, bound = packing.learn_prices(sizes, counts, 2_048)
            made, left = min((packing.round_program(sizes, counts, 2_048, prices, eta) for eta in (1.0, 4.0)), key=lambda x: sum(x[0].values()))
            assert left.sum() <= 0.01 * counts.sum() and (left * sizes).sum() <= 4 * 2_048
            used = sum(made.values()) + len(packing.best_fit(sizes, left, 2_048))
            assert used <= over * bound + 2  # never far from the proven bound
            if times == 1:
                assert used <= 1.001 * len(packing.best_fit(sizes, counts, 2_048))
            held = dict.fromkeys(sizes.tolist(), 0)
            for config, n in made.items():
                assert sum(s * k for s, k in config) <= 2_048
                for s, k in config:
                    held[s] += n * k
            assert all(held[s] == c - r for s, c, r in zip(sizes.tolist(), counts.tolist(), left.tolist()))


def test_token_counts(spark):
    import base64

    import tiktoken

    texts = ["", None, "Hello  world, it's 2024", "größe\n\nnaïve " * 500]
    df = spark.createDataFrame([(i, t, 7) for i, t in enumerate(texts)], "doc_id long, text string, n_tokens int")
    got = {r["doc_id"]: r["n_tokens"] for r in packing.token_counts(df).collect()}
    with open(packing.VOCABULARY, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    enc = tiktoken.Encoding("t", pat_str=packing.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert got == {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}


def _edit(a: str, b: str) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_leaks_are_found_in_any_dress(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(["ka", "to", "mi", "ru", "se", "lo", "pan", "dir", "gel"]) for _ in range(rng.randrange(2, 5)))
    items = [(i, " ".join(word() for _ in range(50)).capitalize() + ".") for i in range(30)]
    text = dict(items)
    filler = lambda n: " ".join(word() for _ in range(n))
    half = text[3].split()
    cyr = text[4].replace("a", "а").replace("o", "о")
    typo = "".join(c if rng.random() > 0.03 else "x" for c in text[5])
    swapped = text[6].split()
    swapped[10], swapped[30] = "entirely", "different"
    docs = [
        (1, f"{filler(300)} {text[1]} {filler(200)}"), (2, text[2].upper().replace(" ", "\n> ")), (3, filler(40) + " " + " ".join(half[10:38]) + " " + filler(9)),
        (4, cyr), (5, typo), (6, " ".join(swapped)), (7, " ".join(text[7].split()[:20]) + " " + filler(80)), (8, filler(400)), (9, None), (10, ""), (11, "ka"),
        (12, "<p>" + "</p> <p>".join(text[8].split()) + "</p>"), (13, text[9].replace(" mi", "-\nmi")), (14, filler(30_000) + text[10]),
        (15, " ".join(sorted(text[11].split()))), (16, f"{text[12]} {filler(5)} {text[13]}"),
    ]
    df = spark.createDataFrame(docs + docs[:2], "doc_id long, text string").withColumn("item_id", F.lit(5))
    it = spark.createDataFrame([*items, items[0], (99, None), (98, ""), (97, "?!")], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).collect()}
    assert got == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 5), (6, 6), (12, 8), (13, 9), (14, 10), (16, 12), (16, 13)}
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it, block=7).collect()} == got
    assert leaks.find_leaks(df.limit(0), it).count() == 0 and leaks.find_leaks(df, it.limit(0)).count() == 0


def test_leaks_in_other_scripts_and_large_test_sets(spark):
    rng = random.Random(7)
    pick = lambda signs, n: "".join(rng.choice(signs) for _ in range(n))
    russian = " ".join(pick("абвгдежзиклмнопрстуфхцчшыьэюя", rng.randrange(3, 9)) for _ in range(40))
    chinese = pick([chr(c) for c in range(0x4E00, 0x5200)], 60)
    hindi = " ".join(pick([chr(c) for c in range(0x0915, 0x0939)], rng.randrange(3, 7)) for _ in range(30))
    short = "zwölf boxkämpfer"
    items = [(1, russian), (2, chinese), (3, hindi), (4, short), (5, "...")]
    filler = " ".join(pick("abcdefgh", 5) for _ in range(200))
    docs = [
        (1, f"{filler} {' '.join(russian.split()[5:28])} {filler}"), (2, filler + chinese[10:45] + filler), (3, hindi.replace(" ", "\n")),
        (4, f"{filler} ZWÖLF  BOXKÄMPFER {filler}"), (5, filler), (6, filler + chinese[:20]), (7, " ".join(russian.split()[:12])),
    ]
    df, it = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}
    many = spark.range(6_000).selectExpr("id + 100 as item_id", "concat('item ', id, ' ', sha2(cast(id as string), 512)) as text")
    got = leaks.find_leaks(df, it.unionByName(many), block=2_500)  # several blocks, nothing refused
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4)}


def test_leaks_recall_on_altered_passages(spark):
    rng = random.Random(9)
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{DATA}/eval_items.parquet").where("text is not null").collect()]
    filler = " ".join(r["text"] for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) between 500 and 3000").limit(40).collect()).split()

    def altered(text, share, rate):
        w = text.split()
        n = int(np.ceil(share * len(w)))
        at = rng.randrange(len(w) - n + 1)
        kept = " ".join(w[at : at + n])
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") if c.isalpha() and rng.random() < rate else c for c in kept)

    def spread(text, _, __):
        w = text.split()
        a, b = sorted(rng.sample(range(5, len(w) - 5), 2))
        some = lambda: filler[(k := rng.randrange(len(filler) - 12)) : k + 12]
        return " ".join(w[:a] + some() + w[a:b] + some() + w[b:])

    for change, share, rate, least in ((altered, 0.52, 0.10, 0.9), (altered, 0.52, 0.15, 0.9), (altered, 1.0, 0.2, 0.85), (spread, 1, 0, 0.9), (altered, 0.44, 0.0, None)):
        docs = []
        for i, (_, text) in enumerate(items):
            at = rng.randrange(len(filler) - 300)
            docs.append((i, " ".join(filler[at : at + 150]) + " " + change(text, share, rate) + " " + " ".join(filler[at + 150 : at + 300])))
        df = spark.createDataFrame(docs, "doc_id long, text string")
        it = spark.createDataFrame(items, "item_id long, text string")
        got = {(r["doc_id"], r["item_id"]) for r in leaks.find_leaks(df, it).collect()}
        found = sum((i, item) in got for i, (item, _) in enumerate(items)) / len(items)
        assert found >= least if least is not None else found <= 0.05


def test_alignment_scores_equal_plain_dynamic_programming():
    rng = random.Random(8)
    a = "".join(rng.choice("abcd") for _ in range(60))
    b = list(a)
    for _ in range(6):
        b[rng.randrange(len(b))] = rng.choice("abcd")
    stream = ("z" * 20 + "".join(b) + "z" * 20).encode()
    index = leaks.ItemIndex([(1, leaks.letters(a), np.array([len(a)]), (len(a), 1))], 3, 0.1)
    lo, hi, match = leaks.align(index, [leaks.letters(stream.decode())], np.array([0]), np.array([0]), np.array([20]), 10)
    best = 0
    row = [0] * (len(stream) + 1)
    for x in a.encode():
        new = [0]
        for j, y in enumerate(stream, 1):
            new.append(max(0, row[j] - 1, new[j - 1] - 1, row[j - 1] + (1 if x == y else -1)))
        row = new
        best = max(best, max(row))
    assert 2 * match[0] - (hi[0] - lo[0]) in (best, best - 1)
    assert _edit(a[lo[0] : hi[0]], "".join(b)[lo[0] : hi[0]]) <= 6


def test_boosted_trees_learn_and_survive_constants():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 4))
    y = np.where(x[:, 0] > 0, 3.0, -1.0) + x[:, 1] * 2
    model = boosting.BoostedTrees().fit(x[:2000], y[:2000])
    assert np.abs(model.predict(x[2000:]) - y[2000:]).mean() < 0.35
    flat = boosting.BoostedTrees(rounds=3).fit(np.ones((50, 2)), np.full(50, 7.0))
    assert np.allclose(flat.predict(np.zeros((2, 2))), 7.0) and len(model.predict(np.zeros((0, 4)))) == 0


def test_reading_level_bands(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    model = reading.fit_model(docs)
    assert model.folds and all(error < constant / 2 for _, _, error, constant in model.folds)  # held-out sources
    easy = "The dog ran. Ben has a red hat. Can you see the cow? We sat all day. "
    hard = (
        "Notwithstanding considerable methodological heterogeneity, comparative historiographical interpretation necessarily presupposes institutional "
        "intermediation, whose epistemological provisionality fundamentally destabilises genealogical attribution throughout subsequent administrative documentation. "
    )
    page = "POLARITY asserted\nLIMIT 64\n<http://example.org/a> <http://example.org/b> \"x\" .\n{\"v\": 1}\nyear | folio | name\n-- copy --\n"
    rows = [(1, easy), (2, hard * 4), (3, page + easy), (4, easy + hard), (5, None), (6, ""), (7, page), (8, "One line. Two lines."), (9, easy * 20_000)]
    df = spark.createDataFrame(rows + rows[:1], "doc_id long, text string").withColumn("band", F.lit(9))
    got = {r["doc_id"]: r["band"] for r in reading.reading_level(df, model).collect()}
    assert got == {1: 1, 2: 3, 3: 1, 4: 1, 5: None, 6: None, 7: None, 8: None, 9: 1}
    assert reading.reading_level(df.limit(0), model).count() == 0
    empty = reading.fit_model(docs.limit(0))
    assert reading.reading_level(df, empty).count() == len(rows) + 1


def test_grades_beat_the_index_on_held_out_sources(spark):
    model = reading.fit_model(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    n = np.array([s[1] for s in model.sources])
    graded, index, constant = (float((n * [s[k] for s in model.sources]).sum() / n.sum()) for k in (2, 3, 4))
    assert graded < 0.7 * index and graded < 0.5 * constant
    assert abs(sum(s[1] * s[5] for s in model.sources) / n.sum()) < 0.5  # calibrated


def test_prose_is_told_from_the_rest():
    p = reading.prose_sentences
    text = "See https://example.org/x for the note. It ends here.\nyear | folio | name\nLIMIT 64\n1861 | 9\nA line of many words that has no mark at its end\nShort title\nTHE ISLAND WAS SOLD IN MAY."
    assert [" ".join(s) for s in p(text)] == ["See for the note.", "It ends here.", "A line of many words that has no mark at its end", "THE ISLAND WAS SOLD IN MAY."]
    x, owner, counts = reading.sentence_features([p("The dog saw the dog. The dog ran; then, it sat."), [], p("The dog saw.")], {"the": 0})
    assert x.shape == (3, len(reading.FEATURES)) and owner.tolist() == [0, 0, 2]
    assert np.allclose(x[:, -2], [0, 1 / 3, 0])  # "The" and "dog"; nothing shared across documents


def test_found_queries_run(spark):
    import duckdb

    pairs = duckdb.sql(f"select source, target, relation from '{DATA}/alignments.parquet'").fetchall()
    keep = [((s or "").strip() or None, (t or "").strip() or None) for s, t, r in pairs if "".join(c for c in (r or "").lower() if c.isalpha()) == "exactequivalent"]
    assert {(r["iri"], r["group_iri"]) for r in queries.p3_found(spark, DATA).collect()} == set(brute_groups(keep).items())
    assert queries.p9_found(spark, DATA).columns == ["doc_id", "item_id"]
    assert set(dict(queries.p10_found(spark, DATA).dtypes).items()) == {("doc_id", "bigint"), ("band", "int")}
