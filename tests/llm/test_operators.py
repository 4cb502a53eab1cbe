"""The operators on small tables, hard ones among them, against brute force."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidelattice.llm import chat, decontam, exactdup, graph, langid, linededup, membership, mixing, neardup, quality, queries, secretscan, sharding
from tidelattice.llm.store import join_by_size
from tidelattice.llm.text import string_bytes

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, __sig string, component_id string"


def _words(seed: int, n: int) -> str:
    return " ".join(f"w{zlib.crc32(f'{seed}-{i}'.encode()) % 5000}" for i in range(n))


@pytest.fixture(scope="module")
def docs(spark):
    base = _words(1, 120)
    near = " ".join("zz" if i in (5, 60) else w for i, w in enumerate(base.split()))
    passage = " ".join(f"p{i}" for i in range(60)) + "."
    rows = [
        (1, base), (2, base), (3, near), (4, base.upper()), (5, None), (6, ""), (7, "   "), (8, "a b"), (9, "A b"), (10, "one"), (11, _words(2, 20000)),
        (12, f"{_words(3, 40)}. {passage} {_words(4, 30)}"), (13, f"{_words(5, 50)}. {passage} {_words(6, 20)}"), (14, "12 34 !"), (None, base), (None, None), (16, "x y z"), (16, "x y z"), (17, base + " "), (18, " é ñ"),
    ]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, None if i == 3 else f"s{(i or 0) % 3}", 1, "clash", "clash") for i, t in rows], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_duplicates(docs):
    got = exactdup.exact_duplicates(docs).collect()
    rows = docs.select("doc_id", "text").collect()
    groups = {}
    for r in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", r["text"] or ""), []).append(r)
    want = []
    for n, members in groups.items():
        best = min(members, key=lambda r: (-len(r["text"] or ""), r["doc_id"] is None, r["doc_id"] or 0))["doc_id"]
        want += [(r["doc_id"], best, len(members), r["doc_id"] == best, hashlib.sha256(n.encode()).hexdigest()) for r in members]
    key = lambda x: str(tuple(x))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)


def test_exact_duplicates_with_a_full_filter(docs):
    """A filter of 64 bits accepts nearly all rows; results stay exact."""
    a = exactdup.exact_duplicates(docs, max_bits=64).collect()
    b = exactdup.exact_duplicates(docs).collect()
    assert sorted(map(str, a)) == sorted(map(str, b))


def _components(rows, k, percent):
    sets = []
    for r in rows:
        low = re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = [r["doc_id"] for r in rows]
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if label[i] is not None and label[j] is not None and (rows[i]["doc_id"] == rows[j]["doc_id"] or sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])) and label[j] < label[i]:
                    label[i] = label[j]
                    changed = True
    return [(r["doc_id"], len(s), c) for r, s, c in zip(rows, sets, label, strict=True)]


@pytest.mark.parametrize("k", [4, 5])
def test_near_duplicates(docs, k):
    got = neardup.near_duplicates(docs, shingle=k).select("doc_id", "n_shingles", "component_id").collect()
    want = _components(docs.collect(), k, 80)
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))


def test_a_large_family_of_near_copies_is_one_component(spark):
    """More near copies than a region holds, each changed in other places, and documents that have nothing to do with them."""
    base = _words(9, 200).split()
    rows = []
    for i in range(1500):
        w = list(base)
        for j in range(3):
            w[zlib.crc32(f"{i}/{j}".encode()) % 200] = f"c{i}x{j}"
        rows.append((i, " ".join(w)))
    rows += [(i, _words(i, 60)) for i in range(5000, 5100)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=5).collect()
    sets = {i: set(zip(*[t.split()[k:] for k in range(5)], strict=False)) for i, t in rows}
    # every copy is linked with some other one in truth; brute force over the family
    label = {i: i for i in sets}
    ids = list(range(1500))
    for a in ids:
        for b in ids[:a]:
            if label[a] != label[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = max(label[a], label[b]), min(label[a], label[b])
                label = {k: new if v == old else v for k, v in label.items()}
    assert {r["doc_id"]: r["component_id"] for r in got} == label


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 60)] + [(100, 101), (101, 100), (7, 7), (200, 300), (250, 300)] + [(400, x) for x in range(401, 450)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 1 for i in range(1, 61)) and got[101] == 100 and got[250] == got[300] == 200 and all(got[x] == 400 for x in range(400, 450))


def test_components_on_the_driver_and_by_stars_agree(spark):
    edges = [(x, 3 * x % 101) for x in range(-50, 50)] + [(1000 + i, 1001 + i) for i in range(90)] + [(-(2**63), 2**63 - 1), (5, None), (2000, 2000)]
    made = spark.createDataFrame(edges, "a long, b long").repartition(3)
    label = {x: x for e in edges if None not in e and e[0] != e[1] for x in e}
    for _ in label:
        for a, b in edges:
            if a != b and b is not None:
                label[a] = label[b] = min(label[a], label[b])
    for small in (0, 100, graph.SMALL):
        assert sorted(tuple(r) for r in graph.components(made, small=small).collect()) == sorted(label.items())


def test_near_duplicates_takes_few_stages(spark):
    """On many partitions the time is that of starting tasks: a chain of links must not cost a round of joins for each of its doublings."""
    base = _words(41, 400).split()
    rows = [(i, " ".join([f"c{i}x{j}" if i <= j < i + 3 else w for j, w in enumerate(base[3 * i : 3 * i + 60])])) for i in range(100)]
    sc = spark.sparkContext
    sc.setJobGroup("few-stages", "near duplicates")
    try:
        neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1, percent=70).collect()
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)
    jobs = [sc.statusTracker().getJobInfo(j) for j in sc.statusTracker().getJobIdsForGroup("few-stages")]
    assert 0 < sum(len(j.stageIds) for j in jobs if j) < 100


def test_join_by_size_keeps_all_rows(spark):
    left = spark.createDataFrame([(1, i) for i in range(3000)] + [(2, 0), (3, 0)], "k long, x long")
    right = left.groupBy("k").agg(F.count("*").alias("n")).filter("k < 3")
    got = join_by_size(left, right, ["k"], "n", 3002, hot_keys=2)
    assert got.count() == 3002 and got.filter("n is null").count() == 1 and got.filter("n = 3000").count() == 3000


def test_membership_has_no_false_negatives(spark):
    ids = spark.range(0, 30000, 3)
    table = membership.member_filter(ids, "id", ids.count())
    rows = spark.range(30000).select("id", *membership.hashes("id")).toArrow()
    got = membership.maybe_members(table, rows.column(1).to_numpy(), rows.column(2).to_numpy())
    member = rows.column(0).to_numpy() % 3 == 0
    assert got[member].all() and got[~member].mean() < 0.05


def test_contamination(docs, spark):
    item = " ".join(f"p{i}" for i in range(10, 40))
    items = spark.createDataFrame([(1, item), (2, None), (3, "a b"), (10, _words(3, 20)), (1, item), (4, "")], "item_id long, text string")
    for size in (16 << 20, 10):  # one block, and a block for each item
        got = {r["doc_id"]: r for r in decontam.report(decontam.contamination(docs.filter("doc_id is not null").dropDuplicates(["doc_id"]), items, block_bytes=size)).collect()}
        assert [got[i]["n_items"] for i in (12, 13, 8, 9, 5, 6)] == [2, 1, 1, 1, 0, 0]
        assert got[8]["contaminated"] and got[13]["n_hit"] == 30 and got[12]["n_hit"] == 50 and got[5]["n_words"] == 0
        assert got[12]["items_sha256"] == hashlib.sha256(b"1,10").hexdigest()
    none = decontam.report(decontam.contamination(docs, items.limit(0))).collect()
    assert len(none) == docs.count() and all(r["n_hit"] == 0 for r in none)


def test_line_dedup(docs):
    got = {r["doc_id"]: r for r in linededup.dedup_units(docs.filter("doc_id in (12, 13, 5, 6, 1, 2, 8)"), least=8).collect()}
    assert got[12]["removed"] == [] and got[1]["removed"] == []
    assert got[2]["clean_text"] == "" and got[5]["clean_text"] is None and got[6]["clean_text"] == "" and got[8]["removed"] == []
    text = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"]}[13]
    gone = "".join(text[s["start"] : s["end"]] for s in got[13]["removed"])
    assert sum(f"p{i}" in gone.replace(".", "").split() for i in range(60)) >= 30 and "w" not in re.sub(r"\bp\d+", "", gone)
    rest, at = [], 0
    for s in got[13]["removed"]:
        rest.append(text[at : s["start"]])
        at = s["end"]
    assert "".join(rest) + text[at:] == got[13]["clean_text"]


def test_line_dedup_inside_a_text(spark):
    line = "this very line has more than eight words in it\n"
    d = spark.createDataFrame([(1, line + "other words stand here in between, nine of them\n" + line), (None, line)], "doc_id long, text string")
    got = {r["doc_id"]: r for r in linededup.dedup_units(d, least=8).collect()}
    assert got[1]["clean_text"].count("very line") == 1 and got[None]["clean_text"] == line
    assert all(r["removed"] == [] for r in linededup.dedup_units(d).collect())


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", "<|im_end|>\n\\"), (2, 1, "assistant", None), (2, 0, None, "x"), (2, 1, "assistant", "b"), (None, 0, "user", "n"), (3, None, "sys\ntem", "é")]
    rows += [(9, i, "assistant" if i % 2 else "user", f"turn {i} <|") for i in range(500)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit("clash"))
    got = {r["conv_id"]: r for r in chat.digests(chat.format_chats(df)).collect()}
    for c in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == c), key=lambda r: tuple((x is not None, x if x is not None else 0 if k == 0 else "") for k, x in enumerate(r[1:])))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[c]["n_turns"] == len(own) and got[c]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[c]["loss_chars"] == len(loss) and got[c]["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()
    assert chat.digests(chat.format_chats(df.limit(0))).count() == 0


def test_shards(docs, empty):
    got = sharding.shard(docs, shards=16).collect()
    assert len(got) == docs.count()
    by = {}
    for r in got:
        by.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in by.values()) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    one = next(r for r in got if r["doc_id"] == 1)
    text = docs.filter("doc_id = 1").first()["text"]
    assert one["size"] == len(text) + 1 and one["text_crc32"] == zlib.crc32(text.encode())
    assert all(r["size"] == 1 and r["text_crc32"] == 0 for r in got if r["doc_id"] == 5)
    assert sharding.shard(empty).count() == 0


def test_mixing(docs, empty):
    got = mixing.mix_sources(docs, share=0.5).collect()
    assert len(got) == docs.count() and all(0 <= r["probability"] <= 1 for r in got)
    expected, total = sum(r["probability"] * r["n_tokens"] for r in got), sum(r["n_tokens"] for r in got)
    assert abs(expected - 0.5 * total) < 1e-3 * total or all(r["probability"] == 1 for r in got if r["weight"] > 0)
    assert got and {r["sampled"] for r in got if r["probability"] == 1} <= {True}
    kept = mixing.Mix(docs, share=0.5).sample(docs)
    assert kept.columns == docs.columns and sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(r["doc_id"]) for r in got if r["sampled"])
    assert mixing.mix_sources(empty).count() == 0 and mixing.Mix(empty).sample(empty).count() == 0


def test_languages(spark, docs, empty):
    train = [(i, " ".join("the and of with that from".split() * 5), "en") for i in range(20)] + [(100 + i, " ".join("der und die nicht von ist".split() * 5), "de") for i in range(20)]
    model = langid.train(spark.createDataFrame(train, "doc_id long, text string, lang string"))
    test = spark.createDataFrame([(1, "with that and from the"), (2, "nicht von der und ist"), (3, None), (4, "12 !"), (5, ""), (6, "the and of with that from " * 30 + "der und die nicht von ist " * 20)], "doc_id long, text string")
    got = {r["doc_id"]: (r["lang_pred"], r["lang_score"]) for r in langid.identify(test, model).collect()}
    assert got[1][0] == "en" and got[2][0] == "de" and got[3] == got[4] == got[5] == ("und", 0.0)
    assert got[6][0] == "en" and 0.5 < got[6][1] < 0.75
    assert langid.identify(docs, langid.train(empty)).filter("lang_pred != 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


def test_quality(spark, docs, empty):
    good, bad = [(i, _words(i, 80), 1) for i in range(60)], [(100 + i, "### $$$ !! " * 30 + _words(i, 5), 0) for i in range(20)]
    rows = spark.createDataFrame(good + bad, "doc_id long, text string, quality int")
    model = quality.train(rows.select("doc_id", "text"), rows.select("doc_id", "quality").filter("doc_id % 2 = 0"))
    got = {r["doc_id"]: r["score"] for r in quality.classify(rows, model).collect()}
    assert all(got[i] > 0.5 for i in range(60)) and all(got[100 + i] < 0.5 for i in range(20))
    assert all(r["score"] == 0.5 for r in quality.classify(docs.filter("text is null or text = ''"), model).collect())
    assert quality.classify(docs, model).count() == docs.count()
    none = quality.train(docs, rows.select("doc_id", "quality").limit(0))
    assert {r["score"] for r in quality.classify(docs, none).collect()} == {0.5}
    assert quality.classify(empty, model).count() == 0


def test_secrets(docs, empty, spark):
    extra = spark.createDataFrame([(50, 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"')], "doc_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(extra)
    got = {r["doc_id"]: r for r in secretscan.scan(rows, secretscan.train(rows)).collect()}
    assert [s["kind"] for s in got[50]["spans"]] == ["assign", "hex"] and got[1]["spans"] == [] and got[5]["spans"] == []
    assert secretscan.scan(empty, secretscan.train(empty)).count() == 0


def test_empty_tables(empty, spark):
    items = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert exactdup.exact_duplicates(empty).count() == 0
    assert neardup.near_duplicates(empty).count() == 0
    assert linededup.dedup_units(empty).count() == 0
    assert decontam.contamination(empty, items).count() == 0


def test_queries_on_the_small_tables(spark):
    """Accuracy on held-out rows, and one row per document."""
    d = "/root/testdata/sf0.01"
    found = queries.op6_language(spark, d).join(spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out")
    assert found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0] > 0.95
    scored = queries.op1_quality(spark, d).join(spark.read.parquet(f"{d}/labels.parquet"), "doc_id").filter("held_out")
    assert scored.agg(F.avg((F.col("quality") == F.col("predicted")).cast("double"))).first()[0] > 0.9


def test_near_pairs_in_a_large_family_of_lesser_similarity(spark):
    """4000 texts share boilerplate (similarity 0.75, no link); each has one partner of similarity 0.804, in regions too large for one comparison."""
    rows = [(i, " ".join([f"b{k}" for k in range(150)] + [f"p{i % 2000}x{k}" for k in range(6)] + [f"o{i}x{k}" for k in range(19)])) for i in range(4000)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), shingle=1).collect()}
    assert [i for i in range(4000) if got[i] != i % 2000] == []


def test_short_lines_and_passages_of_long_lines_go(spark):
    short = "released under the mit license."
    d = spark.createDataFrame([(1, f"{short}\n{_words(21, 12)}\n{short}\nend"), (2, f"{_words(22, 12)}\n{short}\n{_words(23, 12)}"), (3, f"{short} with more\n")], "doc_id long, text string")
    for pieces in (True, False):
        got = {r["doc_id"]: r["clean_text"] for r in linededup.dedup_units(d, least=8, line=1, pieces=pieces).collect()}
        assert got[1] == f"{short}\n{_words(21, 12)}\nend" and got[2] == f"{_words(22, 12)}\n{_words(23, 12)}" and got[3] == f"{short} with more\n"
    # a passage of 50 words inside longer lines, wherever it stands
    rows = []
    for k in range(40):
        shared = _words(1000 + k, 50)
        rows += [(100 + 2 * k, f"{_words(2000 + k, 20)} {shared} {_words(3000 + k, 20)}"), (101 + 2 * k, f"{_words(4000 + k, 25)} {shared} {_words(5000 + k, 15)}")]
    got = {r["doc_id"]: r["removed"] for r in linededup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[100 + 2 * k] == [] and got[101 + 2 * k] for k in range(40))


def test_topics_are_fitted_on_all_documents(spark):
    """The centroids are a fixed point of the rounds over all 9000 documents, not of a sample's."""
    rows = [(i, " ".join(f"t{i % 8}w{zlib.crc32(f'{i}-{k}'.encode()) % 40}" for k in range(20)), "en", f"s{i % 3}") for i in range(9000)]
    mix = mixing.Mix(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    raw, off = string_bytes(pa.array([r[1] for r in rows]))
    x = mixing.word_counts(raw, off)[0].astype(np.float64)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near = np.argmax(x @ mix.centres.T.astype(np.float64), 1)
    for k in np.unique(near):
        m = x[near == k].sum(0)
        assert np.allclose(m / np.linalg.norm(m), mix.centres[k], atol=1e-4)


def test_every_source_has_its_own_target(spark):
    rows = [(i, _words(i, 20), "en", f"s{i % 80}") for i in range(800)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    goal = {f"s{k}": 1 / 80 for k in range(80)}
    got = mixing.mix_sources(docs, share=0.5, targets={"source": goal}).collect()
    assert len(got) == 800 and all(r["probability"] > 0 for r in got)
    expected = {}
    for r in got:
        expected[r["source"]] = expected.get(r["source"], 0) + r["probability"] * r["n_tokens"]
    assert all(abs(v / sum(expected.values()) - 1 / 80) < 1e-3 for v in expected.values())


def test_contamination_in_blocks_keeps_every_row(docs, spark):
    """Repeated and null ids, and rows alike but for the text, are one row each, whatever the size of a block."""
    item = " ".join(f"p{i}" for i in range(10, 40))
    items = spark.createDataFrame([(1, item), (3, "a b"), (10, _words(3, 20))], "item_id long, text string")
    rows = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(12, "other text, a b"), (12, item), (None, "a b"), (None, item)], "doc_id long, text string"))
    got = []
    for size in (16 << 20, 10):
        for key, carry in (("doc_id", False), ("k", True)):
            found = decontam.contamination(rows.withColumn("k", F.struct("doc_id")), items, key=key, block_bytes=size, carry_text=carry)
            got.append(sorted(str((tuple(r[key]) if carry else (r[key],), *r[1:6])) for r in found.collect()))
    assert len(got[0]) == rows.count() and got[0] == got[1] == got[2] == got[3]


def test_decontaminated_rows_are_those_judged_and_cut_one_by_one(docs, spark):
    """One map over the texts, or passes by blocks, give what contamination(), the 5 % rule and cut_spans() give apart."""
    item = " ".join(f"p{i}" for i in range(10, 40))
    items = spark.createDataFrame([(1, item), (2, _words(2, 20000)[:200]), (3, "a b"), (10, _words(3, 20))], "item_id long, text string")
    rows = docs.unionByName(docs.filter("doc_id in (12, 16)")).withColumn("row", F.lit("mine"))
    packed = rows.select(F.struct(*[c for c in rows.columns if c != "text"]).alias("row"), "text")
    found = decontam.contamination(packed, items, key="row", carry_text=True)
    light = found.filter("not (n_hit > 0 and 20 * n_hit >= n_words)")
    want = sorted(map(str, decontam.cut_spans(light, "row", rows.schema).collect()))
    assert 0 < len(want) < rows.count() and light.filter("n_hit > 0").count() > 0
    for size in (4 << 20, 10):
        got = decontam.decontaminate(rows, items, block_bytes=size)
        assert got.columns == rows.columns and sorted(map(str, got.collect())) == want


def test_secrets_without_digits_and_short_ones(spark):
    key, short, long = "qWxZRtYpLkJhGfDsAqZxCvBnMwErTyUiOpLkJhGf", "zQ9x7Kp2Wv", "Zq9xKpWv" * 40
    m = secretscan.train(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    d = spark.createDataFrame([(1, f"look {key} there"), (2, f"look {short} there"), (3, f"token={long}"), (4, "some ordinary sentence about nothing particular WHATEVER")], "doc_id long, text string")
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secretscan.scan(d, m).collect()}
    assert got == {1: [("format", 5, 45)], 2: [("format", 5, 15)], 3: [("assign", 6, 326)], 4: []}


def test_the_mix_meets_its_targets(spark):
    """Shares of probability times tokens are the targets' in all three marginals where they can be met, and what cannot be met is reported."""
    rows = []
    for s in range(4):
        for lang in range(3):
            for k in range(40 * (s + 1) + 15 * lang):
                rows.append((len(rows), " ".join(f"t{k % 4}w{zlib.crc32(f'{len(rows)}-{j}'.encode()) % 30}" for j in range(10 + k % 7)), f"l{lang}", f"s{s}"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    targets = {"source": {f"s{k}": 0.25 for k in range(4)}, "lang": {"l0": 0.5, "l1": 0.3, "l2": 0.2}}
    mix = mixing.Mix(docs, share=0.3, targets=targets, topics=4)
    got = mix.drawn(mix.rows).collect()
    total = sum(r["__probability"] * r["__tokens"] for r in got)
    for name, column in (("source", "source"), ("lang", "lang"), ("topic", "__topic")):
        own = {}
        for r in got:
            own[r[column]] = own.get(r[column], 0) + r["__probability"] * r["__tokens"] / total
        for v, x in own.items():
            goal = targets[name][v] if name in targets else mix.shares[name][v][0]
            assert abs(x - goal) <= 0.01 * goal, (name, v, x, goal)
    # the smallest source cannot be nine tenths of four fifths of all tokens; its share is reported, not met
    far = mixing.Mix(docs, share=0.8, targets={"source": {"s0": 0.9, "s1": 0.1}})
    goal, attained = far.shares["source"]["s0"]
    assert goal == pytest.approx(0.9) and attained < 0.8


def test_quality_votes_are_those_of_all_pairs(spark):
    """The blocked products against a plain loop over references."""
    texts = [_words(k, 30 + k) + (" ##" * (k % 3)) for k in range(40)]
    rows = spark.createDataFrame([(k, t, k % 2) for k, t in enumerate(texts)], "doc_id long, text string, quality int")
    m = quality.train(rows.select("doc_id", "text"), rows.select("doc_id", "quality").filter("doc_id < 30"))
    got = {r["doc_id"]: r["score"] for r in quality.classify(rows, m).collect()}
    raw, off = string_bytes(pa.array(texts))
    x = quality.features(raw, off)
    for k in range(40):
        v = (x[k] * m.idf) @ m.axes
        v = v / np.linalg.norm(v)
        votes = sorted(((float(v @ r), i) for i, r in enumerate(m.refs)), key=lambda p: (-p[0], p[1]))[: quality.NEIGHBOURS]
        w = [max(s, 1e-6) ** quality.POWER * m.weights[i] for s, i in votes]
        assert got[k] == pytest.approx(sum(a * m.labels[i] for a, (_, i) in zip(w, votes, strict=True)) / sum(w), abs=1e-4)


def test_language_sets_by_plain_em(spark):
    """Proportions and the choice of the set against expectation-maximisation in plain loops."""
    words = {"en": "the and of with that from", "de": "der und die nicht von ist", "fr": "le la les des une dans"}
    rows = [(k, " ".join(np.random.default_rng(k).choice(w.split(), 20)), lang) for k, (lang, w) in enumerate((lang, w) for lang, w in words.items() for _ in range(15))]
    m = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), features=60)
    text = "the and of with that from " * 12 + "le la les des une dans " * 8
    c = m.counts(*string_bytes(pa.array([text])))[0].astype(float)

    def em(use):
        pi = np.array([1.0 / len(use) if k in use else 0.0 for k in range(3)])
        for _ in range(langid.ROUNDS):
            new = np.zeros(3)
            for f, n in enumerate(c):
                if n:
                    p = pi * m.prob[:, f]
                    new += n * p / p.sum()
            pi = new / new.sum()
        return pi, sum(n * np.log((pi * m.prob[:, f]).sum()) for f, n in enumerate(c) if n)

    order = np.argsort(-em([0, 1, 2])[0])
    first = max(range(3), key=lambda k: em([k])[1])
    order = [first, *[int(k) for k in order if k != first]]
    best, pi = None, None
    for size in range(1, 4):
        p, ll = em(order[:size])
        bic = -2 * ll + (size - 1) * np.log(c.sum())
        if best is not None and bic >= best:
            break
        best, pi = bic, p
    top, score = m.predict(c[None, :].astype(np.float32))
    assert top[0] == int(np.argmax(pi)) and score[0] == pytest.approx(pi.max(), abs=1e-3) and m.langs[top[0]] == "en"


def test_line_units_by_a_dictionary(spark):
    """Lines alone, of any length: what a dictionary of normalised lines in the order of ids would keep."""
    rng = np.random.default_rng(3)
    pool = [_words(k, 1 + k % 30) for k in range(40)]
    rows = [(int(k), "\n".join(pool[j] for j in rng.integers(0, 40, 6))) for k in rng.permutation(50)]
    got = {r["doc_id"]: r["clean_text"] for r in linededup.dedup_units(spark.createDataFrame(rows, "doc_id long, text string"), line=1, pieces=False).collect()}
    seen = set()
    for k, t in sorted(rows):
        kept = []
        for x in t.split("\n"):
            if x not in seen:
                kept.append(x)
            seen.add(x)
        assert [x for x in got[k].split("\n") if x] == kept


def test_repeated_ids_lose_no_links(spark):
    """Rows of one id with different texts are one document: what either is linked with is in its component."""
    a, b = _words(31, 60), _words(32, 60)
    rows = [(5, a), (5, b), (3, a), (9, b), (7, _words(33, 60))]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["component_id"], r["kept"]) for r in got) == [(3, 3, True), (5, 3, False), (5, 3, False), (7, 7, True), (9, 3, False)]
    with pytest.raises(TypeError):
        neardup.near_duplicates(spark.createDataFrame([("x", "a")], "doc_id string, text string"))


def test_contamination_keeps_items_without_id(spark):
    items = spark.createDataFrame([(None, "a b c"), (2, "b c d")], "item_id long, text string")
    rows = spark.createDataFrame([(1, "x a b c d"), (2, "c d")], "doc_id long, text string")
    for size in (1 << 20, 1):
        got = {r["doc_id"]: r for r in decontam.contamination(rows, items, block_bytes=size).collect()}
        assert got[1]["items"] == [None, "2"] and got[1]["n_hit"] == 4 and got[2]["items"] == []


def test_equal_texts_lie_together(spark):
    """Rows of one text are neighbours in the order of shards, though their sources differ; ties and repeated rows have slots of their own."""
    rows = [(k, f"text {k % 7}" if k % 3 else _words(k, 5), "en", f"s{k % 5}") for k in range(200)] + [(1, "text 1", "en", "s1")] * 2
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").withColumn("shard", F.lit("mine"))
    for limit in (sharding.BROADCAST_GROUPS, 0):
        sharding_limit, sharding.BROADCAST_GROUPS = sharding.BROADCAST_GROUPS, limit
        placed = sharding.place(docs, shards=4).collect()
        sharding.BROADCAST_GROUPS = sharding_limit
        order = [r["text"] for r in sorted(placed, key=lambda r: (r["shard"], r["slot"]))]
        assert len(order) == 202 and sorted(placed[0].asDict()) == sorted(["doc_id", "text", "lang", "source", "size", "text_crc32", "curve", "shard", "slot"])
        runs = [t for i, t in enumerate(order) if i == 0 or order[i - 1] != t]
        assert len(runs) == len(set(runs))


def test_secrets_of_repeated_rows(spark):
    m = secretscan.fit({}, {})
    rows = spark.createDataFrame([(1, "token=abcdef1")] * 2 + [(1, None)], "doc_id long, text string")
    assert sorted(len(r["spans"]) for r in secretscan.scan(rows, m).collect()) == [0, 1, 1]


def test_long_credentials_do_not_train(spark):
    long = "0123456789abcdef" * 20000
    rows = spark.createDataFrame([(1, f"é {long} password=hunter22"), (2, "token=abcdefgh1")], "doc_id long, text string")
    m = secretscan.train(rows)
    assert len(m.automata["hex"].moves) < 10000 and m.automata["assign"].log_likelihood("abcdefgh1") > secretscan.FLOOR * 9
    got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in secretscan.scan(rows, m).collect()}
    assert got == {1: [("hex", 2, 320002), ("assign", 320012, 320020)], 2: [("assign", 6, 15)]}


def test_long_values_train_fewer(spark, monkeypatch):
    r = __import__("random").Random(3)
    values = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz0123456789", k=4096)) for _ in range(300)]
    monkeypatch.setattr(secretscan, "fit", lambda got, pairs: got)
    got = secretscan.train(spark.createDataFrame([(i, f"token={v}") for i, v in enumerate(values)], "doc_id long, text string"))
    assert got.keys() == {"assign"} and got["assign"] < set(values) and 40_000 < sum(map(len, got["assign"])) < 300_000
