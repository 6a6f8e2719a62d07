"""Line dedup (3), SetSketch near-dedup (10): brute force, skew, odd rows, oracles."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradelens.llm import bloom, line_dedup, queries, setsketch
from tools.check_oracles import canon

SF_SMALL = "/root/testdata/sf0.001"
LONG = "This line is long enough to count as a repeat, isn't it"


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_oracles(spark, duck, name):
    con = duck(SF_SMALL)
    df = queries.QUERIES[name](spark, SF_SMALL)
    cur = con.execute(queries.ORACLES[name])
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon([d[0] for d in cur.description], cur.fetchall())


def brute_lines(rows, min_chars=40, min_docs=5):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate(low)
    where = defaultdict(set)
    for d, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= min_chars and d is not None:
                where[key(x)].add(d)
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if d is None or len(where.get(key(x), ())) < min_docs or d == max(where[key(x)])]
        out.append((d, len(lines), len(lines) - len(stay), "\n".join(stay)))
    return sorted(out, key=repr)


def test_line_dedup_brute_force(spark):
    rng = random.Random(4)
    pool = [f"{LONG} number {i} é" for i in range(30)] + ["short", "", "  ", "É" * 39, "É" * 40, "é" * 40, "x" * 40]
    rows = []
    for d in range(120):
        lines = [rng.choice(pool) for _ in range(rng.randint(0, 8))]
        lines = [rng.choice([x, x.upper() if rng.random() < .2 else x, f" \t{x}\r", f" {x}"]) for x in lines]
        rows.append((d, "\n".join(lines)))
    rows += [(None, LONG), (None, LONG), (500, None), (501, ""), (502, LONG * 5000), (3, rows[3][1]), (502, LONG)]
    rows += [(600 + i, LONG) for i in range(4)] + [(603, LONG), (700, f"{LONG}\n{LONG}\nrest")]
    df = spark.createDataFrame([(d, t, "x") for d, t in rows], "doc_id long, text string, Kept_Text string").repartition(7)
    got = sorted(((r.doc_id, r.n_lines, r.n_dropped, r.kept_text) for r in line_dedup.dedup_lines(df).collect()), key=repr)
    assert got == brute_lines(rows)


def test_line_dedup_other_ids_and_empty(spark):
    df = spark.createDataFrame([(f"d{i}", LONG) for i in range(6)], "name string, body string")
    got = {r.name: r.n_dropped for r in line_dedup.dedup_lines(df, "name", "body").collect()}
    assert got == {f"d{i}": int(i < 5) for i in range(6)}
    assert line_dedup.dedup_lines(df.limit(0), "name", "body").count() == 0


def test_filter_has_no_false_negatives(spark):
    ids = spark.range(20000).selectExpr("xxhash64(id) AS h")
    table = bloom.hash_filter(ids, 3)
    h = np.array([r.h for r in ids.collect()]).view(np.uint64)
    assert bloom.contains(table, h).all()
    other = np.arange(1, 20001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    assert bloom.contains(table, other).mean() < 0.05


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({i: i + 32 for i in range(65, 91)}))


def shingles(t, k):
    w = words_of(t)
    return {tuple(w)} if 0 < len(w) < k else {tuple(w[i:i + k]) for i in range(len(w) - k + 1)}


def brute_components(rows, k, percent=80):
    sets = [shingles(t, k) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted((d, len(sets[i]), min(least[find(i)])) for i, (d, _) in enumerate(rows))


def near_copies(rng, n, vocab=300, edits=12):
    base = [f"w{rng.randrange(vocab)}" for _ in range(120)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"w{rng.randrange(vocab)}"
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize("k", [2, 5])
def test_near_duplicates_brute_force(spark, k):
    rng = random.Random(k)
    texts = near_copies(rng, 150) + near_copies(rng, 5) + near_copies(rng, 40, edits=4) + ["same text here"] * 20
    texts += [" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(60))) for _ in range(60)]
    texts += ["", " \n", None, "one", "ONE", "one two", "one two", "A b c d e f", "a B\tc d e f", "y " * 20000, "y y y y y y y"]
    rows = list(enumerate(texts))
    rng.shuffle(rows)
    rows = [(d * 3 + 1, t) for d, t in rows]
    df = spark.createDataFrame([(d, t, 0, "x") for d, t in rows], "doc_id long, text string, n_shingles int, component_id string").repartition(5)
    got = setsketch.near_duplicates(df, k=k).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, k)
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_line_dedup_with_clashing_names(spark):
    line = "A line of more than forty characters, in six documents."
    df = spark.createDataFrame([(i, f"{line}\nown {i}", "a", "b", "c") for i in range(6)], "doc_id long, text string, __lost string, __id string, Kept_text string")
    got = {r.doc_id: (r.kept_text, r["__lost"], r["__id"]) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {i: (f"own {i}" if i < 5 else f"{line}\nown 5", "a", "b") for i in range(6)}


def test_near_duplicates_blocks_of_any_size(spark, monkeypatch):
    rng = random.Random(9)
    rows = list(enumerate(near_copies(rng, 120, edits=40)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(setsketch, "BLOCK", 8)
    monkeypatch.setattr(setsketch, "CELL", 5)
    got = setsketch.near_duplicates(df, k=2).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == brute_components(rows, 2)


def test_near_duplicates_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (7, "a b c"), (None, "lonely text"), (7, "a b c"), (8, None)],
                               "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in setsketch.near_duplicates(df, k=2).collect()), key=repr)
    assert got == sorted([(None, 7, False), (None, 7, False), (7, 7, True), (7, 7, True), (None, None, True), (8, 8, True)], key=repr)
    assert setsketch.near_duplicates(df.limit(0)).count() == 0
    named = spark.createDataFrame([("b", "x y z"), ("a", "X y z"), ("c", "q")], "doc_id string, text string")
    assert {(r.doc_id, r.component_id) for r in setsketch.near_duplicates(named, k=2).collect()} == {("a", "a"), ("b", "a"), ("c", "c")}


def test_texts_that_share_an_id_are_judged_apart(spark):
    long = " ".join(f"w{i}" for i in range(60))
    rows = [(3, long), (7, long + " more"), (7, "something else altogether here"), (9, "something else altogether here"), (5, "w0 w1")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept, r.n_shingles) for r in setsketch.near_duplicates(df, k=2).collect()}
    assert got == {(3, 3, True, 59), (7, 3, False, 60), (7, 7, True, 3), (9, 7, False, 3), (5, 5, True, 1)}
    left = setsketch.drop_duplicates(df.withColumn("__row_key", F.lit(1)), k=2)
    assert sorted((r.doc_id, r.text) for r in left.collect()) == sorted([rows[0], rows[2], rows[4]]) and left.columns == ["doc_id", "text", "__row_key"]


def test_components_of_long_chains(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000 + i, 1000 + (i * 7) % 97) for i in range(97)] + [(5000, 5000)]
    label = {r.i: r.root for r in setsketch.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert len({label[i] for i in range(301)}) == 1
    groups = defaultdict(set)
    for i in label:
        groups[label[i]].add(i)

    def reach(start):
        seen, todo = {start}, [start]
        while todo:
            x = todo.pop()
            for a, b in edges:
                for y in ((b,) if a == x else (a,) if b == x else ()):
                    if y not in seen:
                        seen.add(y)
                        todo.append(y)
        return seen

    assert groups[label[1001]] == reach(1001) and groups[label[0]] == reach(0)


def test_sketches_merge_and_estimate():
    rng = np.random.default_rng(3)
    a, b = (rng.integers(0, 2 ** 63, 400, dtype=np.uint64) for _ in range(2))
    union = np.unique(np.concatenate([a, b]))
    ka, kb, ku = setsketch.sketches([a, b, union])
    assert (np.maximum(ka, kb) >= ku).all() and (np.maximum(ka, kb) == ku).mean() > 0.99
    shared = np.concatenate([a[:360], b[:40]])
    ks = setsketch.sketches([np.unique(a), np.unique(shared)])
    est = setsketch.similarity(np.array([(ks[0] > ks[1]).sum()]), np.array([(ks[0] < ks[1]).sum()]), np.array([400]), np.array([400]))
    assert abs(est[0] - 360 / 440) < 0.12


def test_kept_digest_is_of_the_kept_text(spark):
    docs = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    kept = {r.doc_id: r.kept_text for r in line_dedup.dedup_lines(docs).collect()}
    for r in queries.op3_line_dedup(spark, SF_SMALL).collect():
        assert r.kept_sha256 == hashlib.sha256(kept[r.doc_id].encode()).hexdigest()
