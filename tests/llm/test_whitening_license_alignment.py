"""Embedding whitening (11), license scan (12), cross-tokenizer alignment (13): brute force on whole and odd rows."""

import hashlib
import itertools
import re
from collections import Counter

import numpy as np
import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gradelens.llm import alignment, license_rules, license_scan, queries, whitening

SF = "/root/testdata/sf0.001"
A, B = P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model")


# -- 11 ----------------------------------------------------------------------------------
def integer_rows(rows):
    out = {}
    for i, v in rows:
        if v and all(c is not None and np.isfinite(c) for c in v):
            out.setdefault(i, []).append(tuple(int(np.floor(64 * c)) + 1_000_000 for c in v))
    return out


def test_whitening_of_the_whole_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    x = integer_rows(rows)
    fit = np.array(sorted({v for vs in x.values() for v in vs}), np.int64)
    n, total = len(fit), fit.sum(0)
    z = n * fit - total
    v = (z.T @ z) / n ** 3
    e = np.sort(np.linalg.eigvalsh(v))[::-1]
    got = queries.op11_embedding_whitening(spark, SF).collect()
    assert Counter(r.vec_id for r in got) == {i: 16 * len(vs) for i, vs in x.items()}
    for r in got:
        assert r.n == n and abs(r.explained / (e[r.component - 1] / np.trace(v)) - 1) < 1e-9 and 0 <= r.identity_error < 1e-9
        assert r.deviation in [int(((n * np.array(a) - total) ** 2).sum()) for a in x[r.vec_id]]
    # whitened rows of the fit list have the identity as covariance, and undo to the projections on V's eigenvectors
    w = {r.vec_id: {} for r in got}
    for r in got:
        w[r.vec_id][r.component] = r.whitened
    ids = sorted(w)
    y = np.array([[w[i][c] for c in range(1, 17)] for i in ids])
    own = np.array([x[i][0] for i in ids], float) - total / n
    p, *_ = np.linalg.lstsq(own, y, rcond=None)
    assert np.abs(v @ p - p * e[:16]).max() < 1e-6 * e[0]


def test_whitening_of_odd_rows(spark):
    rows = [(1, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [None, 1.0]), (3, None), (4, []), (5, [float("nan"), 1.0]), (6, [1.0]), (None, [3.0, 5.0]),
            (8, [1e300, 1.0]), (9, [1e15, -2.0]), (10, [7.5, -3.25]), (11, [float("inf"), 0.0])]
    df = spark.createDataFrame([(i, v, "old") for i, v in rows], "vec_id long, embedding array<double>, Whitened string")
    m = whitening.fit(df)
    x = [[64 * 1 + 10 ** 6, 64 * 2 + 10 ** 6], [192 + 10 ** 6, 320 + 10 ** 6], [64 * 10 ** 15 + 10 ** 6, 10 ** 6 - 128], [480 + 10 ** 6, 10 ** 6 - 208]]
    total = [sum(v[k] for v in x) for k in range(2)]
    want = {i: sum((4 * v[k] - total[k]) ** 2 for k in range(2)) for i, v in zip((1, None, 9, 10), x)}
    got = whitening.whiten(df, m).collect()
    assert m.n == 4 and sorted((r.vec_id or 0) for r in got) == [0, 1, 1, 9, 10] and all(int(r.deviation) == want[r.vec_id] for r in got)
    exact = whitening.covariance_numerators(
        [sum(r * r for r in c) for c in ((1, -2, 4), (0, 3, 5))] + [sum((a + b) ** 2 for a, b in zip((1, -2, 4), (0, 3, 5)))], 2, 3, [3, 8])
    assert exact == [[3 * 21 - 9, 3 * 14 - 24], [3 * 14 - 24, 3 * 34 - 64]]
    for few, count in ((df.limit(0), 0), (df.where("vec_id = 1"), 1), (df.where("vec_id in (2, 3, 4)"), 0)):
        flat = whitening.fit(few)
        assert flat.n == count and all(r.whitened == [] and r.deviation == 0 for r in whitening.whiten(few, flat).collect())


def test_polarisation_is_exact_for_large_values():
    rng = np.random.default_rng(1)
    x = rng.integers(-2 ** 40, 2 ** 40, (50, 3))
    big = whitening.squares(x.astype(object))
    small = whitening.squares(x % 1000)
    for q, v in ((big, x.astype(object)), (small, (x % 1000).astype(object))):
        n, s = len(v), [int(c) for c in v.sum(0)]
        c = whitening.covariance_numerators([int(a) for a in q], 3, n, s)
        assert c == [[int(n * (v[:, i] * v[:, j]).sum() - s[i] * s[j]) for j in range(3)] for i in range(3)]


# -- 12 ----------------------------------------------------------------------------------
def words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


def brute_scan(t, rules):
    line = " " + " ".join(words(t)) + " "
    found = []
    for i, r in enumerate(rules):
        for m in re.finditer(rf"(?<= )(?:{re.sub(r'<([0-9]+)>', r'(?: [^ ]+){0,\1}', r.pattern)})(?= )", line):
            start = line[:m.start()].count(" ") - 1
            found.append((start, start + m[0].count(" ") + 1, r.level, i))

    def over(c, d):
        return c != d and c[0] <= d[0] and c[1] >= d[1] and (c[2] < d[2] or (c[2] == d[2] and ((c[0], c[1]) != (d[0], d[1]) or c[3] < d[3])))
    kept = [d for d in found if not any(over(c, d) for c in found)]
    base = sorted((d[0], rules[d[3]].label) for d in found if rules[d[3]].base)
    names = sorted({x for _, x in base})
    return (len(words(t)), base, sorted((d[0], d[1], rules[d[3]].label, d[2]) for d in kept), names,
            sorted(set(names) | {rules[d[3]].label for d in kept if not rules[d[3]].base}), max([license_scan.SCORES[d[2]] for d in kept], default=0.0))


PHRASES = ["Licensed under the Apache License, Version 2.0.", "Released under the MIT License.", "GNU General Public License, version 3", "CC BY-NC 4.0",
           "MIT License MIT license", "SPDX-License-Identifier: Apache-2.0", "foo bar", "beer ware license", "public domain", "mit", "license", "GPL-3.0",
           "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"S\")",
           "neither the name of X nor the names of its contributors may be used to endorse or promote products derived from", "Apache license apache LICENSE v2",
           "creative commons attribution sharealike 4.0", "MİT LICENSE", "mit license", "APACHE-LICENSE"]


def test_license_scan_against_brute_force(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " ", "mit license", "MIT-License\nmit\tlicense", "K" + "K", "MIT License. " * 300]
    texts += [" ".join(rng.choice(PHRASES, rng.integers(1, 10))) for _ in range(60)]
    rules = license_rules.default_rules()
    assert len(rules) > 300
    df = spark.createDataFrame([(i, t, "old", 1) for i, t in enumerate(texts)], "doc_id long, text string, Labels string, __words int")
    for r in license_scan.scan(df).collect():
        got = (r.n_words, [tuple(x) for x in r.base_places], sorted(tuple(x) for x in r.detections), r.base_labels, r.labels, r.score)
        assert got == brute_scan(texts[r.doc_id], rules), texts[r.doc_id]


def test_license_rules_have_their_keywords():
    for r in license_rules.default_rules():
        example = license_rules.expansions(re._parser.parse(re.sub(r"<\d+>", "", r.pattern)))[0]
        assert set(license_rules.keywords(r.pattern)) <= set(example.split())
    with pytest.raises(ValueError, match="no word"):
        license_rules.keywords("mit|apache")


def test_license_query_over_all_documents(spark):
    rules = license_rules.default_rules()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in queries.op12_license_scan(spark, SF).collect()}
    assert set(got) == set(texts) and any(r.n_base for r in got.values())
    for i, t in texts.items():
        n, base, _, names, labels, score = brute_scan(t, rules)
        r = got[i]
        assert (r.n_words, r.n_base, r.base_labels, r.labels, r.score) == (n, len(base), ",".join(names), ",".join(labels), score)
        assert (r.first_word, r.last_word) == ((base[0][0], base[-1][0]) if base else (None, None))
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.scan(empty).count() == 0


# -- 13 ----------------------------------------------------------------------------------
@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(A)
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=B)
    alphabet = alignment.byte_alphabet()

    def tokens(text):
        ia, ib = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        a = [bytes(alphabet[c] for c in tok.id_to_token(i)) for i in ia]
        b = [bytes([int(sp.id_to_piece(i)[3:-1], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ib]
        return ia, ib, a, b
    return tokens


def brute_alignment(text, tokens):
    """(n_a, n_b, groups, links as id pairs)."""
    ia, ib, a, b = tokens(text or "")
    whole = b" " + (text or "").encode()
    if not text or b"".join(a) != whole or b"".join(b) != whole:
        return 0, 0, [], []
    ends = [list(itertools.accumulate(map(len, x))) for x in (a, b)]
    groups, lo = [], [0, 0]
    for c in sorted(set(ends[0]) & set(ends[1])):
        hi = [x.index(c) + 1 for x in ends]
        groups.append(",".join(map(str, ia[lo[0]:hi[0]])) + "|" + ",".join(map(str, ib[lo[1]:hi[1]])))
        lo = hi
    return len(ia), len(ib), groups, [(ia[ends[0].index(c)], ib[ends[1].index(c)]) for c in sorted(set(ends[0]) & set(ends[1]))]


ODD = [None, "", " ", "a", "  x  y ", "é日本 语 🙂\x00z", "<|endoftext|> <s> </s> <unk> x", "\ta\r\n", "ﬁ ①", "a▁b", "don't we'll", "x" * 3000, "plain words here"]


def test_alignment_against_brute_force(spark, libraries):
    texts = ODD + ["a b" * 400, "long text with many words in it " * 400] + [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()]
    df = spark.createDataFrame([(i, t, "old") for i, t in enumerate(texts)] + [(None, "plain words here", "old")], "doc_id long, text string, N_Links string").repartition(3)
    per = {i: brute_alignment(t, libraries) for i, t in enumerate(texts)}
    per[None] = per[ODD.index("plain words here")]
    counts = Counter(p for v in per.values() for p in v[3])
    best = {}
    for (_, b), n in counts.items():
        best[b] = max(best.get(b, 0), n)
    for piece, most in ((alignment.PIECE_BYTES, alignment.FREQUENT), (500, 40), (500, 0)):
        rows = alignment.align(df, A, B, pattern=P.PATTERN, keep_groups=True, piece=piece)
        marked = alignment.best_pairs(alignment.link_counts(rows), alignment.piece_level(B).n)
        assert sum(r.n for r in marked.collect()) == sum(counts.values())
        got = {r.doc_id: r for r in alignment.link_scores(rows, marked, most).collect()}
        assert set(got) == set(per)
        for i, (n_a, n_b, groups, links) in per.items():
            r = got[i]
            text = ";".join(groups)
            assert (r.n_a, r.n_b, r.n_groups, r.n_links, r.groups) == (n_a, n_b, len(groups), len(links), text), (i, piece)
            assert r.groups_sha256 == (hashlib.sha256(text.encode()).hexdigest() if groups else "")
            assert r.count_sum == sum(counts[p] for p in links) and r.n_best == sum(counts[p] == best[p[1]] for p in links), (i, most)


def test_both_encoders_of_the_json_file_agree(spark):
    texts = [" " + r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text] + [" " + t for t in ODD if t]
    fast, library = alignment.byte_level(A, P.PATTERN), alignment.byte_level(A)
    assert [list(x) for x in fast.encode(texts)] == [list(x) for x in library.encode(texts)]
    known = [i for i in range(256 + 50000)]      # every entry encodes to itself, so looking a word up equals merging it
    raw = [fast.data[fast.start[i]:fast.start[i] + fast.size[i]].tobytes() for i in known]
    plain = [(i, r.decode()) for i, r in zip(known, raw) if not r.decode("utf-8", "ignore").encode() != r]
    assert all(library.encode([t])[0] == fast.encode([t])[0] for _, t in plain[::37])


def test_alignment_query_and_empty_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    got = queries.op13_tokenizer_alignment(spark, SF)
    assert got.count() == n and got.where((F.col("n_links") != F.col("n_groups")) | (F.col("count_sum") < F.col("n_links"))).count() == 0
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.scored_links(empty, A, B).count() == 0
