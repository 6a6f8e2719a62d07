"""Decontamination (6), token counts (8), byte-level BPE (9): libraries and brute force on whole and odd texts."""

import base64
import hashlib
import re

import public_tokenizers as P
import pytest
from pyspark.sql import functions as F

from gradelens.llm import byte_bpe, decontaminate, queries, token_counts
from gradelens.llm.token_counts import cut

SF = "/root/testdata/sf0.001"
LONG = "It's a long text, with words; don't cut 12 of them wrongly.\n" * 6000
ODD = [None, "", " ", "\n \n", "a", "  lead and trail  ", "é日本 语 🙂", "<|endoftext|> and <|startoftext|>x", "x" * 300000, "don't I'll we've 's",
       LONG, "ab" * 200 + " " + "cd " * 60000, "Ünïcödé wörds " * 9000, "á é combining", "tabs\tand\r\nbreaks  twice"]


def frame(spark, texts=ODD):
    return spark.createDataFrame([(i, t, "old", "old") for i, t in enumerate(texts)], "doc_id long, text string, N_Tokens string, token_ids string")


def sample(spark):
    return [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


def test_token_counts_are_the_librarys(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    texts = ODD + sample(spark)
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), P.path("word_bpe_49k.json")).collect()}
    for i, t in enumerate(texts):
        n = len(tok.encode(t or "", add_special_tokens=False).ids)
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), i


def test_token_counts_word_by_word(spark):
    """Texts on which splitting at white space could go wrong: special strings, case, combining marks, other spaces, one long word."""
    path = P.path("word_bpe_49k.json")
    assert token_counts.splits_words(path) and not token_counts.splits_words(P.path("byte_bpe_50k.json"))
    texts = ["<|ENDOFTEXT|> x<|endoftext|>y <|startoftext|>", "e\u0301 a \u0323\u0301b \u1e9b\u0323 \u0130 \u212aelvin x\u00a0y \u2003z", "x" * 30_000, "don't we'LL 'S '",
             "a\x1cb\x85c\x0bd", " \n\t ", "\u4e2d\u6587\u5b57 " * 500, "one two " * 60_000, "a b" + "\u0301" * 50]
    from tokenizers import Tokenizer
    lib = Tokenizer.from_file(path)
    got = {r.doc_id: r for r in token_counts.count_tokens(frame(spark, texts), path).collect()}
    assert [got[i].n_tokens for i in range(len(texts))] == [len(e) for e in lib.encode_batch(texts, add_special_tokens=False)]


def test_token_counts_of_a_sentencepiece_model(spark):
    import sentencepiece
    path = P.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    texts = [t for t in ODD if t is None or len(t) < 10000] + [LONG[:100000]]
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame(spark, texts), path).collect()}
    assert got == {i: len(sp.encode(t or "")) for i, t in enumerate(texts)}
    with pytest.raises(Exception, match="no tokenizer library"):
        token_counts.count_tokens(frame(spark, ["x"]), "/none.bin").collect()


@pytest.mark.parametrize("pattern", [token_counts.SAFE, byte_bpe.SAFE])
def test_cuts_are_whole_and_long(pattern):
    raw = LONG.encode()
    parts = cut(raw, 1000, pattern)
    assert b"".join(parts) == raw and len(parts) > 100 and all(len(p) >= 1000 for p in parts[:-1])
    assert cut(b"x" * 5000, 1000, pattern) == [b"x" * 5000] and cut(b"", 10, pattern) == [b""]


def reference_encoding():
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("ref", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_ids_and_bytes(spark):
    enc, path = reference_encoding(), P.path("byte_bpe_50k.tiktoken")
    texts = ODD + sample(spark)
    encoded = byte_bpe.encode(frame(spark, texts), path, P.PATTERN)
    got = {r.doc_id: r for r in byte_bpe.decode(encoded, path, P.PATTERN).collect()}
    trip = {r.doc_id: r for r in byte_bpe.round_trip(frame(spark, texts), path, P.PATTERN, keep_ids=True).collect()}
    for i, t in enumerate(texts):
        ids = enc.encode_ordinary(t or "")
        assert got[i].token_ids == ids == trip[i].token_ids and bytes(got[i].decoded) == (t or "").encode(), i
        assert trip[i].n_tokens == len(ids) and trip[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
        assert trip[i].ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()


def test_bpe_decodes_ids_that_end_inside_a_character(spark):
    enc, path = reference_encoding(), P.path("byte_bpe_50k.tiktoken")
    ids = enc.encode_ordinary("🙂🙂")
    rows = [(1, ids[:1]), (2, None), (3, []), (4, ids)]
    got = {r.i: bytes(r.decoded) for r in byte_bpe.decode(spark.createDataFrame(rows, "i long, token_ids array<int>"), path, P.PATTERN).collect()}
    assert got == {1: enc.decode_bytes(ids[:1]), 2: b"", 3: b"", 4: "🙂🙂".encode()}


def words(t):
    low = (t or "").translate({i: i + 32 for i in range(65, 91)})
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_scan(docs, items, n=10):
    wins = {}
    for item, t in items:
        w = words(t)
        k = min(n, len(w))
        for i in range(len(w) - k + 1):
            if k:
                wins.setdefault(tuple(w[i:i + k]), set()).add("" if item is None else str(item))
    lengths = {len(w) for w in wins}
    out = []
    for d, t in docs:
        w, hit, found = words(t), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                if items_ := wins.get(tuple(w[i:i + k])):
                    hit.update(range(i, i + k))
                    found |= items_
        out.append((d, len(w), len(hit), sorted(found)))
    return sorted(out, key=repr)


ITEMS = [(1, "One two three four five six seven eight nine ten eleven twelve"), (2, "short item"), (3, "é"), (None, "null id item has six words"), (5, None), (6, " .. "),
         (7, "two three four five six seven eight nine ten eleven other"), (2, "second text of item two"), (10, "short item"), (11, "zero " * 12)]
DOCS = [(1, "x ONE, two three; four five six seven eight nine ten y"), (2, None), (3, ""), (4, "Short-item and short  item."), (5, "é É e"), (6, "nothing here"),
        (7, "zero " * 30), (8, "one two three four five six seven eight nine ten eleven twelve " * 2000), (9, "null id item has six words"), (4, "dup id"),
        (10, "two three four five six seven eight nine ten eleven"), (11, "shorter item shortitem"), (12, "w " * 50000 + "short item")]


@pytest.mark.parametrize("block", [100_000, 3])
def test_scan_brute_force(spark, block):
    docs = spark.createDataFrame([(*d, "old") for d in DOCS], "doc_id long, text string, n_hit string").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = decontaminate.scan(docs, bench, block_windows=block).collect()
    assert sorted(((r.doc_id, r.n_words, r.n_hit, r.item_ids) for r in got), key=repr) == brute_scan(DOCS, ITEMS)


def test_large_benchmarks_take_one_scan(spark, monkeypatch):
    docs = spark.createDataFrame([(*d, "old", 1) for d in DOCS], "doc_id long, text string, __row string, Item_ids int").repartition(3)
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    small = decontaminate.scan(docs, bench)
    seen = []
    add = decontaminate.add_columns
    monkeypatch.setattr(decontaminate, "add_columns", lambda df, new, fn: (seen.append(list(new)), add(df, new, fn))[1])
    large = decontaminate.scan(docs, bench, block_windows=3)
    assert [x[0] for x in seen] == ["n_words", "n_hit"]      # the scan, and the hits put together: whatever the number of windows
    assert sorted(map(repr, (r.asDict() for r in large.select(*small.columns).collect()))) == sorted(map(repr, (r.asDict() for r in small.collect())))
    monkeypatch.setattr(decontaminate, "BITS_PER_WINDOW", 0)
    many = spark.range(300_000).select(F.concat(F.lit("m"), "id").alias("item_id"), F.concat_ws(" ", F.lit("alpha"), F.col("id").cast("string"), F.lit("omega"), (F.col("id") * 7).cast("string")).alias("text"))
    got = {r.doc_id: (r.n_hit, r.item_ids) for r in decontaminate.scan(spark.createDataFrame(
        [(1, "see alpha 17 omega 119 here"), (2, "alpha 17 omega 118"), (3, "alpha 299999 omega 2099993 alpha 1 omega 7")], "doc_id long, text string"), many).collect()}
    assert got == {1: (4, ["m17"]), 2: (0, []), 3: (8, ["m1", "m299999"])}


def test_spans_and_documents_are_removed(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    scanned = decontaminate.scan(docs, bench)
    cleaned = decontaminate.remove_spans(scanned)
    assert cleaned.columns == scanned.columns
    texts = {r.doc_id: r.text for r in cleaned.where("doc_id <> 4").collect()}
    assert texts[1] == "x  y" and texts[2] is None and texts[6] == "nothing here" and texts[5] == "  É e".replace("  ", " ", 1)
    assert decontaminate.scan(cleaned.select("doc_id", "text"), bench).where("n_hit > 0").count() == 0
    left = {r.doc_id for r in decontaminate.remove_documents(scanned).collect()}
    assert left == {2, 3, 4, 6, 11}


def test_empty_benchmark_and_documents(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.scan(docs, none).agg({"n_hit": "sum"}).first()[0] == 0
    assert decontaminate.scan(docs.limit(0), none).count() == 0


def test_token_queries_cover_their_table(spark):
    n = spark.read.parquet(f"{SF}/documents.parquet").count()
    assert queries.op8_token_counts(spark, SF).count() == n == queries.op9_byte_bpe(spark, SF).count()
    assert token_counts.count_tokens(frame(spark).limit(0), P.path("word_bpe_49k.json")).count() == 0
    assert byte_bpe.round_trip(frame(spark).limit(0), P.path("byte_bpe_50k.tiktoken"), P.PATTERN).count() == 0
