import hashlib
import random
import time
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from strandmill.llm import bpe, packing, tokenfile, wordids
from strandmill.llm.flat import FlatMap
from strandmill.llm.libtokens import LibraryEncoder
from strandmill.llm.queries import queries
from strandmill.llm.segment import SpacedSplitter, unlike
from strandmill.llm.shared import WordMemo, text_passes

RANKS = P.path("byte_bpe_multi_50k.tiktoken")
TEXTS = ["", None, " ", "it's 'the  \n\n x's", "日本語 🙂    a\t\tb  ", "aaaaaaaaaaaa", "x" * 3000, "<|endoftext|> 12345 \x1c \x00 é", "Thonble reing ofthe. " * 50, "Ελλάς ΑΣ"]


@pytest.fixture(scope="module")
def encoder():
    return bpe.TextEncoder(RANKS, P.PATTERN)


@pytest.fixture(scope="module")
def reference():
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})


def rows(spark, texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, ids string")


def test_bpe_documents(spark, reference):
    got = {r["id"]: r for r in bpe.encode_documents(rows(spark, TEXTS), RANKS, P.PATTERN).collect()}
    for i, t in enumerate(TEXTS):
        assert np.frombuffer(got[i]["ids"], np.uint32).tolist() == reference.encode_ordinary(t or "")
        assert got[i]["decoded"] == (t or "") and got[i]["n_tokens"] == len(reference.encode_ordinary(t or ""))
    digests = {r["doc_id"]: r for r in bpe.encode_documents(rows(spark, TEXTS), RANKS, P.PATTERN, then=bpe.DIGESTS).collect()}
    for i, t in enumerate(TEXTS):
        ids = ",".join(map(str, reference.encode_ordinary(t or "")))
        assert digests[i]["ids_sha256"] == hashlib.sha256(ids.encode()).hexdigest() and digests[i]["decoded_sha256"] == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.encode_documents(rows(spark, TEXTS).where("false"), RANKS, P.PATTERN, then=bpe.DIGESTS).count() == 0


@given(st.text(max_size=40))
@settings(max_examples=150, deadline=None)
def test_bpe_any_text(encoder, reference, text):
    ids = encoder([text])[0]
    assert ids.tolist() == reference.encode_ordinary(text)
    decoder = bpe.StreamingDecoder(encoder.transducer.bytes_of)
    assert "".join(decoder.feed(ids[i : i + 1]) for i in range(len(ids))) + decoder.end() == text


@given(st.binary(max_size=12))
@settings(max_examples=200, deadline=None)
def test_utf8_machine(data):
    machine = bpe.Utf8Machine()
    assert machine.feed(data) + machine.end() == data.decode("utf-8", "replace")


def test_state_limit(reference):
    small = bpe.BpeTransducer(bpe.read_ranks(RANKS), max_states=20)
    for word in ("thonblereing", "straße", "1234567", "zzzzzzzzz", "inanertion"):
        assert small.encode(word.encode()) == reference.encode_ordinary(word)


@pytest.mark.parametrize(("states", "long", "batch"), [(100_000, 400, 1 << 18), (30, 20, 200), (100_000, 5000, 1 << 18)])
def test_flat_transducer(reference, states, long, batch):
    rng, tokens = random.Random(4), list(bpe.read_ranks(RANKS))
    words = ["thonblereing", "a" * 300, "日本語テキスト" * 9, "ab" * 100, "x" * 3000, "é" * 45]
    for _ in range(1500):
        words.append("".join(rng.choice("ab") for _ in range(rng.randrange(1, 40))))
        words.append("".join(rng.choice("etaoinshrdlu") for _ in range(rng.randrange(1, 16))))
        words.append(b"".join(rng.choice(tokens) for _ in range(rng.randrange(1, 6))).decode("utf-8", "ignore") or "x")
        words.append("".join(chr(rng.randrange(0x3040, 0x9000)) for _ in range(rng.randrange(1, 12))))
    flat = bpe.FlatTransducer(bpe.BpeTransducer(bpe.read_ranks(RANKS)), max_states=states, long=long, batch_bytes=batch)
    for some in (words[:900], words):
        for word, ids in zip(some, flat.encode_many([w.encode() for w in some])):
            assert np.frombuffer(ids, "<u4").tolist() == reference._core_bpe.encode_single_piece(word.encode()), word


def test_flat_map():
    rng, held, expected = np.random.default_rng(3), FlatMap(2), {}
    for _ in range(60):
        keys = np.unique(rng.integers(1, 1 << 40, 50).astype(np.uint64))
        keys = keys[held.get(keys) < 0]
        held.put(keys, np.arange(len(keys)))
        expected |= dict(zip(keys.tolist(), range(len(keys))))
    asked = np.concatenate((np.fromiter(expected, np.uint64), np.array([7, 8], np.uint64)))
    assert held.get(asked).tolist() == [expected.get(k, -1) for k in asked.tolist()]


@pytest.mark.parametrize(("file", "pattern"), [("byte_bpe_50k.json", P.PATTERN), ("word_bpe_49k.json", None)])
def test_library_encoder(file, pattern):
    library = Tokenizer.from_file(P.path(file))
    encoder = LibraryEncoder(P.path(file), pattern, 1, kept_words=4)
    for texts in (TEXTS, TEXTS[::-1]):
        got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.packed(texts)]
        assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_splitter_is_the_pattern():
    split = SpacedSplitter(P.PATTERN)
    rng = random.Random(3)
    for _ in range(300):
        text = "".join(rng.choice("ab é1²\n\t .!日 ") for _ in range(rng.randrange(12)))
        assert split(text) == (split.pattern.findall(text) if text else [])


def test_code_points_of_newer_unicode(encoder, reference):
    """Letters that only some Unicode tables know: the libraries' tables count, with and without an apostrophe."""
    odd = np.flatnonzero(unlike())
    library = {f: Tokenizer.from_file(P.path(f)) for f in ("byte_bpe_50k.json", "word_bpe_49k.json")}
    own = {"byte_bpe_50k.json": LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN), "word_bpe_49k.json": LibraryEncoder(P.path("word_bpe_49k.json"), None)}
    for c in [*odd[:: max(1, len(odd) // 60)].tolist(), 0x3F19B, 0x11DE0, 0xE000, 0x10FFFF]:
        for text in (f"{chr(c)}i a{chr(c)}{chr(c)}1 x", f"it's {chr(c)}i'd a{chr(c)}7  {chr(c)}"):
            assert encoder([text])[0].tolist() == reference.encode_ordinary(text)
            for f, tokenizer in library.items():
                assert np.frombuffer(own[f].packed([text])[0], own[f].kind).tolist() == tokenizer.encode(text, add_special_tokens=False).ids, (f, hex(c))


def test_passes_cover_all():
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), pa.array(["a" * 5, None, "", "b" * 100, "c", "d"])], names=["id", "text"])
    assert [t for _, ts in text_passes(iter([batch]), limit=8) for t in ts] == batch.column("text").to_pylist()


@given(st.lists(st.integers(0, 3000), min_size=1, max_size=700))
@settings(max_examples=60, deadline=None)
def test_elias_fano(gaps):
    ends = np.cumsum(gaps)
    code = tokenfile.EliasFano.of(ends)
    assert code.all().tolist() == ends.tolist() == [code.select(i) for i in range(len(ends))]
    assert 8 * (code.low.nbytes + code.upper.nbytes) <= len(ends) * (3 + np.log2(1 + ends[-1] / len(ends))) + 192


def test_token_file(spark, tmp_path):
    texts = [*TEXTS, "last"]
    docs = rows(spark, texts).withColumn("doc_id", 50 - F.col("doc_id") * 3)
    path = f"file://{tmp_path}/f"
    tokenfile.write_token_file(docs, path, P.path("byte_bpe_50k.json"), P.PATTERN, block_ids=40)
    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    start, expected = 0, []
    for i in reversed(range(len(texts))):
        ids = [*library.encode(texts[i] or "", add_special_tokens=False).ids, 2]
        expected.append((50 - 3 * i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(map(tuple, tokenfile.located(spark, path).collect())) == sorted(expected)
    block = tokenfile.TokenBlock.from_bytes(spark.read.parquet(f"{path}/blocks").orderBy("block").first()["data"])
    assert len(block.document(0)) == expected[0][2] and block.name(0) == expected[0][0]
    assert spark.read.parquet(f"{path}/blocks").columns == ["block", "n_ids", "data"]


@given(st.lists(st.one_of(st.none(), st.integers(-(1 << 63), (1 << 63) - 1)), min_size=1, max_size=300))
@settings(max_examples=60, deadline=None)
def test_token_block_round_trip(names):
    names = sorted(names, key=lambda x: (x is not None, x or 0))
    ends = np.cumsum([i % 5 for i in range(len(names))])
    block = tokenfile.TokenBlock.from_bytes(tokenfile.TokenBlock.of(np.arange(ends[-1], dtype="<u2"), ends, names).to_bytes())
    assert [block.name(i) for i in range(len(names))] == names
    assert [block.document(i).tolist() for i in range(len(names))] == [list(range(e - i % 5, e)) for i, e in enumerate(ends.tolist())]


def test_token_file_of_odd_rows(spark, tmp_path):
    """Null and repeated doc_ids, columns that clash, a long text, and no rows at all."""
    odd = spark.createDataFrame([(None, "a b"), (None, None), (7, "c"), (7, "c"), (-3, "x" * 200_000)], "doc_id long, text string").withColumns({"block": F.lit(1), "data": F.lit("z")})
    tokenfile.write_token_file(odd, f"file://{tmp_path}/odd", P.path("byte_bpe_50k.json"), P.PATTERN, block_ids=4)
    got = sorted((r["start"], r["doc_id"], r["n_tokens"]) for r in tokenfile.located(spark, f"file://{tmp_path}/odd").collect())
    assert [d for _, d, _ in got] == [None, None, -3, 7, 7] and [s for s, _, _ in got] == np.cumsum([0, *(n for _, _, n in got)])[:-1].tolist()
    tokenfile.write_token_file(odd.where("false"), f"file://{tmp_path}/none", P.path("byte_bpe_50k.json"), P.PATTERN)
    assert tokenfile.located(spark, f"file://{tmp_path}/none").count() == 0


def best_fit(lengths, window):
    bins = []
    for n in sorted(lengths, reverse=True):
        fits = [b for b in bins if b >= n]
        if fits:
            bins.remove(min(fits))
            bins.append(min(fits) - n)
        else:
            bins.append(window - n)
    return len(bins)


@given(st.lists(st.integers(1, 64), max_size=200))
@settings(max_examples=80, deadline=None)
def test_best_fit(lengths):
    windows, offsets, n = packing.best_fit_decreasing(lengths, 64)
    assert n == best_fit(lengths, 64)
    at = {}
    for w, o, k in sorted(zip(windows, offsets, lengths)):
        assert at.get(w, 0) == o
        at[w] = o + k
    assert all(v <= 64 for v in at.values())


def test_packing(spark):
    texts = [*TEXTS, "word " * 5000, "a", "a"]
    got = packing.pack_documents(rows(spark, texts), P.path("word_bpe_49k.json"), round_tokens=900).orderBy("doc_id", "start").collect()
    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for i, t in enumerate(texts):
        own = [r for r in got if r["doc_id"] == i]
        ids = [*library.encode(t or "", add_special_tokens=False).ids, 1]
        assert [r["start"] for r in own] == np.cumsum([0, *(r["length"] for r in own)])[:-1].tolist()
        assert np.frombuffer(b"".join(r["ids"] for r in own), "<u2").tolist() == ids and own[0]["doc_tokens"] == len(ids)
    filled = {}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == filled.get(r["sequence_id"], 0)
        filled[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(filled.values()) <= 2048
    digests = packing.pack_documents(rows(spark, ["a"]), P.path("word_bpe_49k.json"), then=packing.DIGESTS).collect()
    assert digests[0]["ids_crc32"] == zlib.crc32(np.array([*library.encode("a", add_special_tokens=False).ids, 1], "<u4").tobytes())


@given(st.lists(st.integers(1, 64), max_size=60))
@settings(max_examples=80, deadline=None)
def test_refilled(lengths):
    cuts = packing.refilled(lengths, 64)
    assert [i for i, n in enumerate(lengths) for _ in range(n)] == [i for i, _, n, _ in cuts for _ in range(n)]
    sizes, at = {}, {}
    for i, begin, n, sequence in cuts:
        assert begin == at.get(i, 0)
        at[i], sizes[sequence] = begin + n, sizes.get(sequence, 0) + n
    small = [sizes[k] for k in sorted(sizes) if sizes[k] != 64]
    assert list(sizes) == list(range(len(sizes))) and all(n & (n - 1) == 0 for n in small) and small == sorted(set(small), reverse=True)


@pytest.mark.parametrize("parts", [1, 40])
def test_padding_whatever_the_partitions(spark, parts):
    texts = [f"word{i} " * (1 + i * 37 % 90) for i in range(400)]
    got = packing.pack_documents(rows(spark, texts).repartition(parts), P.path("word_bpe_49k.json"), window=256, round_tokens=900)
    sizes = [r["n"] for r in got.groupBy("sequence_id").agg(F.sum("length").alias("n")).collect()]
    assert all(n >= 248 or n & (n - 1) == 0 for n in sizes) and max(sizes) <= 256
    assert sum(256 if n & (n - 1) else n for n in sizes) < 1.02 * sum(sizes)


ADDED = [*TEXTS, "foo <|endoftext|> bar", "a<|startoftext|><|endoftext|>b  <|endoftext|>", "It's<|endoftext|>'s", "A\u0301<|endoftext|>\u0301", "<|EndOfText|> <|endoftext", "  <|endoftext|>\n\n<|endoftext|> x"]


@pytest.mark.parametrize(("file", "pattern"), [("byte_bpe_50k.json", P.PATTERN), ("word_bpe_49k.json", None)])
def test_added_tokens_as_loaded(file, pattern):
    library = Tokenizer.from_file(P.path(file))
    encoder = LibraryEncoder(P.path(file), pattern, 1, kept_words=4)
    got = [np.frombuffer(x, encoder.kind).tolist() for x in encoder.packed(ADDED)]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in ADDED]


@pytest.mark.parametrize(("file", "pattern"), [("byte_bpe_50k.json", P.PATTERN), ("word_bpe_49k.json", None)])
def test_latin_words(file, pattern):
    """Words of Latin letters with marks and capitals of all sorts."""
    library, encoder = Tokenizer.from_file(P.path(file)), LibraryEncoder(P.path(file), pattern, 1)
    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("aeionstrßÄéñøžİıſǅA") for _ in range(rng.randrange(1, 9))) for _ in range(rng.randrange(60))) + rng.choice(["", " x1", "日本 a", "\u0301 b", "ª º"]) for _ in range(60)]
    assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.packed(texts)] == [[*library.encode(t, add_special_tokens=False).ids, 1] for t in texts]


@pytest.fixture(scope="module")
def both_encoders():
    """The library's, and the one here with few words kept."""
    return Tokenizer.from_file(P.path("byte_bpe_50k.json")), LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN, kept_words=12)


@given(st.lists(st.text(st.sampled_from("a b's\0\n\u2003é日🙂1!\u0301R"), max_size=40), min_size=1, max_size=6))
@settings(max_examples=150, deadline=None)
def test_words_of_many_texts_at_once(both_encoders, texts):
    """Texts side by side do not touch each other, with words of 15 and 16 bytes, NULs at their ends, and few words kept."""
    library, encoder = both_encoders
    texts = [*texts, "", "a" * 15, "a" * 16, "\0", "\0\0", "'", "s", " ", " x", "日本語日本", "日本語日本a", *reversed(texts)]
    for _ in range(2):
        assert [np.frombuffer(x, encoder.kind).tolist() for x in encoder.packed(texts)] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_kept_words_under_one_slot():
    """Words that all want the same slot, and a table that grows with them."""
    low, high = np.arange(3000, dtype=np.uint64), np.full(3000, 8 << 56, np.uint64)
    kept = wordids.KeptWords(np.dtype("<u2"))
    kept._home = lambda low, high: np.full(len(low), len(kept.low) - 2)
    for i in range(0, 3000, 1000):
        kept.put(low[i : i + 1000], high[i : i + 1000], np.full(1000, 2), np.repeat(np.arange(i, i + 1000), 2))
    assert kept.get(low, high).tolist() == list(range(3000)) and kept.get(low, high + np.uint64(1)).tolist() == [-1] * 3000
    counts, ids = kept.spelled(kept.get(low[::-1], high))
    assert counts.tolist() == [2] * 3000 and ids.tolist() == np.repeat(np.arange(3000)[::-1], 2).tolist()


def test_kept_words_cost_no_objects():
    """Words that are kept are looked up in less than half the time that it takes to make strings of them and look these up in a dictionary."""
    rng = random.Random(3)
    words = ["".join(rng.choice("abdeiklmnorstué") for _ in range(rng.randrange(2, 12))) for _ in range(60_000)]
    texts = [" ".join(rng.choices(words, k=500)) for _ in range(300)]
    encoder = LibraryEncoder(P.path("byte_bpe_50k.json"), P.PATTERN, 2)
    memo = WordMemo(400_000, lambda words: [w.encode() for w in words])

    def seconds(run):
        begin = time.process_time()
        run()
        return time.process_time() - begin

    ways = [lambda: encoder.packed(texts), lambda: memo.values([encoder.split(t) for t in texts])]
    for way in ways:
        way()  # now all words are kept
    flat, plain = (min(seconds(way) for _ in range(5)) for way in ways)
    assert flat < 0.5 * plain, (flat, plain)


@pytest.mark.parametrize(("query", "file", "end"), [("op3_token_file", "byte_bpe_50k.json", 2), ("op10_best_fit_packing", "word_bpe_49k.json", 1)])
def test_queries_take_added_tokens(spark, tmp_path, query, file, end):
    rows(spark, ADDED).select("doc_id", "text").write.parquet(f"{tmp_path}/documents.parquet")
    got: dict = {}
    for r in queries()[query](spark, str(tmp_path)).orderBy("doc_id", "start").collect():
        got.setdefault(r["doc_id"], []).append(r)
    library = Tokenizer.from_file(P.path(file))
    before = 0
    for i, t in enumerate(ADDED):
        ids = [*library.encode(t or "", add_special_tokens=False).ids, end]
        at, size, first = (before, "n_tokens", before) if query == "op3_token_file" else (0, "length", 0)
        for r in got[i]:  # op3 gives whole documents, op10 pieces that cover them
            own = ids[at - first : at - first + r[size]]
            assert r["start"] == at and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes()) and len(own) == r[size]
            at += r[size]
        assert at - first == len(ids) and (query == "op3_token_file" or got[i][0]["doc_tokens"] == len(ids))
        before += len(ids)
