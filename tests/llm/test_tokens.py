"""Byte BPE, token counts and packing against the libraries."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from tsforge.llm import bytebpe, packing, tokencount

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
FILE = public_tokenizers.path("byte_bpe_50k.json")
MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def fuzz():
    rng = random.Random(3)
    signs = "abtheino re  ▁\n\t\rü漢字\U0001f600A1'st.,<>́ \x1c"
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 80))) for _ in range(800)]
    parts = ["the", "ing", "th", "e", "at", "in", " ", "  ", "\n"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(1, 120))) for _ in range(300)]
    return [*texts, "", " ", "a" * 5000, "ab" * 3000, " " * 999, "<s></s><|endoftext|>", "\x00a", "don't  we'll\n\n x"]


def test_ids_and_bytes(make, corpus, fuzz):
    rows = corpus + list(enumerate(fuzz, 10_000)) + [(None, "no id"), (1, "twice"), (1, "twice")]
    out = bytebpe.round_trip(make(rows), RANKS, public_tokenizers.PATTERN).collect()
    assert len(out) == len(rows)
    whole = bytebpe.encoding(RANKS, public_tokenizers.PATTERN)
    for row in out:
        text = row["text"] or ""
        assert np.frombuffer(row["ids"], "<u4").tolist() == whole.encode_ordinary(text)
        assert bytes(row["decoded"]) == text.encode()


def test_pieces_are_cut_where_no_match_is(fuzz):
    whole = bytebpe.encoding(RANKS, public_tokenizers.PATTERN)
    for text in [" ".join(fuzz), "word 12a " * 3000, "漢。" * 2000]:
        cut = list(bytebpe.pieces(text, 50))
        assert "".join(cut) == text and len(cut) > 20
        assert sum((whole.encode_ordinary(p) for p in cut), []) == whole.encode_ordinary(text)
    assert list(bytebpe.pieces("x" * 500, 50)) == ["x" * 500]


@pytest.mark.parametrize("sign", ["\u0558", "\u088f", "\u0c5c", "\u208f", "\U000323ff", "é", "漢", "_", "²"])
def test_long_texts_equal_the_library(sign):
    """Characters that Unicode versions class differently, where a text might be cut."""
    whole = bytebpe.encoding(RANKS, public_tokenizers.PATTERN)
    n = bytebpe.PIECE
    for text in ("x" * n + f"{sign}'ll end", "x" * (n - 1) + f" {sign}{sign}'ll, {sign} 've", f"w{sign} " * n, f"{sign}'s " * n):
        assert np.frombuffer(bytebpe.encode_text(text, RANKS, public_tokenizers.PATTERN), "<u4").tolist() == whole.encode_ordinary(text)


def test_query_digests(spark):
    from tsforge.llm.catalog import QUERIES

    folder = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    whole = bytebpe.encoding(RANKS, public_tokenizers.PATTERN)
    for r in QUERIES["op2_byte_bpe"](spark, folder).collect():
        ids = whole.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_token_counts(make, corpus, fuzz):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    rows = corpus + list(enumerate(fuzz, 10_000)) + [(None, "no id"), (1, "twice"), (1, "twice")]
    out = make(rows).withColumn("n", tokencount.token_count(MODEL, F.col("text"))).collect()
    assert len(out) == len(rows)
    assert all(r["n"] == len(model.encode(r["text"] or "")) for r in out)
    assert make([]).withColumn("n", tokencount.token_count(MODEL, F.col("text"))).count() == 0


def test_small_cache_gives_the_same_counts(corpus, monkeypatch):
    texts = [t for _, t in corpus]
    expected = tokencount.count_texts(texts, MODEL)
    monkeypatch.setattr(tokencount, "CACHE", 10)
    monkeypatch.setattr(tokencount, "CHARS", 500)
    monkeypatch.setattr(tokencount, "SYMBOLS", 40)
    assert (tokencount.count_texts(texts, MODEL) == expected).all()


def test_file_ids_equal_the_library(corpus, fuzz):
    from tokenizers import Tokenizer

    library, own = Tokenizer.from_file(FILE), packing.tokenizer(FILE)
    for text in [t or "" for _, t in corpus] + fuzz + ["a ͸ b", "՘x ՘"]:
        ids = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(text), "<u4").tolist() == ids, text[:50]


def test_packing_holds_every_id_once(make, corpus):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(FILE)
    rows = corpus + [(None, "no id"), (1, "twice"), (1, "twice")]
    docs = make([(i, t, 5) for i, t in rows], "doc_id long, text string, start long")
    out = packing.pack_documents(docs, FILE).toPandas()
    assert (out.groupby("sequence_id")["length"].sum() <= 1024).all()
    for _, part in out.sort_values("offset").groupby("sequence_id"):
        assert part["offset"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
    for i, text in corpus:
        if i == 1:
            continue
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        part = out[out["doc_id"] == i].sort_values("start")
        assert part["start"].tolist() == [0, *part["length"].cumsum().tolist()[:-1]]
        assert part["length"].sum() == len(ids) and (part["doc_tokens"] == len(ids)).all()
        for r in part.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert len(out[out["doc_id"].isna()]) == 1
    assert packing.pack_documents(make([]), FILE).count() == 0


def test_shards_pack_alike_and_tightly(spark):
    rng = random.Random(5)
    lengths = sorted((x for n in (rng.randint(1, 3000) for _ in range(4000)) for x in np.diff(packing.cuts(n)).tolist()), reverse=True)
    where, offset = packing.balance(lengths)
    used = np.bincount(where, weights=lengths)
    assert used.max() <= 1024 and len(used) * 1024 < 1.02 * sum(lengths)
    # Cost-balanced: sequences with room get close to the same cost.
    cost = np.bincount(where, weights=[n + n * n * packing.QUADRATIC for n in lengths])
    assert np.percentile(cost, 25) > 0.5 * np.percentile(cost, 99)


def plain_balance(lengths, capacity):
    """The stated rule, by looking at every sequence for every piece."""
    open_ = [[0.0, capacity] for _ in range(-(-sum(lengths) // capacity))]
    where, offset = [], []
    for n in lengths:
        fit = [(cost, room, k) for k, (cost, room) in enumerate(open_) if room >= n]
        if not fit:
            open_.append([0.0, capacity])
            fit = [(0.0, capacity, len(open_) - 1)]
        cost, room, k = min(fit)
        where.append(k)
        offset.append(capacity - room)
        open_[k] = [cost + n + packing.QUADRATIC * n * n, room - n]
    return where, offset


@pytest.mark.parametrize("longest", [5, 60, 1024])
def test_balance_equals_the_plain_rule(longest):
    rng = random.Random(longest)
    for _ in range(80):
        lengths = sorted((rng.randint(1, longest) for _ in range(rng.randint(0, 150))), reverse=True)
        assert packing.balance(lengths) == plain_balance(lengths, 1024)


def test_packing_cache_is_bounded_by_bytes(corpus, monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 20_000)
    own = packing.Ids(FILE)
    whole = packing.tokenizer(FILE)
    for _, text in corpus:
        assert own.encode(text or "") == whole.encode(text or "")
        assert own.held <= 20_000 and sum(map(len, own.known)) <= 20_000
