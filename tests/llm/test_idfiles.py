"""Id files against the tokenizers library, their round trip and access to single documents."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tsforge.llm import idfiles
from tsforge.llm.base import scratch_path

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def plain(rows, library, end=1):
    """(doc_id, start, ids) in the order of the files; the order of rows that share an id is open."""
    out, at = [], 0
    for i, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*library.encode(text or "", add_special_tokens=False).ids, end]
        out.append((i, at, ids))
        at += len(ids)
    return out


def test_round_trip(spark, make, corpus, library):
    docs = make([(i, t, 1, 2, 3) for i, t in corpus], "doc_id long, text string, ids int, at int, start int")
    folder = scratch_path(spark, "ids")
    rows = idfiles.write_documents(docs, PATH, folder, shard=20_000)
    assert rows.select("shard").distinct().count() > 3
    got = sorted((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in idfiles.read(rows, folder).collect())
    assert got == plain(corpus, library)


def test_parts_are_the_whole(library):
    """Blank-separated parts give the ids of the whole text, whatever characters stand in them."""
    import pyarrow as pa

    rng = random.Random(3)
    odd = " \n\t\r\x0b\x0c\x1c\x85\xa0\u2003\u3000\u0301\u030a\u0338\u037e\u212a\u2126aeA'sS'tllΣςİiẞéÉ×÷ß0129١९漢字🙂.,;:!?()\"-_<>=|"
    odd = [*odd, "<|endoftext|>", "\x00", "ﬁ", "가", "가", "e\u0301", "'ll", "'re"]
    texts = ["".join(rng.choice(odd) for _ in range(rng.randint(0, 60))) for _ in range(4000)]
    texts += ["".join(rng.choice("aé,.'s1 ") for _ in range(rng.randint(0, 40))) for _ in range(4000)]
    texts += ["<|endoftext|>", "a <|startoftext|>b\n<|endoftext|>", "é \u0301e", "x" * 3000, "é" * 900 + "," * 900, None, ""]
    tok, got = idfiles.WordIds(PATH), []
    for _, ids, offsets in tok.encode(pa.array(texts), 1):
        got += [ids[a:b].tolist() for a, b in zip(offsets, offsets[1:])]
    assert got == [[*library.encode(t or "", add_special_tokens=False).ids, 1] for t in texts]


def test_single_documents_and_repeats(spark, make, library):
    rows = [(5, "five five"), (None, "none"), (5, "five five"), (2, None), (9, "nine " * 400), (-1, " ")]
    folder = scratch_path(spark, "ids")
    index = idfiles.write_documents(make(rows), PATH, folder)
    want = plain(rows, library)
    got = sorted(((r.doc_id, r.start, np.frombuffer(r.ids, "<u4").tolist()) for r in idfiles.read(index, folder).collect()), key=lambda r: r[1])
    assert got == want
    some = idfiles.fetch(spark, folder, make([(9,), (5,), (5,), (77,)], "doc_id long")).collect()
    assert sorted((r.doc_id, r.start, r.n_tokens) for r in some) == sorted((i, a, len(x)) for i, a, x in want if i in (5, 9))


def test_compressed_by_itself_under_the_dictionary(spark, make, library):
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=40))) for i in range(1500)]
    docs = make(rows)
    dictionary = idfiles.train(docs, PATH)
    assert dictionary
    sizes = []
    for d in (dictionary, b""):
        frames = idfiles.encode(docs, PATH, d)
        sizes.append(idfiles.write(frames, scratch_path(spark, "ids"), d).agg({"size": "sum"}).first()[0])
    assert sizes[0] < 0.8 * sizes[1]


def test_foreign_dictionary_is_refused(spark, make):
    folder = scratch_path(spark, "ids")
    rows = idfiles.write_documents(make([(1, "some text")]), PATH, folder)
    system, place = idfiles._system(folder)
    with system.open_output_stream(f"{place}/dictionary") as file:
        file.write(b"another dictionary")
    with pytest.raises(Exception, match="no id file of this folder"):
        idfiles.read(rows, folder).collect()


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "")], [(1, " \n")], [(1, "one two three")]])
def test_small_tables(spark, make, library, rows):
    folder = scratch_path(spark, "ids")
    got = idfiles.read(idfiles.write_documents(make(rows), PATH, folder), folder).collect()
    assert [(r.doc_id, r.start, zlib.crc32(bytes(r.ids))) for r in got] == [
        (i, a, zlib.crc32(np.array(x, "<u4").tobytes())) for i, a, x in plain(rows, library)
    ]


def test_each_part_is_looked_up_once():
    """Known parts cost one look, new ones get the places they are learnt at."""

    class Counted(dict):
        looks = 0

        def get(self, *args):
            self.looks += 1
            return super().get(*args)

        def __contains__(self, word):
            self.looks += 1
            return super().__contains__(word)

        def __getitem__(self, word):
            self.looks += 1
            return super().__getitem__(word)

    path = public_tokenizers.path("word_bpe_49k.json")
    tok, plain = idfiles.WordIds(path), Tokenizer.from_file(path)
    tok.known = Counted()
    first, second = ["apple", "12", "zebra", "x-y", "@@"], ["x-y", "pear", "apple", "&&", "zebra"]
    for words in (first, second):
        place = tok.slots(words, np.array([w.isalpha() for w in words]))
        got = [tok.flat[tok.start[k] : tok.start[k] + tok.size[k]].tolist() for k in place]
        assert got == [plain.encode(w, add_special_tokens=False).ids for w in words]
    assert tok.known.looks == 10


def test_new_parts_are_learnt_once_a_slice(library, monkeypatch):
    """All new parts of a slice are added to the remembered ids together, and the parts of many slices stay known."""
    tok = idfiles.WordIds(PATH)
    added, learn = [], idfiles.WordIds._learn
    monkeypatch.setattr(idfiles.WordIds, "_learn", lambda self, words, *x: added.append(len(words)) or learn(self, words, *x))
    rng = random.Random(2)
    words = sorted({"".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(9000)}) + [f"#{k:x}#" for k in range(9000)]
    place = tok.slots(words, np.array([w.isalpha() for w in words]))
    assert added == [len(words)]
    some = rng.sample(range(len(words)), 500)
    got = [tok.flat[tok.start[k] : tok.start[k] + tok.size[k]].tolist() for k in place[some]]
    assert got == [library.encode(words[k], add_special_tokens=False).ids for k in some]
    tok.bytes = 100 << 20
    tok.slots(words, np.array([w.isalpha() for w in words]))
    assert added == [len(words)]
