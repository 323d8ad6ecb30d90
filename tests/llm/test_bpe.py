"""BPE against the tokenizers library, and exact round trips."""

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from callsheet.llm import bpe
from callsheet.llm.queries import queries

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = [*" \n\t\r ab'sdtTE1290.,;-_<|>éßÉ日🎉ΣσİſΑΣ\x0b\x0c\x1c\x85 ́", "'re", "<|endoftext|>", "  ", "aaaa"]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def digest(library, key, text):
    ids = library.encode(text or "", add_special_tokens=False).ids
    back = library.decode(ids, skip_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return key, len(ids), sha(",".join(map(str, ids))), sha(back)


def test_ids_are_the_library_s(library):
    rnd, table = random.Random(11), bpe.Merges(PATH)
    texts = ["".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(50))) for _ in range(3000)]
    texts += ["", "a" * 5000, "ab" * 3000, " " * 50, "\n" * 7, "x    ", "the " * 500]
    for text, ids in zip(texts, table.encode(texts), strict=True):
        wanted = library.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<i4").tolist() == wanted, repr(text)


def test_memory_and_blocks_are_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 10)
    monkeypatch.setattr(bpe, "BLOCK", 20)
    table = bpe.Merges(PATH)
    for start in range(0, 300, 30):
        texts = [f"word{i} and others{i * i}" for i in range(start, start + 30)]
        for text, ids in zip(texts, table.encode(texts), strict=True):
            assert np.frombuffer(ids, "<i4").tolist() == library.encode(text).ids
    assert len(table.known) < 200


def test_query(spark, documents, library):
    found = queries()["op10_bpe_round_trip"](spark, SMALL).collect()
    assert Counter(map(tuple, found)) == Counter(digest(library, k, t) for k, t in documents)


def test_odd_rows(frame, odd_rows, library):
    found = bpe.digests(frame(odd_rows), PATH).collect()
    assert Counter(map(tuple, found)) == Counter(digest(library, k, t) for k, t in odd_rows)
    assert bpe.digests(frame(odd_rows).limit(0), PATH).count() == 0


def test_decoding_of_cut_characters(spark, library):
    ids = library.encode("日本🎉", add_special_tokens=False).ids
    rows = [(i, ids[:i]) for i in range(len(ids) + 1)] + [(99, None), (100, [50256, 10**6])]
    frame = spark.createDataFrame(rows, "doc_id BIGINT, ids ARRAY<INT>")
    found = {r.doc_id: r.text for r in bpe.decode(frame, PATH).collect()}
    for i in range(len(ids) + 1):
        assert found[i] == library.decode(ids[:i], skip_special_tokens=False)
    assert (found[99], found[100]) == ("", "<|endoftext|>")
