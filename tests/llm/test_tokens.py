"""Token files and packing against the tokenizers library."""

import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from callsheet.llm import packing, token_files
from callsheet.llm.queries import queries
from callsheet.llm.tokens import WordIds

SMALL = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
ALPHABET = [*" \n\t\r ab'sdtTE1290.,;-_<|>éßÉ日🎉ΣσİſΑΣ\x0b\x0c\x1c\x85 ́", "'re", "<|endoftext|>"]


@pytest.fixture(scope="module")
def library():
    tokenizer = Tokenizer.from_file(PATH)
    return lambda text: tokenizer.encode(text or "", add_special_tokens=False).ids + [1]


def test_ids_are_the_library_s(library):
    rnd, ids_of = random.Random(7), WordIds(PATH)
    for _ in range(3000):
        text = "".join(rnd.choice(ALPHABET) for _ in range(rnd.randrange(40)))
        assert [*np.frombuffer(ids_of.encode(text), "<u4"), 1] == library(text), repr(text)


def test_every_code_point_is_the_library_s(library):
    """In words of letters, digits and marks; also those Python's tables do not name."""
    ids_of = WordIds(PATH)
    points = [c for c in range(0x80, 0x110000) if not 0xD800 <= c < 0xE000]
    some = [c for c in points if c < 0x3000 or c % 37 == 0 or 0x10D40 <= c < 0x10D90]
    for c in some:
        text = f"a{chr(c)}b{chr(c)} 1{chr(c)}"
        assert [*np.frombuffer(ids_of.encode(text), "<u4"), 1] == library(text), hex(c)


def _of_texts(ids_of, texts, kind=None):
    found = []
    for ids, sizes in ids_of.of_texts(pa.array(texts, kind or pa.string())):
        found += [part.tolist() + [1] for part in np.split(ids, np.cumsum(sizes)[:-1])]
    return found


@pytest.mark.parametrize("portion, kind", [(1, pa.string()), (60, pa.large_string()), (8 << 20, pa.string())])
def test_ids_of_many_texts_are_the_library_s(monkeypatch, library, portion, kind):
    monkeypatch.setattr("callsheet.llm.tokens.PORTION", portion)
    rnd = random.Random(8)
    marks = [*" \n\t\r\v\f\x1c\x00aZ", *"ÀÞ×÷ßÿªµİſK\u0301\u00a0\u3000É日'.,)`-_9", "'re", "Ça", "<|endoftext|>", "THE, "]
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randrange(30))) for _ in range(1500)]
    texts += [None, "", " ", "\n \n", "x" * 5000, "Été" * 3000 + "...", None, "<|startoftext|>,", ""]
    assert _of_texts(WordIds(PATH), texts, kind) == [library(t) for t in texts]
    for few in ([], [None], ["", ""], ["\n"]):
        assert _of_texts(WordIds(PATH), few, kind) == [library(t) for t in few]


def test_words_of_many_texts_are_looked_up_once(library):
    asked = []

    class Counted(WordIds):
        def piece(self, piece):
            asked.append(piece)
            return super().piece(piece)

        def __missing__(self, word):
            asked.append(word)
            return super().__missing__(word)

    words = [f"{w}{m}" for w in ("the", "The", "THE", "été", "Été") for m in ("", ",", ".", "...", '."')]
    texts = [" ".join(words)] * 500
    ids_of = Counted(PATH)
    assert _of_texts(ids_of, texts) == [library(t) for t in texts]
    assert sorted(asked) == sorted(["the", "été", ",", ".", "...", '."'])


def test_a_folder_without_a_scheme_is_on_spark_s_file_system(spark):
    assert token_files.qualified(spark, "/some/folder") == "file:///some/folder"
    assert token_files.qualified(spark, "file:/some/folder") == "file:///some/folder"
    conf = spark._jsc.hadoopConfiguration()
    before = conf.get("fs.defaultFS")
    try:  # a default file system of another name
        conf.set("fs.defaultFS", "viewfs://store/")
        conf.set("fs.viewfs.mounttable.store.link./some", "file:///tmp")
        assert token_files.qualified(spark, "/some/folder") == "viewfs://store/some/folder"
    finally:
        conf.set("fs.defaultFS", before)


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr("callsheet.llm.tokens.REMEMBERED", 5)
    ids_of = WordIds(PATH)
    text = " ".join(f"word{i} and" for i in range(50))
    assert [*np.frombuffer(ids_of.encode(text), "<u4"), 1] == library(text)
    assert len(ids_of) <= 6


def _crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def _digest_rows(rows, library):
    found, start = [], 0
    for key, text in rows:
        ids = library(text)
        found.append((key, start, len(ids), _crc(ids)))
        start += len(ids)
    return found


def test_token_file_query(spark, documents, library):
    found = queries()["op2_token_files"](spark, SMALL).collect()
    assert sorted(map(tuple, found)) == _digest_rows(sorted(documents), library)


def test_token_files_of_odd_rows(spark, frame, odd_rows, library):
    found = token_files.digests(frame(odd_rows), PATH).orderBy("start").collect()
    keys = [r.doc_id for r in found]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))
    assert [r.start for r in found] == np.cumsum([0, *(r.n_tokens for r in found)])[:-1].tolist()
    wanted = Counter((k, len(library(t)), _crc(library(t))) for k, t in odd_rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in found) == wanted
    assert token_files.digests(frame([(1, "x")]).limit(0), PATH).count() == 0


def test_files_have_fixed_size_lists_and_random_access(tmp_path):
    uri = f"file://{tmp_path}/some/ids.arrow"
    file = token_files.TokenFile(uri, pa.uint16())
    ids = np.arange(token_files.SEQUENCE * token_files.BATCH * 2 + 777) % 60_000
    for part in np.array_split(ids, 37):
        file.add(part)
    file.close()
    reader = token_files.open_token_file(uri)
    kind = reader.schema.field("ids").type
    assert pa.types.is_fixed_size_list(kind) and kind.list_size == token_files.SEQUENCE
    assert reader.num_record_batches == 3
    last = reader.get_batch(2)
    assert sum(last.column("mask").flatten().to_pylist()) == 777
    for at, n in [(0, 5), (token_files.SEQUENCE * token_files.BATCH - 3, 10), (len(ids) - 4, 4), (9, 0)]:
        assert token_files.stored_ids(reader, at, n).tolist() == ids[at : at + n].tolist()


# --- packing -------------------------------------------------------------------


def _check_packing(found, capacity=4096):
    sequences = defaultdict(list)
    for row in found:
        sequences[row.sequence_id].append(row)
    for rows in sequences.values():
        at = 0
        for row in sorted(rows, key=lambda r: r.offset):
            assert row.offset == at
            at += row.length
        assert at <= capacity
    return len(sequences)


def test_packing_query(spark, documents, library):
    found = queries()["op7_best_fit_packing"](spark, SMALL).collect()
    wanted = []
    for key, text in documents:
        ids = library(text)
        for piece, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at : at + 4096]
            wanted.append((key, piece, at, len(part), _crc(part)))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in found) == sorted(wanted)
    least = -(-sum(w[3] for w in wanted) // 4096)
    assert _check_packing(found) <= least * 1.02 + 1


def test_packing_odd_rows(spark, frame, odd_rows, library):
    found = packing.packed_documents(frame(odd_rows), PATH).collect()
    _check_packing(found)
    tokens = Counter()
    for row in found:
        tokens[row.doc_id] += row.length
    wanted = Counter()
    for key, text in odd_rows:
        wanted[key] += len(library(text))
    assert tokens == wanted
    assert packing.packed_documents(frame([(1, "x")]).limit(0), PATH).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_packing_lengths(spark, seed):
    rnd = random.Random(seed)
    most = [40, 900, 4096, 4096][seed]
    lengths = [rnd.randrange(1, most + 1) if rnd.random() < 0.7 else 7 for _ in range(700)]
    rows = [(i, 0, length) for i, length in enumerate(lengths)]
    pieces = spark.createDataFrame(rows, "doc_id BIGINT, piece INT, length BIGINT")
    found = packing.pack(pieces, 4096).collect()
    assert sorted((r.doc_id, r.length) for r in found) == [(i, n) for i, n in enumerate(lengths)]
    # first-fit decreasing, item by item
    bins = []
    for length in sorted(lengths, reverse=True):
        for i, used in enumerate(bins):
            if used + length <= 4096:
                bins[i] += length
                break
        else:
            bins.append(length)
    assert _check_packing(found) <= len(bins) * 1.04 + 1


def test_configurations_hold_all_items():
    rnd = random.Random(3)
    sizes = sorted(rnd.sample(range(70, 1000), 20), reverse=True)
    counts = [rnd.randrange(1, 500) for _ in sizes]
    found = packing.configurations(sizes, counts, 1024)
    held = sum(column * number for column, number in found)
    assert held.tolist() == counts
    assert all((column * np.array(sizes)).sum() <= 1024 for column, _ in found)
