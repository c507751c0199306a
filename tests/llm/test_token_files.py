import random
import zlib

import numpy as np
import pytest

from fixatlas.llm import simple8b
from fixatlas.llm.queries import tokenizer_path
from fixatlas.llm.token_files import SEGMENT_SCHEMA, read_token_files, write_token_files

SCHEMA = "doc_id long, text string, start int, ids string"
HARD = [
    "", None, " ", "a", "Hello  World\n\nhi", "x<|endoftext|>y <|startoftext|> z", "it's we'll DON'T", " ab",
    "é ́x İstanbul ΣΣ", "tab\tand nbsp wide", "12345 6", "a" * 70_000, "word " * 20_000,
    "same text", "same text", "J\u030c E\u0301. A\u0338, don't. X.Y,Z! <|ENDOFTEXT|> <|endoftext|>.", "I\u0307.", "ABC.DEF", ".a .5 5. 'S", "\ue000 x\ue001y z", "\x00 nul", "日本語 テキスト",
]


def test_words_of_all_widths_and_escapes():
    rng = np.random.default_rng(3)
    for n in (0, 1, 2, 59, 127, 128, 129, 5000):
        for top in (1, 2, 9, 700, 50_000, 2**33, 2**64 - 1):
            ids = rng.integers(0, top, n, dtype=np.uint64, endpoint=True)
            words, firsts, escaped = simple8b.pack(ids)
            assert (simple8b.unpack(words, escaped) == ids).all()
            assert len(firsts) == -(-n // simple8b.BLOCK)
    assert len(simple8b.pack(np.full(128, 65535, np.uint64))[0]) == 43  # three ids of 20 bits in a word


def test_one_text_is_read_from_its_blocks_alone():
    ids = np.arange(1000, dtype=np.uint64) ** 3
    bounds = np.array([0, 0, 5, 300, 300, 1000])
    segment = simple8b.to_segment(ids, bounds)
    for t in range(5):
        assert (simple8b.read_text(segment, t) == ids[bounds[t] : bounds[t + 1]]).all()
    with pytest.raises(ValueError):
        simple8b.from_segment(segment[:-8])
    with pytest.raises(ValueError):
        simple8b.from_segment(b"something" + segment)


def brute(rows):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_path("word_bpe_49k.json"))
    start, out = 0, []
    for doc_id, text in sorted(rows):
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("ranges", [1, 5])
def test_files_hold_the_ids_of_the_library(spark, tmp_path, ranges):
    texts = HARD + [" ".join(random.Random(i).choices(["the", "The", "erhea,", "ß!", "x-y", "\n"], k=i)) for i in range(60)]
    rows = [(900 - 7 * i, t) for i, t in enumerate(texts)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA).repartition(3)
    write_token_files(docs, str(tmp_path / "f"), tokenizer_path("word_bpe_49k.json"), ranges=ranges)
    found = sorted(read_token_files(spark, str(tmp_path / "f")).collect())
    got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in found]
    assert got == brute([(i, t) for i, t in rows])


def test_empty_table_null_ids_and_repeated_rows(spark, tmp_path):
    empty = spark.createDataFrame([], SCHEMA)
    write_token_files(empty, str(tmp_path / "e"), tokenizer_path("word_bpe_49k.json"))
    assert read_token_files(spark, str(tmp_path / "e")).count() == 0
    docs = spark.createDataFrame([(None, "b", 0, ""), (1, "a", 0, ""), (1, "a", 0, "")], SCHEMA)
    write_token_files(docs, str(tmp_path / "r"), tokenizer_path("word_bpe_49k.json"), ranges=3)
    rows = read_token_files(spark, str(tmp_path / "r")).collect()
    assert sorted((r.doc_id is not None, r.start, r.n_tokens) for r in rows) == [(False, 0, 2), (True, 2, 2), (True, 4, 2)]


def test_segments_are_cut_at_documents(spark, tmp_path, monkeypatch):
    from fixatlas.llm import token_files

    monkeypatch.setattr(token_files, "SEGMENT_IDS", 40)
    rows = [(i, "a b c " * (i % 30)) for i in range(50)]
    batches = [b for b in token_files._encoded(tokenizer_path("word_bpe_49k.json"), 1)(
        spark.createDataFrame([(*r, 0, "") for r in rows], SCHEMA).toArrow().to_batches())]
    assert len(batches) > 10 and [f.name for f in batches[0].schema] == [f.split()[0] for f in SEGMENT_SCHEMA.split(", ")]
    ids = [len(simple8b.from_segment(b.column("content")[0].as_py())[0]) for b in batches]
    assert sum(ids) == sum(3 * (i % 30) + 1 for i in range(50))
    assert [b.column("before")[0].as_py() for b in batches] == np.concatenate([[0], np.cumsum(ids)[:-1]]).tolist()
