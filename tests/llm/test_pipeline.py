import random

import sentencepiece

import corpus_pipeline
from corpus_pipeline import STAGES
from test_near_copies import brute as near_brute
from test_near_copies import grams
from test_suffix_search import words

from fixatlas.llm.queries import tokenizer_path

WHERE = "/root/testdata/sf0.01"


def as_rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_each_stage_on_its_own_input(spark):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet")
    columns = docs.columns
    # 1: labelled documents that were held out are told apart, and nothing is changed.
    good = STAGES[0][1](spark, docs, WHERE)
    assert good.columns == columns
    before, after = set(as_rows(docs)), set(as_rows(good))
    assert after < before
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{WHERE}/labels.parquet").collect()}
    kept = {r[0] for r in after}
    wrong = sum((i in kept) != (q == 1) for i, q in labels.items())
    assert wrong < 0.03 * len(labels)
    # 2: one of each class of the documents that came.
    one = STAGES[1][1](spark, good, WHERE)
    classes = near_brute([(r[0], r[1]) for r in after])
    assert one.columns == columns
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, c, n in classes if c == i)
    assert set(as_rows(one)) < after
    # 3: no window of 50 bytes of a smaller id is left; what has no such window is unchanged.
    left = STAGES[2][1](spark, one, WHERE)
    assert left.columns == columns
    texts = {r.doc_id: r.text for r in one.collect()}
    least = {}
    for i in sorted(texts, reverse=True):
        raw = texts[i].encode()
        for s in range(len(raw) - 49):
            least[raw[s : s + 50]] = i
    found = {r.doc_id: r for r in left.collect()}
    for i, text in texts.items():
        raw = text.encode()
        gone = bytearray(len(raw))
        for s in range(len(raw) - 49):
            if least[raw[s : s + 50]] < i:
                gone[s : s + 50] = b"\1" * 50
        at, want = 0, []
        for c in text:
            size = len(c.encode())
            if not all(gone[at : at + size]):
                want.append(c)
            at += size
        want = "".join(want)
        if want != text and not want.strip():
            assert i not in found
        else:
            assert found[i].text == want and found[i].n_chars == len(want)
    # 4: documents with a window of an item go, the others stay as they are.
    windows = set()
    for r in spark.read.parquet(f"{WHERE}/benchmark.parquet").collect():
        w = words(r.text)
        windows |= {tuple(w[s : s + 10]) for s in range(max(len(w) - 9, 1))}
    clean = STAGES[3][1](spark, left, WHERE)
    assert clean.columns == columns
    assert as_rows(clean) == sorted(
        (tuple(r) for r in found.values() if not any(tuple(words(r.text)[s : s + 10]) in windows for s in range(len(words(r.text))))), key=str
    )
    # 5: the library's ids.
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    final = STAGES[4][1](spark, clean, WHERE).collect()
    texts = {r.doc_id: r.text for r in clean.collect()}
    assert {r.doc_id: r.ids for r in final} == {i: lib.encode(t) for i, t in texts.items()}
    assert all(r.exact and r.n_tokens == len(r.ids) for r in final)
    # All at once.
    whole = corpus_pipeline.run(spark, WHERE)
    assert as_rows(whole) == sorted(map(tuple, final), key=str)


def test_stages_on_odd_rows(spark, tmp_path):
    r = random.Random(1)
    text = lambda n: " ".join(r.choices(["alpha", "beta", "gamma", "delta", "né"], k=n))
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, text(60), "en", "s", 1), (3, text(5000), None, "s", 2), (3, text(30), "en", None, 3)]
    rows += [rows[3], rows[2]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (2, "not in there at all")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for k, (_, stage) in enumerate(STAGES):
        out = stage(spark, df, str(tmp_path))
        assert out.count() <= len(rows) and stage(spark, df.where("false"), str(tmp_path)).count() == 0
        if k < 4:
            assert out.columns == df.columns and {(x.doc_id, x.lang) for x in out.collect()} >= {(1, None), (2, "en"), (None, "en"), (3, None)}


def test_last_stage_gives_the_bytes_of_every_piece(spark):
    docs = spark.read.parquet(f"{WHERE}/documents.parquet").limit(60)
    texts = {r.doc_id: r.text for r in docs.collect()}
    lib = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path("piece_bpe_32k.model"))
    rows = [r for r in STAGES[4][1](spark, docs, WHERE).collect() if r.doc_id in texts]
    assert rows
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert len(r.begins) == len(r.ends) == len(r.ids) and (not r.ends or r.ends[-1] == len(raw))
        for k, (low, high, i) in enumerate(zip(r.begins, r.ends, r.ids)):
            piece = lib.id_to_piece(i).replace("▁", " ")
            if not piece.startswith("<0x"):
                assert raw[low:high].decode().replace("▁", " ") in (piece, piece[1:] if k == 0 else piece)


def test_grams_of_short_texts_are_their_words():
    assert grams("a b") == {("a", "b")}
