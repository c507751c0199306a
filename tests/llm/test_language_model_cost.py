"""What keeps training and scoring cheap, and that it changes no result."""

import numpy as np
import pytest

from fixatlas.llm import attention, language_model
from fixatlas.llm.queries import tokenizer_path
from fixatlas.llm.ragged import slice_hashes

PATH = tokenizer_path("byte_bpe_multi_50k.tiktoken")


def small(window=8):
    rng = np.random.default_rng(2)
    pairs = rng.random((64, 64)) * 20
    order = rng.permutation(64)
    return attention.start(pairs[order][:, order], width=6, window=window), rng


def test_start_is_in_c_order():
    p, _ = small()
    assert all(v.flags.c_contiguous for v in p.values())


@pytest.mark.parametrize("scale", [1, 40_000])
def test_quick_gradients_are_the_careful_ones(scale):
    p, rng = small()
    p = {k: v.astype(np.float64) for k, v in p.items()}
    p["out"] *= scale  # beyond the range of plain exponentials
    ids, target, counts = rng.integers(0, 64, (5, 8)), rng.integers(0, 64, (5, 8)), rng.random((5, 8)) > 0.3
    loss, g = attention.loss_and_gradients(p, ids, target, counts)
    want, by_care = attention._careful_gradients(p, ids, target, counts)
    assert abs(loss - want) < 1e-6 * abs(want) and set(g) == set(by_care)
    assert all(np.allclose(g[k], by_care[k], rtol=1e-5, atol=1e-7) for k in g)


def test_no_target_at_all_changes_nothing():
    p, _ = small()
    loss, g = attention.loss_and_gradients(p, np.zeros((2, 8), int), np.zeros((2, 8), int), np.zeros((2, 8), bool))
    assert loss == 0 and all(not v.any() for v in g.values())


def test_every_window_is_in_one_step_and_many_windows_take_few_steps(monkeypatch):
    p, _ = small()
    windows = np.arange(12_810)[:, None] % 64 + np.zeros((1, 9), int)
    seen = []
    monkeypatch.setattr(
        attention, "loss_and_gradients",
        lambda p, ids, target, counts: (seen.append(ids[:, 0]), (0.0, {k: np.zeros_like(v) for k, v in p.items()}))[1],
    )
    attention.train(p, windows)
    assert len(seen) <= 101  # 401 before
    assert np.array_equal(np.sort(np.concatenate(seen)), np.sort(windows[:, 0]))


def test_words_of_earlier_blocks_are_looked_up(monkeypatch):
    language_model._subwords.cache_clear()
    encode = language_model._subwords(PATH)

    def ids_of(text):
        data = np.frombuffer(text.encode(), np.uint8)
        ends = np.append(np.flatnonzero(data == 32), len(data))
        starts = np.append(0, ends[:-1] + 1)
        hashes, first = np.unique(slice_hashes(data, starts, ends), return_index=True)
        ids, bounds = encode(hashes, data, starts[first], ends[first])
        return {text.split(" ")[f]: ids[a:b].tolist() for f, a, b in zip(first, bounds, bounds[1:])}

    import base64

    import tiktoken

    with open(PATH, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    plain = tiktoken.Encoding("plain", pat_str=r"[^\n]+", mergeable_ranks=ranks, special_tokens={})
    for text in ("the cat é x sat", "a zebra sat the \x00\x1f", "the cat", "q" * 500 + " cat new"):
        assert ids_of(text) == {w: plain.encode_ordinary(" " + w) for w in text.split(" ")}
    monkeypatch.setattr(language_model, "KNOWN", 2)  # all are forgotten, and learnt again
    assert ids_of("cat dog") == {w: plain.encode_ordinary(" " + w) for w in ("cat", "dog")}
    language_model._subwords.cache_clear()
