"""What a Python worker keeps between queries: one encoder, which queries with one vocabulary share; and what the encoder works on at a time."""

import weakref

import numpy as np
import pyarrow as pa
import pytest

from millrace.llm import sentencepiece_viterbi as S


def vocabulary(pieces):
    return S.Vocabulary([(p, -1.0 * k, k) for k, p in enumerate(pieces)], {}, 99)


def test_the_former_encoder_goes_before_the_next_is_made(monkeypatch):
    monkeypatch.setattr(S, "_WORKER", [])
    former = weakref.ref(S._encoder("a", lambda: vocabulary(["a", "b"])))
    assert former() is not None

    def other():
        assert former() is None
        return vocabulary(["a", "c"])

    assert S._encoder("b", other) is not None
    assert len(S._WORKER) == 1


def test_equal_vocabularies_have_one_key():
    assert vocabulary(["a", "b"]).digest() == vocabulary(["a", "b"]).digest() != vocabulary(["a", "c"]).digest()


def test_table_of_many_keys():
    rng = np.random.default_rng(7)
    keys = np.unique(np.concatenate([np.arange(3000), rng.integers(0, 1 << 45, 5000)]))
    values = rng.integers(1, 1 << 40, len(keys))
    asked = np.concatenate([keys, keys + 1, rng.integers(0, 1 << 45, 5000)])
    want = dict(zip(keys.tolist(), values.tolist(), strict=True))
    for n in (0, 1, len(keys)):  # one size holds many keys that meet in one place
        table = S._Table(keys[:n], values[:n])
        assert table(asked).tolist() == [want[k] if k in want and k in keys[:n] else 0 for k in asked.tolist()]


@pytest.mark.parametrize("most", [1, 40, 1 << 20])
def test_each_different_stretch_is_searched_once_a_few_at_a_time(most):
    v = S.Vocabulary([(S.MARK, -3.0, 0), ("a", -2.0, 1), ("é", -2.0, 2), (S.MARK + "a", -2.5, 3), ("aé", -3.0, 4)], {}, 99)
    encoder, given = S.Encoder(v, most=most), []
    search = encoder.search.side_by_side
    encoder.search.side_by_side = lambda chars, sizes: given.append(sizes.tolist()) or search(chars, sizes)
    texts = ["a aé éé ", None, "", "a aé b" + " a" * 500, "日 aé" * 50]
    ids, sizes = encoder.encode(pa.array(texts, pa.string()))
    assert sum(map(len, given)) == len({x for t in texts if t for x in encoder._cut(pa.array([t]))[0].to_pylist()})
    assert all(len(g) == 1 or sum(g) <= most for g in given)
    assert [x.tolist() for x in np.split(ids, np.cumsum(sizes))[:-1]] == [encoder.search([S.MARK + t.replace(" ", S.MARK)])[0].tolist() if t else [] for t in texts]
