"""Vectors of a batch are made at once, and are those of one at a time."""

import numpy as np
import pytest

from casebrook.plans import stand_ins
from casebrook.sources import inference


@pytest.mark.parametrize("dim", [0, 1, 5, 8, 26, 129, 700])
def test_vectors_of_a_batch_are_those_of_single_ones(monkeypatch, dim):
    rng = np.random.default_rng(dim)
    vectors = (rng.normal(size=(60, dim)) * np.exp2(rng.integers(-40, 40, 60))[:, None]).tolist()
    vectors[3] = [0.0] * dim
    vectors[7] = vectors[9] = None
    expected = [None if v is None else inference._unit(v) for v in vectors]
    if dim:
        monkeypatch.setattr(inference, "_unit", None)  # not one by one
    made = inference._units(vectors)
    for got, wanted in zip(made, expected, strict=True):
        assert (got is None) == (wanted is None)
        assert wanted is None or (got.dtype == wanted.dtype and got.tobytes() == wanted.tobytes())


def test_vectors_of_different_lengths_and_none_at_all():
    made = inference._units([[3.0, 4.0], None, [2.0], []])
    assert [None if v is None else v.tolist() for v in made] == [pytest.approx([0.6, 0.8]), None, [1.0], []]
    assert inference._units([]) == [] and inference._units([None]) == [None]


def test_letters_are_counted_in_any_text():
    texts = ["", "abcabz", "ABC {|}` \x00\x7f", "naïve Œuvre ñ 東京 😀 zz", "\ud800a", "Ωab" * 300]
    assert stand_ins.letter_counts(texts) == [
        [float(text.count(letter)) for letter in stand_ins.LETTERS] for text in texts
    ]
