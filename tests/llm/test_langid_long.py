"""Operator 3 scores the whole of a long run of letters."""

import numpy as np
import pytest

pytest.importorskip("tidemark.llm")


def test_letters_after_the_64th_count():
    from tidemark.llm.langid import fit

    model = fit([("the cat and the dog with this house", "en"), ("der hund und die katze mit diesem haus", "de")] * 3)
    a = "thecatandthedogwiththishouse" * 3
    s = model.score_words([a, a + "derhundunddiekatzemitdiesemhaus" * 9])
    assert s[0].argmax() != s[1].argmax() and not np.allclose(s[0], s[1])
