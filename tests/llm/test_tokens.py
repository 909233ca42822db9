import random
import re

import numpy as np
import pytest

from urlflow.llm import tokens
from urlflow.llm.tokens import encode, encoding


@pytest.mark.parametrize("text", [" " * 5_000_000, "\n" * 5_000_000, " \n\t" * 2_000_000, "a" + " " * 3_000_000 + "b", "x" * 3_000_000, "é" * 2_000_000])
def test_very_long_runs_come_back(text):
    assert encoding().decode(encode(text).tolist()) == text


def test_cutting_white_space_out_gives_the_same_ids(monkeypatch):
    monkeypatch.setattr(tokens, "_LONG_SPACE", re.compile(tokens._LONG_SPACE.pattern.replace("10000", "2")))
    rng = random.Random(1)
    signs = [" ", "  ", "\n", "\t", "\x85", "\xa0", "\u2003", "\x1c", "\u3000", "a", "it's", "9", "!", "é", "'s", "'"]
    for _ in range(40):
        text = "".join(rng.choices(signs, k=10_000))
        assert np.array_equal(encode(text), np.array(encoding().encode_ordinary(text)))
