"""Texts without spaces: long words searched alone give what the library and the joint search give, in little time."""

import random
import time

import numpy as np

from loomfact.llm import pieces
from loomfact.llm.tokens import vocabulary


def words():
    rng = random.Random(5)
    syllables = ["tion", "the", "aa", "a", "é", "ß", "日", "本", "語", "中文", "1", "99", ".", "—", "😀", "q", "zx", "ing", "Ⅷ", "\x07"]
    out = ["".join(rng.choices(syllables, k=rng.randrange(20, 200))) for _ in range(150)]
    return out + ["a" * 500, "ab" * 300, "é" * 77, "!" * 100]


def test_long_words_equal_the_library():
    model = pieces.pieces(vocabulary("piece_bpe_32k.model"))
    for w in words():
        got = np.frombuffer(model._long(pieces.MARK + w), "<u4").tolist()
        assert got == model.lib.encode(w), w


def test_long_words_equal_the_joint_search_with_scores():
    model = pieces.Pieces(vocabulary("piece_bpe_32k.model"))
    model.merges = False
    for w in (pieces.MARK + x for x in words()[:40]):
        assert model._long(w) == model._equal([w], len(w))[0], w


def test_a_text_without_spaces_takes_little_time():
    model = pieces.pieces(vocabulary("piece_bpe_32k.model"))
    text = "".join(random.Random(1).choices("日本語中文字漢学生abcdetion", k=20_000))
    began = time.process_time()
    got = model._long(pieces.MARK + text)
    assert time.process_time() - began < 2.5
    assert np.frombuffer(got, "<u4").tolist() == model.lib.encode(text)
