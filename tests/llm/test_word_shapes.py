"""Shapes of plain words are told without patterns and equal those that patterns give."""

import random

from renewlake.llm import quality as Q


def by_patterns(word):
    return Q.REPEATS.sub(r"\1", Q.DIGITS.sub("9", Q.LETTERS.sub(lambda found: Q._letters(found[0]), word)))


def test_plain_words_need_no_pattern(monkeypatch):
    class Never:
        def sub(self, *given):
            raise AssertionError("a pattern ran")

    for name in ("LETTERS", "DIGITS", "REPEATS"):
        monkeypatch.setattr(Q, name, Never())
    words = {"word": "a", "Word,": "m,", "WORD": "A", "wORd": "x", "2024.": "9.", "été_": "a_"}
    assert {w: Q.word_shape(w) for w in words} == words


def test_shapes_equal_those_of_patterns():
    draw, signs = random.Random(3), "abABßéÉİǅ中ªʰ19٣²½Ⅷ_,..--́\U0001f600"
    words = ["".join(draw.choices(signs, k=draw.randint(1, 6))) for _ in range(20_000)]
    assert all(Q.word_shape(w) == by_patterns(w) for w in words)
