"""Recall of the entropy scan for random keys, by alphabet and length."""

import random
import re
import string

import pytest

from opsweave.llm import secrets

LOWER, UPPER, DIGITS = string.ascii_lowercase, string.ascii_uppercase, string.digits
COMPILED = [(re.compile(c.pattern), c.alphabet) for c in secrets.CLASSES]


def spans(text):
    return secrets.entropy_spans(text, COMPILED, secrets.WINDOW, re.compile("|".join(f"(?:{a})" for a in secrets.ALLOW)))


@pytest.mark.parametrize("alphabet", [DIGITS + "abcdef", UPPER + "234567", LOWER + DIGITS, UPPER + DIGITS, UPPER + LOWER, UPPER + LOWER + DIGITS, UPPER + LOWER + DIGITS + "+/", UPPER + LOWER + DIGITS + "-_"])
@pytest.mark.parametrize("length", [16, 20, 24, 32, 40])
def test_random_keys_are_found(alphabet, length):
    rng = random.Random(11)
    keys = ["".join(rng.choice(alphabet) for _ in range(length)) for _ in range(1000)]
    assert sum(not spans(f"key {k} end") for k in keys) <= 30


@pytest.mark.parametrize("word", ["internationalization", "Internationalization", "1234567890123456789", "2020-01-15_12345678", "a" * 40, "Aa1" * 20, "some_module/with-words"])
def test_words_are_no_keys(word):
    assert not spans(f"see {word} here")
