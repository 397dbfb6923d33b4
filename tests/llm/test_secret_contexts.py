"""Values that a cheap one before them would hide."""

from __future__ import annotations

import math
import random

import pytest

from ledgerflow.llm import secret_scan

KEY = "9fQ2zK7xWm4Lp8Rt1Vb6"


@pytest.mark.parametrize(
    "text",
    [f"token: Bearer {KEY}", f"auth: bearer {KEY}", f"auth=Basic {KEY}", f'"api_key": "Bearer {KEY}"', f"https://{'u' * 65}:{KEY}@host/", f"password: secret: {KEY}", f"pwd: bearer {KEY[:9]}"],
)
def test_no_value_hides_the_next(text):
    key = KEY if KEY in text else KEY[:9]
    spans = [(a, e) for a, k, e in secret_scan.scan(text)[0] if k == 3]
    assert spans == [(text.index(key), text.index(key) + len(key))]
    assert key not in secret_scan.redact(text)


def test_cheap_values_stay():
    for text in ("token: Bearer password", "password: token: qwerty", "auth: basic 123456"):
        assert not secret_scan.scan(text)[0] and secret_scan.redact(text) == text


@pytest.mark.parametrize("n", [64, 65, 192, 9_000])
def test_a_long_value_is_one_value(n):
    assert secret_scan.guess_cost("z" * n) == pytest.approx(math.log10(26) + math.log10(n))
    assert not secret_scan.scan("pwd:" + "z" * n)[0]


def test_costs_are_not_capped():
    rng = random.Random(4)
    value = "".join(rng.choice("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(2_000))
    assert secret_scan.guess_cost(value) > 1_000
