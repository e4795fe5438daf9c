"""Fixed patterns against their plain expressions, and the time that very long words take."""

import random
import re
import time

import pytest

from loginlens.llm import pii

PLAIN = [
    re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    re.compile(r"[0-9]([\x20-]?[0-9])+"),
    re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
]


def digits_of(s):
    return [int(c) for c in s if c in "0123456789"]


def passes(kind, s):
    d = digits_of(s)
    if kind == 1:
        return all(int(p) <= 255 for p in s.split("."))
    if kind == 2:
        doubled = [x if i % 2 == 0 else sum(divmod(2 * x, 10)) for i, x in enumerate(reversed(d))]
        return 12 <= len(d) <= 19 and sum(doubled) % 10 == 0
    return 9 <= len(d) <= 15 if kind == 3 else True


def plain_spans(text):
    return sorted((m.start(), k, m.end()) for k, p in enumerate(PLAIN) for m in p.finditer(text) if passes(k, m[0]))


@pytest.mark.parametrize("alphabet", ["a@.", "ab@.-+% é", "019.", "0 -149+().", "a@.1+ -(", "@.a1"])
def test_base_spans_equal_the_expressions(alphabet):
    rng = random.Random(alphabet)
    for _ in range(3000):
        text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == plain_spans(text), text
    card = "4111 1111-1111 1111"
    assert pii.base_spans(f"{card}x1.2.3.4.5.6.7.8 a@b.c@d.e") == plain_spans(f"{card}x1.2.3.4.5.6.7.8 a@b.c@d.e") != []


MILLION = 1_000_000


@pytest.mark.parametrize(
    "text",
    ["a" * MILLION + " dot", "a" * MILLION + " x@", "a" * MILLION + "@" + "b" * MILLION, "7" * MILLION, "7" * MILLION + " at x dot @+", "+" + "1 " * (MILLION // 2) + "x"]
    + ["at-" * (MILLION // 3) + " dot", "a@" * (MILLION // 2), "at " * (MILLION // 3) + "dot", "1." * (MILLION // 2), "[at]" * (MILLION // 4), "a.@b" * (MILLION // 4)],
    ids=lambda t: f"{t[:6]}..{t[-6:]}",
)
def test_long_words_take_little_time(text):
    start = time.perf_counter()
    pii.base_spans(text)
    pii.stretches(text)
    # Two seconds on a quiet machine.
    assert time.perf_counter() - start < 6
