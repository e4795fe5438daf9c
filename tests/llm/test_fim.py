"""Fill-in-the-middle against plain slicing."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlens.llm import fim


def plain_output(key, text, seed=1, plain=10, spm=20, unit=None):
    """(units, form, prefix, middle, output) by slicing."""
    text = text or ""
    h = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(h[8 * i : 8 * i + 8], 16) for i in range(4))
    units = list(text) if unit is None else [u for u in re.split(f"({unit})", text) if u]
    n = len(units)
    if not text or c % 100 >= 100 - plain or any(s in text for s in fim.SENTINELS):
        return n, "plain", None, None, text
    i, j = sorted((a % (n + 1), b % (n + 1)))
    x, y, z = "".join(units[:i]), "".join(units[i:j]), "".join(units[j:])
    if d % 100 < spm:
        return n, "spm", len(x), len(y), f"<S>{z}<P>{x}<M>{y}"
    return n, "psm", len(x), len(y), f"<P>{x}<S>{z}<M>{y}"


@pytest.mark.parametrize("size", [0, 1, 2, 16, 33, 500, 70_000])
@pytest.mark.parametrize("fan", [2, 16])
def test_ranks(size, fan):
    rng = np.random.default_rng(size)
    widths = rng.integers(1, 9, size=size).astype(np.uint8)
    units = fim.SkipList(widths, np.random.default_rng(1), fan)
    starts = np.concatenate([[0], np.cumsum(widths, dtype=np.int64)])
    for rank in {0, size, size // 2, *rng.integers(0, size + 1, 300).tolist()}:
        assert units.start_of(rank) == starts[rank]
    assert size < 33 or len(units.lanes) > 1
    for _, points, below in units.lanes:
        assert int(points.sum(dtype=np.int64)) == starts[-1]
    with pytest.raises(IndexError):
        units.start_of(size + 1)


TEXTS = [None, "", "x", "été 🤦🏼‍♂️ ende", "a <P> b", "a <S b", "<", "<<P", "日本語 text\n\nmore", "word " * 40_000, "same", "same"]


@pytest.mark.parametrize("unit", [None, r"\w+"])
def test_parts(spark, unit):
    rng = random.Random(3)
    rows = [(i, t, "clash", i) for i, t in enumerate(TEXTS)] + [(None, "no key at all", "c", 1)] * 2
    rows += [(100 + i, "".join(rng.choice("aé日🤦 <PSM>") for _ in range(rng.randint(1, 60))), "c", 0) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fim string, __draw0 long").repartition(3)
    got = fim.fill_in_middle(df, unit=unit).withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"))).collect()
    assert len(got) == len(rows)
    wanted = sorted([(str(k), t, plain_output(k, t, unit=unit)) for k, t, _, _ in rows], key=repr)
    assert sorted([(str(r["doc_id"]), r["text"], tuple(r["fim"])) for r in got], key=repr) == wanted
    assert all(r["back"] == (r["text"] or "") for r in got)
    assert {r["fim"]["form"] for r in got} == {"plain", "psm", "spm"}


def test_other_sentinels(spark):
    df = spark.createDataFrame([(i, "a(b)c.d*" * i) for i in range(50)], "doc_id long, text string")
    marks = ("(pre)", "[suf]", ".mid*")
    got = fim.fill_in_middle(df, sentinels=marks, plain_percent=0, spm_percent=50, seed=9)
    got = got.withColumn("back", fim.restored(F.col("fim.output"), F.col("fim.form"), marks)).collect()
    assert all(r["back"] == r["text"] for r in got) and {r["fim"]["form"] for r in got[1:]} == {"psm", "spm"}
    for bad in (("<P>", "<P>", "<M>"), ("<P>", "", "<M>"), ("<P>", "x<P>", "<M>"), ("aa", "b", "c"), ("ab", "bc", "d")):
        with pytest.raises(ValueError):
            fim.fill_in_middle(df, sentinels=bad)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert fim.fill_in_middle(df).count() == 0
