"""The language model against counting, step by step evaluation, numeric gradients and a language with rules."""

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from loginlens.llm import lm, queries

WORD = re.compile("[^\x20\x09-\x0d]+")


def plain_tokens(text):
    lowered = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return [w.encode() for w in WORD.findall(lowered)] + [b""]


def small_network(k=30, seed=1, others=7.0):
    counts = np.sort(np.random.default_rng(seed).integers(1, 90, size=k))[::-1].astype(np.float64)
    net = lm.Network(counts, others, lm.class_bounds(counts, 5), 6, 4, seed)
    rng = np.random.default_rng(seed)
    net.w = {n: x.astype(np.float64) + rng.normal(scale=0.2, size=x.shape) for n, x in net.w.items()}
    return net


def step_by_step(net, ids, end):
    """The sum of the logarithms, one token at a time, with plain formulas."""
    w, H = net.w, net.h
    h, total, last = np.zeros(H), 0.0, end
    for i in ids:
        a, u = w["e"][last] @ w["w"] + w["b"], h @ w["u"]
        z, r = (1 / (1 + np.exp(-(a[j : j + H] + u[j : j + H]))) for j in (0, H))
        n = np.tanh(a[2 * H :] + r * u[2 * H :])
        h = (1 - z) * n + z * h
        p = np.exp(h @ w["wc"] + w["bc"])
        c = net.class_of[i]
        total += math.log(p[c] / p.sum())
        if c < len(net.bounds) - 1:
            q = np.exp(w["wo"][net.bounds[c] : net.bounds[c + 1]] @ h + w["bo"][net.bounds[c] : net.bounds[c + 1]])
            total += math.log(q[i - net.bounds[c]] / q.sum())
        last = i
    return total


def streams(documents, end, cut=5):
    for n, ids in enumerate(documents):
        ids = np.array(ids, dtype=np.int64)
        yield lm.Stream(iter([ids[i : i + cut] for i in range(0, len(ids), cut)]), end, n)


@pytest.mark.parametrize("slots,size", [(1, 1), (3, 4), (64, 20)])
def test_windows_carry_the_state(slots, size):
    net, rng = small_network(), random.Random(2)
    documents = [[rng.randint(0, 30) for _ in range(rng.choice([1, 2, 7, 40, 161]))] for _ in range(25)]
    got = {s.row: s.total for s in lm.score_streams(net, streams(documents, 3), slots, size)}
    assert sorted(got) == list(range(25))
    for n, ids in enumerate(documents):
        assert got[n] == pytest.approx(step_by_step(net, ids, 3), rel=1e-4)
    assert list(lm.score_streams(net, iter(()), slots, size)) == []


def test_probabilities_sum_to_one():
    net = small_network()
    states = np.random.default_rng(3).normal(size=(1, 4))
    logs = [net.log_probabilities(states, np.array([i]))[0][0] for i in range(31)]
    assert sum(map(math.exp, logs)) == pytest.approx(1)
    assert sorted(np.concatenate([np.arange(a, b) for a, b in zip(net.bounds, net.bounds[1:])])) == list(range(30))


def test_gradients():
    net, rng = small_network(), np.random.default_rng(5)
    inputs, targets = rng.integers(0, 31, size=(6, 3)), rng.integers(0, 31, size=(6, 3))
    used, h = rng.random((6, 3)) < 0.8, rng.normal(size=(3, 4))
    _, found, _ = net.gradients(inputs, targets, used, h)
    dense = {n: np.zeros_like(x) for n, x in net.w.items()} | {n: found[n] for n in ("w", "u", "b", "wc", "bc")}
    dense["e"][found["e"][0]] = found["e"][1]
    for a, b, g, gb in found["words"]:
        dense["wo"][a:b], dense["bo"][a:b] = g, gb

    def loss():
        states = net.states(inputs, h)
        return -net.log_probabilities(states[used], targets[used])[0].mean()

    for name, x in net.w.items():
        for _ in range(12):
            at = tuple(rng.integers(0, s) for s in x.shape)
            old, slopes = x[at], []
            for e in (1e-5, -1e-5):
                x[at] = old + e
                slopes.append(loss() / (2 * e))
            x[at] = old
            assert dense[name][at] == pytest.approx(sum(slopes), rel=1e-5, abs=1e-8), name


def ruled_text(rng):
    """Sentences in which the first word rules the last one; word counts alone tell nothing of it."""
    out = []
    for _ in range(rng.randint(3, 30)):
        i = rng.randint(0, 9)
        out += [f"Head{i}", rng.choice(["and", "or"]), f"tail{i}", "."]
    return " ".join(out)


ODD = [None, "", " \n\t", "WORD word\x0bÉcole École", "rare" + "x" * 3_000, "never seen again", "dup dup", "dup dup", "word " * 9_000]


@pytest.fixture(scope="module")
def corpus(spark):
    rng = random.Random(7)
    rows = [(i, ruled_text(rng), "x", 1.5) for i in range(1500)] + [(2000 + i, t, "y", 2.5) for i, t in enumerate(ODD)] + [(None, "no key", "z", 0.0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lm string, id double").repartition(3)
    return rows, df


def plain_base(rows):
    trains = lambda i: zlib.crc32(("" if i is None else str(i)).encode()) % 7 != 2
    counts = collections.Counter(t for i, text, *_ in rows if trains(i) for t in plain_tokens(text))
    n, v = sum(counts.values()), len(counts)
    out = []
    for i, text, *_ in rows:
        tokens = plain_tokens(text)
        out.append((i, len(tokens), sum(counts[t] > 0 for t in tokens), sum(math.log10((counts[t] + 1) / (n + v + 1)) for t in tokens)))
    return n, v, out


@pytest.mark.parametrize("words,looked_up", [(8192, 1 << 18), (20, 25), (3, 1)])
def test_counts_and_learning(spark, corpus, words, looked_up, monkeypatch):
    rows, df = corpus
    monkeypatch.setattr(lm, "PIECE", 1000)
    monkeypatch.setattr(lm, "COUNTED", 7)
    model = lm.fit(df.filter(~lm.held_out(F.col("doc_id"))), words=words, looked_up=looked_up, share=1, rounds=2)
    got = lm.score(df, model).withColumn("out", lm.held_out(F.col("doc_id"))).collect()
    n, v, wanted = plain_base(rows)
    assert (model.train_tokens, model.different) == (n, v) and lm.END in model.tokens[: model.words]
    assert set(got[0].asDict()) == {"doc_id", "text", "id", "lm", "out"}
    by_id = lambda r: repr(r[:3])
    found = sorted([(r["doc_id"], r["lm"]["n_tokens"], r["lm"]["n_known"], r["lm"]["base"]) for r in got], key=by_id)
    for a, b in zip(found, sorted(wanted, key=by_id), strict=True):
        assert a[:3] == b[:3] and a[3] == pytest.approx(b[3], rel=1e-9)
    assert all(r["out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 7 == 2) for r in got if r["doc_id"] is not None)
    held = [r["lm"] for r in got if r["out"] and r["doc_id"] < 1500]
    assert all(math.isfinite(r["lm"]["score"]) and r["lm"]["score"] < 0 for r in got)
    if words > 100:
        gain = sum(r["score"] - r["base"] for r in held) / sum(r["n_tokens"] for r in held)
        assert len(held) > 150 and gain > 0.25


def test_the_network_learns_from_every_document(spark, monkeypatch):
    rows = [(i, f"w{i} " * (1 + i % 5)) for i in range(200)] + [(None, None), (None, None)]
    trained = []

    def counted(network, part, squares, *others):
        trained.extend(len(r["ids"]) for r in part.collect())
        return squares

    monkeypatch.setattr(lm, "_train_round", counted)
    model = lm.fit(spark.createDataFrame(rows, "doc_id long, text string"))
    assert len(trained) == len(rows) and sum(trained) == model.train_tokens


def test_nothing_to_learn_from(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    model = lm.fit(empty)
    assert lm.score(empty, model).count() == 0
    got = lm.score(spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    assert [tuple(r["lm"]) for r in got] == [(3, 0, 0.0, 0.0), (1, 0, 0.0, 0.0)]


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n, _, wanted = plain_base(rows)
    got = {r["doc_id"]: r for r in queries.op13_language_model(spark, sf).collect()}
    assert len(got) == len(rows)
    for i, tokens, known, base in wanted:
        assert (got[i]["n_tokens"], got[i]["n_known"], got[i]["train_tokens"]) == (tokens, known, n)
        assert got[i]["base_score"] == pytest.approx(base, rel=1e-9)
    held = [r for r in got.values() if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
