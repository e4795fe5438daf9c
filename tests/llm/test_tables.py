"""Vectors, archives, graphs, the registered queries and the pipeline on small tables."""

import collections
import hashlib
import random
import struct

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loginlens.llm import ann, graph, queries, warc

SF = "/root/testdata/sf0.001"


# Graph


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 300), rng.randint(0, 300)) for _ in range(200)] + [(1000, i) for i in range(1001, 1200)] + [(i, i + 1) for i in range(2000, 2060)]
    edges += [(5, 5), (None, 3), (1000, 1001)]
    parent = {}

    def root(i):
        while parent.setdefault(i, i) != i:
            i = parent[i]
        return i

    for a, b in edges:
        if a is not None and a != b:
            a, b = root(a), root(b)
            parent[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: root(n) for n in list(parent)}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


# Vectors


def exact(ids, vectors, k):
    out = {}
    for i, v in zip(ids, vectors):
        scores = sorted((-float(np.dot(v, w)), j) for j, w in zip(ids, vectors) if j != i)
        out[i] = [j for _, j in scores[:k]]
    return out


def test_neighbours(spark):
    rng = np.random.default_rng(1)
    vectors = rng.normal(size=(1500, 16)) * rng.uniform(0.5, 2.0, size=(1500, 1))
    vectors[100:160] = vectors[100]
    rows = [(i, [float(x) for x in v], "l") for i, v in enumerate(vectors)]
    bad = [(2000, None, "l"), (2001, [0.0] * 16, "l"), (2002, [float("nan")] * 16, "l"), (2003, [None] + [1.0] * 15, "l"), (2004, [1.0] * 3, "l"), (None, [1.0] * 16, "l"), (2005, [float("inf")] * 16, "l")]
    df = spark.createDataFrame([*rows, *bad], "vec_id long, embedding array<double>, score string")
    found = collections.defaultdict(list)
    got = ann.nearest_by_inner_product(df, df.filter("vec_id % 10 = 0"), k=20, block_rows=200).orderBy("query_id", "rank").collect()
    for r in got:
        assert r["rank"] == len(found[r["query_id"]]) + 1
        assert abs(r["score"] - float(np.dot(vectors[r["query_id"]], vectors[r["id"]]))) < 1e-9
        found[r["query_id"]].append(r["id"])
    expected = exact(range(1500), vectors, 20)
    assert set(found) == set(range(0, 1500, 10)) and all(len(v) == 20 for v in found.values())
    recall = np.mean([len(set(v) & set(expected[q])) / 20 for q, v in found.items()])
    assert recall >= 0.9
    twins = [j for j in found[120] if 100 <= j < 160]
    assert twins == sorted(twins) and 120 not in twins


def test_ties_at_the_last_place(spark):
    rng = np.random.default_rng(2)
    # All of one length: the query, then 15 better rows, then copies of one vector and rows with equal products.
    rows = [[4.0, 0.0, 0.0, 0.0]] + [[3.0, *x] for x in ([2.0, 1.0, 1.0], [1.0, 2.0, 1.0], [1.0, 1.0, 2.0], [-2.0, 1.0, 1.0], [1.0, -2.0, 1.0])] * 3
    rows += [[2.0, 2.0, 2.0, 2.0]] * 40 + [[2.0, *rng.permutation([a, b, c])] for a in (2.0, -2.0) for b in (2.0, -2.0) for c in (2.0, -2.0)] * 5
    rows += [[0.0, *x] for x in rng.normal(size=(300, 3))]
    ids = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in zip(ids, rows)], "vec_id long, embedding array<double>")
    got = ann.nearest_by_inner_product(df, df.filter(F.col("vec_id") == ids[0]), k=20).orderBy("rank").collect()
    assert [r["id"] for r in got] == exact(ids, np.array(rows), 20)[ids[0]]


def test_few_candidates(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (20, [0.5, 0.5]), (3, [0.0, 2.0])], "vec_id long, embedding array<double>")
    got = ann.nearest_by_inner_product(df, df.filter("vec_id % 20 = 0"), k=20).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["rank"], r["id"]) for r in got] == [(0, 1, 20), (0, 2, 3), (20, 1, 3), (20, 2, 0)]
    assert ann.nearest_by_inner_product(df.limit(0), df).count() == 0
    assert ann.nearest_by_inner_product(df, df.limit(0)).count() == 0


def test_chi_square_quantile():
    drawn = (np.random.default_rng(2).normal(size=(200_000, 8)) ** 2).sum(axis=1)
    assert abs((drawn <= ann.chi_square_quantile(0.95, 8)).mean() - 0.95) < 0.005


# Archives


def pages_in(spark, tmp_path, rows):
    folder = str(tmp_path / "tables")
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    return folder


def test_archives(spark, tmp_path):
    rng = random.Random(6)
    text = lambda n: "".join(rng.choice("abc <>é") for _ in range(n))
    twice, small = text(1500), "short"
    rows = [(i, f"http://x/{i} ü\r\nEvil: 1", text(rng.randint(0, 4000))) for i in range(300)]
    rows += [(300, None, twice), (301, "http://y", twice), (302, "", twice), (303, "u", small), (304, "u", small), (305, "u", None), (306, "u", ""), (307, "u", text(300_000)), (None, "u", twice)]
    got = {r["page_id"]: r for r in queries.op4_warc(spark, pages_in(spark, tmp_path, rows)).collect()}
    assert len(got) == len(rows)
    for key, _, html in rows:
        data = (html or "").encode()
        assert got[key]["payload_bytes"] == len(data) and got[key]["payload_digest"] == hashlib.sha1(data).hexdigest()
        revisit = key in (300, 301)
        assert got[key]["record_type"] == ("revisit" if revisit else "response") and got[key]["refers_to"] == (302 if revisit else None)


def some_records(n=40):
    rng = random.Random(9)
    return [warc.build_record(f"urn:page:{i}", "response", "http://x", (p := rng.randbytes(20) * rng.randint(1, 400)), hashlib.sha1(p).digest(), None) for i in range(n)]


def test_dictionary_frames():
    records = some_records()
    dictionary = warc.train_dictionary([r for r in records for _ in range(4)])
    for d in (dictionary, b""):
        content = warc.build_archive(records, d)
        assert struct.unpack_from("<I", content)[0] == warc.DICTIONARY_FRAME
        read = list(warc.read_archive(content))
        assert [f["record_id"] for _, f in read] == [f"urn:page:{i}" for i in range(len(records))]
    plain = content[8:]  # an archive without a dictionary frame
    assert len(list(warc.read_archive(plain))) == len(records)


@pytest.mark.parametrize(
    "harm",
    [
        lambda c: c[:-3],
        lambda c: c + b"junk-junk-junk",
        lambda c: c[: len(c) // 2] + bytes([c[len(c) // 2] ^ 255]) + c[len(c) // 2 + 1 :],
    ],
)
def test_broken_archives_fail(harm):
    content = warc.build_archive(some_records(3), b"")
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(harm(content)))


@pytest.mark.parametrize(
    "old, new",
    [(b"WARC/1.1", b"WARC/9.9"), (b"WARC-Date", b"X-Date"), (b"Content-Length: ", b"Content-Length: 1"), (b"<html>", b"<HTML>"), (b"\r\n\r\n", b"\n\n")],
)
def test_broken_records_fail(old, new):
    record = warc.build_record("urn:page:1", "response", "http://x", b"<html>text", hashlib.sha1(b"<html>text").digest(), None)
    assert warc.parse_record(record)["payload"] == b"<html>text"
    with pytest.raises(warc.WarcError):
        warc.parse_record(record.replace(old, new))


def test_reading_nothing(spark):
    df = spark.createDataFrame([("a", None), ("b", bytearray())], "archive string, content binary")
    assert warc.read_archives(df).count() == 0


# Registered queries


@pytest.fixture(scope="module")
def results(spark):
    return {}


def run(spark, results, name):
    if name not in results:
        results[name] = queries.QUERIES[name](spark, SF).toPandas()
    return results[name]


CONTRACTS = {
    "op1_simhash": ["doc_id", "fingerprint", "component_id"],
    "op2_stable_projections": ["query_id", "rank", "vec_id", "score"],
    "op3_decontamination": ["doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"],
    "op4_warc": ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"],
    "op5_quality": ["doc_id", "held_out", "score", "predicted"],
    "op6_byte_bpe": ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
    "op7_personal_data": ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
    "op8_line_dedup": ["doc_id", "lines", "lines_removed", "text"],
    "op9_rendezvous": ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"],
    "op10_suffix_array": ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    "op11_fill_in_middle": ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256"],
    "op12_whitening": ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
    "op13_language_model": ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
}


@pytest.mark.parametrize("name", CONTRACTS)
def test_query(spark, results, name):
    rows = run(spark, results, name)
    assert list(rows.columns) == CONTRACTS[name]
    source = {"op4_warc": "pages"}.get(name, "documents")
    if name not in ("op2_stable_projections", "op12_whitening"):
        assert len(rows) == spark.read.parquet(f"{SF}/{source}.parquet").count()


@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_query_against_sql(spark, results, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    expected = con.execute(queries.ORACLES[name]).df()
    found = run(spark, results, name)[list(expected.columns)]
    key = expected.columns[0]
    as_text = lambda df: [tuple(None if v is None or v is pd.NA or v != v else str(int(v)) if isinstance(v, float) else str(v) for v in r) for r in df.sort_values(key).itertuples(index=False)]
    assert as_text(found) == as_text(expected)


def nearly_repeated_lines():
    """Rows of documents, and the texts that are left of them: of every two lines one has up to a fifth of its words changed."""
    rng = random.Random(41)
    rows, left = [], []
    for i, n in enumerate((5, 7, 10, 12, 20, 32)):
        line = [f"word{rng.randrange(10**6)}" for _ in range(n)]
        near, far = list(line), list(line)
        for k, at in enumerate(rng.sample(range(n), n // 5 + 1)):
            far[at] = f"other{i}{k}"
            near[at] = f"new{i}{k}" if k < n // 5 else near[at]
        texts = [" ".join(line), f"{' '.join(near)}\nthe end of text number {i} {i * 7} {i * 11}", " ".join(far)]
        rows += [(10 * i + k, t, "en", "s", len(t)) for k, t in enumerate(texts)]
        left += [(10 * i, texts[0]), (10 * i + 1, texts[1].split("\n")[1]), (10 * i + 2, texts[2])]
    return rows, left


def test_lines_are_compared_by_edits_whatever_their_length(spark, tmp_path):
    """Short lines too lose their near copies, and keep those a word further away."""
    rows, left = nearly_repeated_lines()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    got = queries.op8_line_dedup(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == left


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "near_copies", "decontamination", "tokens"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert i == 4 or docs.columns == columns
        assert 0 < docs.count() <= before
    left = {r["doc_id"]: r["ids_sha256"] for r in docs.collect()}
    assert {r["doc_id"]: r["ids_sha256"] for r in corpus_pipeline.run(spark, SF).collect()} == left


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long"
    rows = [(1, None, None, None, None), (2, "", "en", "s", 0), (None, "some words that are quite fine here", None, "s", 5), (3, "a b c d e f g", "en", "s", 13), (3, "a b c d e f g", "en", "s", 13)]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        for k, part in enumerate((rows, [])):
            out = stage(spark, spark.createDataFrame(part, schema), SF)
            assert out.count() <= len(part)
            assert i == 4 or out.schema.fieldNames() == ["doc_id", "text", "lang", "source", "n_chars"], k
    kept = corpus_pipeline.one_of_near_copies(spark, spark.createDataFrame(rows, schema), SF).select("doc_id").collect()
    assert sorted((r["doc_id"] for r in kept), key=lambda x: (x is None, x)) == [1, 3, None]
    assert F is not None


def test_pipeline_sends_small_batches_to_python(spark):
    import corpus_pipeline
    from loginlens.llm.common import BATCH_BYTES, BATCH_CONF

    docs = spark.createDataFrame([(1, "a b c d", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    for _, stage in corpus_pipeline.STAGES:
        spark.conf.unset(BATCH_CONF)
        stage(spark, docs, SF)
        assert spark.conf.get(BATCH_CONF) == str(BATCH_BYTES)
    sizes = spark.range(0, 1000, 1, 1).select(F.repeat(F.lit("x"), 20_000).alias("text")).mapInArrow(lambda batches: (pa.record_batch([[b.nbytes]], ["n"]) for b in batches), "n long")
    assert max(r["n"] for r in sizes.collect()) < BATCH_BYTES + 100_000


def test_near_copies_without_or_with_equal_ids(spark):
    import corpus_pipeline

    rng = random.Random(15)
    a, b, c, d, e, f, g = (" ".join(f"{rng.choice('abcdefgh')}{rng.randrange(1000)}" for _ in range(40)) for _ in range(7))
    rows = [(None, a), (None, b), (None, b), (None, c), (None, d), (1, d), (2, e), (2, f), (3, f), (4, g), (4, g), (4, a.upper())]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.one_of_near_copies(spark, docs, SF).collect()
    expected = [(None, b), (None, c), (1, d), (2, e), (2, f), (4, g), (4, a.upper())]
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, expected))


def test_pipeline_removes_lines_that_nearly_repeat(spark):
    import corpus_pipeline

    rows, left = nearly_repeated_lines()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.without_repeated_lines(spark, docs, SF).collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == left and all(r["n_chars"] == len(r["text"]) for r in got)
