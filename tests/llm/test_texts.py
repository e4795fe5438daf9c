"""Operators on texts against brute force, with nulls, empty and long texts, repeated rows and clashing columns."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from loginlens.llm import bpe, decontam, lines, pii, quality, shard, simhash, suffix

WORDS = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon".split()


def words(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def frame(spark, texts, ids=None):
    rows = [(i, t, "x") for i, t in zip(ids or range(len(texts)), texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, component string")


# SimHash


def plain_fingerprint(text):
    xxhash = pytest.importorskip("xxhash")
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    shingles = [" ".join(found[i : i + 3]) for i in range(len(found) - 2)] or ([" ".join(found)] if found else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_groups(codes, distance):
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(codes)):
        for j in range(i):
            if (codes[i] ^ codes[j]).bit_count() <= distance:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(codes))]


@pytest.mark.parametrize("text", [None, "", " \t\n", "One", "one two", "One two THREE", "a\x1cb c\x0bd É e", "x " * 500])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_fingerprint_in_parts(monkeypatch):
    text = words(random.Random(1), 500)
    monkeypatch.setattr(simhash, "SHINGLES_AT_ONCE", 7)
    assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize("distance", [0, 1, 2])
@pytest.mark.parametrize("node_rows", [16_384, 3])
def test_links_connect_all_near_codes(spark, distance, node_rows):
    rng = random.Random(distance)
    codes = []
    for _ in range(12):
        code = rng.getrandbits(64)
        codes.append(code)
        for _ in range(rng.randint(0, 12)):
            for b in rng.sample(range(64), rng.randint(0, 3)):
                code ^= 1 << b
            codes.append(code)
    codes = sorted(set(codes))
    signed = [c - (1 << 64) if c >> 63 else c for c in codes]
    links = simhash.link_fingerprints(spark.createDataFrame([(c,) for c in signed], "fp long"), distance, node_rows).collect()
    place = {c: i for i, c in enumerate(signed)}
    parent = list(range(len(codes)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for r in links:
        a, b = root(place[r["a"]]), root(place[r["b"]])
        parent[max(a, b)] = min(a, b)
    expected = plain_groups(codes, distance)
    found = [root(i) for i in range(len(codes))]
    same = lambda g: sorted(tuple(i for i, x in enumerate(g) if x == v) for v in set(g))
    assert same(found) == same(expected)


def test_gray_tree_finds_every_pair():
    rng = np.random.default_rng(3)
    codes = np.unique(rng.integers(0, 1 << 12, 400, dtype=np.uint64))
    index = simhash.GrayIndex(codes)
    q, other = index.near(codes, 2)
    found = {(int(codes[a]), int(index.codes[b])) for a, b in zip(q, other)}
    assert found == {(int(a), int(b)) for a in codes for b in codes if (int(a) ^ int(b)).bit_count() <= 2}


def test_near_duplicates(spark):
    rng = random.Random(2)
    base = words(rng, 900)
    texts = [base, base + " extra", base, None, "", "  ", "one", "ONE", words(rng, 50), "x " * 3000]
    rows = simhash.near_duplicates(frame(spark, texts)).collect()
    codes = [plain_fingerprint(t) for t in texts]
    groups = plain_groups(codes, 2)
    assert {r["key"]: (r["fingerprint"], r["component"]) for r in rows} == {i: (f"{c:016x}", g) for i, (c, g) in enumerate(zip(codes, groups))}
    none = simhash.near_duplicates(frame(spark, ["a b c", "a b c"], [None, 4])).collect()
    assert {(r["key"], r["component"]) for r in none} == {(None, 4), (4, 4)}
    assert simhash.near_duplicates(frame(spark, ["a"]).limit(0)).count() == 0


# Repeated strings


def test_repeated_strings(spark):
    rng = random.Random(5)
    some = lambda n: "".join(rng.choice("abcdé ") for _ in range(n))
    passage, other = some(260), some(230)
    texts = [some(rng.randint(0, 200)) + passage + some(rng.randint(0, 150)) for _ in range(30)]
    texts += [passage, passage, other, None, "", "a" * 500, "x"] + [some(30) + other for _ in range(9)]
    data = [(t or "").encode() for t in texts]
    count = collections.Counter(t[i : i + 200] for t in data for i in range(len(t) - 199))
    for crowd in (500, 6):
        rows = suffix.remove_repeats(frame(spark, texts), anchor_pieces=crowd).collect()
        assert len(rows) == len(texts)
        for r in rows:
            t = data[r["doc_id"]]
            gone = np.zeros(len(t), dtype=bool)
            for i in range(len(t) - 199):
                if count[t[i : i + 200]] > 1:
                    gone[i : i + 200] = True
            assert bytes(r["kept"]) == bytes(np.frombuffer(t, np.uint8)[~gone])
            assert r["n_bytes"] == len(t) and sum(s["end"] - s["start"] for s in r["removed"]) == gone.sum()
    assert suffix.remove_repeats(frame(spark, ["a"]).limit(0)).count() == 0


def test_transform_against_counting():
    rng = random.Random(3)
    for _ in range(40):
        length, symbols = rng.choice([5, 9, 20]), rng.choice([b"ab", b"abc\0", bytes(range(256))])
        base = bytes(rng.choice(symbols) for _ in range(80))
        pieces = []
        for _ in range(rng.randint(1, 8)):
            a = rng.randint(0, 60)
            pieces.append(base[a : a + rng.randint(0, 60)] + bytes(rng.choice(symbols) for _ in range(rng.randint(0, 20))))
        count = collections.Counter(p[i : i + length] for p in pieces for i in range(len(p) - length + 1))
        expected = [[i for i in range(len(p) - length + 1) if count[p[i : i + length]] > 1] for p in pieces]
        assert [x.tolist() for x in suffix.repeated_suffixes(pieces, length)] == expected


def test_long_texts_are_taken_in_parts(spark, monkeypatch):
    monkeypatch.setattr(suffix, "PART_BYTES", 700)
    rng = random.Random(8)
    long = "".join(rng.choice("abcdefgh") for _ in range(5000))
    rows = suffix.remove_repeats(frame(spark, [long, "zz" + long[1000:3000] + "yy"])).orderBy("doc_id").collect()
    assert bytes(rows[0]["kept"]).decode() == long[:1000] + long[3000:]
    assert bytes(rows[1]["kept"]) == b"zzyy"


# Decontamination


def plain_contamination(texts, items):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = collections.defaultdict(set)
    for name, text in items:
        w = cut(text)
        n = min(10, len(w))
        for i in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[i : i + n])].add(name)
    out = []
    for t in texts:
        w, hit, found = cut(t), set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if (names := windows.get(tuple(w[i : i + n]))) is not None:
                    hit |= set(range(i, i + n))
                    found |= names
        out.append((len(w), len(hit), sorted(str(x) for x in found if x is not None)))
    return out


@pytest.mark.parametrize("pass_bytes", [1 << 24, 60])
def test_contamination(spark, pass_bytes):
    rng = random.Random(7)
    items = [(i, words(rng, rng.randint(10, 25))) for i in range(8)]
    items += [(20, "Straße, École!"), (21, "single"), (22, ""), (23, None), (None, "no id here"), (24, items[0][1]), (20, "Straße, École!")]
    texts = [words(rng, 40) + " " + items[i % 8][1].upper() + "." + words(rng, 30) for i in range(12)]
    texts += [None, "", "...", "SINGLE", "une straße école", "x no-id HERE y", words(rng, 3000) + " " + items[3][1], items[0][1].replace(" ", "\n"), texts[0]]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = decontam.find_contamination(frame(spark, texts).withColumn("contamination", F.lit(1)), bench, pass_bytes=pass_bytes).orderBy("doc_id").collect()
    got = [(r["contamination"]["n_words"], sum(s["end"] - s["start"] for s in r["contamination"]["spans"]), r["contamination"]["items"]) for r in rows]
    assert got == plain_contamination(texts, items)
    empty = decontam.find_contamination(frame(spark, texts), bench.limit(0)).agg(F.sum(F.size("contamination.spans"))).first()[0]
    assert empty == 0


# Tokens


@pytest.fixture(scope="module")
def ranks():
    tokenizers = pytest.importorskip("public_tokenizers")
    return bpe.read_ranks(tokenizers.path("byte_bpe_multi_50k.tiktoken")), tokenizers.PATTERN


def test_tokens(spark, ranks):
    tiktoken = pytest.importorskip("tiktoken")
    vocabulary, pattern = ranks
    rng = random.Random(4)
    symbols = "ab \n\t\r\x1c\x1d\x85 　0é½²'’s?!.ñ😀́\x00<unk>"
    texts = ["".join(rng.choice(symbols) for _ in range(rng.randint(0, 150))) for _ in range(300)]
    texts += [None, "", "a" * 5000, " " * 3000, "?", "<|endoftext|>", "it's the they'll we've", "the the"]
    encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=vocabulary, special_tokens={})
    for plain in (None, bpe.PLAIN):
        encoded = bpe.encode(frame(spark, texts), vocabulary, pattern, plain=plain)
        assert [r["ids"] for r in encoded.orderBy("doc_id").collect()] == [encoder.encode_ordinary(t or "") for t in texts]
    decoded = bpe.decode(encoded, vocabulary).orderBy("doc_id").collect()
    assert [bytes(r["decoded"]) for r in decoded] == [(t or "").encode() for t in texts]
    assert decoded[0]["text"] == texts[0] and bpe.encode(frame(spark, texts).limit(0), vocabulary, pattern).count() == 0


def test_remembered_pretokens_are_bounded(ranks):
    vocabulary, _ = ranks
    small = bpe.PretokenEncoder(bpe.serialise_model(vocabulary), vocabulary, remembered=3)
    large = bpe.PretokenEncoder(bpe.serialise_model(vocabulary), vocabulary)
    rows = [["one", " two"], [" three", " four", " five"], ["one"], []]
    assert [small([r])[0] for r in rows] == large(rows)


def test_rank_gaps_fail():
    with pytest.raises(ValueError):
        bpe.serialise_model({b"a": 0, b"b": 2})


# Sharding


def test_shards(spark):
    ids = [*range(400), None, None, 7]
    df = frame(spark, ["t"] * len(ids), ids).withColumn("slot", F.lit("x"))
    weights = [1.0, 2.0, 0.0, 1.0]
    rows = shard.assign_shards(shard.assign_shards(df, "doc_id", weights), "doc_id", [*weights, 1.0], "grown").collect()
    assert all(r["grown"] in (r["shard"], 4) for r in rows)
    sizes = collections.Counter(r["shard"] for r in rows)
    assert sizes[2] == 0 and sizes[1] > max(sizes[0], sizes[3])
    assert len({r["shard"] for r in rows if r["doc_id"] is None}) == 1
    placed = shard.assign_shards(df, "doc_id", [1.0] * 5)
    slots = collections.defaultdict(list)
    for r in shard.number_in_shards(placed, ["doc_id"]).collect():
        slots[r["shard"]].append(r["slot"])
    assert sum(map(len, slots.values())) == len(ids) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert shard.number_in_shards(placed.limit(0), ["doc_id"]).count() == 0
    with pytest.raises(ValueError):
        shard.assign_shards(df, "doc_id", [0.0])


def test_crc(spark):
    row = spark.createDataFrame([("é",)], "t string").select(F.crc32(F.col("t").cast("binary")).alias("c")).first()
    assert row["c"] == zlib.crc32("é".encode())


# Lines


def test_lines(spark):
    rng = random.Random(9)
    line = lambda n=12: words(rng, n)
    shared, near = line(), " ".join(f"{w}{i}" for i, w in enumerate(words(rng, 60).split()))
    changed = near.replace(near.split()[20], "other")
    texts = [
        f"{shared}\n{line()}\nshort one",
        f"{line()}\n{shared.upper()}!!\nshort one",
        f"{near}\n{line()}",
        f"{changed}\n\n{shared}\n{line()}",
        None,
        "",
        "\n\n",
        "page 17 of the long report today",
        "page 23 of the long report today",
        words(rng, 20_000),
    ]
    df = frame(spark, texts).withColumn("lines", F.lit(3))
    got = {r["doc_id"]: r for r in lines.deduplicate_lines(df).collect()}
    assert all(got[i]["text"] == texts[i] for i in (7, 8))
    got = {r["doc_id"]: r for r in lines.deduplicate_lines(df, similarity=0.8, exact=True).collect()}
    assert got[0]["text"] == texts[0] and got[2]["text"] == texts[2] and got[9]["text"] == texts[9]
    assert shared.upper() not in got[1]["text"] and got[1]["text"].endswith("short one") and got[1]["lines_removed"] == 1
    assert shared not in got[3]["text"]
    assert got[4]["text"] is None and got[4]["lines"] == 0 and got[5]["text"] == "" and got[6]["text"] == "\n\n"
    assert got[8]["text"] == "" and got[8]["lines_removed"] == 1
    assert lines.deduplicate_lines(df.limit(0)).count() == 0


def test_line_fingerprints(spark, monkeypatch):
    rng = random.Random(10)
    texts = [words(rng, n) for n in (5, 6, 30, 700)]
    read = lambda: {r["pos"]: r for r in lines.fingerprinted_lines(frame(spark, ["\n".join(texts)]), "doc_id", "text", 5).collect()}
    whole = read()
    for i, t in enumerate(texts):
        of = [int(xxhash.xxh3_128_hexdigest(w.encode()), 16) for w in t.split()]
        code = sum(1 << b for b in range(128) if 2 * sum(h >> b & 1 for h in of) > len(of))
        assert (whole[i]["high"] % (1 << 64), whole[i]["low"] % (1 << 64)) == (code >> 64, code % (1 << 64))
        assert len(whole[i]["words"]) == whole[i]["size"] == len(of)
    monkeypatch.setattr(lines, "COUNTED_WORDS", 16)
    monkeypatch.setattr(lines, "SLICE_BYTES", 1)
    assert read() == whole


def test_lines_do_not_carry_their_document(spark, monkeypatch):
    """A task's memory does not grow with the lines times the bytes of a document."""
    text, df, runs = "\n".join(f"line {i} of a long document" for i in range(3000)), frame(spark, [""]), []
    monkeypatch.setattr(lines, "stored", lambda df, name: df)
    monkeypatch.setattr(type(df), "mapInArrow", lambda self, run, schema: runs.append(run) or self)
    lines.fingerprinted_lines(df, "doc_id", "text", 5)
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array([1]), pa.array([text])], names=["key", "row", "text"])
    usual = pa.default_memory_pool()
    pool = pa.proxy_memory_pool(usual)
    pa.set_memory_pool(pool)
    try:
        assert sum(b.num_rows for b in runs[0](iter([batch]))) == 3000
    finally:
        pa.set_memory_pool(usual)
    assert pool.max_memory() < 40 * len(text)


def test_both_ways_to_split_lines_agree(spark):
    texts = ["One, two;three_four 5\x7f6 x\u00e9y", "\u4e2d\u6587abc \u0e01\u0e02 \U00020001z", "a" * 11, "\n\nword\nfive words are in here\r", "", None]
    a = lines.fingerprinted_lines(frame(spark, texts), "doc_id", "text", 2).select("key", "row", "pos", "size")
    b = lines.worded_lines(frame(spark, texts), "doc_id", "text", 2).select("key", "row", "pos", "size")
    assert sorted(a.collect()) == sorted(b.collect()) and a.count() == 4


def test_repeated_rows_count_once(spark):
    short, long = "one two three", " ".join(f"word{i}" for i in range(200))
    df = frame(spark, [f"{short}\n{long}"])
    once, thrice = lines.fingerprinted_lines(df, "doc_id", "text", 5), lines.fingerprinted_lines(df.union(df).union(df), "doc_id", "text", 5)
    assert once.count() == 2 and sorted(thrice.distinct().collect()) == sorted(once.collect())
    got = lines.deduplicate_lines(df.union(df)).collect()
    assert [(r["text"], r["lines_removed"]) for r in got] == [(f"{short}\n{long}", 0)] * 2


def test_similar_lines_share_a_group(spark):
    rng = random.Random(12)
    base = [f"{rng.choice(WORDS)}{i}" for i in range(200)]
    variants = [" ".join(base)]
    for i in range(25):
        v = list(base)
        v[rng.randrange(200)] = f"changed{i}"
        variants.append(" ".join(v))
    got = lines.deduplicate_lines(frame(spark, variants)).collect()
    assert sum(r["text"] != "" for r in got) == 1 and next(r for r in got if r["doc_id"] == 0)["text"] == variants[0]


def word_edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        above, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            above, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, above + (x != y))
    return row[-1]


@pytest.mark.parametrize("similarity", [0.8, 0.7, 0.9])
def test_all_similar_lines_are_linked(spark, similarity):
    rng = random.Random(14)
    found = []
    for n in [*range(5, 24), 30, 41, 50, 60] * 3:
        line = [f"{rng.choice(WORDS)}{rng.choice('abcdefghij')}" for _ in range(n)]
        found.append(line)
        for share in (0.1, 0.2, 0.25, 0.3):
            changed = list(line)
            for _ in range(max(1, round(share * n))):
                at, what = rng.randrange(len(changed)), rng.randrange(4)
                changed[at : at + 1] = [["new" + rng.choice("abcdefgh")], ["new" + rng.choice("abcdefgh")], [], [changed[at], "more"]][what]
            found.append(changed)
    found = [x for x in {" ".join(x): x for x in found}.values() if len(x) >= 5]
    similar = lambda a, b: abs(len(a) - len(b)) <= 15 and word_edits(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9
    parent = list(range(len(found)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(found)):
        for j in range(i):
            if root(i) != root(j) and similar(found[i], found[j]):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    got = lines.deduplicate_lines(frame(spark, [" ".join(x) for x in found]), similarity=similarity, exact=True).collect()
    assert {r["doc_id"] for r in got if r["text"]} == {root(i) for i in range(len(found))}


def groups_by_comparing(found, similarity):
    """The least line of each group of similar lines, all pairs compared."""
    similar = lambda a, b: abs(len(a) - len(b)) <= (1 - similarity) * max(len(a), len(b)) + 1e-9 and word_edits(a, b) <= (1 - similarity) * max(len(a), len(b)) + 1e-9
    group = list(range(len(found)))
    for i in range(len(found)):
        for j in range(i):
            if group[i] != group[j] and similar(found[i], found[j]):
                least, other = sorted((group[i], group[j]))
                group = [least if g == other else g for g in group]
    return set(group)


@pytest.mark.parametrize("similarity,sizes", [(0.97, [33, 34, 35, 40, 67, 70, 101]), (0.8, [*range(5, 20), 30]), (0.5, [5, 6, 8])])
def test_no_similar_lines_are_missed_by_default(spark, similarity, sizes):
    rng = random.Random(31)
    found = []
    for n in sizes * 3:
        # Some lines are of few different words, so that runs repeat.
        some = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(rng.choice([2, 5, 1000]))]
        line = [rng.choice(some) for _ in range(n)]
        found.append(line)
        for e in range(1, 2 + int((1 - similarity) * (n + 1) + 1e-9)):
            changed = list(line)
            for _ in range(e):
                at, what = rng.randrange(len(changed)), rng.randrange(4)
                changed[at : at + 1] = [[f"new{rng.randrange(8)}"], [f"new{rng.randrange(8)}"], [], [changed[at], "more"]][what]
            found.append(changed)
    found = [x for x in {" ".join(x): x for x in found}.values() if len(x) >= 5]
    rng.shuffle(found)
    got = lines.deduplicate_lines(frame(spark, [" ".join(x) for x in found]), similarity=similarity).collect()
    assert {r["doc_id"] for r in got if r["text"]} == groups_by_comparing(found, similarity)


@pytest.mark.parametrize("n,edits", [(33, 1), (70, 2)])
def test_no_pair_at_the_threshold_is_missed(spark, n, edits):
    rng = random.Random(n)
    rows = []
    for i in range(200):
        line = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
        changed = list(line)
        for at in rng.sample(range(n), edits):
            changed[at] = f"new{rng.randrange(10**6)}"
        if n == 33:
            changed = [*line[:20], "more", *line[20:]]
        rows += [(i, " ".join(line)), (1000 + i, " ".join(changed))]
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("text = ''").collect()
    assert {r["doc_id"] for r in got} == set(range(1000, 1200))


def test_lines_in_passes(spark, monkeypatch):
    rng = random.Random(17)
    base = [[f"{rng.choice(WORDS)}{rng.randrange(50)}" for _ in range(20)] for _ in range(40)]
    texts = [" ".join(x) for x in base] + [" ".join([*x[:i % 17], "other", *x[i % 17 + 3 :]]) for i, x in enumerate(base)]
    monkeypatch.setattr(lines, "PASS_WORDS", 100)
    assert {r["doc_id"] for r in lines.deduplicate_lines(frame(spark, texts), similarity=0.8, exact=True).collect() if r["text"]} == set(range(40))


@pytest.mark.parametrize("n,edits,least", [(34, 1, 0.9), (70, 2, 0.9), (120, 3, 0.9), (70, 1, 0.98), (40, 0, 1.0)])
def test_recall_of_candidates(spark, n, edits, least):
    """Pairs of a line and a changed one, found among lines that have nothing in common with it."""
    rng = random.Random(n)
    pairs = []
    for _ in range(300):
        line = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(n)]
        changed = list(line)
        for at in rng.sample(range(n), edits):
            changed[at] = f"new{rng.randrange(10**6)}"
        pairs.append((" ".join(line), " ".join(changed).upper()))
    rows = [(i, p[0]) for i, p in enumerate(pairs)] + [(1000 + i, p[1]) for i, p in enumerate(pairs)]
    got = lines.deduplicate_lines(spark.createDataFrame(rows, "doc_id long, text string")).filter("lines_removed > 0").collect()
    assert len(got) >= least * len(pairs) and all(r["doc_id"] >= 1000 for r in got)
    assert all(r["lines"] == 1 and r["text"] == "" for r in got)


def test_bits_within_the_stated_distance_are_found(spark):
    """Codes that differ in up to BLOCKS - 1 bits share a key, also where the lengths lie in neighbouring steps."""
    rng = random.Random(3)
    rows = []
    for i in range(300):
        code, size = rng.getrandbits(128), rng.randrange(34, 400)
        changed = code
        for bit in rng.sample(range(128), lines.BLOCKS - 1):
            changed ^= 1 << bit
        rows += [(i, code, size), (i, changed, rng.choice([size, -(-size * 97 // 100)]))]
    signed = lambda c: c - (1 << 64) if c >> 63 else c
    df = spark.createDataFrame([(i, signed(c >> 64), signed(c % (1 << 64)), n) for i, c, n in rows], "i int, high long, low long, size int")
    keys = collections.defaultdict(list)
    for r in df.withColumn("keys", lines.block_keys(0.97)).collect():
        keys[r["i"]].append(set(r["keys"]))
    assert all(a & b for a, b in keys.values())


def test_hot_buckets_of_lines(spark):
    """Many variants of a line, and lines of a second group in the same buckets."""
    rng = random.Random(21)
    base = [f"{rng.choice(WORDS)}{rng.randrange(10**6)}" for _ in range(100)]
    second = [*base[:93], *(f"other{i}" for i in range(7))]
    texts = [" ".join(base), " ".join(second)]
    for of, n in ((base, 300), (second, 5)):
        for i in range(n):
            v = list(of)
            v[rng.randrange(90)] = f"changed{i}"
            texts.append(" ".join(v))
    got = lines.deduplicate_lines(frame(spark, texts)).filter("text != ''").collect()
    assert {r["doc_id"] for r in got} == {0, 1}


def test_short_lines_and_scripts_without_spaces(spark):
    rng = random.Random(16)
    script = lambda first, n: "".join(chr(first + rng.randrange(40)) for _ in range(n))
    chinese, thai, kana = script(0x4E00, 40), script(0x0E01, 40), script(0x3041, 30)
    texts = [
        f"All rights reserved\n{chinese}\nyes\n{thai}",
        f"all rights reserved.\n{chinese[:20]}{chr(0x8000)}{chinese[21:]}\nyes\n{kana}",
        f"all rights granted\n{script(0x4E00, 40)}\n----------------\n{thai[1:]}",
        f"----------------\n{kana[:29]}\n{kana[:15]}",
    ]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(frame(spark, texts), similarity=0.8, exact=True).collect()}
    assert got == {0: texts[0], 1: f"yes\n{kana}", 2: texts[2].rsplit("\n", 1)[0], 3: f"----------------\n{kana[:15]}"}


def test_lines_of_different_figures_stay(spark):
    texts = ["12 34 56 78 90", "98 76 54 32 10", "12, 34, 56, 78, 90", "12 34 56 78 91", "took 17 of 29 in 31", "took 45 of 68 in 99"]
    got = {r["doc_id"]: r["text"] for r in lines.deduplicate_lines(frame(spark, texts), similarity=0.8, exact=True).collect()}
    assert got == {0: texts[0], 1: texts[1], 2: "", 3: "", 4: texts[4], 5: texts[5]}


# Quality


def test_quality(spark):
    rng = random.Random(11)
    texts, labels = [], []
    for i in range(400):
        good = i % 4 != 0
        texts.append(words(rng, 60) if good else " ".join(w.upper() + "$$$" for w in words(rng, 60).split()))
        labels.append((i, int(good)))
    texts += [None, "", "x" * 100_000]
    docs = frame(spark, texts).withColumn("score", F.lit("x"))
    known = spark.createDataFrame([*labels, (None, 1), (5, None), (7, 1), (7, 1)], "doc_id long, quality int")
    model = quality.fit(docs, known)
    scored = quality.add_scores(docs, model).withColumn("held", quality.held_out(F.col("doc_id"))).collect()
    held = [r for r in scored if r["held"] and r["doc_id"] < 400]
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 for r in held) and len(held) > 40
    assert all((r["score"] >= 0.3) == (r["doc_id"] % 4 != 0) for r in held)
    assert all(0 <= r["score"] <= 1 for r in scored) and len(scored) == len(texts)
    nothing = quality.fit(docs, known.limit(0))
    assert len({r["score"] for r in quality.add_scores(docs, nothing).collect()}) == 1
    bounded = quality.labelled_sample(known, "doc_id", "quality", 50).count()
    assert 10 < bounded <= 80


def test_quality_sends_a_kept_text_once(spark, capsys):
    docs = frame(spark, ["some words", None, ""])
    model = quality.fit(docs, spark.createDataFrame([], "doc_id long, quality int"))
    whole, alone = quality.add_scores(docs, model), quality.add_scores(docs, model, keep=["doc_id"])
    whole.explain()
    assert "__text" not in capsys.readouterr().out
    assert whole.columns == ["doc_id", "text", "component", "score"] and alone.columns == ["doc_id", "score"]
    assert [(r["doc_id"], r["score"]) for r in whole.collect()] == [tuple(r) for r in alone.collect()]
    assert [r["text"] for r in whole.collect()] == ["some words", None, ""]


def test_held_out_labels_are_never_learnt(spark):
    docs = frame(spark, [words(random.Random(i), 30) for i in range(60)])
    flip = F.when(quality.held_out(F.col("doc_id")), 1 - F.col("doc_id") % 2).otherwise(F.col("doc_id") % 2).cast("int")
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    one, two = quality.fit(docs, labels), quality.fit(docs, docs.select("doc_id", flip.alias("quality")))
    assert np.allclose(one.coefficients, two.coefficients)


# Personal data


def test_base_spans():
    text = "mail a.b+c@x-y.example.com, 10.20.30.255 and 1.2.3.256; 4111 1111-1111 1111, +1 (017) 555-7713 +123"
    found = [(pii.KINDS[k], text[s:e]) for s, k, e in pii.base_spans(text)]
    assert found == [("email", "a.b+c@x-y.example.com"), ("ip", "10.20.30.255"), ("card", "4111 1111-1111 1111"), ("phone", "+1 (017) 555-7713")]
    assert pii.base_spans("") == [] and pii.base_spans("9" * 5000) == []


def test_spans(spark):
    rng = random.Random(13)
    clean = [words(rng, 60) for _ in range(40)] + ["look at the dot in 2024-05-06 for 1.234.567,00", "id 51feb63980dfaee7464f96210544c03fc3 end"]
    personal = [words(rng, 10) + f" write to user{i}@mail{i}.example.com or +1 (017) 555-77{i:02d} now " + words(rng, 10) for i in range(30)]
    written = ["please write to anna (at) posteo (dot) de today", "call (017) 555-7713 in the morning", "reach me at bob at firma dot com soon"]
    texts = [*clean, *personal, *written, None, "", "7" * 20_000]
    df = frame(spark, texts).withColumn("spans", F.lit(0))
    model = pii.fit(df)
    rows = pii.find_personal_data(df, model).orderBy("doc_id").collect()
    for r in rows:
        base = [(pii.KINDS[k], s, e) for s, k, e in pii.base_spans(r["text"] or "")]
        assert [(x["kind"], x["start"], x["end"]) for x in r["base"]] == base
        assert set(base) <= {(x["kind"], x["start"], x["end"]) for x in r["spans"]}
    assert not any(r["spans"] for r in rows[: len(clean)])
    added = [texts[r["doc_id"]][x["start"] : x["end"]] for r in rows[len(clean) + 30 : len(clean) + 33] for x in r["spans"]]
    assert len(added) >= 2 and added[0] == "anna (at) posteo (dot) de"
    assert pii.find_personal_data(df.limit(0), pii.fit(df.limit(0))).count() == 0


@pytest.mark.parametrize("at", ["[at]", "( at )", "[ at ]", "{AT }", "< at>", "(\u00a0At\n)"])
def test_written_addresses_make_stretches(at):
    for text in (f"write to jane {at} example.com", f"jane{at}example.com"):
        assert pii.WRITTEN.search(text) and pii.stretches(text)


def test_digest_of_nothing():
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0c442") and base64.b64encode(b"") == b""
