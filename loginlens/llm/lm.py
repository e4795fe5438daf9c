"""Language-model scoring: a gated recurrent network with a class-factored softmax gives every whole document a probability.

Tokens are counted over all training documents. The most frequent ones are the network's words, split into classes by
frequency; all others are one further class, within which a token's probability follows its count. The network learns
from windows by truncated backpropagation: tasks train on their documents from the same weights, and the weights are
averaged after every round. A document's state is carried from window to window, so its likelihood is that of the whole.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loginlens.llm.common import delete_stored, stored

#: Words of the network at most, and tokens whose counts are sent to the tasks at most; the rest is joined.
WORDS = 4_096
LOOKED_UP = 1 << 18
CLASSES = 56
EMBEDDING = 16
STATE = 16
#: One training document in so many, by hash, trains the network: by default each, in one of the rounds.
SHARE = 1
ROUNDS = 4
#: Training tokens of a round that one task takes.
TASK_TOKENS = 1_000_000
TRAINING_SLOTS, TRAINING_WINDOW = 256, 20
SCORING_SLOTS, SCORING_WINDOW = 256, 32
RATE = 0.1
#: Different tokens that a task counts before it hands them on.
COUNTED = 400_000
PIECE = 1 << 20
CHUNK = 1 << 14
#: Steps of a doubling that counts are told apart by, when the most frequent tokens are sought.
STEPS = 16
#: The token that ends every document; no word is empty.
END = b""
SPACE = re.compile(rb"[\x20\x09-\x0D]")


def held_out(key: Column) -> Column:
    """Documents that nothing is learnt from: crc32 of the key's text mod 7 is 2; a null key counts as empty."""
    return F.crc32(F.coalesce(key.cast("string"), F.lit("")).cast("binary")) % 7 == 2


def token_pieces(text: bytes | None) -> Iterator[list[bytes]]:
    """The lower-cased tokens of a text, in pieces, and its end in the last one."""
    text = text or b""
    first = 0
    while len(text) - first > PIECE:
        cut = SPACE.search(text, first + PIECE)
        if not cut:
            break
        yield text[first : cut.start()].lower().split()
        first = cut.start()
    yield [*text[first:].lower().split(), END]


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """(token, n) over all documents, the end of each included."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[bytes] = Counter()

        def found() -> pa.RecordBatch:
            batch = pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["token", "n"])
            counts.clear()
            return batch

        for batch in batches:
            for data in batch.column(0).cast(pa.binary()):
                for piece in token_pieces(data.as_py()):
                    counts.update(piece)
                    if len(counts) >= COUNTED:
                        yield found()
        yield found()

    return docs.select(text).mapInArrow(run, "token binary, n long").groupBy("token").agg(F.sum("n").alias("n"))


def frequency_step(n: Column) -> Column:
    return F.floor(F.log2(n) * STEPS).cast("int")


def class_bounds(counts: np.ndarray, classes: int) -> np.ndarray:
    """Where the classes start, and the end: words by falling count, cut evenly by the sum of their roots."""
    if not len(counts):
        return np.zeros(1, dtype=np.int64)
    mass = np.cumsum(np.sqrt(counts))
    of = np.minimum((mass - np.sqrt(counts) / 2) / mass[-1] * classes, classes - 1).astype(np.int64)
    return np.concatenate([np.flatnonzero(np.diff(of, prepend=-1)), [len(counts)]])


def sigmoid(x: np.ndarray) -> np.ndarray:
    """In a new array; large negative numbers give 0."""
    out = np.negative(x)
    np.minimum(out, 80, out=out)
    np.exp(out, out=out)
    out += 1
    return np.reciprocal(out, out=out)


class Network:
    """Weights of the network over ``k`` words, with word ``k`` for all other tokens."""

    def __init__(self, counts: np.ndarray, others: float, bounds: np.ndarray, embedding: int, state: int, seed: int = 5) -> None:
        k, self.h = len(counts), state
        self.bounds = bounds
        classes = len(bounds) - 1
        self.class_of = np.concatenate([np.repeat(np.arange(classes), np.diff(bounds)), [classes]])
        random = np.random.default_rng(seed)
        mass = np.array([counts[a:b].sum() for a, b in zip(bounds, bounds[1:])] + [others], dtype=np.float64)
        within = np.log(counts / np.maximum(mass[self.class_of[:k]], 1)) if k else np.empty(0)
        # Without any training the network gives every word its share.
        self.w = {
            "e": random.normal(scale=0.3, size=(k + 1, embedding)),
            "w": random.normal(scale=embedding**-0.5, size=(embedding, 3 * state)),
            "u": random.normal(scale=state**-0.5, size=(state, 3 * state)),
            "b": np.zeros(3 * state),
            "wc": np.zeros((state, classes + 1)),
            "bc": np.log(mass / mass.sum()),
            "wo": np.zeros((k, state)),
            "bo": within,
        }
        self.w = {name: x.astype(np.float32) for name, x in self.w.items()}

    def flat(self, arrays: dict[str, np.ndarray]) -> np.ndarray:
        return np.concatenate([arrays[name].ravel() for name in self.w])

    def unflat(self, values: np.ndarray) -> dict[str, np.ndarray]:
        out, at = {}, 0
        for name, x in self.w.items():
            out[name] = values[at : at + x.size].reshape(x.shape).astype(np.float32)
            at += x.size
        return out

    def states(self, inputs: np.ndarray, h: np.ndarray, given: np.ndarray | None = None, steps: list[tuple] | None = None) -> np.ndarray:
        """The states after each step of a window (steps x slots); ``steps`` takes what the way back needs.

        ``given`` has for each word what it adds to the gates.
        """
        w, H = self.w, self.h
        given = (w["e"][inputs.ravel()] @ w["w"] + w["b"]).reshape(*inputs.shape, 3 * H) if given is None else given[inputs]
        out = np.empty((*inputs.shape, H), dtype=h.dtype)
        for t in range(len(inputs)):
            u = h @ w["u"]
            gates = sigmoid(given[t, :, : 2 * H] + u[:, : 2 * H])
            z, r = gates[:, :H], gates[:, H:]
            n = r * u[:, 2 * H :]
            n += given[t, :, 2 * H :]
            n *= 2
            n = sigmoid(n)
            n *= 2
            n -= 1
            if steps is not None:
                steps.append((h, z, r, n, u[:, 2 * H :]))
            h = np.subtract(h, n, out=out[t])
            h *= z
            h += n
        return out

    def bounded(self) -> bool:
        """Whether all logits are so small that their exponentials fit, states lying between -1 and 1."""
        w = self.w
        return max(float((np.abs(x).sum(axis=axis) + np.abs(b)).max(initial=0)) for x, axis, b in ((w["wc"], 0, w["bc"]), (w["wo"], 1, w["bo"]))) < 60

    def log_probabilities(self, states: np.ndarray, words: np.ndarray, gradients: dict[str, np.ndarray] | None = None, bounded: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """Natural logarithms of P(word | state); word ``k`` is the class of all others.

        With ``gradients``, those of the negative mean logarithm are put there, and those of the states returned.
        """
        w = self.w
        order = np.argsort(self.class_of[words], kind="stable")
        states, words = states[order], words[order]
        classes = self.class_of[words]
        back = None if gradients is None else np.empty_like(states)
        out = np.empty(len(words))

        def softmax(part: slice, weights: np.ndarray, bias: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
            """Logarithms of the own entries, and the gradients of the logits."""
            at = np.arange(len(own))
            exps = states[part] @ weights
            exps += bias
            if not bounded:
                exps -= exps.max(axis=1, keepdims=True)
            picked = exps[at, own]
            np.exp(exps, out=exps)
            sums = exps @ np.ones(exps.shape[1], dtype=exps.dtype)
            if gradients is not None:
                exps /= sums[:, None]
                exps[at, own] -= 1
                exps /= len(words)
            return picked - np.log(sums), exps

        out[:], exps = softmax(slice(None), w["wc"], w["bc"], classes)
        if gradients is not None:
            gradients["wc"], gradients["bc"], gradients["words"] = states.T @ exps, exps.sum(axis=0), []
            back[:] = exps @ w["wc"].T
        ends = np.searchsorted(classes, np.arange(len(self.bounds)))
        for c in np.flatnonzero(np.diff(ends)).tolist():
            a, b, part = int(self.bounds[c]), int(self.bounds[c + 1]), slice(ends[c], ends[c + 1])
            if b - a > 1:
                logs, exps = softmax(part, w["wo"][a:b].T, w["bo"][a:b], words[part] - a)
                out[part] += logs
                if gradients is not None:
                    gradients["words"].append((a, b, exps.T @ states[part], exps.sum(axis=0)))
                    back[part] += exps @ w["wo"][a:b]
        found = np.empty_like(out)
        found[order] = out
        if gradients is None:
            return found, None
        unsorted = np.empty_like(back)
        unsorted[order] = back
        return found, unsorted

    def gradients(self, inputs: np.ndarray, targets: np.ndarray, used: np.ndarray, h: np.ndarray) -> tuple[float, dict, np.ndarray]:
        """Negative mean logarithm of a window's used targets, its gradients, and the last state."""
        H = self.h
        steps: list[tuple] = []
        states = self.states(inputs, h, steps=steps)
        found: dict = {}
        logs, back = self.log_probabilities(states[used], targets[used], found)
        into = np.zeros_like(states)
        into[used] = back
        given = np.empty((*inputs.shape, 3 * H), dtype=h.dtype)
        found["u"] = np.zeros_like(self.w["u"])
        dh = np.zeros_like(h)
        for t in range(len(inputs) - 1, -1, -1):
            before, z, r, n, un = steps[t]
            dh = dh + into[t]
            dn = dh * (1 - z) * (1 - n * n)
            own = given[t]
            own[:, :H] = dh * (before - n) * z * (1 - z)
            own[:, H : 2 * H] = dn * un * r * (1 - r)
            own[:, 2 * H :] = dn
            du = own.copy()
            du[:, 2 * H :] *= r
            found["u"] += before.T @ du
            dh = dh * z + du @ self.w["u"].T
        flat, words = given.reshape(-1, 3 * H), inputs.ravel()
        found["b"] = flat.sum(axis=0)
        found["w"] = self.w["e"][words].T @ flat
        order = np.argsort(words, kind="stable")
        rows, starts = np.unique(words[order], return_index=True)
        found["e"] = (rows, np.add.reduceat((flat @ self.w["w"].T)[order], starts, axis=0))
        return -float(logs.mean()), found, states[-1]

    def step(self, found: dict, squares: dict[str, np.ndarray], rate: float) -> None:
        """One step with rates that fall by the squares of past gradients."""

        def move(x: np.ndarray, s: np.ndarray, g: np.ndarray, at) -> None:
            s[at] += g * g
            x[at] -= rate * g / np.sqrt(s[at])

        for name in ("w", "u", "b", "wc", "bc"):
            move(self.w[name], squares[name], found[name], ...)
        move(self.w["e"], squares["e"], found["e"][1], found["e"][0])
        for a, b, g, gb in found.get("words", []):
            move(self.w["wo"], squares["wo"], g, slice(a, b))
            move(self.w["bo"], squares["bo"], gb, slice(a, b))


@dataclass
class Stream:
    """A document on its way through the network: what is left of it, and what is known of it so far."""

    pieces: Iterator[np.ndarray]
    end: int
    row: object = None
    ids: np.ndarray = field(default_factory=lambda: np.empty(0, dtype=np.int64))
    last: int = -1
    total: float = 0.0

    def take(self, n: int) -> np.ndarray:
        while len(self.ids) < n:
            piece = next(self.pieces, None)
            if piece is None:
                break
            self.ids = np.concatenate([self.ids, piece]) if len(self.ids) else piece
        out, self.ids = self.ids[:n], self.ids[n:]
        return out


def windows(documents: Iterator[Stream], slots: int, size: int) -> Iterator[tuple]:
    """(inputs, targets, used, streams, before, ended) of windows of up to ``slots`` documents side by side.

    ``before`` is the slot that each document had in the last window, or -1 if it is new and its state starts anew;
    ``ended`` are the documents of earlier windows that are done. Inputs are the targets before, and at a document's
    start its end token. A slot takes the next document when its own has ended; without one it is closed.
    """
    held: list[Stream] = []
    more = True
    while True:
        ended, streams, before, taken = [], [], [], []
        for b, stream in enumerate(held):
            ids = stream.take(size)
            if len(ids):
                streams.append(stream)
                before.append(b)
                taken.append(ids)
            else:
                ended.append(stream)
        while more and len(streams) < slots:
            stream = next(documents, None)
            more = stream is not None
            if more:
                stream.last = stream.end
                streams.append(stream)
                before.append(-1)
                taken.append(stream.take(size))
        inputs, targets = np.zeros((size, len(streams)), dtype=np.int64), np.zeros((size, len(streams)), dtype=np.int64)
        used = np.zeros((size, len(streams)), dtype=bool)
        for b, ids in enumerate(taken):
            n = len(ids)
            targets[:n, b], used[:n, b] = ids, True
            inputs[0, b], inputs[1:n, b] = streams[b].last, ids[:-1]
            streams[b].last = int(ids[-1])
        yield inputs, targets, used, streams, np.array(before, dtype=np.int64), ended
        if not streams:
            return
        held = streams


def carried(h: np.ndarray, before: np.ndarray) -> np.ndarray:
    """The states that documents have brought from the last window; zeros for new ones."""
    out = np.zeros((len(before), h.shape[1]), dtype=np.float32)
    out[before >= 0] = h[before[before >= 0]]
    return out


def train(network: Network, documents: Iterator[Stream], squares: dict[str, np.ndarray], slots: int, size: int, rate: float) -> int:
    """Truncated backpropagation through the documents; the number of tokens learnt from."""
    h, seen = np.zeros((0, network.h), dtype=np.float32), 0
    for inputs, targets, used, streams, before, _ in windows(documents, slots, size):
        if streams:
            _, found, h = network.gradients(inputs, targets, used, carried(h, before))
            network.step(found, squares, rate)
            seen += int(used.sum())
    return seen


def score_streams(network: Network, documents: Iterator[Stream], slots: int, size: int) -> Iterator[Stream]:
    """The documents as they end, with the sum of their tokens' logarithms in ``total``."""
    given, bounded = network.w["e"] @ network.w["w"] + network.w["b"], network.bounded()
    h = np.zeros((0, network.h), dtype=np.float32)
    for inputs, targets, used, streams, before, ended in windows(documents, slots, size):
        yield from ended
        if streams:
            states = network.states(inputs, carried(h, before), given)
            h = states[-1]
            logs = np.zeros(used.shape)
            logs[used], _ = network.log_probabilities(states[used], targets[used], bounded=bounded)
            for stream, total in zip(streams, logs.sum(axis=0).tolist()):
                stream.total += total


@dataclass
class LanguageModel:
    network: Network
    #: Tokens by falling count, and their counts: of these the first ``words`` are the network's.
    tokens: list[bytes]
    counts: np.ndarray
    words: int
    train_tokens: int
    different: int
    #: (token, n) of all training tokens that are not in ``tokens``.
    rest: DataFrame

    @property
    def end(self) -> int:
        return self.tokens.index(END) if END in self.tokens[: self.words] else self.words


def look_up(tokens: list[bytes], places: dict[bytes, int], none: int) -> np.ndarray:
    return np.fromiter(map(places.get, tokens, repeat(none)), dtype=np.int64, count=len(tokens))


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS, looked_up: int = LOOKED_UP, classes: int = CLASSES, embedding: int = EMBEDDING, state: int = STATE, share: int = SHARE, rounds: int = ROUNDS, rate: float = RATE) -> LanguageModel:
    """A model of all rows of ``docs``: counts of every token, and a network that each document trains in one round.

    A ``share`` above 1 trains it on one document in so many only. Nothing but the ``looked_up`` most frequent tokens and the weights reaches the driver. Rows with a null text have
    only an end; repeated rows count as often as they stand. Without rows every token has the same probability.
    """
    counts = stored(token_counts(docs, text), "counts")
    totals = counts.agg(F.sum("n").alias("n"), F.count("*").alias("v")).first()
    n, v = totals["n"] or 0, totals["v"]
    steps = counts.groupBy(frequency_step(F.col("n")).alias("s")).count().orderBy(F.desc("s")).collect()
    lowest, taken = 1 << 30, 0
    for r in steps:
        taken += r["count"]
        if taken > looked_up:
            break
        lowest = r["s"]
    frequent = counts.filter((frequency_step(F.col("n")) >= lowest) | (F.col("token") == F.lit(bytearray(END))))
    listed = frequent.toArrow()
    listed = sorted(zip(listed.column("n").to_pylist(), listed.column("token").to_pylist()), key=lambda r: (r[1] != END, -r[0], r[1]))
    # The end takes part as a word however few documents there are; then words go by falling count.
    listed = sorted(listed[:words], key=lambda r: (-r[0], r[1])) + listed[words:]
    tokens, found = [t for _, t in listed], np.array([c for c, _ in listed], dtype=np.int64)
    k = min(words, len(tokens))
    others = float(n - found[:k].sum() + v - k + 1)
    network = Network(found[:k].astype(np.float64), others, class_bounds(found[:k], classes), embedding, state)
    rest = counts.filter((frequency_step(F.col("n")) < lowest) & (F.col("token") != F.lit(bytearray(END))))
    model = LanguageModel(network, tokens, found, k, n, v, rest)

    # The training documents are turned into words once; each round reads its own.
    turn = F.pmod(F.xxhash64(F.col(key), F.isnull(key), F.col(text)), F.lit(rounds * share))
    chosen = docs.select(F.col(text).alias("text"), turn.cast("int").alias("round")).filter(F.col("round") < rounds)
    some, end = tokens[:k], model.end

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {t: i for i, t in enumerate(some)}
        for batch in batches:
            found = [np.concatenate([look_up(p, places, k) for p in token_pieces(t.as_py())]) for t in batch.column(0).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], names=["round", "ids"])

    known = stored(chosen.mapInArrow(ids, "round int, ids array<int>"), "known")
    sizes = {r["round"]: r["n"] for r in known.groupBy("round").agg(F.sum(F.size("ids")).alias("n")).collect()}
    squares = {name: np.full_like(x, 1e-6) for name, x in network.w.items()}
    for turn in sorted(sizes):
        tasks = -(-sizes[turn] // TASK_TOKENS)
        part = known.filter(F.col("round") == turn).select("ids").repartition(tasks)
        squares = _train_round(network, part, squares, end, rate / (1 + sorted(sizes).index(turn)) ** 0.5)
    delete_stored(known)
    return model


def _train_round(network: Network, part: DataFrame, squares: dict[str, np.ndarray], end: int, rate: float) -> dict[str, np.ndarray]:
    """Every task trains on its documents from the same weights; the weights become their mean by tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {name: x.copy() for name, x in squares.items()}
        network.w = {name: x.copy() for name, x in network.w.items()}
        streams = (Stream(iter((ids.values.to_numpy().astype(np.int64),)), end) for batch in batches for ids in batch.column(0))
        seen = train(network, streams, own, TRAINING_SLOTS, TRAINING_WINDOW, rate)
        if seen:
            values = (np.concatenate([network.flat(network.w), network.flat(own), [1.0]]) * (seen / TASK_TOKENS)).astype(np.float32)
            chunks = [values[i : i + CHUNK] for i in range(0, len(values), CHUNK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(chunks)), pa.int32()), pa.array(chunks, pa.list_(pa.float32()))], names=["i", "v"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for i, v in zip(batch.column(0).to_pylist(), batch.column(1)):
                sums[i] = sums[i] + v.values.to_numpy() if i in sums else v.values.to_numpy()
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array(list(sums.values()), pa.list_(pa.float32()))], names=["i", "v"])

    schema = "i int, v array<float>"
    size = 2 * sum(x.size for x in network.w.values()) + 1
    sums = part.mapInArrow(run, schema).repartition(max(1, size // CHUNK), "i").mapInArrow(add, schema).toArrow()
    order = np.argsort(sums.column("i").to_numpy())
    if not len(order):
        return squares
    values = np.concatenate([sums.column("v")[int(i)].values.to_numpy() for i in order])
    mean = values[:-1] / values[-1]
    network.w = network.unflat(mean[: len(mean) // 2])
    return network.unflat(mean[len(mean) // 2 :])


SCORED = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known", "n_others")]
    + [T.StructField(c, T.DoubleType()) for c in ("counted", "others", "network")]
    + [T.StructField("rest", T.ArrayType(T.StructType([T.StructField("token", T.BinaryType()), T.StructField("n", T.LongType())])))]
)


def _read_document(text: bytes | None, row: object, places: dict[bytes, int], model_words: int, logs: np.ndarray, end: int) -> Stream:
    """A document whose tokens are looked up as the network gets to them; its figures are kept in ``row``."""
    figures = {"n_tokens": 0, "n_known": 0, "n_others": 0, "counted": 0.0, "others": 0.0, "rest": Counter()}
    none = len(logs)

    def pieces() -> Iterator[np.ndarray]:
        for tokens in token_pieces(text):
            ids = look_up(tokens, places, none)
            known = ids < none
            found = logs[ids[known]]
            other = ids >= model_words
            figures["n_tokens"] += len(tokens)
            figures["n_known"] += int(known.sum())
            figures["n_others"] += int(other.sum())
            figures["counted"] += float(found.sum())
            figures["others"] += float(found[other[known]].sum())
            figures["rest"].update([tokens[i] for i in np.flatnonzero(~known).tolist()])
            yield np.minimum(ids, model_words)

    return Stream(pieces(), end, (row, figures))


def score(docs: DataFrame, model: LanguageModel, text: str = "text", output: str = "lm", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others than ``output`` if not given) and a struct ``output`` of each whole text.

    It holds ``n_tokens`` (with the end), ``n_known`` (in the training documents), ``base`` (log10 probability by
    smoothed counts) and ``score`` (log10 probability by the network). Null and empty texts have only an end. Tokens
    whose counts are not sent to the tasks are joined with them, one row for each document and token. Equal texts may
    differ in the last digits, since documents run through the network side by side. A column named ``output`` is
    replaced.
    """
    keep = [c for c in docs.columns if c != output] if keep is None else keep
    k = len(keep)
    kept = [F.col(c).alias(f"kept{i}") for i, c in enumerate(keep)]
    source = docs.select(F.monotonically_increasing_id().alias("id"), *kept, F.col(text).alias("text"))
    schema = T.StructType([*source.schema.fields[:-1], *SCORED])
    names = [f.name for f in schema]
    network, tokens, logs, words, end = model.network, model.tokens, np.log10(model.counts + 1.0), model.words, model.end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = {t: i for i, t in enumerate(tokens)}
        types: list[pa.DataType] = []

        def documents() -> Iterator[Stream]:
            for batch in batches:
                types[:] = batch.schema.types[: k + 1]
                columns = [batch.column(i) for i in range(k + 1)]
                texts = batch.column(k + 1).cast(pa.binary())
                # Long documents first, so that they do not go on alone when all others have ended.
                for i in np.argsort([-(n or 0) for n in pc.binary_length(texts).to_pylist()], kind="stable").tolist():
                    yield _read_document(texts[i].as_py(), [c[i].as_py() for c in columns], places, words, logs, end)

        def finished(streams: list[Stream]) -> pa.RecordBatch:
            rows, figures = zip(*(s.row for s in streams))
            out = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
            out += [pa.array([f[c] for f in figures], pa.int64()) for c in names[k + 1 : k + 4]]
            out += [pa.array([f[c] for f in figures], pa.float64()) for c in names[k + 4 : k + 6]]
            out.append(pa.array([s.total / np.log(10) for s in streams], pa.float64()))
            rest = [f["rest"] for f in figures]
            offsets = np.concatenate([[0], np.cumsum([len(c) for c in rest])]).astype(np.int32)
            pairs = pa.StructArray.from_arrays([pa.array([t for c in rest for t in c], pa.binary()), pa.array([m for c in rest for m in c.values()], pa.int64())], names=["token", "n"])
            out.append(pa.ListArray.from_arrays(pa.array(offsets), pairs))
            return pa.RecordBatch.from_arrays(out, names=names)

        done, held = [], 0
        for stream in score_streams(network, documents(), SCORING_SLOTS, SCORING_WINDOW):
            done.append(stream)
            held += len(stream.row[1]["rest"])
            if len(done) >= 2000 or held >= 1 << 18:
                yield finished(done)
                done, held = [], 0
        if done:
            yield finished(done)

    scored = stored(source.mapInArrow(run, schema), "scored")
    rest = scored.select("id", F.explode("rest").alias("r")).select("id", F.col("r.token").alias("token"), F.col("r.n").alias("m"))
    joined = rest.join(model.rest, "token").groupBy("id").agg(F.sum("m").alias("__known"), F.sum(F.col("m") * F.log10(F.col("n") + 1)).alias("__log"))
    known, log = F.coalesce("__known", F.lit(0)), F.coalesce("__log", F.lit(0.0))
    found = model.counts[: model.words].sum()
    base = F.log10(F.lit(float(model.train_tokens + model.different + 1)))
    others = F.log10(F.lit(float(model.train_tokens - int(found) + model.different - model.words + 1)))
    result = F.struct(
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        (F.col("counted") + log - F.col("n_tokens") * base).alias("base"),
        (F.col("network") + F.col("others") + log - F.col("n_others") * others).alias("score"),
    )
    return scored.join(joined, "id", "left").select(*[F.col(f"kept{i}").alias(c) for i, c in enumerate(keep)], result.alias(output))
