"""Personal data: fixed patterns, and further spans found by a semi-Markov conditional random field.

The model cuts the tokens of a stretch of text into segments: entities of a kind, bounded in length, and single other
tokens. Features look at whole candidate segments, so boundaries and kinds are chosen jointly by dynamic programming.
It is trained here, on a bounded sample of stretches whose fixed-pattern matches are the labels, and on stretches into
which written-out and otherwise altered forms of such data are put.
"""

from __future__ import annotations

import random
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

KINDS = ("email", "ip", "card", "phone")
# Fixed patterns; their matches are always reported, if their parts pass.
# They are applied in ways that take a time in proportion to the text, also where it has very long words:
# an address [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+ is sought from its at sign,
NAME = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
HOST = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# and an IP address from the start of a run of digits, since what fails there fails within the run as well.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
SOME_DIGIT = re.compile(r"[0-9]")

#: Most tokens of an entity.
MOST_TOKENS = 24
#: Fewest digits of an entity without an at sign or a word for it.
LEAST_DIGITS = 7
#: Characters around a trigger that belong to its stretch.
MARGIN = 48
#: A segment is added if the best cut with it beats the best one without it by so much (log odds).
ADDED_ODDS = 3.0
#: Texts of the corpus whose stretches the model is trained on, at most.
STRETCHES = 240
ALTERED = 320
ROUNDS = 12
SEED = 5

TOKEN = re.compile(r"[^\W\d_]+|[0-9]+|.", re.S)
AT = re.compile(r"(?:@|[\[({<]\s?at\s?[\])}>]|\bat\b)", re.I)
#: Most characters of a name or of a part of a host in an address that is written out.
MOST_PART = 64
WRITTEN = re.compile(rf"[\[({{<]\s?at\s?[\])}}>]\s?[\w-]{{1,{MOST_PART}}}|\bat\b\s?[\w-]{{1,{MOST_PART}}}\s?(?:[\[({{<]\s?dot\s?[\])}}>]|\bdot\b)", re.I)
WRITTEN_NAME = re.compile(r"[\w.%+-]+\s?\Z")
#: A part of whatever WRITTEN matches, besides "dot", in lower case.
CLOSED_AT = re.compile(r"at\s?[\])}>]")
TRIGGER = re.compile(rf"@|[0-9](?:[^\n]{{0,3}}[0-9]){{{LEAST_DIGITS - 1},}}|[0-9]{{1,3}}(?:[^\w\n]{{1,5}}[0-9]{{1,3}}){{3}}")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost addresses without overlaps: each begins where the name before its at sign or the last address ends."""
    last, at = 0, text.find("@")
    while at >= 0:
        first = at
        while first > last and text[first - 1] in NAME:
            first -= 1
        host = HOST.match(text, at + 1) if first < at else None
        if host:
            last = host.end()
            yield first, last
        else:
            last = at + 1
        at = text.find("@", last)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of the kind, end) of the fixed patterns, leftmost and without overlaps in each kind."""
    found = []
    if "@" in text:
        found += [(a, 0, b) for a, b in emails(text)]
    if SOME_DIGIT.search(text):
        for m in IP.finditer(text):
            # Long parts are compared without making numbers of them.
            if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in CARD.finditer(text):
            if m.end() - m.start() < 40:
                digits = re.sub(r"[^0-9]", "", m[0])
                if 12 <= len(digits) <= 19 and luhn(digits):
                    found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in PHONE.finditer(text):
                if 9 <= len(re.sub(r"[^0-9]", "", m[0])) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


def stretches(text: str) -> list[tuple[int, int]]:
    """Parts of the text around anything that may belong to an entity; outside of them no segment is a candidate."""
    marks = [m.span() for m in TRIGGER.finditer(text)] if "@" in text or SOME_DIGIT.search(text) else []
    lowered = text.lower()
    if "dot" in lowered or CLOSED_AT.search(lowered):
        for m in WRITTEN.finditer(text):
            name = WRITTEN_NAME.search(text[max(0, m.start() - MOST_PART - 1) : m.start()])
            if name:
                marks.append((m.start() - len(name[0]), m.end()))
    out: list[list[int]] = []
    for a, b in sorted(marks):
        a, b = max(0, a - MARGIN), min(len(text), b + MARGIN)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _size(n: int) -> str:
    return str(n) if n < 20 else "20+"


def _edge(c: str) -> str:
    return "none" if not c else "word" if c.isalnum() else "space" if c.isspace() else "mark"


def segment_features(text: str, start: int, end: int) -> tuple[str, ...]:
    """Properties of a whole candidate segment and of the characters next to it."""
    part = text[start:end]
    digits = re.sub(r"[^0-9]", "", part)
    groups = re.findall(r"[0-9]+", part)
    letters = bool(re.search(r"[^\W\d_]", part))
    seen = set(re.findall(r"[^\w]", part))
    before, after = text[start - 1 : start], text[end : end + 1]
    out = [
        "any",
        f"digits {_size(len(digits))} {letters}",
        f"groups {min(len(groups), 7)} {letters}",
        f"before {_edge(before)}",
        f"after {_edge(after)}",
        f"first {_edge(part[:1])} {part[:1] in '+('}",
        f"last {_edge(part[-1:])}",
        f"marks {' '.join(sorted(seen & set('+-()@ .[]{}<>')))} {letters}",
    ]
    if seen - set("+-()@ .[]{}<>") or "_" in part or "\n" in part:
        out.append("strange")
    if not letters:
        out.append("shape " + re.sub(r"[0-9]+", lambda m: _size(len(m[0])), part)[:40])
        if 12 <= len(digits) <= 19:
            out.append(f"luhn {luhn(digits)}")
        if len(groups) == 4:
            out.append(f"octets {all(len(g) <= 3 and int(g) <= 255 for g in groups)} {len(set(re.split(r'[0-9]+', part)[1:-1])) == 1}")
        if re.fullmatch(r"[0-9]{2,4}[-./][0-9]{1,2}[-./][0-9]{1,4}.*", part):
            out.append("date")
    else:
        marks = AT.findall(part)
        out.append(f"ats {min(len(marks), 2)}")
        if len(marks) == 1:
            name, host = AT.split(part, maxsplit=1)
            dots = re.split(r"\s?(?:[\[({<]\s?dot\s?[\])}>]|\bdot\b|\.)\s?", host.strip(), flags=re.I)
            plain = bool(re.fullmatch(r"[\w.%+-]+", name.strip())) and all(re.fullmatch(r"[A-Za-z0-9-]+", d) for d in dots)
            spaced = len(name) - len(name.rstrip()) + len(host) - len(host.lstrip())
            out += [f"address {plain} {min(len(dots), 4)} {spaced}", f"ending {bool(re.fullmatch(r'[A-Za-z]{2,6}', dots[-1]))}", f"words {min(3, len(name.split()))}"]
            if "dot" in host.lower().split() or not marks[0].isalpha():
                out.append("written out")
    return tuple(out)


def candidates(text: str, spans: list[tuple[int, int]], limit: int = MOST_TOKENS) -> list[list[tuple[int, int]]]:
    """For each end token (1-based) the (first token, length) of segments that may be entities.

    A candidate has at most ``limit`` tokens, is not bounded by white space, holds an at sign or a written one, or enough
    digits, and doesn't tear a run of letters and digits without need.
    """
    n = len(spans)
    enough = np.zeros(n + 1, dtype=np.int64)
    at = np.zeros(n + 1, dtype=np.int64)
    for i, (a, b) in enumerate(spans):
        piece = text[a:b]
        enough[i + 1] = enough[i] + (b - a if "0" <= piece[0] <= "9" else 0)
        at[i + 1] = at[i] + (piece == "@" or piece.lower() == "at")
    opens = [text[a:b][0].isalnum() or text[a] in "+(._%-" for a, b in spans]
    closes = [text[b - 1].isalnum() for a, b in spans]
    out: list[list[tuple[int, int]]] = [[] for _ in range(n + 1)]
    for end in range(1, n + 1):
        if not closes[end - 1] or (end < n and text[spans[end][0]].isalnum()):
            continue
        for first in range(end - 1, max(-1, end - 1 - limit), -1):
            if "\n" in text[spans[first][0] : spans[first][1]]:
                break
            if opens[first] and (enough[end] - enough[first] >= 4 and (first == 0 or not text[spans[first][0] - 1].isalnum())):
                digits = enough[end] - enough[first]
                if digits >= LEAST_DIGITS or at[end] > at[first] or digits >= 4 and end - first >= 7:
                    out[end].append((first, end - first))
            elif opens[first] and at[end] > at[first] and end - first >= 5 and (first == 0 or not text[spans[first][0] - 1].isalnum()):
                out[end].append((first, end - first))
    return out


@dataclass
class SpanModel:
    """Weights of (feature, kind) for entity segments; other tokens score 0."""

    names: dict[str, int] = field(default_factory=dict)
    weights: np.ndarray = field(default_factory=lambda: np.zeros((0, len(KINDS))))

    def scores(self, features: tuple[str, ...]) -> np.ndarray:
        known = [self.names[f] for f in features if f in self.names]
        # A property never seen in training speaks against an entity.
        return self.weights[known].sum(axis=0) - 1.0 * (len(features) - len(known)) if known else np.full(len(KINDS), -20.0)

    def find(self, text: str) -> list[tuple[int, int, int]]:
        """(start, number of the kind, end) of the entities in the best cut of the text's stretches."""
        found = []
        if not len(self.weights):
            return found
        for a, b in stretches(text):
            spans = [(a + m.start(), a + m.end()) for m in TOKEN.finditer(text[a:b])]
            ends = candidates(text, spans)
            n = len(spans)
            best, back = np.zeros(n + 1), [(-1, -1)] * (n + 1)
            for end in range(1, n + 1):
                best[end], back[end] = best[end - 1], (end - 1, -1)
                for first, _ in ends[end]:
                    scores = self.scores(segment_features(text, spans[first][0], spans[end - 1][1]))
                    kind = int(np.argmax(scores))
                    if scores[kind] > ADDED_ODDS and best[first] + scores[kind] > best[end]:
                        best[end], back[end] = best[first] + scores[kind], (first, kind)
            end = n
            while end > 0:
                first, kind = back[end]
                if kind >= 0:
                    found.append((spans[first][0], kind, spans[end - 1][1]))
                end = first
        return sorted(found)


def all_spans(text: str | None, model: SpanModel) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """The fixed-pattern spans, and these with the model's spans that overlap none of them."""
    if not text:
        return [], []
    base = base_spans(text)
    added = []
    if found := model.find(text):
        covered = np.zeros(len(text) + 1, dtype=np.int8)
        for s, _, e in base:
            covered[s:e] = 1
        added = [x for x in found if not covered[x[0] : x[2]].any()]
    return base, sorted(base + added)


def altered_entities(rng: random.Random) -> tuple[str, int]:
    """A made-up entity and its kind, often in a form that the fixed patterns miss."""
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9)))
    kind = rng.randrange(len(KINDS))
    if kind == 0:
        name = word() + rng.choice(["", "." + word(), number(2), "." + number(2), "_" + word()])
        at = rng.choice(["@", " at ", " (at) ", " [at] ", "(at)", "[at]", " @ "])
        dot = rng.choice([" dot ", "[dot]", " (dot) "]) if at == " at " else rng.choice([".", ".", " dot ", "[dot]", "(dot)"])
        host = dot.join([word() + rng.choice(["", number(1)]), *([word()] if rng.random() < 0.4 else []), rng.choice(["com", "org", "net", "de", "fr", "es", "info"])])
        return name + at + host, kind
    if kind == 1:
        return rng.choice([".", ".", "[.]", " . ", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4)), kind
    if kind == 2:
        digits = str(rng.choice([3, 4, 5, 6])) + number(14)
        digits += next(c for c in "0123456789" if luhn(digits + c))
        gap = rng.choice(["", " ", "-", ".", "  ", " - "])
        return gap.join(digits[i : i + 4] for i in range(0, 16, 4)), kind
    a, b, c = number(3), number(3), number(4)
    forms = [f"+{rng.randint(1, 99)} ({a}) {b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"00{rng.randint(1, 99)} {a} {b} {c}", f"+{rng.randint(1, 99)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"+{rng.randint(1, 99)}/{a}/{b}{c}"]
    return rng.choice(forms), kind


def train(parts: list[str], rounds: int = ROUNDS, altered: int = ALTERED) -> SpanModel:
    """Maximum conditional likelihood by gradient steps over the segments' marginal probabilities.

    Some of the examples are the parts as they are, with their fixed-pattern spans as entities. Parts without such spans
    are left out: what the patterns miss in them would count as no entity, though it is what the model shall find. The
    other examples are parts with an altered entity, or a number that is none, put between two words.
    """
    rng = random.Random(SEED)
    examples: list[tuple[str, list[tuple[int, int, int]]]] = [(p, base_spans(p)) for p in parts if base_spans(p)]
    filler = [p for p in parts if not base_spans(p) and not stretches(p)] or ["The report was sent on time and the answer came back late"]
    number = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    for i in range(altered):
        text = rng.choice(filler)[:120]
        words = text.split(" ")
        at = rng.randint(0, len(words))
        left, right = " ".join(words[:at]), " ".join(words[at:])
        left = left + " " if left else ""
        close = rng.choice([" ", " ", ", ", ". "])
        if i % 4 == 3:
            other = rng.choice(
                [f"{rng.randint(1900, 2099)}-{number(2)}-{number(2)}", f"{number(3)}.{number(3)}.{number(3)},00", f"{number(rng.randint(5, 30))}", f"v{number(1)}.{number(1)}.{number(2)}", f"{number(2)}:{number(2)}:{number(2)}.{number(3)}", f"look at it dot {number(1)}", f"at {number(1)}:{number(2)} dot", f"{number(4)} {number(4)}", f'"{number(3)}a{number(5)}f{number(7)}c{number(3)}"', f"{number(1)}.{number(6)}e-{number(2)}"]
            )
            joined = left + other + close + right
            examples.append((joined, base_spans(joined)))
        else:
            entity, kind = altered_entities(rng)
            joined = left + entity + close + right
            spans = [s for s in base_spans(joined) if s[2] <= len(left) or s[0] >= len(left) + len(entity)]
            examples.append((joined, sorted([*spans, (len(left), kind, len(left) + len(entity))])))
    model = SpanModel()
    lattice = []
    for text, gold in examples:
        spans = [m.span() for m in TOKEN.finditer(text)]
        ends = candidates(text, spans)
        inside = stretches(text)
        segments = []
        for end, starts in enumerate(ends):
            for first, _ in starts:
                s, e = spans[first][0], spans[end - 1][1]
                if any(a <= s and e <= b for a, b in inside):
                    ids = [model.names.setdefault(f, len(model.names)) for f in segment_features(text, s, e)]
                    segments.append((first, end, ids, [g[1] for g in gold if (g[0], g[2]) == (s, e)]))
        if segments:
            lattice.append((len(spans), segments))
    model.weights = np.zeros((len(model.names), len(KINDS)))
    if not lattice:
        return model
    steps = np.full_like(model.weights, 1e-2)
    for _ in range(rounds):
        rng.shuffle(lattice)
        for n, segments in lattice:
            scores = np.array([model.weights[ids].sum(axis=0) for _, _, ids, _ in segments])
            by_end, by_first = defaultdict(list), defaultdict(list)
            for i, (first, end, _, _) in enumerate(segments):
                by_end[end].append(i)
                by_first[first].append(i)
            total = np.logaddexp.reduce(scores, axis=1)
            ahead, behind = np.zeros(n + 1), np.zeros(n + 1)
            for end in range(1, n + 1):
                ahead[end] = np.logaddexp.reduce([ahead[end - 1], *(ahead[segments[i][0]] + total[i] for i in by_end.get(end, ()))])
            for first in range(n - 1, -1, -1):
                behind[first] = np.logaddexp.reduce([behind[first + 1], *(behind[segments[i][1]] + total[i] for i in by_first.get(first, ()))])
            gradient: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(len(KINDS)))
            for i, (first, end, ids, gold) in enumerate(segments):
                change = -np.exp(np.minimum(0.0, ahead[first] + scores[i] + behind[end] - ahead[n]))
                for kind in gold:
                    change[kind] += 1
                for f in ids:
                    gradient[f] += change
            rows = np.fromiter(gradient, dtype=np.int64)
            change = np.array([gradient[f] for f in rows.tolist()]) - 1e-4 * model.weights[rows]
            steps[rows] += change**2
            model.weights[rows] += 0.5 * change / np.sqrt(steps[rows])
    return model


def fit(df: DataFrame, text: str = "text", rows: int = STRETCHES) -> SpanModel:
    """The model, trained on stretches of at most ``rows`` texts: half with digits or at signs, half without.

    The texts are chosen by the smallest hashes, so the same table always gives the same model.
    """
    texts = df.select(F.col(text).alias("text")).filter(F.length("text") > 0)
    hashed = texts.select("text", F.xxhash64("text").alias("h"), F.col("text").rlike("[0-9@]").alias("marked"))
    parts = []
    for marked in (True, False):
        # Only hashes are sorted; the few texts they stand for are then read again, one copy of each.
        least = [r["h"] for r in hashed.filter(F.col("marked") == marked).select("h").distinct().orderBy("h").limit(rows // 2).collect()]
        few = hashed.filter((F.col("marked") == marked) & F.col("h").isin(least)).groupBy("h").agg(F.min("text").alias("text"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for t in batch.column(0):
                    t = t.as_py()
                    out += [t[a:b] for a, b in stretches(t)[:4]] or [t[:200]]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["part"])

        parts += [r["part"] for r in few.select("text").mapInArrow(run, "part string").limit(2 * rows).collect()]
    return train(sorted(parts))


SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_personal_data(df: DataFrame, model: SpanModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns (all others if not given), and ``base`` and ``spans``: arrays of (kind, start, end).

    ``base`` has the matches of the fixed patterns in the whole text, ``spans`` these and the model's further ones,
    which overlap no base span. Positions are code points, ends exclusive; both are ordered by start, then kind. A null
    or empty text has none. Columns named ``base`` or ``spans`` are replaced.
    """
    keep = [c for c in df.columns if c not in ("base", "spans")] if keep is None else keep
    source = df.select(*keep, F.col(text).alias("__text"))
    schema = T.StructType([*source.schema.fields[:-1], T.StructField("base", SPANS), T.StructField("spans", SPANS)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        arrow = to_arrow_type(SPANS)
        for batch in batches:
            found = [all_spans(t.as_py(), model) for t in batch.column(len(keep))]
            columns = [pa.array([[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in pair[i]] for pair in found], arrow) for i in (0, 1)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(keep))), *columns], names=[*keep, "base", "spans"])

    return source.mapInArrow(run, schema)
