"""Secrets: fixed patterns, and a linear-chain conditional random field that adds what they miss.

The field tags the tokens of a line as begin, inside or outside of a secret, from the token's
shape, its neighbours and features of the whole text; Viterbi decodes it. It is trained on a
bounded sample of texts, tagged by the patterns, beside made lines with secrets of other forms.

A bound on what a token can gain over "outside", from its shape and its neighbours, shows most
lines to hold no secret: every path through the other tags would lose. The bound is made for all
tokens of a slice of texts at once. Only lines with a token that may gain are decoded, which gives
the same tags as decoding them all.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import STAGE_BYTES, STAGE_ROWS, Kept, Memo, map_slices, release, slices, texts_of, word_table

# The base patterns, their least lengths, and the order of the kinds.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LEAST = {"assign": 6, "access": 20, "hex": 24}
KINDS = ("assign", "access", "hex", "field")
#: A word that a match can lie in or begin in.
MAY_MATCH = re.compile(r"password|passwd|secret|token|api_?key", re.IGNORECASE | re.ASCII), re.compile(r"AKIA[A-Z0-9]{16}|[0-9a-f]{24}")

TOKEN = re.compile(r"\w+(?:[+/_.-]+\w+)*={0,2}|[^\s\w]")
KEYS = frozenset("password passwd pwd pass secret token apikey api_key key credential credentials auth bearer authorization access_key secret_key private_key client_secret access_token passphrase".split())
TAGS = ("O", "B", "I")
OUT, BEGIN, INSIDE = range(3)
#: Texts and stretches of lines that the field is trained on, at most, and the tokens of a stretch; a line of any length is cut into stretches.
FIT_ROWS, FIT_LINES, LINE_TOKENS = 2_000, 900, 60
MEMO_WORDS = 600_000
#: Words that a stage of a chain keeps, where the executor holds the stages before it.
STAGE_WORDS = 100_000
#: A span must beat "outside" by so much, per span.
MARGIN = 3.0

Span = tuple[int, int, str]


def base_spans(text: str) -> list[Span]:
    """Matches of the base patterns: start, end, kind; by start, then kind."""
    found = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return ordered(found)


def ordered(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: list[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind in spans)


def beyond(text: str, start: int, end: int, base: list[Span]) -> list[tuple[int, int]]:
    """The parts of a span outside of the base spans, without blanks around them; parts of marks alone go."""
    parts, at = [], start
    for s, e, _ in sorted(base):
        if s < end and at < e:
            parts.append((at, s))
            at = e
    out = []
    for a, b in [*parts, (at, end)]:
        part = text[a:b] if a < b else ""
        if any(c.isalnum() for c in part):
            out.append((a + len(part) - len(part.lstrip()), b - len(part) + len(part.rstrip())))
    return out


def role(token: str) -> str:
    """What a token is to its neighbours."""
    low = token.lower()
    if low in KEYS or any(low.endswith("_" + k) for k in ("key", "token", "secret", "password")):
        return "key"
    if token in "=:":
        return "sets"
    if token in "\"'`":
        return "mark"
    return "word" if token.isalpha() else "number" if token.strip(".-/+").replace(".", "").replace("-", "").isdigit() else "mixed" if token.isalnum() else "other"


ROLES = ("key", "sets", "mark", "word", "number", "mixed", "other", "edge")
EDGE = ROLES.index("edge")
HEX_LETTERS = frozenset("0123456789abcdef")
LOGS = [0.0] + [math.log2(k) for k in range(1, 200)]
#: A token as the bound sees it: its role, and what its shape gives to begin and inside.
SEEN = np.dtype([("role", "u1"), ("shape", "<f4", 2)])


def own(token: str) -> list[str]:
    """Features of a token's shape."""
    n = len(token)
    counts = [token.count(c) for c in set(token)] if n < 200 else list(Counter(token).values())
    bits = math.log2(n) - sum([k * LOGS[k] if k < 200 else k * math.log2(k) for k in counts]) / n
    if token.isalpha():
        shape, turns = "a" if token.islower() else "A" if token.isupper() else "Aa" if token[1:].islower() else _shape(token), 0
    else:
        shape, turns = _shape(token), sum(a.isdigit() != b.isdigit() for a, b in zip(token, token[1:], strict=False))
    return [
        f"role={role(token)}",
        f"shape={shape if len(shape) <= 3 else 'long'}",
        f"size={min(n // 4, 8)}",
        f"bits={min(int(bits * 2 + 1e-9), 9)}",
        f"turns={min(turns, 5)}",
        f"bits,size={min(int(bits + 1e-9), 4)},{min(n // 8, 4)}",
        f"hex={n >= 12 and set(token) <= HEX_LETTERS}",
        f"plain={token.isalpha() and (token.islower() or token.istitle())}",
    ]


def _shape(token: str) -> str:
    """Kinds of letters, each run of one kind once."""
    return re.sub(r"(.)\1+", r"\1", "".join("a" if c.islower() else "A" if c.isupper() else "0" if c.isdigit() else c if c in "+/_.-=" else "?" for c in token))


def file_features(text: str) -> list[str]:
    """Features of a whole text: how much of it is digits, and whether it names secrets."""
    low = text.lower()
    digits = sum(map(text.count, "0123456789")) / max(1, len(text))
    named = sum(k in low for k in ("password", "secret", "token", "key"))
    return [f"digits={min(int(digits * 20), 4)}", f"named={min(named, 2)}"]


FILE_VALUES = [[f"digits={i}" for i in range(5)], [f"named={i}" for i in range(3)]]


@dataclass
class Field:
    """Weights by feature, one for each tag; ``steps``: from tag to tag; ``starts``: at a line's start."""

    weights: dict[str, np.ndarray] = field(default_factory=dict)
    steps: np.ndarray = field(default_factory=lambda: np.zeros((3, 3)))
    starts: np.ndarray = field(default_factory=lambda: np.zeros(3))

    def emission(self, names: list[str]) -> np.ndarray:
        return sum((self.weights[f] for f in names if f in self.weights), np.zeros(3))

    def emissions(self, tokens: list[str], of_file: list[str]) -> np.ndarray:
        return np.array([self.emission(names + of_file) for names in line_features(tokens)])

    def viterbi(self, scores: np.ndarray) -> list[int]:
        """The best tags of a line; an inside tag only follows a begin or inside tag."""
        barred = np.array([[0, 0, -1e9], [0, 0, 0], [0, 0, 0]])
        best, back = self.starts + scores[0] + [0, -MARGIN, -1e9], []
        step = self.steps + barred - MARGIN * np.array([0, 1, 0])
        for s in scores[1:]:
            way = best[:, None] + step
            back.append(way.argmax(axis=0))
            best = way.max(axis=0) + s
        tags = [int(best.argmax())]
        for b in reversed(back):
            tags.append(int(b[tags[-1]]))
        return tags[::-1]

    def settle(self) -> None:
        """What a token gains over "outside" at most: as the first of a span, and as a later one.

        A span has a step in, and one for each later token, in place of steps outside; it pays
        the margin once. If no token gains either way, neither does any span. ``gains`` are by
        the roles of the neighbours; the shape's gains come from ``own_gains``.
        """
        s = self.steps - self.steps[OUT, OUT]
        out = max(0.0, s[BEGIN, OUT], s[INSIDE, OUT])
        first = max(*s[:, BEGIN], self.starts[BEGIN] - self.starts[OUT]) + out - MARGIN
        later = max(s[BEGIN, INSIDE], s[INSIDE, INSIDE])
        of_file = sum(np.max([self.over(f) for f in values], axis=0) for values in FILE_VALUES)
        self.fixed = np.array([first, later]) + of_file
        self.gains = {at: np.array([self.over(f"{at}={r}") for r in ROLES]) for at in ("before", "before2", "after")}

    def over(self, *names: str) -> np.ndarray:
        """What features give to begin and inside beyond outside."""
        e = self.emission(list(names))
        return np.array([e[BEGIN] - e[OUT], e[INSIDE] - e[OUT]])

    def may_gain(self, roles: np.ndarray, shapes: np.ndarray) -> np.ndarray:
        """Whether each token of a sequence may gain; lines are two edges apart, in front of the first and after the last too."""
        total = shapes + self.fixed
        total[2:-1] += self.gains["before"][roles[1:-2]] + self.gains["before2"][roles[:-3]] + self.gains["after"][roles[3:]]
        return (total.max(axis=1) > -0.01) & (roles != EDGE)


def line_features(tokens: list[str]) -> list[list[str]]:
    roles = ["edge", "edge", *map(role, tokens), "edge"]
    return [own(t) + [f"before={roles[i + 1]}", f"before2={roles[i]}", f"after={roles[i + 3]}"] for i, t in enumerate(tokens)]


def tags_of(line: str, spans: list[tuple[int, int]]) -> tuple[list[str], list[int]]:
    """Tokens of a line and their tags by the spans of secrets in it."""
    tokens, tags = [], []
    for m in TOKEN.finditer(line):
        inside = next((s for s in spans if s[0] <= m.start() and m.end() <= s[1]), None)
        tokens.append(m[0])
        tags.append(OUT if inside is None else INSIDE if tags and tags[-1] != OUT and m.start() > inside[0] else BEGIN)
    return tokens, tags


def stretched(tokens: list[str], tags: list[int], size: int = LINE_TOKENS) -> list[tuple[list[str], list[int]]]:
    """A line as stretches of about ``size`` tokens; a secret that would be cut lengthens its stretch."""
    found, start = [], 0
    while start < len(tokens):
        end = start + size
        while end < len(tokens) and tags[end] == INSIDE:
            end += 1
        found.append((tokens[start:end], tags[start:end]))
        start = end
    return found


def made_lines(rng: random.Random, n: int) -> list[tuple[list[str], list[int]]]:
    """Lines with secrets of many forms, and lines like them without."""
    letters, out = "abcdefghijklmnopqrstuvwxyz", []
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 9)))
    some = lambda chars, low, high: "".join(rng.choice(chars) for _ in range(rng.randint(low, high)))
    mixed, digits = letters + letters.upper() + "0123456789", "0123456789"
    alone = [lambda: some("0123456789abcdef", 16, 40), lambda: some(mixed, 16, 40), lambda: some(letters.upper() + "234567", 16, 32), lambda: some(mixed, 10, 24) + some(digits, 2, 4), lambda: some(mixed, 12, 24) + rng.choice("+/-_.") + some(mixed, 12, 24)]
    short = [lambda: word() + some(digits, 1, 4), lambda: word().title() + some(digits, 2, 4) + rng.choice(["", "!", "$", "#"]), lambda: some(mixed, 6, 12), lambda: some(digits, 1, 2) + word() + some(digits, 1, 3)]
    for _ in range(n):
        head = rng.choice(sorted(KEYS))
        sets = [head + "=", head + ": ", head + ' = "', '"' + head + '": "']
        value, heads = rng.choice([(rng.choice(alone)(), [*sets, head + " "]), (rng.choice(short)(), sets)])
        before, after = " ".join(word() for _ in range(rng.randint(0, 6))), " ".join(word() for _ in range(rng.randint(0, 6)))
        lead = f"{before} {rng.choice(heads)}".lstrip()
        out.append(tags_of(f"{lead}{value}{chr(34) if lead.endswith(chr(34)) else ''} {after}", [(len(lead), len(lead) + len(value))]))
        plain = rng.choice(
            [
                lambda: f"{before} {head} {after}",
                lambda: f"{before} {head}: {word()} {after}",
                lambda: f"{before} {some(digits, 1, 12)} {after}",
                lambda: f"{before} +{rng.randint(1, 99)} ({rng.randint(100, 999)}) {rng.randint(100, 999)}-{rng.randint(1000, 9999)} {after}",
                lambda: f"{word()}.{rng.randint(1, 99)}@{word()}.example.com {after}",
                lambda: f"http://{word()}.example.com/{word()}/{rng.randint(1, 9999)} {after}",
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)} {after}",
                lambda: f"{before.upper()} {after}",
                lambda: f"{word()}{rng.randint(1, 99)} {after}",
                lambda: f"{word()}: {word()}{rng.randint(1, 99)} {after}",
                lambda: f"{word()} = {rng.randint(1, 9999)} {after}",
                lambda: f"{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)}.{rng.randint(1, 255)} {after}",
            ]
        )()
        out.append(tags_of(plain, []))
    return out


def train(lines: list[tuple[list[str], list[int]]], of_files: list[list[str]], rounds: int = 40, rate: float = 0.5, ridge: float = 1e-5, seed: int = 7, batch: int = 32) -> Field:
    """Maximise the conditional likelihood of the tags; gradients by forward and backward sums, in batches of lines of like length."""
    rng, model = random.Random(seed), Field()
    number: dict[str, int] = {}
    sequences = sorted(((np.array([[number.setdefault(f, len(number)) for f in x + of] for x in line_features(t)]), np.array(tags)) for (t, tags), of in zip(lines, of_files, strict=True) if t), key=lambda x: len(x[1]))
    w, seen = np.zeros((len(number), 3)), np.full((len(number), 3), 1e-8)
    chain, chain_seen = np.zeros((4, 3)), np.full((4, 3), 1e-8)  # steps, and in the last row starts
    batches = [sequences[k : k + batch] for k in range(0, len(sequences), batch)]
    for _ in range(rounds):
        rng.shuffle(batches)
        for part in batches:
            n, length = len(part), max(len(tags) for _, tags in part)
            there = np.array([[i < len(tags) for i in range(length)] for _, tags in part])
            scores = np.zeros((n, length, 3))
            for k, (ids, _) in enumerate(part):
                scores[k, : len(ids)] = w[ids].sum(axis=1)
            ahead, behind = np.zeros((n, length, 3)), np.zeros((n, length, 3))
            ahead[:, 0] = chain[3] + scores[:, 0]
            for i in range(1, length):
                ahead[:, i] = np.where(there[:, i, None], _log_sum(ahead[:, i - 1, :, None] + chain[:3], 1) + scores[:, i], ahead[:, i - 1])
            for i in range(length - 2, -1, -1):
                behind[:, i] = np.where(there[:, i + 1, None], _log_sum(chain[:3] + (scores[:, i + 1] + behind[:, i + 1])[:, None, :], 2), 0.0)
            total = _log_sum(ahead[:, -1], 1)
            off = -np.exp(ahead + behind - total[:, None, None]) * there[:, :, None]
            slope, chain_slope = np.zeros_like(w), np.zeros_like(chain)
            both = np.exp(ahead[:, :-1, :, None] + chain[:3] + (scores + behind)[:, 1:, None, :] - total[:, None, None, None]) * there[:, 1:, None, None]
            chain_slope[:3] = -both.sum(axis=(0, 1))
            for k, (ids, tags) in enumerate(part):
                off[k, np.arange(len(tags)), tags] += 1
                np.add.at(slope, ids, off[k, : len(tags), None, :])
                np.add.at(chain_slope, (tags[:-1], tags[1:]), 1)
            chain_slope[3] = off[:, 0].sum(axis=0)
            for x, g, g2 in ((w, slope, seen), (chain, chain_slope, chain_seen)):
                g -= ridge * n * x
                g2 += g * g
                x += rate * g / np.sqrt(g2)
    model.weights, model.steps, model.starts = {f: w[i] for f, i in number.items()}, chain[:3].copy(), chain[3].copy()
    return model


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def sample_lines(text: str, seed: int) -> list[tuple[list[str], list[int], list[str]]]:
    """Stretches of a text to learn from: all with a base match, and one other."""
    spans, of, out, at, other = base_spans(text), file_features(text), [], 0, []
    for line in text.split("\n"):
        inside = []
        for start, end, kind in spans:
            if at <= start and end <= at + len(line):
                m = ASSIGN.match(text, start) if kind == "assign" else None
                inside.append(((m.start(2) if m else start) - at, end - at))
        if inside:
            out += [(*part, of) for part in stretched(*tags_of(line, inside)) if any(part[1])]
        elif line.strip():
            other.append(line)
        at += len(line) + 1
    if other:
        parts = stretched(*tags_of(other[seed % len(other)], []))
        out.append((*parts[seed % len(parts)], of))
    return out


def fit(docs: DataFrame, max_rows: int = FIT_ROWS, max_lines: int = FIT_LINES) -> Field:
    """Train on stretches of lines of at most about ``max_rows`` texts, chosen by a hash of the text, and on made lines.

    Half of at most ``max_lines`` stretches have a secret, as far as there are such. The order of
    lines comes from their text, so the same documents give the same field however they are split.
    """
    spread, n = 1 << 30, max(docs.count(), 1)
    texts = docs.select("text").filter("text is not null").filter(F.pmod(F.xxhash64("text", F.lit(11)), F.lit(spread)) < int(spread * min(1.0, max_rows / n))).dropDuplicates(["text"])
    schema = "tokens array<string>, tags array<int>, file array<string>"

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            found = [row for t in texts_of(batch) for row in sample_lines(t, len(t))]
            kinds = (pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.string()))
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in found], k) for i, k in enumerate(kinds)], names=["tokens", "tags", "file"])

        return run

    ranked = map_slices(texts, make, schema).withColumn("has", F.exists("tags", lambda t: t > 0)).withColumn("order", F.xxhash64("tokens"))
    rows = [r for has in (True, False) for r in ranked.filter(F.col("has") == has).orderBy("order", "tokens").limit(max_lines // 2).collect()]
    made = made_lines(random.Random(5), max_lines // 3)
    rng = random.Random(6)
    return train([(r["tokens"], r["tags"]) for r in rows] + made, [r["file"] for r in rows] + [[rng.choice(v) for v in FILE_VALUES] for _ in made])


class Finder:
    """Base matches and spans of the field in whole texts."""

    def __init__(self, model: Field, keep: int = MEMO_WORDS):
        self.model = model
        model.settle()
        edges = np.array([(EDGE, (0.0, 0.0))] * 2, SEEN).tobytes()
        shape, self.of_names = Memo(self.shape, keep), Memo(self.of_features, keep, 200)

        def seen(words: list[str]) -> list[bytes]:
            return [edges.join(b"".join([shape[t] for t in TOKEN.findall(part)]) for part in word.split("\n")) for word in words]

        self.seen = Kept(seen, keep)
        self.matches = Kept(lambda words: [bool(MAY_MATCH[0].search(w) or MAY_MATCH[1].search(w)) for w in words], keep)
        self.own = Memo(lambda token: model.emission(own(token)), keep)

    def shape(self, token: str) -> bytes:
        return self.of_names["\t".join(own(token))]

    def of_features(self, names: str) -> bytes:
        features = names.split("\t")
        return np.array([(ROLES.index(features[0][5:]), self.model.over(*features))], SEEN).tobytes()

    def hints(self, texts: list[str]) -> list[tuple[bool, bool]]:
        """Of each text: whether base patterns may match in it, and whether a token of it may gain."""
        words, at, first = word_table([t + " \n" for t in texts])
        seen, matches = self.seen(words), np.array(self.matches(words), bool)
        sizes = np.array([len(x) // SEEN.itemsize for x in seen], np.int64)
        table = np.frombuffer(b"".join(seen), SEEN)
        place = np.array(at, np.int64)
        length = sizes[place]
        ends = np.cumsum(length)
        # a word's tokens end at the sum of sizes up to it; its place's tokens end at the sum of lengths
        take = np.repeat(np.cumsum(sizes)[place] - ends, length) + np.arange(ends[-1] if len(ends) else 0)
        edge = np.full(2, EDGE, np.int64)
        roles = np.concatenate([edge, table["role"][take].astype(np.int64), edge])
        shapes = np.concatenate([np.zeros((2, 2)), table["shape"][take].astype(np.float64), np.zeros((2, 2))])
        gain = np.concatenate([[0], np.cumsum(self.model.may_gain(roles, shapes)[2:-2])])
        bounds = np.concatenate([[0], ends])[np.array(first, np.int64)]
        found = np.concatenate([[0], np.cumsum(matches[place])])[np.array(first, np.int64)]
        return list(zip((np.diff(found) > 0).tolist(), (np.diff(gain[bounds]) > 0).tolist(), strict=True))

    def spans_of(self, texts: list[str]) -> list[tuple[list[Span], list[Span]]]:
        """Of each text its base spans, and those the field adds."""
        out = []
        for text, (matches, gains) in zip(texts, self.hints(texts) if texts else [], strict=True):
            base = base_spans(text) if matches else []
            out.append((base, self.added(text, base) if gains else []))
        return out

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """The base spans of a text, and those the field adds."""
        return self.spans_of([text])[0]

    def tags(self, tokens: list[str], of_file: np.ndarray, always: bool = False) -> list[int]:
        """The tags of a line; without decoding, if no token may gain, unless ``always``."""
        roles = np.array([EDGE, EDGE, *[ROLES.index(role(t)) for t in tokens], EDGE, EDGE])
        scores = np.array([self.own[t] for t in tokens])
        shapes = np.concatenate([np.zeros((2, 2)), scores[:, [BEGIN, INSIDE]] - scores[:, [OUT]], np.zeros((2, 2))])
        if not always and not self.model.may_gain(roles, shapes).any():
            return [OUT] * len(tokens)
        for at, move in (("before", -1), ("before2", -2), ("after", 1)):
            of_role = np.array([self.model.emission([f"{at}={r}"]) for r in ROLES])
            scores = scores + of_role[roles[2 + move : len(roles) - 2 + move]]
        return self.model.viterbi(scores + of_file)

    def added(self, text: str, base: list[Span]) -> list[Span]:
        """The parts of the field's spans beyond the base spans."""
        found, at, of_file = [], 0, self.model.emission(file_features(text))
        for line in text.split("\n"):
            places = [(m.start() + at, m.end() + at) for m in TOKEN.finditer(line)]
            tags = self.tags([text[a:b] for a, b in places], of_file) if places else []
            for (a, b), tag in zip(places, tags, strict=True):
                if tag == BEGIN:
                    found.append([a, b])
                elif tag == INSIDE:
                    found[-1][1] = b
            at += len(line) + 1
        return [(a, b, "field") for span in found for a, b in beyond(text, *span, base)]


def scan(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """Spans of secrets in whole texts: doc_id, n_assign, n_access, n_hex, n_field, base_sha256, spans.

    ``spans`` has kind:start:end in code points, by start, then kind; ``base_sha256`` is the digest
    of the base spans alone. Of the field's spans, of any length, the parts outside of base spans are
    given. One scan without a shuffle after the fit. Null texts are empty; a text
    without secrets has counts of 0 and empty spans. Rows with equal or null doc_id each give a
    row; an empty table gives none; columns other than doc_id and text are ignored. A text is held
    whole; memory is bounded by a slice of texts (``SLICE_BYTES``) or one longer text, and the kept words.
    """
    model = model or fit(docs)

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        finder = Finder(model)

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for base, more in finder.spans_of(texts_of(batch)):
                n = Counter(s[2] for s in base)
                rows.append((n["assign"], n["access"], n["hex"], len(more), hashlib.sha256(joined(base).encode()).hexdigest(), joined(ordered(base + more))))
            columns = list(zip(*rows, strict=True)) or [()] * 6
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 4 + [pa.string()] * 2, strict=True)]], names=["doc_id", "n_assign", "n_access", "n_hex", "n_field", "base_sha256", "spans"])

        return run

    return map_slices(docs.selectExpr("cast(doc_id as bigint) doc_id", "text"), make, "doc_id long, n_assign long, n_access long, n_hex long, n_field long, base_sha256 string, spans string")


def masked(text: str, spans: list[Span], mask: str = "[SECRET]") -> str:
    """The text with each span, or run of overlapping spans, replaced."""
    out, at = [], 0
    for start, end, _ in ordered(spans):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join(out) + text[at:]


def without_secrets(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """The rows of ``docs``, all columns; secrets in ``text`` are masked and ``n_chars``, if there, is counted anew.

    A row without secrets stays as it is, a null text too; no row goes, whatever its doc_id. An
    empty table stays empty; columns of any other name are kept and not read. A text is held
    whole; memory is bounded by a slice of texts or one longer text.
    """
    model = model or fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = Finder(model, STAGE_WORDS)
        for part in slices(batches, STAGE_ROWS, STAGE_BYTES):
            texts = part.column("text").to_pylist()
            found = [base + more for base, more in finder.spans_of([t or "" for t in texts])]
            if any(found):
                new = [masked(t, f) if f else t for t, f in zip(texts, found, strict=True)]
                columns = list(part.columns)
                where = part.schema.get_field_index("text")
                columns[where] = pa.array(new, part.schema.field(where).type)
                if (k := part.schema.get_field_index("n_chars")) >= 0:
                    was = part.column(k).to_pylist()
                    columns[k] = pa.array([len(t) if f else w for t, f, w in zip(new, found, was, strict=True)], part.schema.field(k).type)
                part = pa.RecordBatch.from_arrays(columns, schema=part.schema)
            yield part
        del finder
        release()

    return docs.mapInArrow(run, docs.schema)
