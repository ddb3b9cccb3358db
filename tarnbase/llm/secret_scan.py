"""Secret scans: fixed patterns, and character Markov models of random strings against ordinary identifiers.

Two first-order character models are estimated from labelled samples. They judge every run of `[A-Za-z0-9+/_=-]`, or what a pattern's span leaves of it, of
`STRETCH_LEAST` characters: it is a span of kind `random` if its log-likelihood ratio per character is above `THRESHOLD` and, where it is short or lacks digits or letters, so that a
word could reach that by chance, its sum is above `TOTAL`. Of others each piece between `=` is judged in the same way, and then by its
best stretch: a stretch whose ratios sum to `STRETCH` (`TOTAL` for the others) or more is a span, widened to the next `/`, so names and paths in front of a secret don't hide it.
Texts pass through Arrow batches, one at a time.

Defined cases: a null text has no spans; spans are code points, end exclusive; very long texts are scanned whole; equal rows give equal rows; an
empty table gives an empty table; other columns may have any name.
"""

from __future__ import annotations

import base64
import hashlib
import math
import random
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("assign", "access", "hex", "random")
# The patterns of the base spans and the least length of what they hold.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
_NAMES = ("passw", "secret", "token", "api")
#: Tokens that the models judge; from `LONG` characters with a digit and a letter on the ratio per character suffices.
TOKEN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
THRESHOLD, LONG = 0.25, 20
#: Least sum of log ratios of a random stretch inside a token, its least length, and the least sum of short tokens and those without digits or letters.
STRETCH, STRETCH_LEAST, TOTAL = 10.0, 12, 16.0
PIECE = re.compile(r"[^=]+")
_CLASS = str.maketrans({c: "x" for c in "+/=-_"})
# Words that identifiers are made of.
IDENTIFIER_WORDS = (
    "account active address admin array backup batch buffer build cache call catalog change channel check child client close cluster code column "
    "commit compare config connect content context control convert copy count create current data date default delete device document domain download "
    "element email enable engine entry error event exception execute export factory field file filter find first flag format frame function gateway "
    "global group handle handler header height history host image import index info initial input insert instance integer internal item job join key label "
    "language last layer layout length level library license limit line link list listener load local location lock log login machine main manager map "
    "master match maximum member memory merge message method metric minimum mode model module monitor name network next node notify number object "
    "offset open operation option order output owner package page parent parse partition path pattern payment pending pipeline plan player point policy "
    "pool port position prefix previous print private process product profile project property provider public queue random range read record register "
    "release remote remove render report request reset resource response result retry return role root route row rule run sample save schedule schema scope "
    "search select send sequence server service session setting shape shared signal simple size source stack start state static status step storage store "
    "stream string struct style submit suffix summary switch system table target task template test text thread time title total trace transaction transform "
    "tree trigger type unique update upload user utility valid value vector version view visible warning widget width window worker write zone"
).split()


def samples(n: int = 4000, seed: int = 20) -> list[tuple[str, int]]:
    """Labelled strings (1: random, 0: identifier), generated from a seed; any other labelled list does as well."""
    rng, out = random.Random(seed), []
    join = ("_", "-", "")
    for i in range(n):
        raw = rng.randbytes(rng.randrange(12, 40))
        out.append(([base64.b64encode(raw).decode(), raw.hex(), base64.b32encode(raw).decode(), base64.urlsafe_b64encode(raw).decode()][i % 4], 1))
        words = rng.choices(IDENTIFIER_WORDS, k=rng.randrange(2, 6))
        if i % 3 == 0:
            words = [words[0], *(w.title() for w in words[1:])]
        s = join[i % 3].join(words) if i % 3 else "".join(words)
        if i % 4 == 0:
            s = s.upper()
        if rng.random() < 0.6:
            s += rng.choice(join) + rng.choice((str(rng.randrange(100)), f"{rng.randrange(1990, 2030)}-{rng.randrange(1, 13):02d}-{rng.randrange(1, 29):02d}", f"v{rng.randrange(9)}", str(rng.randrange(10**6))))
        out.append((s, 0))
    return out


@dataclass(frozen=True)
class Markov:
    """log P(char | the one before) of both labels, with add-`smooth` smoothing over the alphabet."""

    ratio: dict[str, float]
    unseen: dict[str, float]
    other: float

    @classmethod
    def train(cls, labelled: Iterable[tuple[str, int]], smooth: float = 0.5) -> Markov:
        count: list[dict[str, int]] = [{}, {}]
        before: list[dict[str, int]] = [{}, {}]
        alphabet = set()
        for s, y in labelled:
            t = "^" + s.translate(_CLASS)
            alphabet.update(t)
            for i in range(1, len(t)):
                count[y][t[i - 1 : i + 1]] = count[y].get(t[i - 1 : i + 1], 0) + 1
                before[y][t[i - 1]] = before[y].get(t[i - 1], 0) + 1
        a = max(1, len(alphabet))
        p = lambda y, g: math.log((count[y].get(g, 0) + smooth) / (before[y].get(g[0], 0) + smooth * a))
        ratio = {g: p(1, g) - p(0, g) for g in {*count[0], *count[1]}}
        pairs = {*before[0], *before[1]}
        return cls(ratio, {b: p(1, b + "\0") - p(0, b + "\0") for b in pairs}, 0.0)

    def score(self, s: str) -> float:
        """Log-likelihood ratio per character; positive: rather random."""
        if not s:
            return 0.0
        t = "^" + s.translate(_CLASS)
        got = self.ratio.get
        total = 0.0
        for i in range(1, len(t)):
            g = t[i - 1 : i + 1]
            x = got(g)
            total += self.unseen.get(g[0], self.other) if x is None else x
        return total / len(s)

    def stretch(self, s: str) -> tuple[float, int, int]:
        """(sum, start, end) of the stretch of `s` whose log ratios sum to most."""
        t = "^" + s.translate(_CLASS)
        best, total, start = (0.0, 0, 0), 0.0, 0
        for i in range(1, len(t)):
            if total <= 0:
                total, start = 0.0, i - 1
            x = self.ratio.get(t[i - 1 : i + 1])
            total += self.unseen.get(t[i - 1], self.other) if x is None else x
            if total > best[0]:
                best = (total, start, i)
        return best


def random_parts(s: str, model: Markov, threshold: float = THRESHOLD) -> list[tuple[int, int]]:
    """(start, end) of the random parts of a token: itself, or pieces and stretches of it."""

    def least(x: str) -> float:
        return STRETCH if len(x) >= LONG and any(c.isdigit() for c in x) and any(c.isalpha() for c in x) else TOTAL

    def whole(x: str) -> bool:
        mean = model.score(x)
        return mean > threshold and (least(x) == STRETCH or mean * len(x) >= TOTAL)

    if not any(c.isalnum() for c in s):
        return []
    if whole(s):
        return [(0, len(s))]
    found, todo = [], [(m.start(), m.end(), True) for m in PIECE.finditer(s)]
    while todo:
        a, b, first = todo.pop()
        if b - a < STRETCH_LEAST:
            continue
        total, start, end = model.stretch(s[a:b])
        if total < least(s) or end - start < STRETCH_LEAST:
            continue
        if first and whole(s[a:b]):
            found.append((a, b))
            continue
        left, right = max(a, s.rfind("/", a, a + start) + 1), s.find("/", a + end, b)
        right = b if right < 0 else right
        found.append((left, right))
        todo += [(a, left, False), (right, b, False)]
    # Padding belongs to what it ends.
    return sorted((a, len(s) if not s[b:].strip("=") else b) for a, b in found)


def outside(start: int, end: int, base: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What the sorted spans leave of a stretch."""
    out = []
    for a, b in base:
        if b > start and a < end:
            if a > start:
                out.append((start, a))
            start = max(start, b)
    return [*out, (start, end)] if start < end else out


def scan(text: str | None, model: Markov | None = None, threshold: float = THRESHOLD) -> list[tuple[str, int, int]]:
    """(kind, start, end) of every span, by start and then kind. Without a model: the base spans."""
    if not text:
        return []
    found: list[tuple[str, int, int]] = []
    low = text.lower()
    if any(x in low for x in _NAMES):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    if model is not None:
        base = sorted((s, e) for _, s, e in found)
        for m in TOKEN.finditer(text):
            for a, b in outside(m.start(), m.end(), base) if base else ((m.start(), m.end()),):
                if b - a >= STRETCH_LEAST:
                    found += [("random", a + x, a + y) for x, y in random_parts(text[a:b], model, threshold)]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def joined(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


def masked(text: str | None, spans: list[tuple[str, int, int]], mark: str = "[SECRET]") -> str | None:
    """The text with each span replaced; of an assignment the name stays."""
    if text is None or not spans:
        return text
    holes: list[list[int]] = []
    for kind, start, end in spans:
        if kind == "assign":
            start = start + ASSIGN.match(text, start, end).start(2) - start
        if holes and start <= holes[-1][1]:
            holes[-1][1] = max(holes[-1][1], end)
        else:
            holes.append([start, end])
    out, at = [], 0
    for start, end in holes:
        out += [text[at:start], mark]
        at = end
    return "".join([*out, text[at:]])


def find_secrets(docs: DataFrame, labelled: Iterable[tuple[str, int]] | None = None, with_text: bool = True) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of every row, and the text `masked` if that is wanted."""
    model = Markov.train(labelled if labelled is not None else samples())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, digests, spans, texts = {k: [] for k in KINDS}, [], [], []
            for t in b.column(1):
                text = t.as_py()
                found = scan(text, model)
                for k in KINDS:
                    counts[k].append(sum(x[0] == k for x in found))
                digests.append(hashlib.sha256(joined(x for x in found if x[0] != "random").encode()).hexdigest())
                spans.append(joined(found))
                if with_text:
                    texts.append(masked(text, found))
            arrays = [b.column(0), *(pa.array(counts[k], pa.int64()) for k in KINDS), pa.array(digests, pa.string()), pa.array(spans, pa.string())]
            names = ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"]
            yield pa.RecordBatch.from_arrays([*arrays, pa.array(texts, pa.string())] if with_text else arrays, names=[*names, "masked"] if with_text else names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, " + ", ".join(f"n_{k} bigint" for k in KINDS) + ", base_sha256 string, spans string" + (", masked string" if with_text else "")
    return docs.select("doc_id", "text").mapInArrow(run, schema)


def mask_secrets(docs: DataFrame, labelled: Iterable[tuple[str, int]] | None = None) -> DataFrame:
    """The same rows and columns, with `text` masked and `n_chars`, if there and not null, counted anew."""
    model = Markov.train(labelled if labelled is not None else samples())
    names, at = docs.columns, docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [masked(t, scan(t, model)) for t in (x.as_py() for x in b.column(at))]
            columns = [pa.array(texts, b.schema.field(at).type) if i == at else b.column(i) for i in range(b.num_columns)]
            yield pa.RecordBatch.from_arrays(columns, schema=b.schema)

    out = docs.mapInArrow(run, docs.schema)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in names])
