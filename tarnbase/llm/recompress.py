"""Substring dedup by recompression.

A document's words become symbols (64-bit names). Rounds of recompression then shorten it: runs of one symbol become one symbol, and where a symbol of
the left half of the alphabet stands before one of the right half (a hash bit of the symbol and the round decides) the pair
becomes one symbol. Names are hashes of what they stand for, so they are global without any exchange: equal substrings get
equal interior symbols wherever they stand. With each symbol goes the extent of words that its forming depended on.

A window of `WINDOW` words that is repeated repeats every symbol whose extent lies inside it. So:
1. Spark counts the top symbols of all documents (each group of documents sends a name once, marked if it has it twice);
2. windows around a symbol that occurs once are ruled out;
3. Spark counts the exact names of the windows left over (64 bits, in one of many classes by another hash), and
4. covered words are removed.
Names travel in binary blocks of eight bytes each, and answers as one bit per name. The same exchange of the texts serves both passes.

Defined cases: a null text has no words; documents below `WINDOW` words lose nothing; exact copies lose all words but what no
window covers; equal rows and equal or null doc_ids are documents of their own; an empty table gives an empty table;
other columns may have any name (they are not read).
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW = 35
ROUNDS = 6
GROUP_BYTES = 1 << 20
CLASS_BYTES = 16 << 20
CACHE_WORDS = 200_000
_U = np.uint64
_C1, _C2, _C3, _C4 = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0xFF51AFD7ED558CCD), _U(0xC4CEB9FE1A85EC53)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(33))) * _C3
    x = (x ^ (x >> _U(29))) * _C4
    return x ^ (x >> _U(32))


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return _mix(a * _C1 + (b ^ (b >> _U(31))) * _C2 + _C4)


class Words(dict):
    """64-bit names of words, remembered up to a bound for as long as the worker lives."""

    def __missing__(self, word: bytes) -> int:
        name = self[word] = xxhash.xxh3_64_intdigest(word)
        return name

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > CACHE_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


_NAMES = Words()


def symbols(ids: np.ndarray, doc: np.ndarray, rounds: int = ROUNDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, first word, last word + 1 of the extent it depends on) of the symbols after all rounds.

    `doc` has the document of each word (equal neighbours belong together). The place before a document's first word and the one after its last
    belong to the extents that depend on them.
    """
    sym, lo, hi, doc = ids, np.arange(len(ids), dtype=np.int32), np.arange(1, len(ids) + 1, dtype=np.int32), doc.astype(np.int32)
    for k in range(rounds):
        if not len(sym):
            break
        joins = doc[1:] == doc[:-1]  # symbol i and i + 1 are of one document
        if k % 3 == 0:
            first = np.flatnonzero(np.r_[True, ~(joins & (sym[1:] == sym[:-1]))])
            length = np.diff(np.r_[first, len(sym)])
            last = first + length - 1
            left, right = np.r_[False, joins][first], np.r_[joins, False][last]
            before, after = np.maximum(first - 1, 0), np.minimum(last + 1, len(sym) - 1)
            nlo, nhi = np.minimum(lo[first], lo[last]), np.maximum(hi[first], hi[last])
            nlo = np.where(left, np.minimum(nlo, lo[before]), nlo - 1)
            nhi = np.where(left, np.maximum(nhi, hi[before]), nhi)
            nhi = np.where(right, np.maximum(nhi, hi[after]), nhi + 1)
            nlo = np.where(right, np.minimum(nlo, lo[after]), nlo)
            sym, lo, hi, doc = np.where(length > 1, _pair(sym[first], length.astype(np.uint64) + _C2), sym[first]), nlo, nhi, doc[first]
            joins = doc[1:] == doc[:-1]
        left_half = (_mix(sym + _U((2 * k + 1) * int(_C1) % (1 << 64))) & _U(1)).astype(bool)
        pair = np.zeros(len(sym), bool)
        pair[:-1] = joins & left_half[:-1] & ~left_half[1:]
        stay = np.ones(len(sym), bool)
        stay[1:] = ~pair[:-1]
        # A pair depends on its two symbols; a left symbol that stays alone on the next one, a right one on the one before.
        after, before = left_half.copy(), ~left_half
        after[:-1] &= joins
        before[1:] &= joins
        after[-1] = before[0] = False
        nlo, nhi = lo.copy(), hi.copy()
        np.minimum(nlo[:-1], lo[1:], out=nlo[:-1], where=after[:-1])
        np.maximum(nhi[:-1], hi[1:], out=nhi[:-1], where=after[:-1])
        np.minimum(nlo[1:], lo[:-1], out=nlo[1:], where=before[1:])
        np.maximum(nhi[1:], hi[:-1], out=nhi[1:], where=before[1:])
        nhi += left_half & ~after
        nlo -= ~left_half & ~before
        at = np.flatnonzero(pair)
        sym = sym.copy()
        sym[at] = _pair(sym[at], sym[at + 1])
        sym, lo, hi, doc = sym[stay], nlo[stay], nhi[stay], doc[stay]
    return sym, lo, hi


def window_names(ids: np.ndarray, doc: np.ndarray, width: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, name, second name) of the windows inside one document, by doubling."""
    n = len(ids) - width + 1
    if n <= 0:
        none = np.zeros(0, np.uint64)
        return np.zeros(0, np.int64), none, none
    out = []
    for salt in (_C1, _C3):
        power, size, have, at = _mix(ids + salt), 1, None, 0
        left = width
        while left:
            if left & 1:
                part = power[at : at + n]
                have = part if have is None else _pair(have, part)
                at += size
            left >>= 1
            if left:
                power = _pair(power[:-size], power[size:])
                size *= 2
        out.append(have[:n])
    start = np.flatnonzero(doc[:n] == doc[width - 1 :])
    return start, out[0][start], out[1][start]


class Group:
    """The documents of one group: words, names and document of each word."""

    def __init__(self, texts: list[str | None], names: Words = _NAMES):
        self.words = [(t or "").encode("utf-8", "surrogatepass").split() for t in texts]
        self.lengths = np.array([len(w) for w in self.words], np.int64)
        self.flat = [x for w in self.words for x in w]
        self.ids = names.of(self.flat)
        self.doc = np.repeat(np.arange(len(texts)), self.lengths)

    def top(self, width: int, rounds: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sym, lo, hi = symbols(self.ids, self.doc, rounds)
        fits = hi - lo <= width
        return sym[fits], lo[fits], hi[fits]

    def windows(self, width: int, lone_lo: np.ndarray, lone_hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows without a symbol that occurs only once (`lone_*`: the extents of those)."""
        start, a, b = window_names(self.ids, self.doc, width)
        out = np.zeros(len(self.ids) + 2, np.int64)
        np.add.at(out, np.maximum(lone_hi - width, 0), 1)
        np.add.at(out, np.clip(lone_lo + 1, 0, len(out) - 1), -1)
        open_ = np.cumsum(out)[start] == 0
        return start[open_], a[open_], b[open_]


def _blocks(group: int, names: np.ndarray, classes: np.ndarray) -> pa.Table:
    """One row per class: the sorted distinct names as bytes, and a bit for each that is there twice."""
    order = np.lexsort((names, classes))
    names, classes = names[order], classes[order]
    fresh = np.r_[True, (names[1:] != names[:-1]) | (classes[1:] != classes[:-1])] if len(names) else np.zeros(0, bool)
    at = np.flatnonzero(fresh)
    twice = np.diff(np.r_[at, len(names)]) > 1
    names, classes = names[at], classes[at]
    ends = np.flatnonzero(np.r_[classes[1:] != classes[:-1], True]) + 1 if len(names) else np.zeros(0, np.int64)
    rows, begin = [], 0
    for end in ends.tolist():
        rows.append((int(classes[begin]), group, names[begin:end].astype("<u8").tobytes(), np.packbits(twice[begin:end]).tobytes()))
        begin = end
    columns = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], names=["class", "group", "names", "twice"])


_BLOCK = "class bigint, group bigint, names binary, twice binary"


def repeated(blocks: DataFrame, as_names: bool = False) -> DataFrame:
    """(class, group, hit): the names of each block that occur twice in all blocks together, as a bit for each name or as the names themselves."""

    def run(t: pa.Table) -> pa.Table:
        names = [np.frombuffer(x, "<u8") for x in t.column("names").to_pylist()]
        twice = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(n)) for x, n in zip(t.column("twice").to_pylist(), names)]
        flat = np.concatenate(names)
        order = np.argsort(flat, kind="stable")
        ordered, marks = flat[order], np.concatenate(twice)[order].astype(bool)
        same = ordered[1:] == ordered[:-1]
        # A name marked as double in one block and present in another is an equal neighbour there.
        back = np.zeros(len(flat), bool)
        back[order] = np.r_[False, same] | np.r_[same, False] | marks
        ends = np.cumsum([len(n) for n in names])
        parts = np.split(back, ends[:-1])
        out = [n[x].tobytes() for n, x in zip(names, parts)] if as_names else [np.packbits(x).tobytes() for x in parts]
        return pa.table([t.column("class"), t.column("group"), pa.array(out, pa.binary())], names=["class", "group", "hit"])

    return blocks.groupBy("class").applyInArrow(run, "class bigint, group bigint, hit binary")


def _among(names: np.ndarray, classes: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Whether each (name, class) is among those of the replies."""
    found = [(int(c), np.frombuffer(h, "<u8")) for c, h in zip(replies.column("class").to_pylist(), replies.column("hit").to_pylist()) if h]
    out = np.zeros(len(names), bool)
    if not found or not len(names):
        return out
    held, of = np.concatenate([h for _, h in found]), np.concatenate([np.full(len(h), c) for c, h in found])
    order = np.lexsort((of, held))
    held, of = held[order], of[order]
    at = np.searchsorted(held, names)
    while True:  # one step but for names of several classes
        here = np.minimum(at, len(held) - 1)
        match = (at < len(held)) & (held[here] == names)
        out |= match & (of[here] == classes)
        if not (match & ~out).any():
            return out
        at = at + 1


def _lookup(names: np.ndarray, classes: np.ndarray, replies: pa.Table) -> np.ndarray:
    """Whether each name is repeated, from the replies to this group's blocks."""
    order = np.lexsort((names, classes))
    sorted_names, sorted_classes = names[order], classes[order]
    fresh = np.r_[True, (sorted_names[1:] != sorted_names[:-1]) | (sorted_classes[1:] != sorted_classes[:-1])] if len(names) else np.zeros(0, bool)
    of_class = {c: h for c, h in zip(replies.column("class").to_pylist(), replies.column("hit").to_pylist())}
    present, counts = np.unique(sorted_classes[fresh], return_counts=True)
    bits = [np.unpackbits(np.frombuffer(of_class[int(c)], np.uint8), count=int(n)) for c, n in zip(present, counts)]
    distinct = np.concatenate(bits).astype(bool) if bits else np.zeros(0, bool)
    out = np.zeros(len(names), bool)
    out[order] = distinct[np.cumsum(fresh) - 1]
    return out


def input_bytes(docs: DataFrame) -> int:
    """Bytes of all texts."""
    return int(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0)


def remove_repeats(docs: DataFrame, width: int = WINDOW, rounds: int = ROUNDS, group_bytes: int = GROUP_BYTES, class_bytes: int = CLASS_BYTES) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, kept) of every row; `kept` is the text that stays, words joined by one space."""
    size = input_bytes(docs)
    groups, classes = max(1, math.ceil(size / group_bytes)), max(8, math.ceil(size / class_bytes))
    kind = docs.schema["doc_id"].dataType.simpleString()
    dealt = docs.select("doc_id", "text").withColumn("group", F.expr(f"pmod(xxhash64(doc_id, text), {groups}L)"))
    n_parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), min(groups, 1 << 20) // 16)
    dealt = dealt.repartition(n_parts, "group")
    of = _U(classes)

    def load(t: pa.Table) -> Group:
        return Group(t.column("text").to_pylist())

    def top_blocks(t: pa.Table) -> pa.Table:
        g = load(t)
        sym, _, _ = g.top(width, rounds)
        return _blocks(t.column("group")[0].as_py(), sym, (_mix(sym ^ _C2) % of).astype(np.int64))

    def left_windows(g: Group, replies: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        sym, lo, hi = g.top(width, rounds)
        hit = _lookup(sym, (_mix(sym ^ _C2) % of).astype(np.int64), replies)
        start, a, b = g.windows(width, lo[~hit], hi[~hit])
        return start, a, (b % of).astype(np.int64)

    def window_blocks(t: pa.Table, replies: pa.Table) -> pa.Table:
        if not t.num_rows:
            return _blocks(0, np.zeros(0, np.uint64), np.zeros(0, np.int64))
        start, a, c = left_windows(load(t), replies)
        return _blocks(t.column("group")[0].as_py(), a, c)

    def cleaned(t: pa.Table, replies: pa.Table) -> pa.Table:
        g = load(t) if t.num_rows else Group([])
        start, a, b = window_names(g.ids, g.doc, width) if replies.num_rows else window_names(g.ids[:0], g.doc[:0], width)
        found = start[_among(a, (b % of).astype(np.int64), replies)]
        edge = np.zeros(len(g.flat) + width + 1, np.int64)
        np.add.at(edge, found, 1)
        np.add.at(edge, found + width, -1)
        gone = np.cumsum(edge)[: len(g.flat)] > 0
        removed, digests, texts, at = [], [], [], 0
        for w, n in zip(g.words, g.lengths.tolist()):
            mask = gone[at : at + n]
            at += n
            lost = int(mask.sum())
            kept = b" ".join(w if not lost else [x for x, m in zip(w, mask.tolist()) if not m])
            removed.append(lost)
            digests.append(hashlib.sha256(kept).hexdigest())
            texts.append(kept.decode("utf-8", "surrogatepass"))
        ids = t.column("doc_id") if t.num_rows else pa.array([], t.schema.field("doc_id").type)
        return pa.table([ids, pa.array(g.lengths, pa.int64()), pa.array(removed, pa.int64()), pa.array(digests, pa.string()), pa.array(texts, pa.string())], names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])

    tops = repeated(dealt.groupBy("group").applyInArrow(top_blocks, _BLOCK))
    exact = repeated(dealt.groupBy("group").cogroup(tops.groupBy("group")).applyInArrow(window_blocks, _BLOCK), as_names=True)
    schema = f"doc_id {kind}, n_words bigint, n_removed bigint, kept_sha256 string, kept string"
    return dealt.groupBy("group").cogroup(exact.groupBy("group")).applyInArrow(cleaned, schema)
