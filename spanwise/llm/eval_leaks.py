"""Evaluation texts leaking into training text, by template canonicalisation.

Texts become words (maximal runs of letters and digits, case ignored). A
word's template is itself, or a typed placeholder: number, unit (a unit word
right after a number), name. Windows of `span` template words are hashed and
the documents' windows are joined to those of the evaluation items, so a
passage is found whatever its numbers, units or names are. Matched windows on
one diagonal are then checked on the words themselves: a run of `span` equal
words is a verbatim leak; a run whose slots differ but map one-to-one is a
re-parameterised one.

Names are told by a capital inside a sentence, which a verbatim copy may lack;
windows are therefore also hashed with names left as they are, and the first
word of a window is never a unit, so no verbatim passage depends on a guess.

The items are the build side: they are cut into blocks of a bounded number of
windows, each block is broadcast, and every document is read, tokenised and
judged in one pass per block. Documents are never shuffled.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, functions as F

from spanwise.llm.truncation import pieces

#: A word, or a mark that parts it from the word before it; blanks and commas don't.
TOKEN = re.compile(r"[^\W_]+|[^\w \t,]|_")

#: Unit words.
UNITS = frozenset("mm cm dm m km µm um nm in ft yd mi mg g kg t lb oz ms s sec min h hr d °c c f k hz khz mhz ghz v mv kv a ma w kw mw n kn pa kpa mpa bar db px dpi l ml kb mb gb tb".split())
_WORD, _NUMBER, _UNIT, _NAME = 0, 1, 2, 3
_DIGIT = re.compile(r"\d")
_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_CODES = np.array([xxhash.xxh64_intdigest(f"\x00{k}") for k in ("word", "number", "unit", "name")], np.uint64)


class Coder:
    """Texts as arrays of words: the 64-bit code of each word, its kind, and the place of its text; a million forms are remembered."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}
        self.codes: list[int] = []
        self.marks: list[int] = []

    def _learn(self, token: str) -> None:
        """marks: 1 has a digit, 2 a unit word, 4 capitalised and longer than one letter, 8 all capitals, 16 no word."""
        low = token.lower()
        marks = 1 if _DIGIT.search(token) else 2 if low in UNITS else 0
        marks |= 4 if len(token) > 1 and token[0].isupper() else 0
        marks |= 8 if token.isupper() else 0
        self.known[token] = len(self.codes)
        self.codes.append(xxhash.xxh64_intdigest(low))
        self.marks.append(marks if token[0].isalnum() else 16)

    def of(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(codes, kinds, text) of the words of all texts.

        A unit follows a number. A name has a capital and follows a word of its
        sentence, in a text that also has small letters: a text of capitals has
        no names, and its numbers and units alone are slots.
        """
        if len(self.known) > 1_000_000:
            self.__init__()
        tokens: list[str] = []
        sizes = []
        for t in texts:
            found = TOKEN.findall(t)
            tokens += found
            sizes.append(len(found))
        for t in set(tokens) - self.known.keys():
            self._learn(t)
        ids = np.fromiter(map(self.known.__getitem__, tokens), np.int64, len(tokens))
        text = np.repeat(np.arange(len(texts)), sizes)
        marks = np.array(self.marks, np.int8)[ids]
        word = marks < 16
        joined = np.append(False, word[:-1] & (text[1:] == text[:-1]))[: len(ids)]
        at = np.flatnonzero(word)
        codes, marks, text, joined = np.array(self.codes, np.uint64)[ids[at]], marks[at], text[at], joined[at]
        kinds = (marks & 1).astype(np.int8)
        after = np.append(False, (kinds[:-1] == _NUMBER) & (text[1:] == text[:-1]))[: len(at)]
        kinds[(marks & 2 > 0) & after] = _UNIT
        loud = np.bincount(text, marks & 8 > 0, len(texts)) > 0.5 * np.bincount(text, marks & 1 == 0, len(texts))
        kinds[(marks & 4 > 0) & (kinds == _WORD) & joined & ~loud[text]] = _NAME
        return codes, kinds, text


def _scrambled(codes: np.ndarray) -> np.ndarray:
    return (codes ^ (codes >> np.uint64(29))) * _MIX


def window_hashes(codes: np.ndarray, kinds: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash with names as they are, hash with names as placeholders, whether the latter counts) of every window of the words.

    A template of more than half slots tells nothing (a table of numbers): such a window is hashed on its words
    as they are, and doesn't count with names as placeholders.
    """
    n = len(codes) - span + 1
    unit = kinds == _UNIT  # no unit at the start of a window, as its number lies outside
    own = _scrambled(codes)
    plain = _scrambled(np.where((kinds == _NUMBER) | unit, _CODES[kinds], codes))
    masked = _scrambled(np.where(kinds > _WORD, _CODES[kinds], codes))

    def rolled(series: np.ndarray) -> np.ndarray:
        h = np.where(unit, own, series)[:n]
        for i in range(1, span):
            h = h * _M + series[i : i + n]
        return h ^ (h >> np.uint64(32))

    def held(flags: np.ndarray) -> np.ndarray:
        sums = np.append(0, np.cumsum(flags))
        return sums[span:] - sums[:n]

    named = held(kinds == _NAME)
    slots = held((kinds == _NUMBER) | unit) - unit[:n]
    dense = slots > span // 2
    first = rolled(plain)
    if dense.any():
        first = np.where(dense, rolled(own) ^ np.uint64(2), first)
    return first, rolled(masked) ^ np.uint64(1), (named > 0) & (slots + named <= span // 2)


def judge(a: np.ndarray, ak: np.ndarray, b: np.ndarray, bk: np.ndarray, shift: int, span: int) -> tuple[int, int, int]:
    """(verbatim, template, slots) on one diagonal of document a and item b (place in a is place in b plus shift).

    verbatim: the longest run of equal words; template: the longest run of
    consistent slots, one with replaced slots before one without; slots: how many differ there.
    """
    lo, hi = max(0, -shift), min(len(b), len(a) - shift)
    if hi <= lo:
        return 0, 0, 0
    x, y = b[lo:hi], a[lo + shift : hi + shift]
    kx, ky = bk[lo:hi], ak[lo + shift : hi + shift]
    equal = x == y
    verbatim = max((e - s for s, e in _runs(equal)), default=0)
    slots = (kx == ky) & (kx > _WORD)
    template = differ = 0
    for s, e in _runs(equal | slots):
        if e - s < min(span, template + 1) and differ:
            continue
        got = _consistent(x, y, kx, slots, equal, s, e)
        if (got[1] > 0, got[0]) > (differ > 0, template):
            template, differ = got
    return verbatim, template, differ


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist()))


def _consistent(x, y, kinds, slots, equal, s: int, e: int) -> tuple[int, int]:
    """(length, differing slots) of the best one-to-one run within [s, e); a conflict moves the start to just after the binding it conflicts with."""
    places = (np.flatnonzero(slots[s:e]) + s).tolist()
    replaced = np.append(0, np.cumsum(~equal[s:e]))
    start, best, forth, back = s, (0, 0), {}, {}

    def take(end: int) -> None:
        nonlocal best
        got = (end - start, int(replaced[end - s] - replaced[start - s]))
        if (got[1] > 0, got[0]) > (best[1] > 0, best[0]):
            best = got

    for j in places:
        k, p, q = int(kinds[j]), int(x[j]), int(y[j])
        moved = start
        for known, word, other in ((forth, p, q), (back, q, p)):
            value, place = known.get((k, word), (other, -1))
            if value != other:
                moved = max(moved, place + 1)
        if moved > start:
            take(j)
            start = moved
        forth[k, p], back[k, q] = (q, j), (p, j)
    take(e)
    return best


def _texts(items: DataFrame) -> DataFrame:
    """(item_id, text): one row for each item and text."""
    return items.select(F.col("item_id").cast("bigint").alias("item_id"), "text").where("text is not null and item_id is not null").distinct()


def _sized(span: int):
    """mapInPandas: adds the number of windows of each text, short texts left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n = [sum(t[0].isalnum() for t in TOKEN.findall(text)) - span + 1 for text in pdf["text"]]
            yield pdf.assign(windows=np.asarray(n, np.int64))[np.asarray(n) > 0]

    return run


class _Probes:
    """One block of items: sorted window hashes with their item and place, and the items' words."""

    def __init__(self, ids: list[int], texts: list[str], span: int) -> None:
        coder, hashes, owners, places, self.words, self.ids = Coder(), [], [], [], [], ids
        for i, text in enumerate(texts):
            codes, kinds, _ = coder.of([text])
            self.words.append((codes, kinds))
            plain, masked, named = window_hashes(codes, kinds, span)
            at = np.arange(len(plain), dtype=np.int32)
            for h, p in ((plain, at), (masked[named], at[named])):
                hashes.append(h)
                places.append(p)
                owners.append(np.full(len(h), i, np.int32))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owners, self.places = h[order], np.concatenate(owners)[order], np.concatenate(places)[order]
        # A quarter of a million bits that tell most misses at once.
        self.sieve = np.zeros(1 << 18, bool)
        self.sieve[(self.hashes & np.uint64((1 << 18) - 1)).astype(np.int64)] = True

    @classmethod
    def of(cls, parts: dict) -> _Probes:
        """From what vars() gives: broadcasts carry plain arrays, so that workers need no installed package to read them."""
        out = cls.__new__(cls)
        out.__dict__.update(parts)
        return out

    def met(self, hashes: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, probe) of equal hashes, of the given windows."""
        windows = windows[self.sieve[(hashes[windows] & np.uint64((1 << 18) - 1)).astype(np.int64)]]
        h = hashes[windows]
        low, high = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        n = high - low
        return np.repeat(windows, n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low, n)


def _scan(shared, span: int):
    """mapInPandas over documents: (doc_id, item, verbatim_words, template_words, differing_slots)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        probes, coder = _Probes.of(shared.value), Coder()
        for pdf in batches:
            ids, at = pdf["doc_id"].to_numpy(), 0
            for texts in pieces(pdf["text"].tolist()):
                out = _met(probes, coder, texts, span)
                if out:
                    found = np.array(out, np.int64)
                    yield pd.DataFrame({"doc_id": ids[at + found[:, 0]], "item": found[:, 1], **{c: found[:, 2 + i].astype(np.int32) for i, c in enumerate(("verbatim_words", "template_words", "differing_slots"))}})
                at += len(texts)

    return run


def _met(probes: _Probes, coder: Coder, texts: list[str], span: int) -> list[tuple[int, int, int, int, int]]:
    """(text, item, verbatim, template, slots) of the texts with windows of the block."""
    codes, kinds, text = coder.of(texts)
    if len(codes) < span:
        return []
    plain, masked, named = window_hashes(codes, kinds, span)
    inside = text[: len(plain)] == text[span - 1 :]
    w, p = probes.met(plain, np.flatnonzero(inside))
    w2, p2 = probes.met(masked, np.flatnonzero(inside & named))
    w, p = np.append(w, w2), np.append(p, p2)
    if not len(w):
        return []
    begin = np.searchsorted(text, np.arange(len(texts) + 1))
    owner = text[w]
    diagonals, met = np.unique(np.stack([owner, probes.owners[p], w - begin[owner] - probes.places[p]]), axis=1, return_counts=True)
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    # The diagonals with most windows first: a run of n words has n - span + 1 windows (twice, with names), so the rest may be too short to matter.
    order = np.argsort(-met, kind="stable")
    for (doc, item, shift), windows in zip(diagonals.T[order].tolist(), met[order].tolist()):
        if windows + span - 1 <= best.get((doc, item), (0,))[0]:
            continue
        own = slice(begin[doc], begin[doc + 1])
        v, t, d = judge(codes[own], kinds[own], *probes.words[item], shift, span)
        V, T, D = best.get((doc, item), (0, 0, 0))
        if (d > 0, t) <= (D > 0, T):
            t, d = T, D
        best[doc, item] = (max(v, V), t, d)
    return [(doc, probes.ids[item], *b) for (doc, item), b in best.items() if b[0] >= span or (b[1] >= span and b[2] > 0)]


def eval_leaks(documents: DataFrame, items: DataFrame, span: int = 13, block_windows: int = 1_000_000) -> DataFrame:
    """(doc_id, item_id, kind, verbatim_words, template_words, differing_slots) of documents with passages of items.

    kind is 'verbatim' where at least `span` consecutive words are equal, else
    'reparameterised' where as many agree but for consistently replaced
    numbers, units and names; a passage needs a window of which half at least are plain words. template_words is the longest such run with a
    replaced slot, or without one where there is none (of a verbatim pair: where a longer verbatim passage was looked for). Null, empty and shorter texts give no row; a
    repeated id counts as one document; items of one text are found once and told each.
    Blocks hold about `block_windows` windows (32 bytes each), a single item
    at least; the documents are read once for each block. Names are told by capitals: texts
    written wholly in capitals or small letters match re-parameterised names only where these are left as they are.
    """
    spark = documents.sparkSession
    given = _texts(items).mapInPandas(_sized(span), "item_id long, text string, windows long")
    classes = given.groupBy("text").agg(F.min("item_id").alias("item"), F.first("windows").alias("windows"))
    total, longest = classes.agg(F.sum("windows"), F.max("windows")).first()
    schema = "doc_id long, item long, verbatim_words int, template_words int, differing_slots int"
    if not total:
        out = spark.createDataFrame([], schema)
    else:
        # An item's text is read whole; hashed blocks hold the bound on average, one of several spreads little.
        blocks = max(1, math.ceil(total / block_windows))
        docs = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null and doc_id is not null")
        out = spark.createDataFrame([], schema)
        for block in range(blocks):
            own = classes.where(F.pmod(F.xxhash64("text"), F.lit(blocks)) == block) if blocks > 1 else classes
            rows = own.select("item", "text").collect()
            if not rows:
                continue
            shared = spark.sparkContext.broadcast(vars(_Probes([r.item for r in rows], [r.text for r in rows], span)))
            found = docs.mapInPandas(_scan(shared, span), schema)
            out = found if blocks == 1 else out.unionByName(found)
    members = given.join(classes.select("text", "item"), "text").select("item", "item_id")
    out = out.join(members, "item").groupBy("doc_id", "item_id").agg(
        F.max("verbatim_words").alias("verbatim_words"),
        F.max(F.struct(F.col("differing_slots") > 0, "template_words", "differing_slots")).alias("t"),
    )
    kind = F.when(F.col("verbatim_words") >= span, "verbatim").otherwise("reparameterised")
    return out.select("doc_id", "item_id", kind.alias("kind"), "verbatim_words", F.col("t.template_words").alias("template_words"), F.col("t.differing_slots").alias("differing_slots"))


def leak_report(documents: DataFrame, items: DataFrame, span: int = 13) -> DataFrame:
    """Per item that leaked: documents with it verbatim and re-parameterised, and the longest passage."""
    leaks = eval_leaks(documents, items, span)
    return leaks.groupBy("item_id").agg(
        F.count_if(F.col("kind") == "verbatim").alias("verbatim_documents"),
        F.count_if(F.col("kind") == "reparameterised").alias("reparameterised_documents"),
        F.max("verbatim_words").alias("longest_passage"),
    )
