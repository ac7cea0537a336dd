"""Texts cut off by field limits or in transfer.

Per source, histograms of the lengths in characters and in bytes are tested
for a spike at the maximum: a field limit. Values at a spike length without
terminal punctuation are flagged (`by_limit`), unless a check proves their ending
whole: a list entry or closing line may fill the field by chance.

Cuts in transfer have no common length. For values elsewhere a second, separate
test judges the ending (`by_ending`): whether it is whole is learned from all
texts, by how often its last token, after the same one to three tokens, ended a
sentence or line elsewhere, against how often a sentence went on there or the
token was only the beginning of a longer word. Closing remarks, log lines,
readings and file names, which no full stop follows, show by closing several
different texts.

The documents are read twice: once for their lengths and endings, once for the
tokens in the contexts that endings ask about. A bitmap of fixed size keeps the
rest of the tokens out of the shuffle; it can only let too many through.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window, functions as F

from spanwise.functions.text import unify_source
from spanwise.operators.skew import hot_keys, lookup
from spanwise.session import cut

_TOKEN = re.compile(r"\d+(?:[.,:]\d+)*|[^\W\d_]+|\n+|[.!?]+(?=[\s\"')\]]|$)|[^\w\s]|_")
#: Marks that a system appends where it cut a text, as patterns.
APPENDED = (
    r"\s", "…", r"\.{3,}", "�", r"\x00", "&hellip;",
    r"[\[(<{]\s*(?:\.{3}|…|cut|cut off|truncated|more|continued|cont\.?|snip)\s*[\])>}]", r"(?:read|show|see) more",
)
#: Marks that close a text, may follow those, and can't end one.
_STOPS, _CLOSERS, _OPENERS = frozenset(".!?"), "\"'”’»)]", frozenset(",;:([{</\\&+=–—-")
_BULLETS = ("-", "*", "•", "–", "·")
ENDS = ("\n", ".", "!", "?")
UNITS = ("chars", "bytes", "body_chars", "body_bytes")

_M = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_START = np.uint64(xxhash.xxh64_intdigest("\x00start"))
_KINDS = np.array([xxhash.xxh64_intdigest("\x00prose"), xxhash.xxh64_intdigest("\x00entry")], np.uint64)
#: Prefixes up to this length are joined by equality, longer ones by their first so many letters and a check.
_PREFIX = 40


#: The longest single mark, in characters; any number of them may follow each other.
_MARK = 64


def stripped(marks: tuple[str, ...]) -> re.Pattern:
    return re.compile("(?:" + "|".join(marks) + ")+$", re.I)


def ending(text: str, marks: re.Pattern) -> tuple[str, bool, bool]:
    """(text without appended marks, whether it is closed by punctuation, whether it stops at a mark that can't end a text)."""
    size, body = _MARK, text
    while found := marks.search(text[-size:]):
        body = text[: max(len(text) - size, 0) + found.start()]
        if found.start() >= _MARK or size >= len(text):
            break
        size *= 4  # marks may go on before what was searched
    inner = body.rstrip(_CLOSERS)
    closed = inner[-1:] in _STOPS and not (body[-1:] == "." and body[-2:-1].isdecimal())
    return body, closed, body[-1:] in _OPENERS


def pieces(texts: list[str], limit: int = 8_000_000) -> Iterator[list[str]]:
    """Runs of texts of about `limit` characters, one text at least."""
    run, size = [], 0
    for t in texts:
        run.append(t)
        size += len(t)
        if size >= limit:
            yield run
            run, size = [], 0
    if run:
        yield run


def last_unit(body: str) -> list[str]:
    """The tokens of the last sentence or line that has any, numbers written 9; nothing before it is tokenised."""
    end = len(body)
    while end > 0:
        at = max(body.rfind(c, 0, end) for c in ENDS)
        while at > 0 and body[at] == "." and body[at - 1].isdecimal() and at + 1 < len(body) and body[at + 1].isdecimal():
            at = max(body.rfind(c, 0, at) for c in ENDS)  # a point inside a number
        tokens = _TOKEN.findall(body, at + 1, end)
        if tokens:
            return ["9" if t[0].isdigit() else t.lower() for t in tokens]
        end = at
    return []


def _mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x = (a * _M) ^ b
    return (x ^ (x >> np.uint64(31))) * _MIX


def contexts(kind: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes of the three, two and one tokens before a token (c is next to it)."""
    one = _mix(kind, c)
    two = _mix(one + np.uint64(1), b)
    return _mix(two + np.uint64(1), a), two, one


def _code(token: str) -> int:
    return xxhash.xxh64_intdigest(token)


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, np.uint64).view(np.int64)


_TAIL = ["doc_id", "source", *UNITS, "broken", "punctuated", "token", "context3", "context2", "context1", "tail", "body"]


def _endings(marks: tuple[str, ...]):
    """mapInPandas: endings that punctuation doesn't close (n is null), and counts n of lengths by source, unit and length."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern = stripped(marks)
        for pdf in batches:
            out, before, sizes = [], [], Counter()
            for i, source, text in zip(pdf["doc_id"], pdf["source"], pdf["text"]):
                if not text or not text.strip():
                    continue
                body, closed, broken = ending(text, pattern)
                n, size = len(text), len(text.encode())
                lengths = (n, size, len(body), size if len(body) == n else len(body.encode()))
                for unit, length in enumerate(lengths):
                    sizes[source, unit, length] += 1
                if closed or not body:
                    continue
                tail = ["\x00"] if body[-1] in ".!?" else last_unit(body)
                if not tail:
                    continue
                p = [_START] * 3 + [np.uint64(_code(t)) for t in tail[-4:-1]]
                before.append((_KINDS[int(tail[0] in _BULLETS)], *p[-3:]))
                out.append((i, source, *lengths, broken, body[-1] in ".!?", tail[-1], 0, 0, 0, _code("\x01".join(tail)) - (1 << 63), _code(text) - (1 << 63)))
            if out:
                rows = pd.DataFrame(out, columns=_TAIL)
                for name, x in zip(("context3", "context2", "context1"), contexts(*np.array(before, np.uint64).T)):
                    rows[name] = _signed(x)
                yield rows.assign(unit=None, length=None, n=None)
            if sizes:
                k = list(sizes)
                rows = pd.DataFrame({"source": [x[0] for x in k], "unit": [x[1] for x in k], "length": [x[2] for x in k], "n": list(sizes.values())})
                yield rows.assign(**{c: None for c in _TAIL if c != "source"})[[*_TAIL, "unit", "length", "n"]]

    return run


_SCHEMA = (
    "doc_id long, source string, chars int, bytes int, body_chars int, body_bytes int, broken boolean, punctuated boolean, token string, "
    "context3 long, context2 long, context1 long, tail long, body long, unit int, length int, n long"
)


def _sieve_place(context: np.ndarray, letter: np.ndarray, bits: int) -> np.ndarray:
    return _mix(context, letter) >> np.uint64(64 - bits)


def _grams(marks: tuple[str, ...], sieve, bits: int):
    """mapInPandas: text to (context, token, ends, goes) for the contexts and first letters that the sieve lets through, summed within each batch."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pattern, words = stripped(marks), sieve.value
        known: dict[str, int] = {}  # form: number of the lower-case token
        names: list[str] = []
        codes: list[int] = []
        letters: list[int] = []
        numbers: dict[str, int] = {}

        def form(t: str) -> int:
            low = "\n" if t[0] in ENDS else "9" if t[0].isdigit() else t.lower()
            k = numbers.get(low)
            if k is None:
                k = numbers[low] = len(names)
                names.append(low)
                codes.append(_code(low))
                letters.append(_code("\x02" + low[0]))
            known[t] = k
            return k

        for texts in (t for pdf in batches for t in pieces([x for x in pdf["text"] if x])):
            if len(known) > 1_000_000:
                for x in (known, names, codes, letters, numbers):
                    x.clear()
            stop = form("\n")
            flat: list[str] = []
            stops, open_ended = [], []
            for text in texts:
                body, closed, _ = ending(text, pattern)
                flat += _TOKEN.findall(body)
                flat.append("\n")
                stops.append(len(flat) - 1)
                open_ended.append(not closed)
            for t in set(flat) - known.keys():
                form(t)
            ids = np.fromiter(map(known.__getitem__, flat), np.int64, len(flat))
            end = ids == stop
            place = np.arange(len(ids))
            begun = np.maximum.accumulate(np.where(end, place + 1, 0))
            begun = np.append(0, begun[:-1])  # where the unit of a token starts
            code, letter = np.array(codes, np.uint64), np.array(letters, np.uint64)
            own = code[ids]
            bullets = np.array([numbers[b] for b in _BULLETS if b in numbers], np.int64)
            kind = _KINDS[np.isin(ids[np.minimum(begun, len(ids) - 1)], bullets).astype(int)]
            back = [np.where(place - begun >= d, own[np.maximum(place - d, 0)], _START) for d in (3, 2, 1)]
            # Whether the last token of an open ending ends anything is what is asked.
            latest = np.maximum.accumulate(np.where(end, -1, place))[np.array(stops)[np.array(open_ended)]]
            keep = ~end
            keep[latest[latest >= 0]] = False
            last = np.append(end[1:], True)
            parts = []
            for context in contexts(kind, *back):
                at = _sieve_place(context, letter[ids], bits).astype(np.int64)
                through = np.flatnonzero(keep & ((words[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) > 0))
                if not len(through):
                    continue
                _, first, group = np.unique(_mix(context[through], own[through]), return_index=True, return_inverse=True)
                stopped = last[through]
                ends, goes = np.bincount(group, stopped), np.bincount(group, ~stopped)
                parts.append((_signed(context[through][first]), ids[through][first], ends.astype(np.int64), goes.astype(np.int64)))
            if parts:
                context, token, ends, goes = map(np.concatenate, zip(*parts))
                yield pd.DataFrame({"context": context, "token": [names[k] for k in token.tolist()], "ends": ends, "goes": goes})

    return run


def _spikes(histogram: DataFrame, least_share: float, least_ratio: float, slack_bytes: int, above_share: float) -> DataFrame:
    """(source, unit, limit, at_limit) of a histogram (source, unit, n, texts)."""
    ordered = Window.partitionBy("source", "unit").orderBy(F.col("n").desc())
    slack = F.when(F.endswith("unit", F.lit("bytes")), slack_bytes).otherwise(0)
    ranked = histogram.select(
        "source", "unit", "n", "texts", F.sum("texts").over(Window.partitionBy("source", "unit")).alias("all"),
        F.coalesce(F.sum("texts").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("above"),
    )
    # Each such length holds ten times what lies above it: a handful for each source.
    tops = ranked.where((F.col("above") <= above_share * F.col("texts")) & (F.col("texts") * (slack + 1) * 2 >= 3)).select("source", "unit", F.col("n").alias("limit"), "all")
    at = (F.col("n") >= F.col("limit") - slack) & (F.col("n") <= F.col("limit"))
    below = (F.col("n") < F.col("limit") - slack) & (F.col("n") >= F.col("limit") * 0.9)
    test = histogram.join(tops, ["source", "unit"]).groupBy("source", "unit", "limit", "all").agg(
        F.sum(F.when(at, F.col("texts")).otherwise(0)).alias("at_limit"),
        (F.sum(F.when(below, F.col("texts")).otherwise(0)) / F.greatest(F.floor(F.col("limit") * 0.1), F.lit(1))).alias("nearby"),
    )
    spike = (F.col("at_limit") >= 3) & (F.col("at_limit") >= least_share * F.col("all")) & (F.col("at_limit") >= least_ratio * F.col("nearby"))
    found = test.where(spike)
    best = Window.partitionBy("source", "unit").orderBy(F.col("at_limit").desc(), F.col("limit").desc())
    return found.withColumn("k", F.row_number().over(best)).where("k = 1").select("source", "unit", F.col("limit").cast("int").alias("limit"), "at_limit")


def length_limits(documents: DataFrame, least_share: float = 0.01, least_ratio: float = 8.0, slack_bytes: int = 3, above_share: float = 0.1) -> DataFrame:
    """(source, unit, limit, at_limit): sources whose lengths spike at their maximum, in 'chars' or 'bytes'.

    The maximum is the largest length but for a few longer texts, at most
    `above_share` of those at it (a mark appended after the cut, an import past
    the field). A spike holds at least `least_share` of the source's texts, three at
    least, and `least_ratio` times as many as the lengths of the tenth below it hold
    on average. A byte limit may cost a few bytes more, where it would split a
    character; values up to `slack_bytes` below count as at it.
    """
    sized = documents.where("text is not null and trim(text) <> ''").select(unify_source(F.col("source")).alias("source"), F.length("text").alias("chars"), F.octet_length("text").alias("bytes"))
    lengths = sized.select("source", F.explode(F.array(F.struct(F.lit("chars").alias("unit"), F.col("chars").alias("n")), F.struct(F.lit("bytes").alias("unit"), F.col("bytes").alias("n")))).alias("x")).select("source", "x.*")
    return _spikes(lengths.groupBy("source", "unit", "n").agg(F.count("*").alias("texts")), least_share, least_ratio, slack_bytes, above_share)


def _sources(documents: DataFrame) -> DataFrame:
    return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(unify_source(F.col("source")), F.lit("")).alias("source"), "text").where("text is not null")


def _evidence(asked: DataFrame, grams: DataFrame) -> DataFrame:
    """(context, token, ends, goes) for the asked contexts and tokens; a longer token there counts as the shorter one going on.

    Longer tokens are met by equality on their prefixes, so neither a context
    with very many tokens nor one with very many askers is joined pair by pair.
    """
    both = F.col("ends") + F.col("goes")
    starts = F.transform(F.sequence(F.lit(1), F.least(F.length("token") - 1, F.lit(_PREFIX))), lambda i: F.substring("token", F.lit(1), i))
    exact = grams.select("context", "token", "ends", "goes")
    longer = grams.where((F.length("token") > 1) & ~F.col("token").eqNullSafe("9")).select("context", F.explode(starts).alias("token"), F.lit(0).cast("bigint").alias("ends"), both.alias("goes"))
    short = exact.unionByName(longer).groupBy("context", "token").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes"))
    # Tokens too long for their prefixes to be listed.
    head = lambda c: F.substring(c, F.lit(1), F.lit(_PREFIX))
    a = asked.where(F.length("token") > _PREFIX).select("context", "token", head(F.col("token")).alias("head"))
    g = grams.where(F.length("token") > _PREFIX + 1).select("context", F.col("token").alias("long"), head(F.col("token")).alias("head"), both.alias("more"))
    rest = a.join(g, ["context", "head"]).where(F.startswith("long", F.col("token")) & (F.col("long") != F.col("token"))).groupBy("context", "token").agg(F.sum("more").alias("more"))
    out = asked.join(short, ["context", "token"], "left").join(rest, ["context", "token"], "left")
    return out.select("context", "token", "asks", F.coalesce("ends", F.lit(0)).alias("ends"), (F.coalesce("goes", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("goes"))


def _bitmap(asked: DataFrame, bits: int) -> np.ndarray:
    """2 ** bits bits of the asked contexts and first letters; the driver gets at most 2 ** (bits - 6) numbers."""

    def places(batches):
        for pdf in batches:
            letter = np.array([_code("\x02" + t[0]) for t in pdf["token"]], np.uint64)
            at = _sieve_place(pdf["context"].to_numpy(np.int64).view(np.uint64), letter, bits)
            yield pd.DataFrame({"word": (at >> np.uint64(6)).astype(np.int64), "bit": _signed(np.uint64(1) << (at & np.uint64(63)))})

    rows = asked.select("context", "token").mapInPandas(places, "word long, bit long").groupBy("word").agg(F.bit_or("bit").alias("bits")).toPandas()
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[rows["word"].to_numpy(np.int64)] = rows["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def _judged(documents: DataFrame, whole_share: float, proven_share: float, slack_bytes: int, marks: tuple[str, ...], sieve_bits: int, hot_rows: int) -> tuple[DataFrame, DataFrame]:
    """(endings with both tests, histogram of lengths)."""
    spark = documents.sparkSession
    docs = _sources(documents)
    scan = cut(docs.mapInPandas(_endings(marks), _SCHEMA))
    tails = scan.where("n is null").drop("unit", "length", "n")
    names = F.array(*map(F.lit, UNITS))
    histogram = scan.where("n is not null").groupBy("source", F.element_at(names, F.col("unit") + 1).alias("unit"), F.col("length").alias("n")).agg(F.sum("n").alias("texts"))

    # One row for each ending; copies of one text are one witness.
    kinds = tails.groupBy("tail", "body").agg(*(F.first(c).alias(c) for c in ("token", "context3", "context2", "context1")), F.count("*").alias("rows"))
    kinds = cut(kinds.groupBy("tail").agg(*(F.first(c).alias(c) for c in ("token", "context3", "context2", "context1")), F.count("*").alias("closing"), F.sum("rows").alias("rows")))
    asked = kinds.select(F.explode(F.array("context3", "context2", "context1")).alias("context"), "token").groupBy("context", "token").agg(F.count("*").alias("asks"))
    shared = spark.sparkContext.broadcast(_bitmap(asked, sieve_bits))
    grams = docs.select("text").mapInPandas(_grams(marks, shared, sieve_bits), "context long, token string, ends long, goes long")
    grams = cut(grams.groupBy("context", "token").agg(F.sum("ends").alias("ends"), F.sum("goes").alias("goes")))
    evidence = cut(_evidence(asked, grams))
    total = kinds.agg(F.count("*"), F.sum("rows")).first()
    hot = hot_keys(evidence, ["context", "token"], "asks", total[0], hot_rows)
    judged = kinds
    for n in (3, 2, 1):
        own = evidence.select(F.col("context").alias(f"context{n}"), "token", F.col("ends").alias(f"ends{n}"), F.col("goes").alias(f"goes{n}"))
        judged = lookup(judged, own, [f"context{n}", "token"], hot and hot.withColumnRenamed("context", f"context{n}"), F.col("tail"))
    judged = judged.fillna(0, [f"{x}{n}" for n in (3, 2, 1) for x in ("ends", "goes")])
    # The longest context that occurs elsewhere decides; a whole ending that closes several texts is longer than any.
    known = lambda n: F.col(f"ends{n}") + F.col(f"goes{n}") > 0
    decide = lambda x: F.when(known(3), F.col(f"{x}3")).when(F.col("closing") > 1, 0).when(known(2), F.col(f"{x}2")).otherwise(F.col(f"{x}1"))
    judged = judged.select("tail", "rows", (decide("ends") + F.col("closing") - 1).alias("ended"), decide("goes").alias("went_on"))
    hot_tails = hot_keys(judged, ["tail"], "rows", total[1] or 0, hot_rows)

    limits = _spikes(histogram, 0.01, 8.0, slack_bytes, 0.1).groupBy("source").agg(*(F.max(F.when(F.col("unit") == u, F.col("limit"))).alias(f"{u}_limit") for u in UNITS))
    at = F.lit(False)
    for u in UNITS:
        n, limit = F.col(u), F.col(f"{u}_limit")
        at = at | F.coalesce(n.between(limit - slack_bytes, limit) if u.endswith("bytes") else n == limit, F.lit(False))
    # One row for each source: a table of settings.
    rows = lookup(tails, judged.drop("rows"), ["tail"], hot_tails, F.col("body")).join(F.broadcast(limits), "source", "left").withColumn("at_limit", at)
    whole = lambda share: (F.col("ended") > 0) & (F.col("ended") >= share * (F.col("ended") + F.col("went_on")))
    rows = rows.withColumn("by_limit", F.col("at_limit") & ~F.col("punctuated") & ~whole(proven_share)).withColumn("by_ending", F.col("broken") | ~whole(whole_share))
    return rows.select("doc_id", "source", "at_limit", "ended", "went_on", "by_limit", "by_ending"), histogram


def truncated(documents: DataFrame, whole_share: float = 0.5, proven_share: float = 0.9, slack_bytes: int = 3, marks: tuple[str, ...] = APPENDED, sieve_bits: int = 24, hot_rows: int = 100_000) -> DataFrame:
    """(doc_id, source, at_limit, ended, went_on, by_limit, by_ending) of texts that stop inside a word or sentence.

    by_limit: the text has its source's limit length, no terminal punctuation,
    and not `proven_share` of evidence for a whole ending; by_ending: its ending goes on elsewhere more often than not, or
    stops at a mark that can't end a text. `marks` are patterns of what systems
    append after a cut. Null and blank texts don't count; sources are unified in
    spelling, a null source is one of its own; repeated ids give a row for each
    row. `sieve_bits` sets the size of the bitmap, 2 MB at 24; endings shared
    by more than `hot_rows` rows and a thousandth of all are looked up by broadcast.
    """
    rows, _ = _judged(documents, whole_share, proven_share, slack_bytes, marks, sieve_bits, hot_rows)
    return rows.where("by_limit or by_ending")


def truncation_report(documents: DataFrame, marks: tuple[str, ...] = APPENDED) -> DataFrame:
    """Per source: texts, truncated ones, those found at the field limit and by their ending, and the rate."""
    rows, histogram = _judged(documents, 0.5, 0.9, 3, marks, 24, 100_000)
    texts = histogram.where(F.col("unit") == "chars").groupBy("source").agg(F.sum("texts").alias("texts"))
    found = rows.where("by_limit or by_ending").groupBy("source").agg(F.count("*").alias("truncated"), F.count_if("by_limit").alias("at_limit"), F.count_if("by_ending").alias("by_ending"))
    return texts.join(found, "source", "left").fillna(0, ["truncated", "at_limit", "by_ending"]).withColumn("rate", F.col("truncated") / F.col("texts"))
