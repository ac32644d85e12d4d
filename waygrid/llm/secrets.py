"""Secret scans with built-in functions only: fixed patterns plus sliding-window entropy of candidate strings."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let

# The patterns of the base kinds.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")

CANDIDATE = r"(?<![A-Za-z0-9+/=_-])[A-Za-z0-9+/=_-]{20,}"


@dataclass(frozen=True)
class CharClass:
    """What a window of ``WINDOW`` characters must hold to count for this class, and its least entropy in bits.

    ``symbols``: at most so many characters of ``+/=_-``. Words, joined in paths, names and identifiers, have as much entropy
    as some keys, so a window with more than ``pairs`` of the frequent letter pairs is no secret.
    """
    name: str
    bits: float
    lower: int = 0
    upper: int = 0
    digits: int = 0
    symbols: int = 0
    pairs: int = 3
    only: str | None = None  # a pattern that no character of the window may match


WINDOW = 20
CLASSES = (
    CharClass("hex", 3.0, lower=3, digits=3, only="[^0-9a-f]"),
    CharClass("HEX", 3.0, upper=3, digits=3, only="[^0-9A-F]"),
    CharClass("base64", 3.6, lower=3, upper=3, digits=2, symbols=2),
    CharClass("mixed", 3.6, lower=3, upper=3, digits=1),
    CharClass("lower", 3.6, lower=4, digits=3, only="[^0-9a-z]"),
    CharClass("upper", 3.5, upper=4, digits=1, only="[^0-9A-Z]"),  # base32 has few digits
    CharClass("letters", 3.9, lower=5, upper=5),
)
# Frequent letter pairs of English, French, German and Spanish.
PAIRS = ("th he in er an re on at en nd ti es or te of ed is it al ar st to nt ng se ha as ou io le ve co me de hi ri ro ic ne ea "
         "ra ce li ch ll be ma si om ur el la ta ie ei un ge ue qu sc us et ai tr na ca di do no lo mo pa pe po su").split()
_FREQUENT = "(?i)(?=" + "|".join(PAIRS) + ")"
_PLACEHOLDER = r"(?i:example|sample|dummy|placeholder|changeme|redacted|abcdefgh|12345678|your[_-]?(?:key|token|secret))"
# Placeholders and identifiers that are no secrets, whatever their entropy. Placeholders and runs of 8 equal characters
# clear a candidate only if they leave no 20 characters, the window of all classes, between them: the rest is judged.
ALLOW = (
    rf"^(?!(?:.*?(?:{_PLACEHOLDER}|(.)\1{{7}}(?!\1)))?(?:(?!{_PLACEHOLDER}|(.)\2{{7}}).){{20}})",
    r"^[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}$",
)


def _located(text: Column, pattern: str, body) -> Column:
    """``body(hits, starts)`` for the leftmost non-overlapping matches; starts count code points from 0."""
    hits, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)

    def placed(hs: Column) -> Column:
        steps = F.zip_with(hs, gaps, lambda h, g: F.struct(F.length(h).alias("h"), F.length(g).alias("g")))
        start = F.aggregate(
            F.slice(steps, 1, F.size(hs)), F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<int>)").alias("all")),
            lambda s, x: F.struct((s["at"] + x["g"] + x["h"]).alias("at"), F.concat(s["all"], F.array(s["at"] + x["g"])).alias("all")),
            lambda s: s["all"])
        return let(start, lambda st: body(hs, st))

    return let(hits, placed)


def _span(start: Column, end: Column, kind: str) -> Column:
    return F.struct(start.cast("long").alias("start"), F.lit(KINDS.index(kind)).alias("rank"),
                    end.cast("long").alias("end"), F.lit(kind).alias("kind"))


NONE = "cast(array() as array<struct<start:bigint,rank:int,end:bigint,kind:string>>)"


def _pattern_spans(text: Column, pattern: str, kind: str) -> Column:
    """Spans of a base kind; passes over texts without a match stop at one test."""
    def body(hs: Column, st: Column) -> Column:
        return F.transform(hs, lambda h, i: _span(F.get(st, i), F.get(st, i) + F.length(h), kind))

    def assigned(hs: Column, st: Column) -> Column:
        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(2))
        return let(values, lambda vs: F.filter(
            F.transform(hs, lambda h, i: F.when(F.length(F.get(vs, i)) >= 6, _span(F.get(st, i), F.get(st, i) + F.length(h), kind))),
            lambda s: s.isNotNull()))

    return F.when(text.rlike(pattern), _located(text, pattern, assigned if kind == "assign" else body)).otherwise(F.expr(NONE))


SPANS = "cast(array() as array<struct<first:int,last:int>>)"


def _joined(spans: Column, first: Column, last: Column) -> Column:
    """The spans and one more that starts no earlier than the last of them: it joins that one if they touch."""
    tail = F.get(spans, F.size(spans) - 1)
    new = lambda a: F.array(F.struct(a.cast("int").alias("first"), F.greatest(last, F.coalesce(tail["last"], last)).cast("int").alias("last")))
    return F.when(tail["last"] >= first, F.concat(F.slice(spans, 1, F.size(spans) - 1), new(tail["first"]))).otherwise(
        F.concat(spans, F.array(F.struct(first.cast("int").alias("first"), last.cast("int").alias("last")))))


def hot_spans(c: Column, chars: Column, classes=CLASSES, window: int = WINDOW) -> Column:
    """Maximal stretches (first, last) of the candidate ``c`` that windows of one of the classes cover.

    The window slides one character at a time. Its state is the count of each character, of lower-case letters, capitals
    and digits, and the sum of c log2 c, all changed by the entering and the leaving character only.
    """
    f = lambda n: F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))
    move = lambda i, at, by: F.struct(F.get(chars, at).alias("ch"), F.lit(by).alias("by"), i.alias("i"))
    moves = F.flatten(F.transform(F.sequence(F.lit(1), F.size(chars)), lambda i: F.when(
        i > window, F.array(move(i, i - window - 1, -1), move(i, i - 1, 1))).otherwise(F.array(move(i, i - 1, 1)))))
    zero = F.lit(0)
    start = F.struct(F.expr("cast(map() as map<string,int>)").alias("counts"), F.lit(0.0).alias("sum"), zero.alias("lower"),
                     zero.alias("upper"), zero.alias("digits"), F.expr(SPANS).alias("spans"))

    def step(s: Column, m: Column) -> Column:
        n = F.coalesce(F.try_element_at(s["counts"], m["ch"]), F.lit(0))
        plus = lambda name, lo, hi: s[name] + F.when(m["ch"].between(lo, hi), m["by"]).otherwise(0)
        moved = F.struct(
            F.map_concat(F.map_filter(s["counts"], lambda k, v: k != m["ch"]), F.create_map(m["ch"], n + m["by"])).alias("counts"),
            (s["sum"] + f(n + m["by"]) - f(n)).alias("sum"), plus("lower", "a", "z").alias("lower"), plus("upper", "A", "Z").alias("upper"),
            plus("digits", "0", "9").alias("digits"), s["spans"].alias("spans"))

        def judged(t: Column) -> Column:
            view, hot = F.substring(c, m["i"] - window + 1, F.lit(window)), F.lit(False)
            for k in classes:
                symbols = window - t["lower"] - t["upper"] - t["digits"]
                fits = (math.log2(window) - t["sum"] / window >= k.bits) & (t["lower"] >= k.lower) & (t["upper"] >= k.upper) & (t["digits"] >= k.digits) & (symbols <= k.symbols)
                if k.only:
                    fits = fits & ~view.rlike(k.only)
                hot = hot | (fits & (F.regexp_count(view, F.lit(_FREQUENT)) <= k.pairs))
            full = (m["by"] == 1) & (m["i"] >= window)
            return F.struct(*[t[x] for x in ("counts", "sum", "lower", "upper", "digits")], F.when(
                full & hot, _joined(t["spans"], m["i"] - window, m["i"])).otherwise(t["spans"]).alias("spans"))

        return let(moved, judged)

    return F.aggregate(moves, start, step, lambda s: s["spans"])


_BEFORE, _AFTER = r"^(?:(?:[A-Z]?[a-z]+|[A-Z]+)?[+/=_-])+", r"(?:[+/=_-](?:[A-Z]?[a-z]+|[A-Z]+)?)+$"  # words at the ends of a span


def _whole_words(c: Column, spans: Column) -> Column:
    """Spans widened to the letters and digits around them, so that a key is covered to both ends, without the plain words
    that its first and last windows reached across a symbol.
    """
    found = F.regexp_extract
    more = lambda text, pattern: F.greatest(F.length(found(text, pattern, 0)) - 1, F.lit(0))  # beyond the span's own end
    wide = F.aggregate(spans, F.expr(SPANS), lambda out, s: _joined(
        out, s["first"] - more(F.substring(c, F.lit(1), s["first"] + 1), "[A-Za-z0-9]*$"),
        s["last"] + more(F.substring(c, s["last"], F.length(c)), "^[A-Za-z0-9]*")))
    return F.transform(wide, lambda s: let(F.substring(c, s["first"] + 1, s["last"] - s["first"]), lambda t: F.struct(
        (s["first"] + F.length(found(t, _BEFORE, 0))).alias("first"), (s["last"] - F.length(found(t, _AFTER, 0))).alias("last"))))


def _entropy_spans(text: Column, classes, allow) -> Column:
    def judged(c: Column) -> Column:
        chars = F.transform(F.sequence(F.lit(1), F.length(c)), lambda i: F.substring(c, i, F.lit(1)))
        listed = F.lit(False)
        for p in allow:
            listed = listed | c.rlike(p)
        worth = F.lit(False)  # no window can fit a candidate without what some class asks for
        for k in classes:
            has = F.lit(True)
            for pattern, least in (("[a-z]", k.lower), ("[A-Z]", k.upper), ("[0-9]", k.digits)):
                has = has & c.rlike(pattern) if least else has
            worth = worth | has
        return F.when(worth & ~listed, let(let(chars, lambda cs: hot_spans(c, cs, classes)), lambda ss: _whole_words(c, ss))).otherwise(F.expr(SPANS))

    def body(hs: Column, st: Column) -> Column:
        return F.flatten(F.transform(hs, lambda h, i: F.transform(
            judged(h), lambda r: _span(F.get(st, i) + r["first"], F.get(st, i) + r["last"], "entropy"))))

    return F.when(text.rlike(CANDIDATE), _located(text, CANDIDATE, body)).otherwise(F.expr(NONE))


def find_spans(text: Column, classes=CLASSES, allow=ALLOW) -> Column:
    """Array of (start, rank, end, kind), sorted by start then kind; a null text has none.

    Base kinds always stay; an entropy span inside a base span adds nothing and is left out. Texts are read whole, whatever
    their length, in one expression; equal texts get equal spans.
    """
    t = F.coalesce(text, F.lit(""))

    def merged(tt: Column) -> Column:
        base = F.concat(_pattern_spans(tt, ASSIGN, "assign"), _pattern_spans(tt, ACCESS, "access"), _pattern_spans(tt, HEX, "hex"))
        return let(base, lambda b: F.sort_array(F.concat(b, F.filter(
            _entropy_spans(tt, classes, allow),
            lambda e: ~F.exists(b, lambda s: (s["start"] <= e["start"]) & (e["end"] <= s["end"]))))))

    return let(t, merged)


def scan(docs: DataFrame, text: str = "text", out: str = "spans", **params) -> DataFrame:
    """Add the array of spans, as a column ``out``, which replaces one of that name. One projection, no shuffle; repeated
    rows are scanned alike, a null or empty text has no spans, an empty table gives an empty table.
    """
    return docs.withColumn(out, find_spans(F.col(text), **params))


def span_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redact(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span, overlapping ones merged, replaced by ``mask``. Null stays null."""
    def rebuilt(ss: Column) -> Column:
        start = F.struct(F.lit("").alias("out"), F.lit(0).cast("long").alias("at"))
        piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        return F.aggregate(ss, start, lambda s, x: F.struct(
            F.when(x["start"] >= s["at"], F.concat(s["out"], piece(s["at"], x["start"]), F.lit(mask))).otherwise(s["out"]).alias("out"),
            F.greatest(s["at"], x["end"]).alias("at")), lambda s: F.concat(s["out"], piece(s["at"], F.length(text).cast("long"))))
    return F.when(F.size(spans) == 0, text).otherwise(let(spans, rebuilt))
