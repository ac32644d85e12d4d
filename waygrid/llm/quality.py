"""Quality rules: a threshold table compiled into one projection of built-in expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from .common import let, words

# Frequent function words of the languages served.
STOP_WORDS = tuple((
    "the of and to a in that is for on with as by it this was be are from or "
    "der die das und den von zu mit sich des auf für ist im dem nicht ein eine als auch "
    "le la les de des et du un une que en dans qui pour est au par sur pas "
    "el los las del y se por con una su para es lo no").split())
SYMBOLS = "#*$%&|<>"
EDGES = ".,;:!?\"'()"


@dataclass(frozen=True)
class Rule:
    """``low <= 100 * numerator / denominator <= high`` where ``n_words >= from_words``; integers only.

    ``denominator`` None compares the numerator itself.
    """
    name: str
    numerator: str
    denominator: str | None = None
    low: int | None = None
    high: int | None = None
    from_words: int = 0


BASE = (
    Rule("too_short", "n_words", low=10),
    Rule("repetition", "n_repeat_words", "n_words", high=20),
)
RULES = (
    Rule("word_length", "word_chars", "n_words", low=200, high=1500),
    Rule("symbols", "n_symbols", "word_chars", high=8),
    Rule("stop_words", "n_stop_words", "n_words", low=2, from_words=30),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=40),
    Rule("bullets", "n_bullet_lines", "n_lines", high=90),
    Rule("ellipsis", "n_ellipsis_lines", "n_lines", high=30),
)


def _repeated(ws: Column) -> Column:
    """Words inside 5-word windows that occur twice or more, counted once each."""
    def covered(sorted_windows: Column) -> Column:
        n = F.size(sorted_windows)
        # windows sorted by content then place: a window repeats if a neighbour has equal content
        marked = F.filter(F.transform(sorted_windows, lambda w, i: F.when(
            ((i > 0) & (F.get(sorted_windows, i - 1)["w"] == w["w"]))
            | ((i < n - 1) & (F.get(sorted_windows, i + 1)["w"] == w["w"])), w["i"])), lambda p: p.isNotNull())
        return let(F.sort_array(marked), lambda at: F.when(F.size(at) == 0, F.lit(0)).otherwise(F.aggregate(
            F.zip_with(at, F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(1))), lambda p, q: F.least(F.coalesce(q - p, F.lit(5)), F.lit(5))),
            F.lit(0), lambda s, d: s + d)))

    def of(windows: Column) -> Column:
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(
            let(F.sort_array(F.transform(windows, lambda w, i: F.struct(w.alias("w"), i.alias("i")))), covered))

    at = F.sequence(F.lit(1), F.size(ws) - 4)
    windows = F.transform(at, lambda i: F.array_join(F.slice(ws, i, F.lit(5)), " "))
    # distinct hashes prove distinct windows; only texts with a repeated hash compare the windows themselves
    hashes = F.transform(at, lambda i: F.xxhash64(*[F.get(ws, i + k) for k in range(-1, 4)]))
    return F.when(F.size(ws) < 6, F.lit(0)).otherwise(let(hashes, lambda h: F.when(
        F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(let(windows, of))))


def measures(text: Column) -> Column:
    """Struct of the counts that rules compare (long). A null text counts as empty."""
    t = F.coalesce(text, F.lit(""))

    def with_words(ws: Column, tt: Column) -> Column:
        chars = F.length(F.translate(tt, " \t\n\x0b\x0c\r", ""))
        lines = F.filter(F.split(tt, "\n", -1), lambda s: F.length(F.translate(s, " \t\n\x0b\x0c\r", "")) > 0)
        n = lambda c: c.cast("long")
        return let(lines, lambda ls: F.struct(
            n(F.size(ws)).alias("n_words"), n(chars).alias("word_chars"),
            n(F.length(tt) - F.length(F.translate(tt, SYMBOLS, ""))).alias("n_symbols"),
            n(F.size(ls)).alias("n_lines"), n(F.size(ls) - F.size(F.array_distinct(ls))).alias("n_dup_lines"),
            n(F.size(F.filter(ls, lambda s: F.ltrim(s).rlike(r"^[-*•+]\s")))).alias("n_bullet_lines"),
            n(F.size(F.filter(ls, lambda s: F.rtrim(s).endswith("...") | F.rtrim(s).endswith("…")))).alias("n_ellipsis_lines"),
            n(_repeated(ws)).alias("n_repeat_words"),
            n(F.size(F.filter(ws, lambda w: F.lower(F.btrim(w, F.lit(EDGES))).isin(*dict.fromkeys(STOP_WORDS))))).alias("n_stop_words")))

    return let(t, lambda tt: let(words(tt), lambda ws: with_words(ws, tt)))


def fails(m: Column, rule: Rule) -> Column:
    """True where the measures break the rule; an undefined ratio (zero denominator) never does."""
    top, scale = m[rule.numerator], F.lit(1) if rule.denominator is None else m[rule.denominator]
    top = top if rule.denominator is None else top * 100
    bad = F.lit(False)
    if rule.low is not None:
        bad = bad | (top < rule.low * scale)
    if rule.high is not None:
        bad = bad | (top > rule.high * scale)
    return bad & (m["n_words"] >= rule.from_words) & (scale > 0)


def apply_rules(docs: DataFrame, base=BASE, rules=RULES, text: str = "text", out: str = "quality") -> DataFrame:
    """Add struct ``out``: the measures, ``base_failed``, ``failed`` (names of broken rules) and ``kept``.

    One projection, no shuffle, no user function. Null or empty texts have zero counts and fail
    ``too_short``; repeated rows are judged alike; other columns pass through untouched (a column
    already called ``out`` is replaced).
    """
    def judged(m: Column) -> Column:
        broken = lambda rs: F.filter(F.array(*[F.when(fails(m, r), F.lit(r.name)) for r in rs]), lambda x: x.isNotNull())
        return let(broken(base), lambda b: let(broken(rules), lambda r: F.struct(
            m.alias("measures"), (F.size(b) > 0).alias("base_failed"), F.concat(b, r).alias("failed"),
            ((F.size(b) == 0) & (F.size(r) == 0)).alias("kept"))))

    return docs.withColumn(out, let(measures(F.col(text)), judged))
