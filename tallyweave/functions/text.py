"""Strings typed by people or sent by other systems, brought into shape with built-ins only."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def stripped(c: Column) -> Column:
    """White space of any kind off both ends (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def filled(*cs: Column) -> Column:
    """The first value that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in cs])


def norm_email(c: Column) -> Column:
    """Stripped and lowered; NULL without an ``@`` or without a dot after the last one."""
    v = F.lower(stripped(c))
    return F.when(v.contains("@") & F.substring_index(v, "@", -1).contains("."), v)


def norm_phone(c: Column, digits: int = 10) -> Column:
    """The last ``digits`` digits; NULL if there are fewer."""
    v = F.regexp_replace(c, r"[^0-9]", "")
    return F.when(F.length(v) >= digits, F.right(v, F.lit(digits)))


def first_word(c: Column) -> Column:
    return F.nullif(F.get(F.split(stripped(c), r"\s+"), F.lit(0)), F.lit(""))


def other_words(c: Column) -> Column:
    """All words but the first, with single spaces; NULL if there is none."""
    return F.nullif(F.array_join(F.slice(F.split(stripped(c), r"\s+"), 2, 1 << 30), " "), F.lit(""))


def url_param(url: Column, name: str) -> Column:
    return F.nullif(F.regexp_extract(url, rf"[?&]{name}=([\w-]+)", 1), F.lit(""))


def first_keyword(text: Column, keywords: Sequence[str]) -> Column:
    """The first of the keywords, in their order, that the text holds in any case; NULL if none."""
    return F.get(F.filter(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.lower(text), F.lower(k))), F.lit(0))


def mapped(c: Column, names: Mapping[str, str]) -> Column:
    """The category a spelling stands for, whatever its case and outer spaces; unknown ones are NULL."""
    table = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    return F.try_element_at(table, F.lower(stripped(c)))


def ranked(c: Column, order: Sequence[str]) -> Column:
    """Place of a value in an order of values, from 0; unknown ones and NULL are 0."""
    return F.greatest(F.coalesce(F.array_position(F.array(*[F.lit(x) for x in order]), c), F.lit(0)) - 1, F.lit(0)).cast("int")


def is_one_of(c: Column, values: Sequence[str]) -> Column:
    return F.coalesce(F.lower(stripped(c)).isin([v.lower() for v in values]), F.lit(False))


def title_case(c: Column) -> Column:
    """Every letter after a non-letter in upper case, all others lower (``initcap`` knows spaces only)."""
    parts = F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(parts, lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substr(w, F.lit(2)))), "")


def html_escaped(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def counted(n: Column, one: str, many: str | None = None) -> Column:
    """``1 gift``, ``2 gifts``."""
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, F.lit(one)).otherwise(F.lit(many or one + "s")))


def header_block(text: Column) -> Column:
    """Keys (lower case) and values of ``key: value`` lines between the first two rules of ``=``.

    A rule is a line of more than five ``=`` and nothing else. Of a key given twice the last value
    stays. Without two rules the map is empty; NULL gives NULL.
    """
    lines = F.transform(F.split(text, r"\r?\n"), stripped)
    rule = lambda x: x.rlike(r"^={6,}$")
    at = F.filter(F.transform(lines, lambda x, i: F.when(rule(x), i)), lambda i: i.isNotNull())
    inner = F.when(F.size(at) >= 2, F.slice(lines, F.get(at, F.lit(0)) + 2, F.get(at, F.lit(1)) - F.get(at, F.lit(0)) - 1)).otherwise(F.array().cast("array<string>"))
    pairs = F.transform(F.filter(inner, lambda x: x.contains(":")), lambda x: F.struct(F.lower(stripped(F.substring_index(x, ":", 1))).alias("key"), stripped(F.regexp_replace(x, r"^[^:]*:", "")).alias("value")))
    last = F.filter(pairs, lambda p, i: F.size(F.filter(pairs, lambda q, j: (j > i) & (q["key"] == p["key"]))) == 0)
    return F.when(text.isNotNull(), F.map_from_entries(last))


def folded_lines(lines: Column) -> Column:
    """Lines without those that repeat, or end, the last line kept (not the line before)."""
    return F.aggregate(lines, F.array().cast("array<string>"), lambda kept, x: F.when((F.size(kept) > 0) & F.coalesce(F.endswith(F.element_at(kept, -1), x), F.lit(False)), kept).otherwise(F.concat(kept, F.array(x))))


def caption_lines(text: Column) -> Column:
    """Spoken lines of a caption file: no header, cue numbers, times, tags or sound marks; repeats folded."""
    lines = F.transform(F.split(F.regexp_replace(text, "^\\ufeff", ""), r"\r?\n"), lambda x: stripped(F.regexp_replace(F.regexp_replace(x, r"<[^>]*>", ""), r"\[(?i:music|applause|laughter)\]", "")))
    spoken = F.filter(lines, lambda x: (x != "") & ~x.contains("-->") & ~x.rlike(r"^(WEBVTT|Kind:|Language:|NOTE|\d+$)"))
    return folded_lines(spoken)


def chunked(sentences: Column, most_sentences: int = 4, most_words: int = 120) -> Column:
    """Paragraphs of consecutive sentences, closed as soon as they have so many sentences or words (parted by single spaces)."""
    none = F.array().cast("array<string>")
    state = lambda done, open_, n, words: F.struct(done.alias("done"), open_.alias("open"), n.alias("n"), words.alias("words"))

    def step(s: Column, x: Column) -> Column:
        grown = F.concat_ws(" ", s["open"], x)
        n, words = s["n"] + 1, s["words"] + F.size(F.split(x, " "))
        full = (n >= most_sentences) | (words >= most_words)
        return state(F.when(full, F.array_append(s["done"], grown)).otherwise(s["done"]), F.when(~full, grown), F.when(full, 0).otherwise(n), F.when(full, 0).otherwise(words))

    start = state(none, F.lit(None).cast("string"), F.lit(0), F.lit(0))
    return F.aggregate(sentences, start, step, lambda s: F.when(s["n"] > 0, F.array_append(s["done"], s["open"])).otherwise(s["done"]))


def sentences(text: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(text, r"\s+", " "), r"(?<=[.!?])\s+"), lambda x: x != "")
