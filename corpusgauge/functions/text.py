"""Text rules as Column expressions; one document stays in one row."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge import fixed

# Fixed patterns.
WORD = r"[\p{L}\p{N}]+"
TOKEN = r"[\p{L}\p{N}_]{2,}"
WORD_RULES = {
    "letters": r"[A-Za-z]+",
    "apostrophe": r"[A-Za-z']+",
    "hyphen": r"[A-Za-z0-9-]+",
    "cjk_latin": r"[\x{4e00}-\x{9fff}]|[A-Za-z]+",
    "whitespace": r"[^ \t\n\r\f]+",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it many times inside ``body``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def found(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def words(text: Column) -> Column:
    return found(F.lower(text), WORD)


def tokens(text: Column) -> Column:
    """Lower-case word runs of at least two characters."""
    return found(F.lower(text), TOKEN)


def count_words(text: Column, rule: str) -> Column:
    return F.regexp_count(text, F.lit(WORD_RULES[rule]))


def strip_markdown(text: Column) -> Column:
    """Headings and marks off, line breaks to one space."""
    text = F.regexp_replace(text, r"#+[ \t\r\n\f]*[^\n]*\n", "")
    return F.regexp_replace(F.regexp_replace(text, r"[*_`]", ""), r"\n+", " ")


def strip_html(html: Column) -> Column:
    """Scripts, styles, comments and tags off; common entities; spaces squeezed."""
    text = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<!--.*?-->", " "), r"<[^>]*>", " ")
    for entity, mark in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        text = F.replace(text, F.lit(entity), F.lit(mark))
    return F.trim(F.regexp_replace(text, r"[ \t\r\n\f]+", " "))


def chapters(text: Column) -> Column:
    """Chapters as an array of (number, title, body), whatever the body holds.

    A chapter begins at ``# Chapter n: title`` or ``# 第n章：title``.  A text without
    such a heading is split at its ``# `` lines, numbered from 1; what stands before
    the first heading belongs to no chapter.
    """
    heading = r"#[ \t]*(?:第[ \t]*([0-9]+)[ \t]*章|Chapter[ \t]+([0-9]+))[:：][ \t]*"

    # U+0001 marks where a heading begins, U+0002 parts its number from the title.
    # The text, its marked form and its parts are worked out once, not once a chapter.
    def marked(clean: Column) -> Column:
        named = F.regexp_replace(clean, heading, "\x01$1$2\x02")
        plain = F.regexp_replace(F.concat(F.lit("\n"), clean), r"\n# ", "\x01\x02")
        return let(named, lambda n: let(F.contains(n, F.lit("\x01")), lambda is_named: blocks(is_named, F.when(is_named, n).otherwise(plain))))

    def blocks(is_named: Column, whole: Column) -> Column:
        found = lambda p: F.slice(p, F.lit(2), F.greatest(F.size(p) - 1, F.lit(0)))
        return let(F.split(whole, "\x01"), lambda p: F.transform(found(p), lambda block, place: chapter(is_named, block, place)))

    def chapter(is_named: Column, block: Column, place: Column) -> Column:
        number = F.when(is_named, F.substring_index(block, "\x02", 1)).otherwise((place + 1).cast("string"))
        return let(F.substring_index(block, "\x02", -1), lambda rest: let(F.substring_index(rest, "\n", 1), lambda title: parts(number, rest, title)))

    def parts(number: Column, rest: Column, title: Column) -> Column:
        body = F.substring(rest, F.length(title) + 2, F.length(rest))
        return F.struct(number.alias("number"), F.trim(title).alias("title"), body.alias("body"))

    return let(F.translate(text, "\x01\x02", ""), marked)


def sentences_kept(text: Column, least: int = 2) -> Column:
    """Terminators stay with their sentence and an ellipsis does not end one."""
    held = F.replace(F.trim(text), F.lit("..."), F.lit("〈E〉"))
    parts = F.regexp_extract_all(held, F.lit(r"[^.。!！?？;；\n]+[.。!！?？;；]+|[^.。!！?？;；\n]+$|[^.。!！?？;；\n]+"), F.lit(0))
    restored = F.transform(parts, lambda s: F.trim(F.replace(s, F.lit("〈E〉"), F.lit("..."))))
    return F.filter(restored, lambda s: F.length(s) >= least)


def sentences_split(text: Column, longer_than: int = 0) -> Column:
    """Split at terminators; blanks and too short pieces are dropped."""
    parts = F.transform(F.split(text, r"[。！？.!?]+"), lambda s: F.trim(F.regexp_replace(s, r"^[ \n]+|[ \n]+$", "")))
    return F.filter(parts, lambda s: F.length(s) > longer_than)


def normal_punctuation(text: Column) -> Column:
    """Marks follow the majority script; repeated marks collapse."""
    wide, narrow = "，。！？：；（）", ",.!?:;()"
    cjk = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    latin = F.regexp_count(text, F.lit(r"[A-Za-z]"))
    fixed_marks = F.when(cjk > latin, F.translate(text, narrow, wide)).otherwise(F.translate(text, wide, narrow))
    for mark in (",", "!", r"\?", ":", ";"):
        fixed_marks = F.regexp_replace(fixed_marks, f"{mark}+", mark)
    return fixed_marks


def grammar_errors(text: Column) -> Column:
    """Runs of 3+ spaces, listed misspellings, a/an before the wrong letter."""
    spaces = F.regexp_count(text, F.lit(r"[ \t\r\n\f]{3,}"))
    spelled = F.size(F.filter(found(F.lower(text), r"[\p{L}]+"), lambda w: w.isin(fixed.MISSPELLINGS)))
    a_vowel = F.regexp_count(text, F.lit(r"(^|[^\p{L}])a[ \t\r\n\f]+[aeiouAEIOU]"))
    an_consonant = F.regexp_count(text, F.lit(r"(^|[^\p{L}])an[ \t\r\n\f]+[bcdfghjklmnpqrstvwxyzBCDFGHJKLMNPQRSTVWXYZ]"))
    return spaces + spelled + a_vowel + an_consonant


def token_estimate(text: Column) -> Column:
    cjk = F.regexp_count(text, F.lit(r"[\x{4e00}-\x{9fff}]"))
    return F.greatest(F.floor(cjk / 1.5 + (F.length(text) - cjk) / 4), F.lit(1))


def window_starts(n: Column, size: int, stride: int) -> Column:
    """0-based starts of full windows plus one last full window at the tail."""
    last = n - size
    steps = F.sequence(F.lit(0), F.greatest(last, F.lit(0)), F.lit(stride))
    return F.when(last < 0, F.array(F.lit(0))).otherwise(F.array_union(steps, F.array(last)))


def ngrams(toks: Column, n: int) -> Column:
    """Token runs of length n joined by a space."""
    grams = toks
    for k in range(2, n + 1):
        size = F.greatest(F.size(toks) - (k - 1), F.lit(0))
        head = F.slice(grams, F.lit(1), size)
        tail = F.slice(toks, F.lit(k), size)
        grams = F.zip_with(head, tail, lambda a, b: F.concat(a, F.lit(" "), b))
    return grams


def distinct_scores(toks: Column, size: int = 1000, stride: int = 500, least: int = 10) -> Column:
    """(distinct_1, distinct_2) with +1 smoothing, mean over sliding windows."""

    def scores(t: Column, pairs: Column) -> Column:
        def one(start: Column) -> Column:
            window = F.slice(t, start + 1, F.lit(size))
            bi = F.slice(pairs, start + 1, F.lit(size - 1))
            d1 = F.size(F.array_distinct(window)) / (F.size(window) + 1)
            d2 = F.size(F.array_distinct(bi)) / (F.size(bi) + 1)
            return F.struct(d1.alias("d1"), d2.alias("d2"))

        def means(per_window: Column) -> Column:
            zero = F.struct(F.lit(0.0).alias("d1"), F.lit(0.0).alias("d2"))
            total = F.aggregate(per_window, zero, lambda acc, w: F.struct((acc["d1"] + w["d1"]).alias("d1"), (acc["d2"] + w["d2"]).alias("d2")))
            n = F.size(per_window)
            return let(total, lambda s: F.struct((s["d1"] / n).alias("distinct_1"), (s["d2"] / n).alias("distinct_2")))

        both = let(F.transform(window_starts(F.size(t), size, stride), one), means)
        return F.when(F.size(t) >= least, both).otherwise(F.struct(F.lit(0.0).alias("distinct_1"), F.lit(0.0).alias("distinct_2")))

    return let(toks, lambda t: let(ngrams(t, 2), lambda pairs: scores(t, pairs)))


def counted(items: Column) -> Column:
    """Distinct items of an array with their counts, in one pass over the sorted array."""

    def runs(s: Column) -> Column:
        n = F.size(s)
        spots = F.filter(F.sequence(F.lit(1), n), lambda i: (i == 1) | (F.element_at(s, i) != F.element_at(s, F.greatest(i - 1, F.lit(1)))))

        def lengths(p: Column) -> Column:
            ends = F.concat(F.slice(p, F.lit(2), F.size(p)), F.array(n + 1))
            return F.zip_with(p, ends, lambda a, b: F.struct(F.element_at(s, a).alias("item"), (b - a).alias("c")))

        return let(spots, lengths)

    empty = F.array().cast("array<struct<item:string,c:int>>")
    return let(F.sort_array(items), lambda s: F.when(F.size(s) > 0, runs(s)).otherwise(empty))


def contains_any(toks: Column, wanted: Sequence[str]) -> Column:
    return F.arrays_overlap(toks, F.array(*[F.lit(w) for w in wanted]))
