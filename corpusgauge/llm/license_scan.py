"""License scan: MinHash bands over overlapping windows, verified by exact containment.

Templates fall into classes by length; a class with templates of up to L words cuts
texts into windows of 2 L words, L apart, so every place where such a template can
stand lies inside a window.  Window and template are compared on shingles of five
words (of all its words for a shorter template).  A window that contains 0.8 of a
template's shingles has a Jaccard similarity of 1/12 at least in the worst case (a
template of one shingle in the longest window of its class); ``BANDS`` bands of one
MinHash value each then collide with probability 1 - (11/12)^128 > 0.99998.
Collisions retrieve (window, template) pairs by a join on (class, band, value), and
the exact share of the template's shingles that the window contains verifies them.

A window can only collide where it holds one of the templates' minimum shingles, and
a text only if it holds that shingle's longest word.  Both tests come first and lose
nothing; they use the bounded template table (``MAX_TEMPLATES``; beyond it the
tests are left out and the join alone decides).

DataFrame functions only: the words, shingles, hashes, bands and intersections are
built-in array functions.

Cases: NULL and empty texts and templates match nothing; a template may match at any
number of windows (``n_windows``); repeated rows and ids count together; NULL ids
are one document; an empty table on either side gives no rows; other columns are
not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusgauge.llm.common import stored
from corpusgauge.llm.license_texts import LICENSES

SHINGLE, CONTAINMENT, BANDS, MAX_TEMPLATES = 5, 0.8, 128, 2_000
_PARTS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Common one-line license statements, then full texts and standard headers.
TEMPLATES = (
    ("all-rights-reserved", "All rights reserved."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    *LICENSES,
)


def words(text: str) -> Column:
    """Lower-cased (A-Z) runs of digits, letters and characters beyond ASCII."""
    # Of a text that is all ASCII, ``lower`` changes A-Z only, and is faster.
    lowered = F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(lowered, _PARTS), "")


def shingles(items: Column, width: Column | int) -> Column:
    """Space-joined shingles of ``width`` words; none if there are fewer words."""
    width = F.lit(width) if isinstance(width, int) else width
    count = F.size(items) - width + 1
    return F.when(
        count > 0, F.transform(F.sequence(F.lit(1), count), lambda i: F.array_join(F.slice(items, i, width), " "))
    ).otherwise(F.array().cast("array<string>"))


def minima(hashes: Column) -> Column:
    """The MinHash value of every band."""
    return F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.array_min(F.transform(hashes, lambda h: F.xxhash64(h, k))))


def prepared(templates: DataFrame, name: str, text: str) -> DataFrame:
    """name, words, width, class, shingles, hashes and minima of every template with words.

    The class is the width below five words and then the power of two that holds the length.
    """
    rows = templates.select(F.col(name).alias("template"), words(text).alias("words")).where("size(words) > 0").dropDuplicates(["template", "words"])
    n = F.size("words")
    rows = rows.withColumn("width", F.least(n, F.lit(SHINGLE)))
    rows = rows.withColumn("class", F.when(n < SHINGLE, n).otherwise(F.pow(F.lit(2), F.ceil(F.log2(n.cast("double")))).cast("int")))
    rows = rows.withColumn("shingles", F.array_distinct(shingles(F.col("words"), F.col("width"))))
    rows = rows.withColumn("hashes", F.transform("shingles", lambda s: F.xxhash64(s)))
    return rows.withColumn("minima", minima(F.col("hashes")))


def scan(docs: DataFrame, templates: DataFrame, key: str = "doc_id", text: str = "text", name: str = "template", template_text: str = "text") -> DataFrame:
    """(key, template, containment, n_windows, first_word): per document and template the best window's share, and where the first matching window starts."""
    known = stored(prepared(templates, name, template_text), "templates")
    classes = known.groupBy("class").agg(F.max("width").alias("width"), F.max(F.size("words")).alias("longest")).orderBy("class").collect()
    few = known.count() <= MAX_TEMPLATES
    # The shingle that has a band's minimum, with its hash and its longest word.
    tops = known.select("class", F.inline(F.arrays_zip("shingles", "hashes")), "minima")
    tops = tops.where(F.exists(F.transform(F.sequence(F.lit(0), F.lit(BANDS - 1)), lambda k: F.xxhash64("hashes", k) == F.get("minima", k)), lambda x: x))
    longest = F.element_at(F.array_sort(F.transform(F.split("shingles", " "), lambda w: F.struct(F.char_length(w).alias("n"), w.alias("w")))), -1)["w"]
    first = F.substring_index("shingles", " ", 1).alias("first")
    tops = tops.select("class", F.col("hashes").alias("hash"), longest.alias("word"), first).distinct().collect() if few else []
    source = docs.select(F.col(key).alias("doc"), words(text).alias("words"))
    if few:
        probes = sorted({r.word for r in tops})
        source = source.where(F.arrays_overlap("words", F.array(*map(F.lit, probes)).cast("array<string>")))
    texts = stored(source.where("size(words) > 0"), "texts")
    found = _windows(texts, classes, tops if few else None)
    windows = stored(found, "windows").where("size(hashes) > 0")
    bands = windows.select("doc", "start", "class", "words", F.posexplode(minima(F.col("hashes"))).alias("band", "value"))
    own = known.select("class", "template", "width", "shingles", F.posexplode("minima").alias("band", "value"))
    own = F.broadcast(own) if few else own  # MAX_TEMPLATES x BANDS rows at most
    pairs = bands.join(own, ["class", "band", "value"]).select("doc", "start", "class", "words", "template", "width", "shingles").distinct()
    share = F.size(F.array_intersect("shingles", shingles(F.col("words"), F.col("width")))) / F.size("shingles")
    hits = pairs.withColumn("share", share).where(F.col("share") >= CONTAINMENT)
    return hits.groupBy(F.col("doc").alias(key), "template").agg(
        F.max("share").alias("containment"),
        F.count_distinct("start").alias("n_windows"),
        F.min("start").alias("first_word"),
    )


def _windows(texts: DataFrame, classes: list, tops: list | None) -> DataFrame:
    """Overlapping windows of every class with the hashes of their shingles; with ``tops`` only windows that hold such a shingle.

    The words are gone through once for all classes; only places of a shingle's first word
    are hashed, once for every width.  The starts come from an outer explode: a plain one
    would make the optimizer work the array out twice.
    """
    n = F.size("words")
    start_type = "array<struct<class:int,width:int,longest:int,start:int>>"
    begins = lambda c, starts: F.transform(starts, lambda s: F.struct(F.lit(c["class"]).alias("class"), F.lit(c["width"]).alias("width"), F.lit(c["longest"]).alias("longest"), s.alias("start")))
    if tops is None:
        starts = [begins(c, F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(c["longest"]))) for c in classes]
    else:
        firsts = sorted({r.first for r in tops})
        texts = texts.withColumn("places", F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.get("words", i).isin(firsts)))
        marks = {c["class"]: [r.hash for r in tops if r["class"] == c["class"]] for c in classes}
        widths = {c["width"]: sorted({m for d in classes if d["width"] == c["width"] for m in marks[d["class"]]}) for c in classes}
        for width, own in widths.items():
            texts = texts.withColumn(f"hits{width}", _hits(width, own))
        starts = [begins(c, _starts(F.filter(f"hits{c['width']}", _among(marks[c["class"]])), c["longest"])) for c in classes]
    starts = F.flatten(F.array(*starts)) if starts else F.array()
    cut = texts.select("doc", "words", F.explode_outer(starts.cast(start_type)).alias("at")).where("at is not null")
    cut = cut.select("doc", "at.start", "at.class", "at.width", F.slice("words", F.col("at.start") + 1, 2 * F.col("at.longest")).alias("words"))
    hashes = F.transform(F.array_distinct(shingles(F.col("words"), F.col("width"))), lambda s: F.xxhash64(s))
    return cut.select("doc", "start", "class", "words", hashes.alias("hashes"))


def _among(marks: list[int]) -> Callable[[Column], Column]:
    return lambda x: x["hash"].isin(marks)


def _hits(width: int, marks: list[int]) -> Column:
    """(place, hash) of the shingles with one of the hashes at ``places``."""
    whole = F.filter("places", lambda i: i <= F.size("words") - width)
    hash_at = lambda i: F.xxhash64(F.array_join(F.slice("words", i + 1, width), " "))
    return F.filter(F.transform(whole, lambda i: F.struct(i.alias("place"), hash_at(i).alias("hash"))), _among(marks))


def _starts(hits: Column, longest: int) -> Column:
    """The two windows that a place lies in; a shingle across a window's end is in the other one."""
    last = lambda x: F.floor(x["place"] / longest).cast("int") * longest
    return F.filter(F.array_distinct(F.flatten(F.transform(hits, lambda x: F.array(last(x) - longest, last(x))))), lambda s: s >= 0)
