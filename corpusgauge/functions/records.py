"""Column rules for messy records: JSON replies, run names, ratio and list strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgauge.functions.text import let

# Run names look like topic_genrerewrite_structure_T0.7_s2.
RUN_NAME = r"^([^_]+)_([^_]+)rewrite_(nonlinear|linear)_T([0-9.]+)_s([0-9]+)$"


def repaired_json(reply: Column) -> Column:
    """Full-width marks to ASCII, fences off, cut after the balanced end, joined values to one list.

    Brackets count outside strings only.  Objects that follow each other become a
    list, lists that follow each other one list; other text ends the value.  A value
    that never closes gives an empty string.
    """
    text = F.translate(reply, "，。", ",.")
    fenced = F.regexp_extract(text, r"```(?:json)?([\s\S]*?)```", 1)
    text = F.trim(F.when(F.contains(text, F.lit("```")) & (fenced != ""), fenced).otherwise(text))
    text = F.regexp_extract(text, r"[\[{][\s\S]*", 0)
    start = F.struct(
        F.lit(0).alias("depth"), F.lit(False).alias("over"), F.lit(0).alias("at"), F.lit(0).alias("begin"), F.array().cast("array<string>").alias("values"),
    )

    def scanned(text: Column) -> Column:
        parts = F.regexp_extract_all(text, F.lit(_JSON_PARTS), F.lit(0))
        return F.aggregate(parts, start, lambda s, x: _json_step(text, s, x), lambda s: s["values"])

    return let(let(text, scanned), _joined_values)


def _joined_values(done: Column) -> Column:
    """One value as it is; several as one list, lists by their items."""
    inner = F.array_join(F.transform(done, lambda v: F.substring(v, F.lit(2), F.length(v) - 2)), ",")
    lists = F.concat(F.lit("["), inner, F.lit("]"))
    objects = F.concat(F.lit("["), F.array_join(done, ","), F.lit("]"))
    first = F.get(done, 0)
    return F.when(F.size(done) > 1, F.when(F.startswith(first, F.lit("[")), lists).otherwise(objects)).otherwise(F.coalesce(first, F.lit("")))


#: A string (an open one runs to the end), a bracket, or what stands between them.
_JSON_PARTS = r'"(?:[^"\\]|\\[\s\S])*"?|[\[\]{}]|[^\[\]{}"]+'


def _json_step(text: Column, state: Column, part: Column) -> Column:
    """One part of the scan: depth, where the open value began, the closed values."""
    over, at, depth = state["over"], state["at"], state["depth"]
    opens, closes = part.isin("[", "{"), part.isin("]", "}")
    inside = (depth > 0) | opens
    # Between values only white space and the same opening bracket may stand.
    other_kind = opens & (F.size(state["values"]) > 0) & ~F.startswith(F.get(state["values"], 0), part)
    ends = over | (~inside & part.rlike(r"[^ \n\r\t]")) | ((depth == 0) & other_kind)
    after = at + F.length(part)
    closed = inside & closes & (depth == 1) & ~ends
    value = F.substring(text, state["begin"] + 1, after - state["begin"])
    return F.struct(
        F.when(ends, 0).otherwise(depth + opens.cast("int") - closes.cast("int")).alias("depth"),
        ends.alias("over"),
        after.alias("at"),
        F.when((depth == 0) & opens, at).otherwise(state["begin"]).alias("begin"),
        F.when(closed, F.concat(state["values"], F.array(value))).otherwise(state["values"]).alias("values"),
    )


def run_parameters(name: Column) -> dict[str, Column]:
    """Topic, genre, structure, temperature and seed; NULL where the name does not parse."""

    def part(index: int) -> Column:
        return F.nullif(F.regexp_extract(name, RUN_NAME, index), F.lit(""))

    return {
        "topic": part(1),
        "genre": part(2),
        "structure": part(3),
        "temperature": F.round(part(4).try_cast("double"), 3),
        "seed": part(5).try_cast("int"),
    }


def parsed_ratio(text: Column) -> dict[str, Column]:
    """``m/n`` (with any note after it) or a plain number; NULL when neither."""
    trimmed = F.trim(text)
    top = F.nullif(F.regexp_extract(trimmed, r"^([0-9]+)/([0-9]+)", 1), F.lit("")).try_cast("double")
    bottom = F.nullif(F.regexp_extract(trimmed, r"^([0-9]+)/([0-9]+)", 2), F.lit("")).try_cast("double")
    plain = F.nullif(F.regexp_extract(trimmed, r"^([0-9]*\.?[0-9]+)$", 1), F.lit("")).try_cast("double")
    return {"ratio": F.coalesce(F.try_divide(top, bottom), plain), "top": top, "bottom": bottom}


def parsed_list(text: Column) -> Column:
    """``[0.1, -0.2]`` as array<double>; empty array when the string is bad."""
    return F.coalesce(F.from_json(text, "array<double>"), F.array().cast("array<double>"))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text)).isin("1", "true", "yes")
