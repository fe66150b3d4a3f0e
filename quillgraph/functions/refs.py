"""Line-level provenance: maps of document to line tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def token_lines(token: Column) -> Column:
    """Line numbers of one token: ``3``, ``5-7``, also reversed; anything else gives none."""
    text = F.trim(token)
    low = F.trim(F.regexp_extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 1)).try_cast("int")
    high = F.trim(F.regexp_extract(text, r"^\s*(\d+)\s*-\s*(\d+)\s*$", 2)).try_cast("int")
    one = F.when(text.rlike(r"^[+-]?\d+$") & ~text.contains("-"), text.try_cast("int"))
    return (
        F.when(low.isNotNull() & high.isNotNull(), F.sequence(F.least(low, high), F.greatest(low, high)))
        .when(one.isNotNull(), F.array(one))
        .otherwise(F.array().cast("array<int>"))
    )


def ref_union(a: Column, b: Column) -> Column:
    """Documents of both maps; tokens united and sorted as strings."""
    merged = F.map_zip_with(
        F.coalesce(a, F.create_map().cast("map<string,array<string>>")),
        F.coalesce(b, F.create_map().cast("map<string,array<string>>")),
        lambda _, x, y: F.array_sort(F.array_union(F.coalesce(x, F.array().cast("array<string>")), F.coalesce(y, F.array().cast("array<string>")))),
    )
    return merged


def filter_ref(ref: Column, docs: list[str] | Column) -> Column:
    """Entries of the given documents; for long lists explode and semi-join instead."""
    keep = docs if isinstance(docs, Column) else F.array(*[F.lit(d) for d in docs]).cast("array<string>")
    return F.map_filter(ref, lambda k, _: F.array_contains(keep, k))


def support(ref: Column) -> Column:
    """Number of distinct documents."""
    return F.coalesce(F.size(F.map_keys(ref)), F.lit(0))


def prop_entries(properties: Column) -> Column:
    """Top-level properties of a JSON object as map<string,variant>; null if it does not parse to an object."""
    return F.try_variant_get(F.try_parse_json(properties), "$", "map<string,variant>")


def merge_props(winner: Column, loser: Column) -> Column:
    """JSON object with the properties of both; the winner's count where both have one. Keys of an object come out in
    alphabetical order within either source; what does not parse counts as empty."""
    nothing = F.expr("cast(parse_json('{}') as map<string,variant>)")
    w = F.coalesce(prop_entries(winner), nothing)
    extra = F.map_filter(F.coalesce(prop_entries(loser), nothing), lambda k, _: ~F.array_contains(F.map_keys(w), k))
    return F.to_json(F.map_concat(w, extra))


def fold_properties(rows: DataFrame, keys: list[str], order: Column, *, properties: str = "properties", last: bool = False) -> DataFrame:
    """(keys, properties): one JSON object a group with, for every top-level key, the value of the row of least (``last``: greatest) ``order``.

    One value a property and group travels, however many rows a group has.
    """
    bag = rows.select(*keys, order.alias("__o"), F.explode(F.map_entries(prop_entries(F.col(properties)))).alias("e"))
    best = bag.groupBy(*keys, F.col("e.key").alias("k")).agg((F.max_by if last else F.min_by)(F.to_json("e.value"), "__o").alias("v"))
    entries = best.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("k", "v"))).alias("es"))
    return entries.select(*keys, F.to_json(F.map_from_entries(F.transform("es", lambda e: F.struct(e["k"].alias("key"), F.parse_json(e["v"]).alias("value"))))).alias("properties"))


def fold_refs(rows: DataFrame, keys: list[str], *, ref: str = "ref") -> DataFrame:
    """(keys, ref): the union of the references of every group, tokens sorted as strings."""
    tokens = rows.select(*keys, F.explode(ref).alias("d", "ts")).select(*keys, "d", F.explode_outer("ts").alias("t"))
    by_doc = tokens.groupBy(*keys, "d").agg(F.array_sort(F.collect_set("t")).alias("ts"))
    return by_doc.groupBy(*keys).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("d", "ts")))).alias("ref"))
