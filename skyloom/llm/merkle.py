"""Merkle trees over the sections and paragraphs of texts, by DataFrame functions only.

A section is what lies between line feeds; its paragraphs are sentences, and where one is longer than ``LEAF``
characters, pieces of that length. A leaf is the md5 of a paragraph, a section's node the md5 of its leaves, the root
the md5 of the sections' nodes. Equal roots mean equal texts; where roots differ, only sections with differing nodes need
to be opened to find the paragraphs that were edited.

As a string a fingerprint is the root, a colon, and for each section (after a slash from the second on) eight hex digits
of its node followed by eight of each leaf.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

LEAF = 120
PARAGRAPH = rf"[^.!?]{{1,{LEAF}}}[.!?]*|[.!?]+"
SHORT = 8


def tree(text: Column) -> Column:
    """array<array<string>>: for each section the md5 of each paragraph. A null text is an empty one: one section without leaves."""
    return F.transform(F.split(F.coalesce(text, F.lit("")), "\n", -1), lambda s: F.transform(F.regexp_extract_all(s, F.lit(PARAGRAPH), F.lit(0)), lambda p: F.md5(p)))


def nodes(leaves: Column) -> Column:
    """array<string>: the node of each section of a ``tree``."""
    return F.transform(leaves, lambda s: F.md5(F.concat(F.lit("s"), F.array_join(s, ""))))


def root(section_nodes: Column) -> Column:
    return F.md5(F.concat(F.lit("r"), F.array_join(section_nodes, "")))


def short(leaves: Column) -> Column:
    """array<string>: the shortened leaves of all sections, as a fingerprint holds them."""
    return F.transform(F.flatten(leaves), lambda p: F.left(p, F.lit(SHORT)))


def fingerprint(leaves: Column, section_nodes: Column) -> Column:
    parts = F.zip_with(section_nodes, leaves, lambda n, s: F.concat(F.left(n, F.lit(SHORT)), F.array_join(F.transform(s, lambda p: F.left(p, F.lit(SHORT))), "")))
    return F.concat(root(section_nodes), F.lit(":"), F.array_join(parts, "/"))


def likeness(root_a: Column, short_a: Column, root_b: Column, short_b: Column) -> Column:
    """1 for equal roots, else twice the number of common different leaves by the number of both's; 0 if neither has leaves."""
    both = F.size(F.array_distinct(short_a)) + F.size(F.array_distinct(short_b))
    return F.when(root_a == root_b, 1.0).when(both == 0, 0.0).otherwise(2.0 * F.size(F.array_intersect(short_a, short_b)) / F.greatest(both, F.lit(1)))


def changed_sections(leaves_a: Column, leaves_b: Column) -> Column:
    """The differing branches: array<struct<section, leaves>>. Sections whose node the other tree has too are the same,
    wherever they stand; those left over are paired in order, and their paragraphs are compared by place. section is the
    place (from 0) in b, or in a where b lacks it; leaves are the places of paragraphs that differ or that one side lacks."""
    none = F.array().cast("array<string>")

    def left_over(own: Column, other: Column) -> Column:
        placed = F.transform(own, lambda s, i: F.struct(i.alias("i"), s.alias("s")))
        return F.filter(placed, lambda x: ~F.array_contains(nodes(other), F.md5(F.concat(F.lit("s"), F.array_join(x["s"], "")))))

    pairs = F.zip_with(left_over(leaves_a, leaves_b), left_over(leaves_b, leaves_a), lambda a, b: F.struct(F.coalesce(b["i"], a["i"]).alias("section"), F.coalesce(a["s"], none).alias("a"), F.coalesce(b["s"], none).alias("b")))
    differing = lambda x: F.filter(F.transform(F.zip_with(x["a"], x["b"], lambda p, q: p.eqNullSafe(q)), lambda same, k: F.when(~same, k)), lambda k: k.isNotNull())
    return F.transform(pairs, lambda x: F.struct(x["section"], differing(x).alias("leaves")))


def quantiles(rows: DataFrame, column: str, ranges: int) -> Column:
    """Bounds of so many ranges of about equally many rows, ascending, in arrays of some sqrt(ranges) each: one literal in plans."""
    width = max(1, round(ranges**0.5))
    found = rows.agg(F.array_distinct(F.percentile_approx(column, [k / ranges for k in range(1, ranges)], 100 * ranges)).alias("b")).first()["b"] or []
    return F.from_json(F.lit(json.dumps([found[k : k + width] for k in range(0, len(found), width)])), "array<array<bigint>>")


def place(value: Column, bounds: Column) -> Column:
    """How many of the bounds (a result of ``quantiles``) lie below value; null for null. The arrays that lie below
    as a whole are counted first, then one is searched."""
    whole = F.size(F.filter(bounds, lambda b: F.element_at(b, -1) < value))
    within = F.filter(bounds, lambda b: (F.element_at(b, -1) >= value) & (F.element_at(b, 1) < value))
    rest = F.coalesce(F.size(F.filter(F.get(within, F.lit(0)), lambda b: b < value)), F.lit(0))
    width = F.coalesce(F.size(F.get(bounds, F.lit(0))), F.lit(0))
    return F.when(value.isNotNull(), whole * width + rest)


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(doc_id, text, next_text): each text (null: empty) beside that of the next document in descending doc_id.

    After the last document comes the first. Null ids are last; rows of one id are ordered by text. Documents are dealt to
    ranges of ids between quantiles of all ids, one shuffle of the texts; the head of each range is copied to the end of
    the range before it, so that no window spans the table.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    ranges = parts or 4 * partitions(docs.sparkSession)
    rows = rows.withColumn("range", F.coalesce(place(F.col("doc_id"), quantiles(rows, "doc_id", ranges)), F.lit(-1)))
    heads = rows.groupBy("range").agg(F.max("doc_id").alias("head"))  # a row for each range
    order = Window.orderBy(F.desc("range"))
    heads = heads.select("range", "head", F.coalesce(F.lag("range").over(order), F.min("range").over(Window.partitionBy())).alias("before"))
    led = rows.join(F.broadcast(heads.withColumnRenamed("range", "__range")), (F.col("range") == F.col("__range")) & F.col("doc_id").eqNullSafe(F.col("head")), "left")
    own = F.struct("range", F.lit(False).alias("copy"))
    copied = F.struct(F.col("before").alias("range"), F.lit(True).alias("copy"))
    dealt = led.select("doc_id", "text", F.explode(F.when(F.col("__range").isNull(), F.array(own)).otherwise(F.array(own, copied))).alias("at")).select("doc_id", "text", "at.*")
    walk = Window.partitionBy("range").orderBy("copy", F.desc_nulls_last("doc_id"), "text")
    return dealt.withColumn("next_text", F.lead("text").over(walk)).where("not copy").select("doc_id", "text", "next_text")


def fingerprints(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """A row for each of docs: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text is the text with its last half (rounded down) replaced by as many first code points of the next
    text, or all of it. Null texts are empty; an empty text has a root of its own and no leaves. Other columns aren't read.
    """
    rows = with_next(docs, parts)
    half = F.floor(F.length("text") / 2).cast("int")
    rows = rows.withColumn("edited", F.concat(F.left("text", F.length("text") - half), F.left("next_text", half)))
    for name, text in (("own", "text"), ("edit", "edited"), ("next", "next_text")):
        rows = rows.withColumn(name, tree(F.col(text)))
    for name in ("own", "edit", "next"):
        rows = rows.withColumn(f"{name}_nodes", nodes(F.col(name))).withColumn(f"{name}_short", short(F.col(name)))
    for name in ("own", "edit", "next"):
        rows = rows.withColumn(f"{name}_root", root(F.col(f"{name}_nodes")))
    near = lambda other: likeness(F.col("own_root"), F.col("own_short"), F.col(f"{other}_root"), F.col(f"{other}_short"))
    return rows.select(
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("own"), F.col("own_nodes")).alias("fingerprint"),
        fingerprint(F.col("edit"), F.col("edit_nodes")).alias("edited_fingerprint"),
        near("edit").alias("near_edited"),
        near("next").alias("near_next"),
    )
