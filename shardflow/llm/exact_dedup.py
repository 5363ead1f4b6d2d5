"""Exact dedup by content-defined chunk recipes, on built-in functions alone.

A text, with every run of white space replaced by one space, is cut at spaces
that lie between certain letters, so the same passage is cut alike wherever it
stands.  Chunks are deduplicated once, whole, by content; a chunk's number is a
64-bit hash plus, where two different chunks share a hash, its place among
those (the hash is thereby verified, not trusted).  A text is then the ordered
list of its chunk numbers, its recipe: texts are equal exactly when recipes
are.  Only chunks that are seen for the first time in a task cross the network;
groups are found on recipes, some eight bytes per few hundred letters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shardflow.llm.key_filter import marked
from shardflow.scratch import materialise

#: White space that is not yet a single space.
UNEVEN_SPACE = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"
#: A cut: after one of these endings and before one of these beginnings.
CUT = r" (?<=[aeiou][dnr] )(?=[a-i][a-n])"
#: Longest chunk in letters, for texts without cuts.
LONGEST = 8192


def normalised(text: Column | str) -> Column:
    """The text with one space for every run of white space; null counts as empty."""
    text = F.col(text) if isinstance(text, str) else text
    return F.regexp_replace(F.coalesce(text, F.lit("")), UNEVEN_SPACE, " ")


def chunks(text: Column) -> Column:
    """The text cut into chunks that each end with a space; joined together they are the text and a space."""

    def ended(part: Column) -> Column:
        whole = F.concat(part, F.lit(" "))
        pieces = F.regexp_extract_all(whole, F.lit(f"(?s).{{1,{LONGEST}}}"), F.lit(0))
        return F.when(F.length(part) < LONGEST, F.array(whole)).otherwise(pieces)

    return F.flatten(F.transform(F.split(text, CUT), ended))


def _number(chunk: Column, bits: int) -> Column:
    return F.shiftright(F.xxhash64(chunk), 64 - bits)


def recipes(docs: DataFrame, id: str, text: str, bits: int = 64) -> DataFrame:
    """``(row, id, sha, recipe, places)`` of every row, written down.

    ``places`` tells apart chunks that share a number; it is empty but for
    texts with such a chunk.  ``bits`` shortens the hash (for tests).
    """
    norm = docs.select(F.col(id).cast("bigint").alias("id"), normalised(text).alias("norm"))
    cut = norm.select("id", "norm", chunks(F.col("norm")).alias("chunks"))
    listed = cut.select(
        F.monotonically_increasing_id().alias("row"),
        "id",
        F.sha2("norm", 256).alias("sha"),
        F.transform("chunks", lambda c: _number(c, bits)).alias("recipe"),
    )
    listed = materialise(listed, "recipes")

    known = cut.select(F.explode("chunks").alias("chunk")).select(_number(F.col("chunk"), bits).alias("number"), "chunk").distinct()
    shared = known.groupBy("number").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("number")
    shared = materialise(shared, "shared-numbers")
    nowhere = F.array().cast("array<struct<at:int,place:bigint>>")
    if shared.isEmpty():
        return listed.withColumn("places", nowhere)
    clashes = materialise(known.join(shared, "number"), "chunk-clashes")
    # Chunks with one number get places in the order of their texts, found by
    # counting smaller ones.
    placed = (
        clashes.alias("x").join(clashes.alias("y"), F.expr("x.number = y.number and y.chunk < x.chunk"), "left")
        .groupBy("x.number", "x.chunk").agg(F.count("y.chunk").alias("place"))
    )
    touched = listed.select("sha", F.explode("recipe").alias("number")).join(clashes.select("number").distinct(), "number")
    texts = cut.withColumn("sha", F.sha2("norm", 256)).join(touched.select("sha").distinct(), "sha", "left_semi")
    spots = (
        texts.select("norm", F.posexplode("chunks").alias("at", "chunk"))
        .withColumn("number", _number(F.col("chunk"), bits))
        .join(placed, ["number", "chunk"])
        .where("place > 0")
        .groupBy("norm").agg(F.array_sort(F.collect_set(F.struct("at", "place"))).alias("places"))
        .select(F.sha2("norm", 256).alias("sha"), "places")
    )
    whole = listed.join(spots, "sha", "left").select(*listed.columns, F.coalesce("places", nowhere).alias("places"))
    return materialise(whole, "placed-recipes")


def exact_groups(docs: DataFrame, id: str = "doc_id", text: str = "text", *, bits: int = 64) -> DataFrame:
    """``(<id>, keep_id, group_size, kept, text_sha256)``, one row per row of ``docs``.

    Rows whose texts are equal but for white space are one group, of which the
    row with the smallest id stays (of repeated rows with that id, one).  Null
    texts count as empty, and all empty texts are equal.  A null id comes after
    all others; if a whole group has none, ``keep_id`` is null and one row
    stays.  Other columns are not looked at.
    """
    listed = recipes(docs, id, text, bits)
    last = F.lit((1 << 63) - 1).cast("bigint")
    groups = listed.groupBy("recipe", "places").agg(
        F.min("id").alias("keep_id"),
        F.count(F.lit(1)).alias("group_size"),
        F.min_by("row", F.coalesce("id", last)).alias("keep_row"),
    )
    return listed.join(groups, ["recipe", "places"]).select(
        F.col("id").alias(id),
        "keep_id",
        "group_size",
        (F.col("row") == F.col("keep_row")).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def without_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names.

    Only rows that go, and ids with a text that occur more than once, are named in
    tables; texts are joined with those, not with all that stay, and only texts
    whose id may be named there travel.
    """
    key = F.struct(F.col(id).cast("bigint").alias("id"), F.col("text_sha256").alias("sha")).alias("key")
    told = exact_groups(docs, id, text).groupBy(key).agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    told = materialise(told.where("not kept or n > 1"), "not-as-they-are")
    sha = F.sha2(normalised("text"), 256).alias("sha")
    rows = docs.select(F.struct("*").alias("row"), F.col(id).cast("bigint").alias("id"), F.col(text).alias("text"))
    split = marked(rows, told.select("key.id"), "id", "perhaps")
    mine = split.where("perhaps").select("row", F.struct("id", sha).alias("key"))
    stay = split.where("not perhaps").select("row").unionByName(mine.join(told.select("key"), "key", "left_anti").select("row"))
    repeated = materialise(told.where("kept").select("key"), "repeated-rows")
    if not repeated.isEmpty():  # rows with one id and text: one of them
        once = mine.join(repeated, "key", "left_semi").dropDuplicates(["key"]).select("row")
        stay = stay.unionByName(once)
    return stay.select("row.*")
