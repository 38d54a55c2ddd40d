"""Merkle fingerprints of documents, with DataFrame functions only.

A text is paragraphs (lines) of short sentence pieces. A paragraph's digest is
that of its text, a section is a group of paragraphs that ends where a paragraph's
digest says so (so an edit moves no other boundary), its digest is that of its
paragraphs, and the root is the digest of the sections. A fingerprint is

    root:section=paragraph,paragraph/section=paragraph...

with a paragraph given as the 8-digit digests of its pieces. Equal roots mean
equal texts; differing sections, and in them differing paragraphs, locate edits;
the share of common pieces tells how alike two texts are.

Edge cases: NULL is the empty text, which has a fingerprint too. Repeated rows
have equal fingerprints. Neighbours by id: NULL ids come last, equal ids are in
order of their text's hash. The next document of a lone one is itself. Other
columns are ignored. Empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PIECE = r"[^.!?]{1,40}[.!?]*|[.!?]+"
ROWS = 512       # documents of a place
SEGMENTS = 64    # of the id range
SHIFT = 40       # bits for the places of a segment


def tree(text: Column) -> Column:
    """Fingerprint and distinct piece digests of a text, as a struct."""
    pieces = lambda line: F.transform(
        F.regexp_extract_all(line, F.lit(PIECE), F.lit(0)), lambda p: F.substring(F.sha1(p), 1, 8)
    )
    return F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda line: F.struct(F.sha1(line).alias("digest"), pieces(line).alias("pieces")),
    )


def fingerprint(paragraphs: Column) -> Column:
    """The fingerprint string of a tree."""
    listed = F.array_join(
        F.transform(paragraphs, lambda p: F.concat(p["digest"], F.lit("="), F.array_join(p["pieces"], ""))), ","
    )
    # A section ends behind a paragraph whose digest ends with 0 or 8.
    sections = F.split(F.regexp_replace(listed, "([08]=[0-9a-f]*),", "$1/"), "/")
    digests = F.transform(sections, lambda s: F.sha1(s))
    short = F.transform(sections, lambda s: F.concat(F.substring(F.sha1(s), 1, 8), F.lit("="), F.regexp_replace(s, "[0-9a-f]{40}=", "")))
    return F.concat(F.sha2(F.array_join(digests, ""), 256), F.lit(":"), F.array_join(short, "/"))


def piece_set(paragraphs: Column) -> Column:
    return F.array_distinct(F.flatten(F.transform(paragraphs, lambda p: p["pieces"])))


def likeness(one: Column, pieces: Column, other: Column, others: Column) -> Column:
    """1 for equal fingerprints, else the share of common pieces (Dice)."""
    common = F.size(F.array_intersect(pieces, others))
    total = F.size(pieces) + F.size(others)
    return F.when(one == other, F.lit(1.0)).when(total > 0, 2.0 * common / total).otherwise(F.lit(0.0))


def pieces_of(column: Column) -> Column:
    """Distinct piece digests, out of a fingerprint string."""
    return F.array_distinct(F.regexp_extract_all(F.regexp_replace(column, "^[^:]*:|[0-9a-f]{8}=", ""), F.lit("[0-9a-f]{8}"), F.lit(0)))


def differing_paragraphs(one: Column, other: Column) -> Column:
    """Paragraphs of one fingerprint, as its digests, that are not in the other; equal sections are skipped."""
    branches = lambda c: F.split(F.regexp_replace(c, "^[^:]*:", ""), "/")
    lines = lambda c: F.flatten(F.transform(c, lambda s: F.split(F.regexp_replace(s, "^[0-9a-f]{8}=", ""), ",")))
    return F.when(one == other, F.array().cast("array<string>")).otherwise(
        F.array_except(lines(F.array_except(branches(one), branches(other))), lines(branches(other)))
    )


def _place(docs: DataFrame, id_column: str) -> Column:
    """Groups neighbouring ids: at most SEGMENTS bounds by quantiles, then equal steps."""
    found = docs.agg(
        F.count(F.lit(1)), F.min(id_column), F.max(id_column),
        F.percentile_approx(id_column, [k / SEGMENTS for k in range(1, SEGMENTS)], 2000),
    ).first()
    rows, low, high, cuts = found
    steps = max(1, -(-rows // (SEGMENTS * ROWS)))
    unknown = -1 - F.pmod(F.xxhash64("text"), F.lit(max(1, rows // ROWS)))  # NULL ids, in any order
    if low is None:
        return unknown
    starts = sorted({low, *(cuts or [])})
    ends = [*starts[1:], high + 1]
    widths = [max(1, -(-(e - s) // steps)) for s, e in zip(starts, ends, strict=True)]
    as_longs = lambda values: F.array(*[F.lit(v).cast("long") for v in values])
    one = F.col(id_column)
    segment = F.size(F.filter(as_longs(starts), lambda s: s <= one))
    inside = F.floor((one - F.element_at(as_longs(starts), segment)) / F.element_at(as_longs(widths), segment))
    return F.when(one.isNull(), unknown).otherwise(F.shiftleft(segment.cast("long"), SHIFT) + inside)


def with_next_text(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Documents (id, text, tree ...) with the text and fingerprint of the next one by falling id.

    Ids are dealt to places, neighbours to the same; within a place the next is
    the next row, and the last row of a place takes the first of the place below.
    """
    held = docs.select(F.col(f"`{id_column}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    held = held.withColumn("place", _place(held, "id")).withColumn("h", F.xxhash64("text"))
    below = _places_below(held)

    within = Window.partitionBy("place").orderBy(F.desc_nulls_last("id"), F.asc("h"))
    dealt = held.repartition("place")  # the one exchange of texts; all below keeps to it
    described = dealt.withColumn("tree", tree(F.col("text"))).select(
        "*", fingerprint(F.col("tree")).alias("fingerprint"), piece_set(F.col("tree")).alias("pieces")
    ).drop("tree")
    chained = described.withColumn("following", F.lead(F.struct("text", "fingerprint", "pieces")).over(within))

    heads = dealt.withColumn("rank", F.row_number().over(within)).filter("rank = 1").select(
        F.col("place").alias("at"), "text", tree(F.col("text")).alias("tree"))
    heads = heads.join(below, F.col("at") == F.col("next_place")).select(
        F.col("this").alias("above"),
        F.struct("text", fingerprint(F.col("tree")).alias("fingerprint"), piece_set(F.col("tree")).alias("pieces")).alias("head"))
    joined = chained.join(heads, F.col("place") == F.col("above"), "left")
    return joined.withColumn("following", F.coalesce("following", "head")).drop("head", "above", "h", "place")


def _places_below(held: DataFrame) -> DataFrame:
    """(this, next_place): the next lower place that has rows; the lowest is followed by the highest."""
    places = held.select("place").distinct().withColumn("segment", F.shiftright("place", SHIFT))
    lower = F.lead("place").over(Window.partitionBy("segment").orderBy(F.desc("place")))
    tops = places.groupBy("segment").agg(F.max("place").alias("top"))  # at most SEGMENTS and one for NULL
    wrap = F.max("top").over(Window.partitionBy())
    tops = tops.select(F.col("segment").alias("of"), F.coalesce(F.lead("top").over(Window.orderBy(F.desc("segment"))), wrap).alias("top"))
    return places.withColumn("lower", lower).join(tops, F.col("segment") == F.col("of")).select(
        F.col("place").alias("this"), F.coalesce("lower", "top").alias("next_place"))


def edited_fingerprints(docs: DataFrame, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike neighbours are.

    The edit replaces the last floor(n / 2) code points by the first as many of
    the next text.
    """
    paired = with_next_text(docs, id_column, text)
    count = F.char_length("text")
    half = F.floor(count / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), count - half), F.substring(F.col("following.text"), F.lit(1), half))
    made = paired.select(
        "id", count.cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "pieces",
        F.col("following.fingerprint").alias("next_fingerprint"), F.col("following.pieces").alias("next_pieces"),
    ).withColumn("tree", tree(F.col("edited")))
    made = made.select(
        "*", fingerprint(F.col("tree")).alias("edited_fingerprint"), piece_set(F.col("tree")).alias("edited_pieces"),
    ).drop("tree")
    return made.select(
        F.col("id").alias(id_column), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        "fingerprint", "edited_fingerprint",
        likeness(F.col("fingerprint"), F.col("pieces"), F.col("edited_fingerprint"), F.col("edited_pieces")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.col("pieces"), F.col("next_fingerprint"), F.col("next_pieces")).alias("near_next"),
    )
