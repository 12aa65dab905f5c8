"""SimHash fingerprints of documents, in DataFrame operations only.

A term is a word with up to two words behind it; it votes on 64 bits with its hash, once per occurrence,
so its weight is its count. A bit of the fingerprint is set if more than half of the votes are for it.
Votes are summed in pairs: one long sum counts two bits in its halves, so 32 sums make a fingerprint
inside whole-stage code, with partial sums before any shuffle.

Fingerprints within a Hamming radius are found through permuted block tables: with r bits allowed to
differ and the bits cut into r + k blocks, some k blocks agree, so there is one table per choice of k
blocks, keyed by their bits. A pair is reported by the first table in which it agrees.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tallyframe.llm.common import whole_text
from tallyframe.session import materialise

BITS = 64
RADIUS = 3
#: blocks that must agree; with radius 3 there are 20 tables keyed by 32 bits
AGREEING = 3
#: bits of an id that are ordered at once when each document's successor is looked up
_ORDER_BITS = 16
_PAIR = (1 << 32) | 1


def _words(text: Column) -> Column:
    blanks = "\t\n\x0b\x0c\r"
    return F.array_remove(F.split(F.translate(text, blanks, " " * len(blanks)), " "), "")


def fingerprints(texts: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys``, ``number``, a signed 64-bit fingerprint, and ``rows``: how many rows have these keys and so this text.

    Null, empty and blank texts have the number zero. Equal texts have equal numbers.
    """
    words = texts.select(*keys, _words(whole_text(text)).alias("w"))
    terms = words.select(*keys, F.posexplode_outer(F.arrays_zip(
        F.col("w").alias("a"), F.slice("w", F.lit(2), F.size("w")).alias("b"), F.slice("w", F.lit(3), F.size("w")).alias("c"))).alias("pos", "t"))
    hashed = terms.select(*keys, "pos", F.when(F.col("t.a").isNotNull(), F.xxhash64("t.a", "t.b", "t.c")).alias("h"))
    votes = hashed.groupBy(*keys).agg(F.count("h").alias("n"), F.count_if(F.coalesce("pos", F.lit(0)) == 0).alias("rows"), *(
        F.sum(F.shiftrightunsigned("h", b).bitwiseAND(F.lit(_PAIR))).alias(f"v{b}") for b in range(32)))
    number = F.lit(0).cast("long")
    for b in range(32):
        low, high = F.col(f"v{b}").bitwiseAND(F.lit((1 << 32) - 1)), F.shiftrightunsigned(f"v{b}", 32)
        for bit, count in ((b, low), (b + 32, high)):
            number = number.bitwiseOR(F.when(2 * count > F.col("n"), F.lit((1 << bit) - (1 << 64) * (bit == 63))).otherwise(F.lit(0).cast("long")))
    return votes.select(*keys, number.alias("number"), "rows")


def digits(number: str) -> Column:
    return F.lower(F.lpad(F.hex(number), BITS // 4, "0"))


def likeness(one: str, other: str) -> Column:
    """The cosine between two texts' term counts that their differing bits estimate, 0 if negative."""
    differing = F.bit_count(F.col(one).bitwiseXOR(F.col(other)))
    return F.when(differing == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.cos(differing * F.lit(3.141592653589793 / BITS))))


def successors(ids: DataFrame, id: str = "doc_id") -> DataFrame:
    """``id`` and the next greater one, ``next`` (null for the greatest), of distinct non-null long ids.

    Ids are ordered within buckets of equal leading bits; the last id of a bucket is followed by the least
    of the next bucket that is used, which the same step finds among bucket numbers. No bucket has more
    than 2^16 ids, and four levels cover 64 bits.
    """
    bucket = F.shiftright(id, _ORDER_BITS)
    rows = ids.select(id, bucket.alias("bucket"))
    inside = rows.withColumn("next", F.lead(id).over(Window.partitionBy("bucket").orderBy(id)))
    first = rows.groupBy("bucket").agg(F.min(id).alias("first"))

    def following(firsts: DataFrame, shift: int) -> DataFrame:
        """(bucket, then): the first id of the next used bucket."""
        up = F.shiftright("bucket", _ORDER_BITS)
        if shift >= 64:
            return firsts.select("bucket", F.lead("first").over(Window.partitionBy(F.lit(0)).orderBy("bucket")).alias("then"))
        above = firsts.withColumn("up", up)
        led = above.withColumn("near", F.lead("first").over(Window.partitionBy("up").orderBy("bucket")))
        beyond = following(above.groupBy("up").agg(F.min("first").alias("first")).withColumnRenamed("up", "bucket"), shift + _ORDER_BITS)
        beyond = beyond.withColumnsRenamed({"bucket": "up", "then": "far"})
        return led.join(beyond, "up", "left").select("bucket", F.coalesce("near", "far").alias("then"))

    then = following(first, 2 * _ORDER_BITS)
    return inside.join(then, "bucket", "left").select(id, F.coalesce("next", "then").alias("next"))


def within(numbers: DataFrame, queries: DataFrame, radius: int = RADIUS, agreeing: int = AGREEING) -> DataFrame:
    """(query, number, bits): all numbers that differ from a query in 1 to ``radius`` bits; both inputs distinct (number)."""
    blocks = radius + agreeing
    edges = [BITS * i // blocks for i in range(blocks + 1)]
    masks = [sum((1 << b) for i in chosen for b in range(edges[i], edges[i + 1])) for chosen in combinations(range(blocks), agreeing)]
    masks = [m - (1 << 64) if m >> 63 else m for m in masks]

    def tables(rows: DataFrame, name: str) -> DataFrame:
        places = F.array(*[F.lit(m) for m in masks])
        dealt = rows.select(F.col("number").alias(name), F.posexplode(places).alias("place", "mask"))
        return dealt.select(name, "place", F.col(name).bitwiseAND(F.col("mask")).alias("key"))

    differing = F.col("query").bitwiseXOR(F.col("number"))
    earliest = F.lit(len(masks))
    for place, mask in reversed(list(enumerate(masks))):
        earliest = F.when(differing.bitwiseAND(F.lit(mask)) == 0, F.lit(place)).otherwise(earliest)
    left, right = tables(queries, "query").alias("q"), tables(numbers, "number").alias("n")
    near = F.bit_count(differing).between(1, radius) & (F.col("q.place") == earliest)
    return left.join(right, (F.col("q.place") == F.col("n.place")) & (F.col("q.key") == F.col("n.key")) & near).select(
        "query", "number", F.bit_count(differing).alias("bits"))


def edited(documents: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, key, text, edited, next: the last quarter of a text replaced by the start of the next document's.

    Null text is empty. Rows with a null id have no next document and lose their last quarter. Where an
    id is repeated, its rows share the next document, and the text of least hash is its predecessor's next.
    """
    # Both joins take the same three columns by the same key, so texts are dealt out once, and sums per document
    # can be made where they lie. The key stands in for the id because it is never null, which keeps filters on
    # null ids out of one of the two branches. Rows without an id need no other row, so their texts' hashes spread them.
    spread = F.concat(F.lit("none "), F.xxhash64(whole_text(text)).cast("string"))
    rows = documents.select(F.col(id).alias("doc_id"), F.coalesce(F.col(id).cast("string"), spread).alias("key"), whole_text(text).alias("text"))
    quarter = F.floor(F.char_length("text") / 4).cast("int")
    sizes = materialise(rows.select("doc_id", quarter.alias("quarter")), "quarters").where("doc_id is not null")
    needs = sizes.groupBy("doc_id").agg(F.max("quarter").alias("quarter"), F.count(F.lit(1)).alias("n"))
    follows = materialise(successors(needs.select("doc_id")), "successors")
    ends = needs.agg(F.min("doc_id"), F.max("n")).first()
    follows = follows.select("doc_id", F.coalesce("next", F.lit(ends[0]).cast("long")).alias("next"))
    wanted = needs.join(follows, "doc_id").select(F.col("doc_id").alias("before"), F.col("next").cast("string").alias("key"), "quarter")
    starts = rows.join(wanted, "key").select(F.col("before").cast("string").alias("key"), F.col("doc_id").alias("next"), F.expr("substr(text, 1, quarter)").alias("start"), F.xxhash64("text").alias("own"))
    if (ends[1] or 0) > 1:
        starts = starts.groupBy("key", "next").agg(F.min_by("start", "own").alias("start"))
    kept = F.expr("substr(text, 1, char_length(text) - cast(floor(char_length(text) / 4) as int))")
    end = F.expr("substr(start, 1, cast(floor(char_length(text) / 4) as int))")
    return rows.join(starts, "key", "left").select("doc_id", "key", "text", F.concat(kept, F.coalesce(end, F.lit(""))).alias("edited"), "next")


def compare(documents: DataFrame, *, id: str = "doc_id", text: str = "text", every: int = 50) -> DataFrame:
    """Fingerprints of every row and of its edited text, their likeness, and neighbours of a query set.

    Queries are the rows whose id is divisible by ``every``; for them n_near counts the rows with another
    fingerprint within the radius, nearest_bits and nearest_id name the nearest (null for other rows).
    Null and empty texts have fingerprint zero and keep it when edited with nothing; a row with a null id has
    no next document, so near_next is 0; repeated rows are returned each, and share the next document;
    of several rows that the next id has, the text of least hash is meant. An empty table gives an empty result; other columns are ignored.
    """
    rows = edited(documents, id=id, text=text)
    keys = ["key", "doc_id", "next", "n_chars", "edited_sha256", "own"]
    both = rows.select("key", "doc_id", "next", F.char_length("text").cast("long").alias("n_chars"),
                       F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.xxhash64("text").alias("own"),
                       F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("text").alias("t")),
                                         F.struct(F.lit(1).alias("side"), F.col("edited").alias("t")))).alias("s"))
    sides = materialise(fingerprints(both.select(*keys, "s.side", "s.t"), [*keys, "side"], "t"), "simhashes")
    side = lambda n: F.max(F.when(F.col("side") == n, F.col("number")))
    wide = materialise(sides.groupBy(*keys).agg(side(0).alias("number"), side(1).alias("edited_number"), F.max("rows").alias("rows")), "simhashes")

    nexts = wide.where("doc_id is not null").groupBy("doc_id").agg(F.min_by("number", "own").alias("next_number")).withColumnRenamed("doc_id", "next")
    tally = wide.groupBy("number").agg(F.sum("rows").alias("rows"), F.min("doc_id").alias("least"))
    asked = F.coalesce(F.pmod("doc_id", F.lit(every)) == 0, F.lit(False))
    near = within(tally.select("number"), wide.where(asked).select("number").distinct())
    near = near.join(tally, "number").groupBy("query").agg(F.sum("rows").alias("n_near"), F.min(F.struct("bits", "least")).alias("nearest"))
    found = wide.join(nexts, "next", "left").join(near, wide["number"] == near["query"], "left")
    return found.select(
        "doc_id", "n_chars", "edited_sha256", digits("number").alias("fingerprint"), digits("edited_number").alias("edited_fingerprint"),
        likeness("number", "edited_number").alias("near_edited"), likeness("number", "next_number").alias("near_next"),
        F.when(asked, F.coalesce("n_near", F.lit(0))).alias("n_near"), F.when(asked, F.col("nearest.bits")).alias("nearest_bits"),
        F.when(asked, F.col("nearest.least")).alias("nearest_id"),
        F.explode(F.array_repeat(F.lit(0), F.col("rows").cast("int")))).drop("col")
