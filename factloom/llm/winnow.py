"""Document fingerprints by winnowing, with DataFrame functions alone.

Every run of GRAM code points is hashed; of each WINDOW hashes in a row the least
is chosen, the rightmost of equals; the chosen hashes with their positions are
the fingerprint. Two texts that share GRAM + WINDOW - 1 code points in a row
share a chosen hash, and a shared hash comes from texts that share GRAM.

SQL carries no state from one place to the next, so a gram's hash is taken from
its bytes, not updated from the one before. A polynomial hash of grams, built by
doubling (h2 = h1 * b + h1', ...), rolls without cutting grams, but took 1.5 to
1.9 times as long as this on the same texts.

The text becomes four bytes a code point, so that each gram is a slice at a
known place. A hash h at place i travels as the number h * 2**31 - i: the least
number is the least hash at the rightmost place. The least of each window comes
by doubling: of 2, 4, ... neighbours. Long texts go through in overlapping
stretches, so that memory stays bounded.

Defined results: null texts are empty; a text shorter than GRAM is one gram, one
with fewer than WINDOW grams one window; equal texts have equal fingerprints;
the likeness of two fingerprints is the share of their distinct hashes that
both have, 1 for two equal ones. Ids are integers; rows without id come last, and
rows that share an id follow each other by descending text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GRAM = 8
WINDOW = 32  # a power of two
STRETCH = 1 << 16  # windows handled at a time
MAX_BINS = 1 << 16
BINS_A_BUCKET = 8
BUCKET_CHARS = 8_000_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body over a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def chosen(text: Column) -> Column:
    """Array of longs, hash * 2**31 - place, of the chosen grams by position."""

    def least(grams: Column, width: int) -> Column:
        if width == WINDOW:
            return F.array_distinct(grams)
        n = F.size(grams) - width
        return let(F.zip_with(F.slice(grams, 1, n), F.slice(grams, width + 1, n), lambda a, b: F.least(a, b)), lambda x: least(x, 2 * width))

    def of_stretch(points: Column, start: Column, last: Column) -> Column:
        stop = F.least(last, start + 4 * (STRETCH + WINDOW - 2))
        grams = F.transform(F.sequence(start, stop, F.lit(4)), lambda i: F.shiftleft(F.hash(F.substring(points, i, F.lit(4 * GRAM))).cast("long"), 31) - i)
        return let(grams, lambda g: F.when(F.size(g) < WINDOW, F.array(F.array_min(g))).otherwise(least(g, 1)))

    def of_text(points: Column) -> Column:
        last = F.greatest(F.lit(1), F.octet_length(points) - 4 * GRAM + 1)
        starts = F.sequence(F.lit(1), F.greatest(F.lit(1), last - 4 * (WINDOW - 1)), F.lit(4 * STRETCH))
        return F.array_distinct(F.flatten(F.transform(starts, lambda s: of_stretch(points, s, last))))

    return let(F.encode(text, "UTF-32"), of_text)


def position(place: Column) -> Column:
    """The code point at which a chosen gram begins, from 0."""
    return F.shiftright(F.shiftleft(F.shiftright(place + (2**31 - 1), 31), 31) - place, 2).cast("int")


def hashes(places: Column) -> Column:
    return F.transform(places, lambda p: F.shiftright(p + (2**31 - 1), 31).cast("int"))


def positions(places: Column) -> Column:
    return F.transform(places, position)


def edited_hashes(places: Column, edited: Column, kept: Column) -> Column:
    """Hashes of an edited text whose first ``kept`` code points are those of the text with the chosen ``places``.

    A gram whose windows all lie in the kept part is chosen in both or neither; only the rest of the text, from early
    enough to hold every window of the later grams, is winnowed.
    """
    begin = F.greatest(F.lit(0), kept - GRAM - 2 * WINDOW + 2)
    border = F.when(begin > 0, kept - GRAM - WINDOW + 1).otherwise(-1)
    old = F.filter(places, lambda p: position(p) <= border)
    new = F.filter(chosen(F.substr(edited, begin + 1)), lambda p: position(p) + begin > border)
    return hashes(F.concat(old, new))


def likeness(a: Column, b: Column) -> Column:
    """Shared distinct hashes over all distinct hashes."""
    return let(F.size(F.array_intersect(a, b)), lambda n: n / (F.size(F.array_distinct(a)) + F.size(F.array_distinct(b)) - n))


def written(found: Column) -> Column:
    return F.array_join(F.transform(found, lambda h: F.lower(F.lpad(F.right(F.hex(h.cast("long")), F.lit(8)), 8, "0"))), "")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Columns: the id, hashes and positions (arrays of int) of the chosen grams."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col), chosen(text).alias("places")).select(id_col, hashes(F.col("places")).alias("hashes"), positions(F.col("places")).alias("positions"))


def place_among(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value, by binary search."""
    if not bounds:
        return F.lit(0)
    steps = [1 << k for k in range(len(bounds).bit_length() - 1, -1, -1)]
    known, n = F.split(F.lit(",".join(map(str, bounds))), ",").cast("array<bigint>"), F.lit(len(bounds))
    return F.aggregate(F.array(*(F.lit(k) for k in steps)), F.lit(0), lambda at, k: F.when((at + k <= n) & (F.get(known, F.least(at + k, n) - 1) <= value), at + k).otherwise(at))


def with_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, Window]:
    """Rows of documents (id, text) in buckets of neighbouring ids, each bucket closed by a copy of the first row of the
    next one (closing is true); and the window in which lead() gives each document's successor by descending id.

    Quantiles of the ids, MAX_BINS at most, cut them into bins of about as many rows each, whatever gaps the ids have;
    neighbouring bins form buckets of about BUCKET_CHARS characters, a partition each. So no sort is global.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.length("text") + 64)).first()[0] or 0
    wanted = min(MAX_BINS, max(1, BINS_A_BUCKET * -(-size // BUCKET_CHARS)))
    shares = [k / wanted for k in range(1, wanted)]
    bounds = rows.agg(F.percentile_approx("id", shares, 4 * wanted)).first()[0] if shares else []
    bounds = sorted(set(bounds or []))
    rows = rows.withColumn("bin", F.when(F.col("id").isNull(), -1).otherwise(place_among(F.col("id"), bounds)))
    sizes = rows.groupBy("bin").agg(F.sum(F.length("text") + 64).alias("size"))
    upto = F.sum("size").over(Window.orderBy("bin"))
    buckets = sizes.select("bin", F.floor((upto - F.col("size")) / BUCKET_CHARS).cast("int").alias("bucket"))  # MAX_BINS + 1 rows at most
    rows = rows.join(F.broadcast(buckets), "bin").select("bucket", "id", "text")
    order = Window.orderBy("bucket")
    chain = buckets.select("bucket").distinct()
    chain = chain.select("bucket", F.coalesce(F.lead("bucket").over(order), F.min("bucket").over(Window.partitionBy())).alias("serves"))
    heads = rows.groupBy("bucket").agg(F.max(F.struct("id", "text")).alias("head")).join(F.broadcast(chain), "bucket").select(F.col("serves").alias("bucket"), "head.id", "head.text", F.lit(True).alias("closing"))
    chained = rows.withColumn("closing", F.lit(False)).unionAll(heads.select("bucket", "id", "text", "closing"))
    many = max(1, -(-size // BUCKET_CHARS), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return chained.repartition(many, "bucket"), Window.partitionBy("bucket").orderBy("closing", F.col("id").desc_nulls_last(), F.col("text").desc())


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each document against its edited text (its second half replaced by the start of the next document by descending id)
    and against the next document: the id, n_chars, edited_sha256, hashes, positions, edited_hashes, near_edited, near_next."""
    chained, window = with_next(docs, id_col, text_col)
    rows = chained.select("*", F.lead("text").over(window).alias("next"), F.length("text").alias("n_chars"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("edited", F.when(~F.col("closing"), F.concat(F.left("text", F.col("n_chars") - half), F.left("next", half))))
    rows = rows.select("bucket", "id", "closing", "text", "n_chars", "edited", chosen(F.col("text")).alias("places"))
    kept = F.col("n_chars") - F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.select("bucket", "id", "closing", "text", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), hashes(F.col("places")).alias("hashes"), positions(F.col("places")).alias("positions"), edited_hashes(F.col("places"), F.col("edited"), kept).alias("edited_hashes"))
    rows = rows.withColumn("next_hashes", F.lead("hashes").over(window)).where("not closing")
    return rows.select(
        F.col("id").alias(id_col),
        F.col("n_chars").cast("long").alias("n_chars"),
        "edited_sha256",
        "hashes",
        "positions",
        "edited_hashes",
        likeness(F.col("hashes"), F.col("edited_hashes")).alias("near_edited"),
        likeness(F.col("hashes"), F.col("next_hashes")).alias("near_next"),
    )
