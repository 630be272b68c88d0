"""Secrets in texts, with DataFrame functions alone.

Base spans (assign, access, hex) are fixed by their patterns and always stay.
Two first-order Markov models over characters, one of random strings and one of
ordinary identifiers, score every further token of MIN_TOKEN characters or more
by its log-likelihood ratio, summed over its transitions; tokens over a limit
become spans of kind "random" unless they overlap a base span.

The models are counts of character pairs in labelled samples. Random strings:
digests in several spellings and lengths, and the base secrets of the sampled
texts. Identifiers: the words of a sample of distinct texts whose base secrets
are cut out, plain, joined, numbered or in capitals, and runs of one mark.
One in five of either kind is held back from the counts: the limit is the least
that lets at most FALSE_SHARE of the identifiers held back pass.

Positions come from two facts: split() by a pattern gives what lies between its
matches, and regexp_extract_all() gives the matches, so running sums of both
lengths are offsets in code points. The sums run by blocks of BLOCK matches, so
that a text with very many matches does not copy its list for each.

Defined results: null and empty texts have no spans; equal texts give equal
spans; an empty sample leaves uniform models, which propose nothing; null ids
and repeated rows are kept as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE_KINDS = ("assign", "access", "hex")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
MIN_TOKEN = 12
TOKEN = rf"[A-Za-z0-9+/_=-]{{{MIN_TOKEN},}}"
#: Distinct documents whose words train the model of ordinary identifiers: this many to twice as many, by their hash.
SAMPLE_ROWS = 2000
RANDOM_STRINGS = 3000
FALSE_SHARE = 0.001
BLOCK = 256
SIZE = 95  # printable ASCII


def matches(text: Column, pattern: str, least: Column | None = None, group: int = 0, group_least: int = 0) -> Column:
    """Array of structs (start, end) of a pattern's leftmost matches; those whose group is shorter than group_least are dropped."""
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    lengths = F.zip_with(F.zip_with(between, whole, lambda b, m: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"))), inner, lambda s, g: F.struct(s["gap"], s["size"], F.length(g).alias("inner")))
    lengths = F.filter(lengths, lambda s: s["size"].isNotNull())
    of = "array<struct<start:int,end:int,inner:int>>"

    def running(block: Column) -> Column:
        """The total length of a block, and its spans from its own begin."""
        return F.aggregate(
            block,
            F.struct(F.lit(0).alias("at"), F.array().cast(of).alias("out")),
            lambda acc, s: F.struct(
                (acc["at"] + s["gap"] + s["size"]).alias("at"),
                F.array_append(acc["out"], F.struct((acc["at"] + s["gap"]).alias("start"), (acc["at"] + s["gap"] + s["size"]).alias("end"), s["inner"].alias("inner"))).alias("out"),
            ),
        )

    def shifted(out: Column, by: Column) -> Column:
        return F.transform(out, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end"), s["inner"].alias("inner")))

    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / BLOCK).cast("int")), lambda b: running(F.slice(lengths, b * BLOCK + 1, BLOCK)))
    joined = F.aggregate(
        blocks,
        F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{of}>").alias("out")),
        lambda acc, b: F.struct((acc["at"] + b["at"]).alias("at"), F.array_append(acc["out"], shifted(b["out"], acc["at"])).alias("out")),
    )["out"]
    placed = F.when(F.size(lengths) == 0, F.array().cast(of)).when(F.size(lengths) <= BLOCK, running(lengths)["out"]).otherwise(F.flatten(joined))
    return F.filter(placed, lambda s: s["inner"] >= group_least) if group_least else placed


def _kind(name: str, spans: Column, order: int, present: Column) -> Column:
    kind = "array<struct<start:int,order:int,end:int,kind:string>>"
    made = F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(name).alias("kind")))
    return F.when(present, made).otherwise(F.array().cast(kind))


def base_spans(text: Column) -> Column:
    """Array of (start, order, end, kind), by start and kind. Cheap searches spare most texts the patterns."""
    low = F.lower(text)
    named = (low.contains("passw") | low.contains("secret") | low.contains("token") | low.contains("apikey") | low.contains("api_key")) & (text.contains(":") | text.contains("="))
    return F.array_sort(
        F.concat(
            _kind("assign", matches(text, ASSIGN, group=2, group_least=6), 0, named),
            _kind("access", matches(text, ACCESS), 1, text.contains("AKIA")),
            _kind("hex", matches(text, HEX), 2, text.rlike(HEX)),
        )
    )


def pair_counts(strings: DataFrame, column: str) -> DataFrame:
    """Counts of character pairs (code) in printable ASCII strings."""
    s = F.col(column)
    code = lambda i: F.ascii(F.substr(s, i, F.lit(1))) - 32
    pairs = F.transform(F.sequence(F.lit(1), F.length(s) - 1), lambda i: code(i) * SIZE + code(i + 1))
    return strings.where(F.length(s) > 1).select(F.explode(pairs).alias("code")).groupBy("code").count()


def samples(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Labelled strings: s, random, and held (not counted). Copies count once, and the same strings are drawn from any
    order of the rows."""
    spark = docs.sparkSession
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    hashed = docs.select(F.xxhash64(text).alias("h"), text.alias("text"))
    every = max(1, hashed.select("h").distinct().count() // sample_rows)
    sample = hashed.where(F.pmod("h", F.lit(every)) == 0).groupBy("h").agg(F.min("text").alias("text"))
    bare = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", ASSIGN, " "), ACCESS, " "), HEX, " ")
    words = sample.select("h", F.regexp_extract_all(bare, F.lit("[A-Za-z]{3,}"), F.lit(0)).alias("w"))
    shaped = words.select(F.posexplode("w").alias("k", "w"), F.get("w", F.col("k") + 1).alias("next")).select("w", "next", F.xxhash64("w", "next").alias("h"))
    join = F.get(F.array(F.lit("_"), F.lit("/"), F.lit("-"), F.lit("")), F.pmod("h", F.lit(4)).cast("int"))
    pair = F.concat("w", join, F.when(join == "", F.initcap("next")).otherwise(F.col("next")))
    plain = shaped.select(F.when(F.col("next").isNull() | (F.pmod("h", F.lit(8)) == 7), F.col("w")).when(F.pmod(F.shiftright("h", 3), F.lit(6)) == 0, F.concat(pair, F.pmod("h", F.lit(1000)).cast("string"))).otherwise(pair).alias("s"))
    plain = plain.select(F.when(F.pmod(F.xxhash64("s"), F.lit(8)) == 0, F.upper("s")).otherwise(F.col("s")).alias("s"))
    runs = spark.range(10_000).select(F.repeat(F.get(F.array(*(F.lit(c) for c in "-=_/+")), (F.col("id") % 5).cast("int")), (2 + F.floor(F.col("id") / 5) % 100).cast("int")).alias("s"))
    seeds = spark.range(RANDOM_STRINGS).select("id", F.sha2(F.col("id").cast("string"), 256).alias("d"))
    spelt = F.array(F.col("d"), F.upper(F.md5("d")), F.base64(F.unhex("d")), F.translate(F.base64(F.unhex(F.sha2("d", 512))), "+/=", "-_"))
    forms = seeds.select("id", F.explode(spelt).alias("s")).select(F.left("s", (MIN_TOKEN + F.col("id") % 53).cast("int")).alias("s"))
    own = sample.select(F.explode(F.concat(F.regexp_extract_all("text", F.lit(HEX), F.lit(0)), F.regexp_extract_all("text", F.lit(ACCESS), F.lit(0)), F.filter(F.regexp_extract_all("text", F.lit(ASSIGN), F.lit(2)), lambda v: v.rlike(rf"^(?=.*[0-9])[^.]{{{MIN_TOKEN},}}$")))).alias("s"))
    labelled = forms.unionAll(own).withColumn("random", F.lit(True)).unionAll(plain.unionAll(runs).withColumn("random", F.lit(False)))
    return labelled.withColumn("held", F.pmod(F.xxhash64("s", F.lit(5)), F.lit(5)) == 0)


def weights(table: list[float]) -> Column:
    return F.split(F.lit(",".join(f"{x:.5f}" for x in table)), ",").cast("array<double>")


def ratio(s: Column, table: Column) -> Column:
    """The log-likelihood ratio of a printable ASCII string, summed over its transitions."""
    code = lambda i: F.ascii(F.substr(s, i, F.lit(1))) - 32
    return F.aggregate(F.sequence(F.lit(1), F.length(s) - 1), F.lit(0.0), lambda acc, i: acc + F.element_at(table, code(i) * SIZE + code(i + 1) + 1))


def ratios(docs: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> tuple[list[float], float]:
    """log P(random) - log P(identifier) of each character pair, SIZE * SIZE numbers, and the limit of a token's sum."""
    import math

    rows = samples(docs, text_col, sample_rows)
    counted = rows.where("not held")
    pairs = pair_counts(counted.where("random"), "s").withColumn("random", F.lit(True)).unionAll(pair_counts(counted.where("not random"), "s").withColumn("random", F.lit(False)))
    table = {True: [[0.5] * SIZE for _ in range(SIZE)], False: [[0.5] * SIZE for _ in range(SIZE)]}
    for code, n, random in pairs.where(F.col("code").between(0, SIZE * SIZE - 1)).collect():
        table[random][code // SIZE][code % SIZE] += n
    total = {k: [sum(row) for row in t] for k, t in table.items()}
    found = [math.log(table[True][a][b] / total[True][a]) - math.log(table[False][a][b] / total[False][a]) for a in range(SIZE) for b in range(SIZE)]
    scores = rows.where(F.col("held") & ~F.col("random") & F.col("s").rlike(f"^{TOKEN}$")).select(ratio(F.col("s"), weights(found)).alias("r"))
    n, limit = scores.agg(F.count(F.lit(1)), F.percentile_approx("r", 1 - FALSE_SHARE, 10_000)).first()
    if docs.limit(1).count() == 0:
        return [0.0] * (SIZE * SIZE), 0.0
    return found, max(0.0, limit or 0.0)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: tuple[list[float], float] | None = None) -> DataFrame:
    """Columns: the id, base and spans: arrays of (start, order, end, kind) by start and kind, spans with the scored tokens."""
    table, limit = ratios(docs, text_col) if model is None else model
    known = weights(table)
    rows = docs.select(F.col(id_col), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("base", base_spans(F.col("text")))
    text = F.col("text")
    tokens = F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))
    rows = rows.withColumn("likely", F.when(text.rlike(TOKEN), F.transform(tokens, lambda s: ratio(s, known) > limit)).otherwise(F.array().cast("array<boolean>")))
    scored = F.zip_with(matches(text, TOKEN), F.col("likely"), lambda m, k: F.struct(m["start"].alias("start"), F.lit(3).alias("order"), m["end"].alias("end"), F.when(k, F.lit("random")).alias("kind")))
    free = F.filter(scored, lambda c: c["kind"].isNotNull() & ~F.exists("base", lambda b: (b["start"] < c["end"]) & (b["end"] > c["start"])))
    found = F.when(F.exists("likely", lambda k: k), free).otherwise(F.array().cast("array<struct<start:int,order:int,end:int,kind:string>>"))
    return rows.select(F.col(id_col), "base", F.array_sort(F.concat("base", found)).alias("spans"))


def written(spans: str) -> Column:
    """kind:start:end of the spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
