"""I-Match fingerprints with randomised lexicon subsets, in DataFrame operations alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.llm.common import staged

#: Inverse document frequency, ln(documents / documents with the term), of the terms that are kept.
IDF_LOW, IDF_HIGH = 1.0, 6.0
#: Lexicon subsets: so many of them, each with one term in `modulus`, chosen by the hash's bits from `shift` on.
SUBSETS = ((1, 1, 0), (16, 32, 0), (16, 128, 8), (16, 512, 16))
#: Cells that approximate percentiles cut the ids into, and these percentiles' accuracy.
CELLS, ACCURACY = 256, 10_000
#: Rows of a range of ids that are put in order together, and about the most ranges there are.
RANGE_ROWS, MOST_RANGES = 2_000, 65_536


def terms(text: Column) -> Column:
    """Distinct lower-case runs of letters and digits, and the empty string, which stands for the text itself."""
    return F.array_distinct(F.concat(F.array(F.lit("")), F.split(F.lower(text), r"[^\p{L}\p{N}]+")))


def lexicon(texts: DataFrame, column: str = "text") -> DataFrame:
    """Hashes of the terms in the band, and of the empty string.

    A text holds m different terms on average and a kept term is in at least documents / e**IDF_HIGH texts, so
    there are m * e**IDF_HIGH at most (403 m), however many texts there are: small enough to broadcast.
    """
    empty = F.xxhash64(F.lit(""))
    counts = texts.select(F.explode(terms(F.col(column))).alias("term")).groupBy(F.xxhash64("term").alias("h")).agg(F.count("*").alias("n"))
    total = texts.agg(F.count("*").alias("total"))
    idf = F.log(F.col("total") / F.col("n"))
    return counts.crossJoin(F.broadcast(total)).filter(idf.between(IDF_LOW, IDF_HIGH) | (F.col("h") == empty)).select("h")


def subset_hashes(kept: str, text_hash: str) -> Column:
    """A hash for every lexicon subset over the sorted terms in it, 0 where the text has none; last the text's hash if no term is kept."""

    def group(count: int, modulus: int, shift: int) -> str:
        """The subsets of one modulus: terms in none of them are passed over first."""
        place = f"(shiftright(t, {shift}) & {modulus - 1})"
        own = f"transform(array(filter({kept}, t -> {place} < {count})), g -> transform(sequence(0, {count - 1}), j -> filter(g, t -> {place} = j)))[0]"
        return f"transform({own}, f -> IF(size(f) = 0, 0, CAST(xxhash64(f) & 2147483647 AS INT)))"

    groups = ", ".join(group(*s) for s in SUBSETS)
    return F.expr(f"concat({groups}, array(IF(size({kept}) = 0, CAST({text_hash} & 2147483647 AS INT), 0)))")


def likeness(a: str, b: str) -> Column:
    """Share of the subsets with a hash in either fingerprint in which both have the same."""
    pairs = f"zip_with({a}, {b}, (x, y) -> IF(x = 0 AND y = 0, NULL, x = y))"
    return F.expr(f"coalesce(size(filter({pairs}, e -> e)) / nullif(size(filter({pairs}, e -> e IS NOT NULL)), 0), 0D)")


def shown(column: str) -> Column:
    return F.expr(f"array_join(transform({column}, x -> IF(x = 0, '', lower(hex(x)))), '.')")


def _part(cuts: str = "cuts") -> Column:
    """The cell of an id: -1 without one, odd for an id that is a cut, even between two cuts."""
    below = F.expr(f"size(filter({cuts}, c -> c < doc_id))")
    return F.when(F.col("doc_id").isNull(), -1).otherwise(2 * below + F.coalesce(F.get(cuts, below) == F.col("doc_id"), F.lit(False)).cast("int"))


def _ranged(docs: DataFrame) -> DataFrame:
    """Adds range and h: ranges of about RANGE_ROWS rows each, in order of id and h.

    Approximate percentiles cut the ids into cells, whose sizes are counted; a cell is cut further into ranges of
    equal width. A cell of a single id, or of null ids, is cut by the texts' hashes h, which are 0 in all others.
    So neither an outlying id nor one that many rows share makes a large range.
    """
    shares = F.array(*(F.lit(i / CELLS) for i in range(1, CELLS)))
    cuts = F.broadcast(docs.agg(F.coalesce(F.array_distinct(F.percentile_approx("doc_id", shares, F.lit(ACCURACY))), F.array().cast("array<bigint>")).alias("cuts")))
    celled = docs.crossJoin(cuts).withColumn("part", _part()).drop("cuts")
    sizes = docs.select("doc_id").crossJoin(cuts).groupBy(_part().alias("part")).agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("rows"))
    every, upto = Window.partitionBy(), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    least = F.greatest(F.lit(RANGE_ROWS), F.ceil(F.sum("rows").over(every) / MOST_RANGES))
    # 2 * CELLS rows at most
    cells = sizes.withColumn("pieces", F.ceil(F.col("rows") / least)).withColumn("base", F.coalesce(F.sum("pieces").over(upto), F.lit(0)))
    one = F.coalesce(F.col("lo") == F.col("hi"), F.lit(True)) & (F.col("pieces") > 1)
    cells = cells.select("part", "base", "pieces", "lo", one.alias("one"), ((F.col("hi").cast("double") - F.col("lo") + 1) / F.col("pieces")).alias("width"))
    held = celled.join(F.broadcast(cells), "part").withColumn("h", F.when(F.col("one"), F.shiftrightunsigned(F.xxhash64("text"), 1)).otherwise(F.lit(0)))
    by_hash, by_id = F.col("h") / F.lit(2.0**63) * F.col("pieces"), (F.col("doc_id").cast("double") - F.col("lo")) / F.col("width")
    piece = F.coalesce(F.floor(F.when(F.col("one"), by_hash).otherwise(by_id)), F.lit(0))
    return held.withColumn("range", (F.col("base") + F.least(piece, F.col("pieces") - 1)).cast("long")).select("doc_id", "text", "h", "range")


def in_order(docs: DataFrame) -> DataFrame:
    """Adds range, nth, next_text, next_range, next_nth: each row's place and that of the row with the next id.

    The first row of each range is also sent to the range before it, so the next row is always at hand and no task
    sorts all ids. The last id's next is the first. Rows with equal ids follow each other in order of text, or
    of their texts' hashes where they are many. Null ids follow each other too; the last of them has no next one.
    """
    dealt = _ranged(docs)
    firsts = dealt.groupBy("range").agg(F.min("doc_id").alias("first"), F.min("h").alias("first_h"))
    order, whole = Window.partitionBy(F.isnull("first")).orderBy("range"), Window.partitionBy(F.isnull("first"))
    # one row a range, MOST_RANGES + 2 * CELLS at most
    firsts = firsts.withColumn("before", F.coalesce(F.lag("range").over(order), F.when(F.col("first").isNotNull(), F.max("range").over(whole)))).filter("before IS NOT NULL")
    found = dealt.join(F.broadcast(firsts), "range").filter("doc_id <=> first AND h = first_h")
    guests = found.select("doc_id", "text", "h", F.col("before").alias("range"), F.lit(1).alias("guest"), F.col("range").alias("home"))
    both = dealt.select("doc_id", "text", "h", "range", F.lit(0).alias("guest"), F.lit(None).cast("long").alias("home")).unionByName(guests)
    w = Window.partitionBy("range").orderBy("guest", "doc_id", "h", "text")
    return (
        both.select("*", F.row_number().over(w).alias("nth"), F.lead("text").over(w).alias("next_text"), F.lead("home").over(w).alias("next_home"))
        .filter("guest = 0")
        .withColumn("next_range", F.coalesce("next_home", "range"))
        .withColumn("next_nth", F.when(F.col("next_home").isNotNull(), 1).otherwise(F.col("nth") + 1))
        .drop("guest", "home", "next_home", "h")
    )


def fingerprint_edits(docs: DataFrame, columns: tuple[str, str] = ("doc_id", "text")) -> DataFrame:
    """Fingerprints of every text and of its edit, and how alike they and the next document's are.

    The edit replaces the last half of the code points by the first as many of the next document. Of each text
    the terms within the band of inverse document frequency are kept, sorted, and hashed for each lexicon subset.
    Frequencies cover all documents. Texts are shuffled once, by range of ids; the terms of a text never leave
    their task; only fingerprints are joined afterwards.

    Null texts count as empty; an empty text's fingerprint is the hash of the empty text, as is that of any text
    without a kept term, so equal texts always have equal fingerprints. Rows with null ids are edited among
    themselves; rows of one id follow each other by text, or by hash of the text where they are many. An empty table gives no rows. Extra columns are ignored.
    """
    key, text = columns
    docs = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    edited = F.concat(F.expr("left(text, length(text) - CAST(length(text) DIV 2 AS INT))"), F.coalesce(F.expr("left(next_text, CAST(length(text) DIV 2 AS INT))"), F.lit("")))
    rows = in_order(docs).withColumn("edited", edited)
    rows = rows.select(
        "range", "nth", "text", "edited",
        F.struct("doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("sha"), F.xxhash64("text").alias("h"), F.xxhash64("edited").alias("e"), "next_range", "next_nth").alias("own"),
    )
    both = rows.select("range", "nth", "own", F.explode(F.array(F.struct(F.lit(0).alias("of"), "text"), F.struct(F.lit(1).alias("of"), F.col("edited").alias("text")))).alias("v"))
    parts = both.select("range", "nth", F.when(F.col("v.of") == 0, F.col("own")).alias("own"), F.col("v.of").alias("of"), F.explode(terms(F.col("v.text"))).alias("term"))
    parts = parts.select("range", "nth", "of", F.col("term") == "", F.when(F.col("term") == "", F.col("own")).alias("own"), F.xxhash64("term").alias("h")).toDF("range", "nth", "of", "whole", "own", "h")
    kept = parts.join(F.broadcast(lexicon(docs)), "h", "left_semi")

    def gathered(of: int) -> Column:
        return F.sort_array(F.collect_list(F.when(~F.col("whole") & (F.col("of") == of), F.col("h"))))

    found = kept.groupBy("range", "nth").agg(gathered(0).alias("kept"), gathered(1).alias("kept_e"), F.first("own", ignorenulls=True).alias("own"))
    found = found.select("range", "nth", "own.*", subset_hashes("kept", "own.h").alias("f"), subset_hashes("kept_e", "own.e").alias("g"))
    found = staged(found.drop("h", "e"), "fingerprints")
    after = found.select(F.col("range").alias("next_range"), F.col("nth").alias("next_nth"), F.col("f").alias("nf"))
    return found.join(after, ["next_range", "next_nth"], "left").select(
        "doc_id", "n_chars", F.col("sha").alias("edited_sha256"), shown("f").alias("fingerprint"), shown("g").alias("edited_fingerprint"),
        likeness("f", "g").alias("near_edited"), likeness("f", "nf").alias("near_next"),
    )
