"""I-Match fingerprints: digests of the distinct terms that are neither too common nor too rare.

The lexicon holds the terms whose inverse document frequency lies in a band. A text's terms
in the lexicon are sorted; the whole of them and those in several random subsets of the
lexicon are hashed. Subsets of one draw are nested and shrink fourfold, so that texts of any
length have subsets in which they hold only a few terms: these survive an edit elsewhere.

Document frequencies are counted over all documents per term (its 64-bit hash) with map-side
combine, and the band is applied to terms. The lexicon is the exact list of those inside,
broadcast as one row; texts are then fingerprinted where they are, without a shuffle. The list
is bounded whatever the corpus: a term of idf <= high is in e^-high of the documents or more, so
there are at most e^high (665 by default) times the mean number of distinct terms of a text.

Defined results: a null or empty text has no terms, all its subsets are empty; a text none of
whose terms is in the lexicon is taken by all its terms; equal texts have equal fingerprints;
repeated rows are each fingerprinted; an empty corpus gives an empty lexicon; other columns
are carried along, except ones named like a result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

BUCKET_BITS = 13  # the lexicon is a list of 2^13 lists of hashes, by their last bits
# Draw d looks at the bits of a term's hash from 16 + 4 d on; its subset of level l holds the
# terms whose next l bits are zero.
DRAWS, LEVELS = 10, (1, 3, 5, 7, 9)
EMPTY = 42  # last 32 bits of the hash of an empty array
BLOCK = 4096  # rows ordered together, about


def terms(text: Column) -> Column:
    """Hashes of the distinct lower-cased runs of letters and digits, sorted."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(corpus: DataFrame, text: str = "text", low: float = 1.5, high: float = 6.5) -> DataFrame:
    """One row with `lexicon`, the hashes of the terms whose idf = ln(documents / document
    frequency) lies in [low, high], in 2^BUCKET_BITS buckets by their last bits."""
    size = 1 << BUCKET_BITS
    found = corpus.select(F.explode(terms(F.coalesce(text, F.lit("")))).alias("term"))
    counts = found.groupBy("term").agg(F.count(F.lit(1)).alias("n"))
    total = corpus.agg(F.count(F.lit(1)).alias("total"))
    idf = F.log(F.col("total") / F.col("n"))
    buckets = (
        counts.join(F.broadcast(total))
        .filter(idf.between(low, high))
        .groupBy(F.col("term").bitwiseAND(F.lit(size - 1)).alias("bucket"))
        .agg(F.collect_list("term").alias("inside"))
    )
    every = corpus.sparkSession.range(size).select(F.col("id").alias("bucket"))
    none = F.array().cast("array<long>")
    filled = every.join(buckets, "bucket", "left").select("bucket", F.coalesce("inside", none).alias("inside"))
    ordered = F.array_sort(F.collect_list(F.struct("bucket", "inside")))
    return filled.agg(F.transform(ordered, lambda w: w["inside"]).alias("lexicon"))


def _last_bits(terms_: Column) -> Column:
    """The last 32 bits of the hash of a list of terms, as an int."""
    return F.shiftright(F.shiftleft(F.xxhash64(terms_), 32), 32).cast("int")


def fingerprinted(
    df: DataFrame,
    corpus: DataFrame | None = None,
    text: str = "text",
    marks: str = "marks",
    keep: list[str] | None = None,
    words: DataFrame | None = None,
    **band,
) -> DataFrame:
    """Add `marks`: hashes of the text's lexicon terms, of all and of each random subset.

    `corpus` (column `text`) gives the document frequencies; `band` is that of `lexicon`. A lexicon
    made before is given as `words`.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c != marks]
    names = {c: f"__c{i}" for i, c in enumerate(kept)}
    known = lexicon(corpus, **band) if words is None else words
    whole = df.select(
        *[F.col(c).alias(n) for c, n in names.items()], terms(F.coalesce(text, F.lit(""))).alias("__terms")
    ).join(F.broadcast(known.withColumnRenamed("lexicon", "__lexicon")))
    inside = F.expr(f"filter(__terms, h -> array_contains(get(__lexicon, CAST(h & {(1 << BUCKET_BITS) - 1} AS INT)), h))")
    chosen = whole.withColumn("__in", inside).drop("__lexicon")
    some = F.when(F.size("__in") > 0, F.col("__in")).otherwise(F.col("__terms"))
    chosen = chosen.withColumn("__kept", some).drop("__in", "__terms")
    kept = F.col("__kept")
    draws = [_nested(kept, 16 + 4 * d, 0) for d in range(DRAWS)]
    every = F.concat(F.array(_last_bits(kept)), *draws)
    return chosen.select(*[F.col(n).alias(c) for c, n in names.items()], every.alias(marks))


def _nested(hashes: Column, shift: int, level: int) -> Column:
    """Hashes of the subsets of one draw from LEVELS[level] on. They are nested, so each is taken
    from the one before it; a subset is the one element of an array, to be computed once."""
    mask = ((1 << LEVELS[level]) - 1) << shift
    subset = F.array(F.filter(hashes, lambda h: h.bitwiseAND(F.lit(mask)) == 0))

    def both(own: Column) -> Column:
        first = F.array(_last_bits(own))
        return F.concat(first, _nested(own, shift, level + 1)) if level + 1 < len(LEVELS) else first

    return F.flatten(F.transform(subset, both))


def written(marks: str) -> Column:
    """The fingerprint as one string, eight hex digits for each hash."""
    digits = F.transform(marks, lambda m: F.lpad(F.lower(F.hex(m.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0"))
    return F.array_join(digits, "")


def likeness(a: str, b: str) -> Column:
    """Share of the draws whose smallest subset with a term of either text has the same terms of both.

    Draws without a term of either do not count; where none counts, texts with the same terms
    are 1 alike and others 0.
    """
    votes = []
    for d in range(DRAWS):
        vote = F.lit(None).cast("double")
        for place in range(1 + d * len(LEVELS), 1 + (d + 1) * len(LEVELS)):
            left, right = F.get(a, F.lit(place)), F.get(b, F.lit(place))
            vote = F.when((left != EMPTY) | (right != EMPTY), (left == right).cast("double")).otherwise(vote)
        votes.append(vote)
    known = F.array_compact(F.array(*votes))
    share = F.aggregate(known, F.lit(0.0), lambda x, y: x + y) / F.size(known)
    same = (F.get(a, F.lit(0)) == F.get(b, F.lit(0))).cast("double")
    return F.when(F.size(known) > 0, share).otherwise(same)


def with_next(
    df: DataFrame,
    order: str,
    columns: list[str],
    add: Callable[[DataFrame], DataFrame] | None = None,
    added: tuple[str, ...] = (),
) -> DataFrame:
    """Add `next_<c>`: the columns of the row with the next smaller `order` (a whole number; null
    comes last, ties by a hash of the columns), of the first row after the last one.

    Rows are ordered in blocks of about BLOCK rows: as many equal stretches of the numbers, counted
    first, and stretches of the hash for rows without a number. So neither sparse numbers nor many
    nulls put all rows, or all blocks, into one place. Rows are shuffled once, by block; between
    blocks only each one's first row moves. `add` gives the rows the columns `added`, row by row: it
    works on rows that are in their order already, once for each, and their next values are added too.
    """
    facts = df.agg(F.count(order).alias("n"), F.min(order).alias("low"), F.max(order).alias("high"), F.count(F.lit(1)).alias("all"))
    n, low, high, every = facts.first()
    width = max(1, -(-((high - low + 1) if n else 1) * BLOCK // max(n, 1)))
    loose = max(1, -(-(every - n) // BLOCK))  # blocks of rows without a number
    number, tie = F.col(order).cast("decimal(20,0)"), F.xxhash64(*columns)
    numbered = F.floor((number - F.lit(low or 0)) / F.lit(width)).cast("long")
    # Hashes run from -2^63; the shift keeps the order of the blocks that of the hashes.
    hashed = F.floor((tie.cast("double") / 2.0**63 + 1) / 2 * loose).cast("long") - loose - 1
    rows = df.withColumns({"__block": F.coalesce(numbered, hashed), "__tie": tie})
    place = Window.partitionBy("__block").orderBy(F.col(order).desc_nulls_last(), F.col("__tie").desc())
    first_of = F.struct(*columns)
    ahead = rows.withColumns({"__next": F.lead(first_of).over(place), "__at": F.row_number().over(place)})
    # The same shuffle serves the rows and the first row of every block.
    heads = ahead.filter("__at = 1").drop("__next")
    add = add or (lambda rows: rows)
    heads = add(heads).select("__block", first_of.alias("__head"), F.struct(F.lit(0).alias("__0"), *added).alias("__head_added"))
    chain = Window.orderBy(F.col("__block").desc())
    follows = rows.select("__block").distinct().select(
        "__block", F.coalesce(F.lead("__block").over(chain), F.first("__block").over(chain)).alias("__then")
    )
    borders = follows.join(heads.withColumnRenamed("__block", "__then"), "__then").select("__block", "__head", "__head_added")
    more = F.lead(F.struct(F.lit(0).alias("__0"), *added)).over(place)
    joined = add(ahead).withColumn("__next_added", more).join(borders, "__block", "left")
    nearest = {c: F.coalesce("__next", "__head")[c] for c in columns}
    nearest |= {c: F.coalesce("__next_added", "__head_added")[c] for c in added}
    return joined.select(*df.columns, *added, *[value.alias(f"next_{c}") for c, value in nearest.items()])
