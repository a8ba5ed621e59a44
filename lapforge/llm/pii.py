"""Personal data in texts: fixed patterns first, then patterns learnt from where they stand.

Spans of the base kinds are the seeds. The words to the left of a seed are its lexical patterns.
Any other token with a digit or an at sign is a candidate instance, whatever its form, and has
patterns by the same words. Patterns and instances form a bipartite graph, scored in rounds: a
pattern of a kind by the share of sure instances among all instances that it precedes, an instance
by its best pattern. Patterns of enough confidence and support mark the instances they precede,
which may prove further patterns; rounds go on until no pattern is added.

Everything is SQL functions and joins. Texts never move: only spans with their contexts are
shuffled, counted per pattern with map-side combine. Work on a text grows with its length, also
where it is full of matches: positions, overlaps and replacements come from running sums and
maxima over the matches, taken in stretches, not from comparing all with all.

Defined results: a null text is empty (no spans); repeated rows are each scanned; an empty
table gives an empty table; other columns are carried along, except ones named like a result,
which are replaced; without seeds nothing is learnt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lapforge.session import cut_lineage

KINDS = ("email", "ip", "card", "phone")

# The base patterns, written so that no text takes more than linear time. A run of characters
# that begin a match is entered at its start only (or where the last match ended), quantifiers
# do not give back what cannot help, and only digit runs of 14 to 19 digits are cards.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
# A candidate for a learnt pattern: a token of 3 to 64 characters with a digit or an at sign, and the
# groups of digits that go on after a space. Its form is that of no kind.
_TOKEN = r"[^\s\"'<>()\[\],;]"
IDENTIFIER = (
    rf"(?<!{_TOKEN})(?=[^\s\"'<>()\[\],;0-9@]{{0,63}}+[0-9@]){_TOKEN}{{3,64}}(?<![.:!?])(?=[.:!?]*+(?!{_TOKEN}))"
    r"(?:\x20[0-9][0-9.-]{1,7}+(?![^\s\"'<>()\[\],;]))*+"
)
# What a text must hold before a pattern is tried at all.
NEEDS = {"email": "@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]{2}|[0-9][\x20-][0-9]", "phone": r"\+[0-9]"}
CONTEXT_CHARS = 64
STRETCH = 64  # matches of a text whose running values are taken together
CUT = 1024  # characters of a piece of a text
BROADCAST_ROWS = 100_000  # rows with learnt spans up to which they are sent to all tasks
BROADCAST_SPANS = 1_000_000  # and spans in them, 12 bytes each
SPAN = "struct<start:int,kind:int,stop:int>"
SEEN = "struct<start:int,kind:int,stop:int,value:string,near:string,far:string>"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, zero: Column, merge: Callable[[Column, Column], Column]) -> Column:
    """For each element of an array of ints, the merge of all elements before it.

    Taken in stretches: inside one each element merges those before it, between them one value goes on.
    """

    def two(a: Column, b: Column) -> Column:
        return merge(a, b)

    def stretched(values: Column) -> Column:
        last = F.greatest(F.ceil(F.size(values) / F.lit(STRETCH)).cast("int") - 1, F.lit(0))
        return F.transform(F.sequence(F.lit(0), last), lambda c: F.slice(values, c * STRETCH + 1, F.lit(STRETCH)))

    def carried(stretches: Column) -> Column:
        begin = F.struct(zero.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))

        def step(state: Column, stretch: Column) -> Column:
            at = F.aggregate(stretch, state["at"], two)
            return F.struct(at.alias("at"), F.concat(state["out"], F.array(state["at"])).alias("out"))

        return F.aggregate(stretches, begin, step, lambda state: state["out"])

    def inside(stretches: Column, before: Column) -> Column:
        def each(stretch: Column, c: Column) -> Column:
            return F.transform(stretch, lambda _, i: F.aggregate(F.slice(stretch, F.lit(1), i), F.get(before, c), two))

        return F.flatten(F.transform(stretches, each))

    return let(values, lambda v: let(stretched(v), lambda s: let(carried(s), lambda b: inside(s, b))))


def matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, stop, value, before): code points from 0,
    and the text back to the match before the last one."""

    def placed(between: Column, values: Column) -> Column:
        sizes = F.transform(values, lambda v, i: F.length(F.get(between, i)) + F.length(v))

        def each(before: Column) -> Column:
            def one(v: Column, i: Column) -> Column:
                gap = F.get(between, i)
                start = F.get(before, i) + F.length(gap)
                earlier = F.when(i > 0, F.concat(F.right(F.get(between, i - 1), F.lit(CONTEXT_CHARS)), F.get(values, i - 1)))
                context = F.concat(F.coalesce(earlier, F.lit("")), F.right(gap, F.lit(CONTEXT_CHARS)))
                return F.struct(
                    start.alias("start"), (start + F.length(v)).alias("stop"), v.alias("value"), context.alias("before")
                )

            return F.transform(values, one)

        return let(running(sizes, F.lit(0), lambda a, b: a + b), each)

    def found(values: Column) -> Column:
        some = let(F.split(text, pattern, -1), lambda between: placed(between, values))
        none = F.array().cast("array<struct<start:int,stop:int,value:string,before:string>>")
        return F.when(F.size(values) > 0, some).otherwise(none)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), found)


def digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of 14 to 19 digits passes the Luhn check."""
    def weighed(i: Column) -> Column:
        digit = F.substring(F.reverse(number), i, F.lit(1)).cast("int")
        twice = digit * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(digit)

    places = F.sequence(F.lit(1), F.length(number))
    return F.aggregate(F.transform(places, weighed), F.lit(0), lambda a, b: a + b) % 10 == 0


def valid(kind: str, value: Column) -> Column:
    """Whether a match of the base pattern of `kind` counts."""
    if kind == "ip":
        part = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
        return value.rlike(rf"^{part}(?:\.{part}){{3}}$")
    if kind == "card":
        return luhn(digits(value))
    if kind == "phone":
        return F.length(digits(value)).between(10, 15)
    return F.lit(True)


def _seen(text: Column, kind: int, pattern: str) -> Column:
    """Matches of one kind (-1 for none) with their value and left contexts, as array of SEEN."""
    found = matches(text, pattern)
    if kind >= 0:
        found = F.filter(found, lambda m: valid(KINDS[kind], m["value"]))

    def shaped(m: Column) -> Column:
        before = F.regexp_replace(F.right(m["before"], F.lit(CONTEXT_CHARS)), r"[\s\"'<(\[]+", " ")
        words = F.split(F.lower(F.trim(before)), " ")
        last, prior = (F.coalesce(F.get(words, F.size(words) - k), F.lit("")) for k in (1, 2))
        return F.struct(
            m["start"].alias("start"),
            F.lit(kind).alias("kind"),
            m["stop"].alias("stop"),
            F.lower(m["value"]).alias("value"),
            last.alias("near"),
            F.concat_ws(" ", prior, last).alias("far"),
        )

    need = NEEDS[KINDS[kind]] if kind >= 0 else "[0-9@]"
    return F.when(text.rlike(need), F.transform(found, shaped)).otherwise(F.array().cast(f"array<{SEEN}>"))


def apart(spans: Column, others: Column) -> Column:
    """Those of `spans` that overlap none of `others` (both arrays of structs with start and stop)."""
    far = F.lit(2**31 - 1)

    def marked(array: Column, is_span: int) -> Column:
        return F.transform(
            array, lambda s, i: F.struct(s["start"].alias("start"), F.lit(is_span).alias("own"), s["stop"].alias("stop"), i.alias("i"))
        )

    def clear(every: Column) -> Column:
        # What lies before a span must have ended, what lies after it not have begun.
        ended = running(F.transform(every, lambda s: F.when(s["own"] == 0, s["stop"]).otherwise(-1)), F.lit(-1), F.greatest)
        begun = running(F.transform(F.reverse(every), lambda s: F.when(s["own"] == 0, s["start"]).otherwise(far)), far, F.least)

        def kept(ended: Column, begun: Column) -> Column:
            sides = F.transform(
                every, lambda s, i: F.struct(s.alias("s"), F.get(ended, i).alias("low"), F.get(begun, F.size(every) - 1 - i).alias("high"))
            )
            free = F.filter(
                sides, lambda x: (x["s"]["own"] == 1) & (x["low"] <= x["s"]["start"]) & (x["high"] >= x["s"]["stop"])
            )
            return F.transform(free, lambda x: F.get(spans, x["s"]["i"]))

        return let(ended, lambda e: let(begun, lambda b: kept(e, b)))

    both = F.array_sort(F.concat(marked(spans, 1), marked(others, 0)))
    return F.when((F.size(spans) > 0) & (F.size(others) > 0), let(both, clear)).otherwise(spans)


def scanned(df: DataFrame, text: str = "text") -> DataFrame:
    """Add `seeds` (valid base spans in order) and `loose` (candidates that overlap none of them),
    each with value and contexts, and `base`, the seeds' spans alone."""
    df = df.withColumn("__text", F.coalesce(F.col(text), F.lit("")))
    whole = F.col("__text")
    seeds = F.concat(*[_seen(whole, kind, BASE[name]) for kind, name in enumerate(KINDS)])
    df = df.withColumns({"seeds": F.array_sort(seeds), "loose": _seen(whole, -1, IDENTIFIER)}).drop("__text")
    spans = F.transform("seeds", lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["stop"].alias("stop")))
    return df.withColumns({"loose": apart(F.col("loose"), F.col("seeds")), "base": spans})


def _patterns(s: str) -> Column:
    """The patterns of a span: the word before it, and the two words before it."""
    return F.filter(F.array_distinct(F.array(f"{s}.near", f"{s}.far")), lambda p: F.length(p) > 1)


def learnt_patterns(scans: DataFrame, confidence: float = 0.8, support: float = 4.0) -> DataFrame:
    """Patterns (kind, pattern) that bootstrap from the base spans of `scans` with certainty.

    An instance is a distinct value. It is sure of a kind from the start if it is a seed of it. In
    each round a pattern scores, for a kind, (sum of the scores of its instances) / (number of all
    its instances + 1) and is taken if that reaches `confidence` and the sum `support`; an instance
    that is no seed then gets the score of its best pattern taken. Copies of a text count once, for
    values are counted, not spans. Rounds go on until no pattern is added.
    """
    seen = scans.select(F.explode(F.concat("seeds", "loose")).alias("s"))
    edges = cut_lineage(
        seen.select("s.kind", "s.value", F.explode(_patterns("s")).alias("pattern"))
        .groupBy("value", "pattern")
        .agg(F.max("kind").alias("kind"))
    )
    every = edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("all"))
    sure = edges.filter("kind >= 0").select("value", "pattern", "kind", F.lit(1.0).alias("score"))
    taken, n = None, -1
    while True:
        weights = sure.groupBy("kind", "pattern").agg(F.sum("score").alias("weight")).filter(F.col("weight") >= support)
        strong = weights.join(every, "pattern").withColumn("sure", F.col("weight") / (F.col("all") + 1))
        strong = strong.filter(F.col("sure") >= confidence).select("kind", "pattern", "sure")
        # What was taken stays taken, with its best score, so the rounds come to an end.
        strong = strong if taken is None else strong.unionByName(taken).groupBy("kind", "pattern").agg(F.max("sure").alias("sure"))
        taken = cut_lineage(strong)
        before, n = n, taken.count()
        if n == before or n == 0:
            return taken.select("kind", "pattern")
        best = edges.filter("kind < 0").select("value", "pattern").join(taken, "pattern")
        best = best.groupBy("value", F.col("kind").alias("found")).agg(F.max("sure").alias("score"))
        unseen = edges.filter("kind < 0").select("value", "pattern").join(best, "value")
        sure = edges.filter("kind >= 0").select("value", "pattern", "kind", F.lit(1.0).alias("score")).unionByName(
            unseen.select("value", "pattern", F.col("found").alias("kind"), "score")
        )


def personal_spans(df: DataFrame, text: str = "text", keep: list[str] | None = None, **how) -> DataFrame:
    """Add `base_spans` and `spans`: arrays of (start, kind, stop) in order, kinds numbered as in
    KINDS. `spans` holds the base ones and those found by learnt patterns, which overlap no
    base span. `keep` names the other columns to carry along, by default all.
    """
    kept = [c for c in (df.columns if keep is None else keep) if c not in ("base_spans", "spans")]
    renamed = {c: f"__c{i}" for i, c in enumerate(kept)}
    whole = df.select(*[F.col(c).alias(n) for c, n in renamed.items()], F.col(text).alias("__t"))
    scans = cut_lineage(scanned(whole, "__t").drop("__t").withColumn("__row", F.monotonically_increasing_id()))
    found = cut_lineage(found_spans(scans, learnt_patterns(scans, **how)))
    size = found.agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(F.size("more")), F.lit(0)).alias("spans")).first()
    if size.rows <= BROADCAST_ROWS and size.spans <= BROADCAST_SPANS:
        found = F.broadcast(found)
    return scans.join(found, "__row", "left").select(
        *[F.col(n).alias(c) for c, n in renamed.items()],
        F.col("base").alias("base_spans"),
        F.array_sort(F.concat("base", F.coalesce("more", F.array().cast(f"array<{SPAN}>")))).alias("spans"),
    )


def found_spans(scans: DataFrame, patterns: DataFrame) -> DataFrame:
    """(`__row`, `more`): per row the candidates after a learnt pattern, with its kind."""
    unsure = scans.select("__row", F.explode("loose").alias("s"))
    hits = (
        unsure.select("__row", "s.start", "s.stop", F.explode(_patterns("s")).alias("pattern"))
        .join(patterns, "pattern")
        .groupBy("__row", "start", "stop")
        .agg(F.min("kind").alias("kind"))
    )
    # Candidates are matches of one pattern, so they do not overlap each other.
    return hits.groupBy("__row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "stop"))).alias("more"))


def masked(df: DataFrame, text: str = "text", spans: str = "spans") -> DataFrame:
    """`df` with every span of its texts replaced by the kind in brackets, such as [EMAIL].

    Overlapping spans (a number may be both card and phone) are replaced as one, by the kind
    of the first.
    """
    names = F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS])
    whole, every = F.coalesce(F.col(text), F.lit("")), F.col(spans)

    def cut(pieces: Column, start: Column, stop: Column) -> Column:
        """The text from `start` to `stop`, out of the pieces that hold it."""
        first = F.floor(start / F.lit(CUT)).cast("int")
        last = F.greatest(F.floor((stop - 1) / F.lit(CUT)).cast("int"), first)
        held = F.array_join(F.slice(pieces, first + 1, last - first + 1), "")
        return F.substring(held, start - first * CUT + 1, F.greatest(stop - start, F.lit(0)))

    def replaced(pieces: Column, before: Column) -> Column:
        def each(s: Column, i: Column) -> Column:
            at = F.get(before, i)
            name = F.when(s["start"] >= at, F.get(names, s["kind"])).otherwise(F.lit(""))
            return F.concat(cut(pieces, F.least(at, s["start"]), s["start"]), name)

        end = F.aggregate(every, F.lit(0), lambda a, s: F.greatest(a, s["stop"]))
        rest = let(end, lambda e: cut(pieces, e, F.length(whole)))
        return F.concat(F.array_join(F.transform(every, each), ""), rest)

    pieces = F.regexp_extract_all(whole, F.lit(rf"(?s).{{1,{CUT}}}"), F.lit(0))
    before = running(F.transform(every, lambda s: s["stop"]), F.lit(0), F.greatest)
    changed = let(pieces, lambda p: let(before, lambda b: replaced(p, b)))
    return df.withColumn(text, F.when(F.size(spans) > 0, changed).otherwise(F.col(text)))


def written(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["stop"].cast("string"))), ","
    )


def counted(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")
