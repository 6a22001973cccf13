"""Finding the name somebody meant in a list of known names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridlore.session import materialise

# ---- fixed values of the match -------------------------------------------------------------------
FUZZY_CUTOFF = 0.6
SYNONYMS = {
    "date": ["timestamp", "time", "datetime", "dt"],
    "name": ["title", "label", "identifier", "desc", "description"],
    "value": ["amount", "quantity", "number", "total", "sum", "price", "cost"],
    "id": ["identifier", "code", "number", "num"],
    "category": ["type", "class", "group", "kind"],
    "status": ["state", "condition"],
    "age": ["years", "year"],
    "salary": ["wage", "income", "pay"],
    "gender": ["sex"],
    "country": ["nation", "location"],
    "city": ["town", "location"],
}
STAGES = ["exact", "any case", "part", "without underscores", "similar", "synonym", "related"]
# ---- end of fixed values -------------------------------------------------------------------------

def clean_name(column: Column) -> Column:
    """The rule for clean column names, as a column expression."""
    word = F.regexp_replace(column, "[\"'`]", "")
    word = F.regexp_replace(word, r"[^\p{L}\p{N}_]", "_")
    word = F.regexp_replace(F.regexp_replace(word, "_+", "_"), "^_|_$", "")
    return F.lower(F.when(word.rlike(r"^[^\p{L}]"), F.concat(F.lit("col_"), word)).otherwise(word))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 for equal words, 0 for words without a letter in place."""
    return 1 - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b), F.lit(1))


def _has_any(text: Column, words: list[str]) -> Column:
    return text.rlike("|".join(words))


GRAM = 3


def _grams(text: Column) -> Column:
    """All different runs of one to three letters."""
    size = F.length(text)
    return F.array_distinct(F.flatten(F.transform(
        F.filter(F.array(*[F.lit(n) for n in range(1, GRAM + 1)]), lambda n: n <= size),
        lambda n: F.transform(F.sequence(F.lit(1), size - n + 1), lambda at: F.substring(text, at, n)),
    )))


def _containing(outer: DataFrame, inner: DataFrame) -> DataFrame:
    """(out, in): all pairs in which the text ``out`` contains the text ``in``; empty texts are left out.

    A contained text is looked up under the one of its runs of letters that fewest outer texts have, and only what is
    found there is compared.
    """
    looked_up = outer.select("out").distinct().select("out", F.explode(_grams(F.col("out"))).alias("gram"))
    counts = looked_up.groupBy("gram").agg(F.count("*").alias("n"))
    longest = F.filter(_grams(F.col("in")), lambda g: F.length(g) == F.least(F.lit(GRAM), F.length("in")))
    keys = inner.select("in").distinct().select("in", F.explode(longest).alias("gram")).join(counts, "gram", "left")
    rarest = keys.groupBy("in").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("k"))
    rarest = rarest.where("k.n > 0").select("in", F.col("k.gram").alias("gram"))
    return rarest.join(looked_up, "gram").where(F.contains("out", "in")).select("out", "in")


def _allowed(a: Column, b: Column) -> Column:
    """The most edits with which words of these lengths still count as similar."""
    return F.floor(F.greatest(a, b) * (1 - FUZZY_CUTOFF) + 1e-6).cast("int")


def _lengths(size: Column) -> Column:
    """Lengths that a similar word can have."""
    return F.sequence(F.ceil(size * FUZZY_CUTOFF - 1e-6).cast("int"), F.floor(size / FUZZY_CUTOFF + 1e-6).cast("int"))


def _similar(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(a, c, ratio): all pairs of words of asked(a) and known(c) with a ratio of at least the cutoff.

    With at most d edits, let i be the first of d + 1 parts of the known word such that parts 0 to i have i edits at most. All
    of these come before part i, which stands unchanged, and at most d - i come after it. So it has moved by i letters at most,
    and the difference of the lengths, less that, is d - i at most: few places for each part. Words meet by equal length of
    both, number and text of a part; the ratio is computed for these pairs only.
    """
    c, a = F.col("c"), F.col("a")

    def begin(i: Column, size: Column, d: Column) -> Column:
        return F.floor(i * size / (d + 1)).cast("int")

    def parts(la: Column) -> Column:
        d = _allowed(la, F.length(c))
        return F.transform(F.sequence(F.lit(0), d), lambda i: F.struct(
            la.alias("la"), F.length(c).alias("lc"), i.alias("i"),
            F.substring(c, begin(i, F.length(c), d) + 1, begin(i + 1, F.length(c), d) - begin(i, F.length(c), d)).alias("part"),
        ))

    def places(lc: Column) -> Column:
        la, d = F.length(a), _allowed(F.length(a), lc)

        def around(i: Column) -> Column:
            size = begin(i + 1, lc, d) - begin(i, lc, d)
            least, most = F.greatest(-i, la - lc - d + i), F.least(i, la - lc + d - i)
            moves = F.when(least <= most, F.sequence(least, F.greatest(least, most))).otherwise(F.array().cast("array<int>"))
            starts = F.filter(F.transform(moves, lambda m: begin(i, lc, d) + m), lambda s: (s >= 0) & (s + size <= la))
            return F.transform(starts, lambda s: F.struct(
                la.alias("la"), lc.alias("lc"), i.alias("i"), F.substring(a, s + 1, size).alias("part")
            ))

        return F.flatten(F.transform(F.sequence(F.lit(0), d), around))

    names = known.select("c").where("c <> ''").distinct()
    names = names.select("c", F.explode(F.flatten(F.transform(_lengths(F.length(c)), parts))).alias("k"))
    words = asked.select("a").where("a <> ''").distinct()
    words = words.select("a", F.explode(F.array_distinct(F.flatten(F.transform(_lengths(F.length(a)), places)))).alias("k"))
    pairs = words.join(names, "k").select("a", "c").distinct().withColumn("ratio", edit_ratio(a, c))
    return pairs.where(F.col("ratio") >= FUZZY_CUTOFF)


def _stage(number: int, order: Column | float = 0.0) -> Column:
    order = order if isinstance(order, Column) else F.lit(order)
    return F.struct(F.lit(number).alias("stage"), order.cast("double").alias("order"), "position", "name").alias("found")


def _firsts(known: DataFrame, key: Column, name: str) -> DataFrame:
    """The known name with the smallest position for each value of a key."""
    first = known.groupBy(key.alias(name)).agg(F.min(F.struct("position", "name")).alias("_first"))
    return first.select(name, "_first.*")


def match_names(requested: DataFrame, names: DataFrame) -> DataFrame:
    """(asked, name, stage): the known name that each distinct requested name means, or null.

    requested(asked), names(position, name); positions give the order of the names. The first stage that has any match
    wins; within it the position decides, or the similarity for the 'similar' stage. Every stage is an equi-join, and
    the costly ones see only what the cheap ones have left.
    """
    asked = requested.select("asked").where("asked IS NOT NULL").distinct().withColumn("a", clean_name(F.col("asked")))
    known = names.select("position", "name", clean_name(F.col("name")).alias("c"))

    def bare(c: str) -> Column:
        return F.replace(F.col(c), F.lit("_"), F.lit(""))

    equal = [
        asked.join(_firsts(known, F.col("c"), "a"), "a").select("asked", _stage(1)),
        asked.join(_firsts(known, F.lower("name"), "a"), "a").select("asked", _stage(2)),
        asked.withColumn("b", bare("a")).join(_firsts(known, bare("c"), "b"), "b").select("asked", _stage(4)),
    ]
    found = equal[0].unionAll(equal[1]).unionAll(equal[2]).groupBy("asked").agg(F.min("found").alias("found"))
    state = materialise(asked.join(found, "asked", "left"), "names-equal")
    rest = state.where("found IS NULL OR found.stage > 3").select("asked", "a")

    by_clean = _firsts(known, F.col("c"), "c")
    holding = _containing(by_clean.select(F.col("c").alias("out")), rest.select(F.col("a").alias("in"))).toDF("c", "a")
    held = _containing(rest.select(F.col("a").alias("out")), by_clean.select(F.col("c").alias("in"))).toDF("a", "c")
    parts = rest.join(holding.unionByName(held).join(by_clean, "c"), "a").select("asked", _stage(3))
    # an empty name is part of every name
    everywhere = [
        (F.col("a") == "", known.agg(F.min(F.struct("position", "name"))).scalar()),
        (F.lit(True), known.where("c = ''").agg(F.min(F.struct("position", "name"))).scalar()),
    ]
    for holds, first in everywhere:
        empty = rest.where(holds).select("asked", first.alias("_first")).where("_first IS NOT NULL")
        parts = parts.unionAll(empty.select("asked", "_first.*").select("asked", _stage(3)))
    parts = parts.groupBy("asked").agg(F.min("found").alias("_part"))
    state = state.join(parts, "asked", "left")
    state = materialise(state.select("asked", "a", F.least("found", "_part").alias("found")), "names-parts")
    rest = state.where("found IS NULL").select("asked", "a")

    similar = _similar(rest, by_clean).join(by_clean, "c").join(rest, "a").select("asked", _stage(5, -F.col("ratio")))

    def kinds(text: str, words_of) -> Column:
        numbers = [F.when(words_of(F.col(text), k, w), F.lit(i)) for i, (k, w) in enumerate(SYNONYMS.items())]
        return F.explode(F.array_compact(F.array(*numbers)))

    def by_kind(number: int, in_asked, in_known, order: bool) -> DataFrame:
        few = _firsts(known.withColumn("kind", kinds("c", in_known)), F.col("kind"), "kind")
        # at most one row per kind of synonym
        met = rest.withColumn("kind", kinds("a", in_asked)).join(F.broadcast(few), "kind")
        return met.select("asked", _stage(number, F.col("kind") if order else 0.0))

    synonyms = by_kind(6, lambda t, k, w: t.contains(k), lambda t, k, w: _has_any(t, w), True)
    either = lambda t, k, w: _has_any(t, [k, *w])
    others = similar.unionAll(synonyms).unionAll(by_kind(7, either, either, False))
    others = others.groupBy("asked").agg(F.min("found").alias("_other"))
    stages = F.array(*[F.lit(s) for s in STAGES])
    best = state.join(others, "asked", "left").select("asked", F.coalesce("found", "_other").alias("found"))
    return best.select(
        "asked",
        F.col("found.name").alias("name"),
        F.when(F.col("found").isNotNull(), F.get(stages, F.col("found.stage") - 1)).alias("stage"),
    )


def unknown_names(requested: DataFrame, names: DataFrame) -> DataFrame:
    """Requested names that are no known name, with the number of requests and the most similar name."""
    counts = requested.where("asked IS NOT NULL").groupBy("asked").agg(F.count("*").alias("requests"))
    counts = counts.withColumn("a", clean_name(F.col("asked")))
    known = names.select("position", "name", clean_name(F.col("name")).alias("c"))
    unknown = counts.join(known.select(F.col("c").alias("a")).distinct(), "a", "left_anti")
    near = _similar(unknown, known).join(_firsts(known, F.col("c"), "c"), "c")
    best = near.groupBy("a").agg(F.min(F.struct((-F.col("ratio")).alias("order"), "position", "name")).alias("best"))
    return unknown.join(best, "a", "left").select("asked", "requests", F.col("best.name").alias("suggestion"))
