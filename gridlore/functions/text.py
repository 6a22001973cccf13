"""Column functions that read questions: tokens, keywords, mentions, filters, intents, search terms."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---- fixed values: word lists and patterns that decide the result --------------------------------
# A word is a run of letters, digits and underscores of any script. WORD and the word ends START, BEFORE
# and AFTER replace \w and \b, whose meaning for letters outside ASCII depends on the regex engine.
WORD = r"[\p{L}\p{N}_]+"
START = r"(?<![\p{L}\p{N}_])"
NAME = f"{START}({WORD}+)"  # possessive: what follows a name is never part of a word, so there is nothing to give back
BEFORE = r"(?:^|[^\p{L}\p{N}_])"
AFTER = r"(?:$|[^\p{L}\p{N}_])"

STOP_WORDS = [
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "having",
    "do", "does", "did", "doing", "done", "will", "would", "shall", "should", "may", "might", "must",
    "can", "could", "and", "or", "but", "if", "then", "else", "when", "where", "why", "how",
]

AGGREGATION_WORDS = {
    "average": ["average", "avg", "mean"],
    "sum": ["sum", "total"],
    "count": ["count", "number of", "how many"],
    "max": ["max", "highest", "top", "most"],
    "min": ["min", "lowest", "bottom", "least"],
}

QUESTION_TYPES = {
    "count": ["count", "number", "how many"],
    "sum": ["sum", "total"],
    "average": ["avg", "average", "mean"],
    "top": ["top", "highest", "max"],
    "filter": ["where", "with", "having"],
}

# Each pattern stands with the parts one of which a matching text must contain.
MENTION_PATTERNS = [
    (rf"{NAME}\s*[=<>!]", ["=", "<", ">", "!"]),
    (rf"(?i){NAME}\s+(?:is|are|was|were)\s+", ["is", "are", "was", "were"]),
    (rf"(?i){NAME}\s+(?:has|have)\s+", ["has", "have"]),
    (
        rf"(?i){NAME}\s+(?:greater|less|more|above|below)",
        ["greater", "less", "more", "above", "below"],
    ),
    (rf"(?i)count\s+of\s+({WORD})", ["count"]),
    (rf"(?i)sum\s+of\s+({WORD})", ["sum"]),
    (rf"(?i)avg\s+of\s+({WORD})", ["avg"]),
    (rf"(?i)top\s+\p{{Nd}}+\s+({WORD})", ["top"]),
    (rf"(?i)by\s+({WORD})", ["by"]),
]

QUOTED = "[\"']([^\"']+)[\"']"
FILTER_PATTERNS = [
    (rf"{NAME}\s*=\s*{QUOTED}", "=", ["="]),
    (rf"{NAME}\s*=\s*({WORD})", "=", ["="]),
    (rf"{NAME}\s*=\s*(\p{{Nd}}+)", "=", ["="]),
    (rf"{NAME}\s*>\s*(\p{{Nd}}+)", ">", [">"]),
    (rf"{NAME}\s*<\s*(\p{{Nd}}+)", "<", ["<"]),
    (rf"(?i){NAME}\s+is\s+{QUOTED}", "=", ["is"]),
    (rf"(?i){NAME}\s+is\s+({WORD})", "=", ["is"]),
]

SEARCH_SKIP_WORDS = ["give", "the", "and", "for", "with", "have", "from"]
PAIR_PARTS = ["=", ":"]
PAIR_PATTERNS = [
    rf"{NAME}\s*[=:]\s*['\"]?({WORD})['\"]?",
    rf"{START}({WORD}+\s++{WORD}+)\s*[=:]\s*['\"]?({WORD})['\"]?",
]

LIMIT_PATTERN = rf"{BEFORE}(?:top|first|limit to|show only)\s+\p{{Nd}}+{AFTER}"
GROUPING_PARTS = ["by", "per", "each"]
SAME_PARTS = ["date", "time", "day", "value", "record"]
FIND_PARTS = ["duplicate", "match", "similar", "pair"]
JOIN_PARTS = [
    "join", "together", "both", "and their", "with their", "combine", "including", "along with", "with",
]
# ---- end of fixed values -------------------------------------------------------------------------


def contains_any(text: Column, parts: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(p) for p in parts])


def extract_all(
    text: Column, pattern: str, group: int = 0, parts: list[str] | None = None
) -> Column:
    """All matches; texts that contain none of the given lower-case parts are not searched."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    if not parts:
        return found
    return F.when(contains_any(F.lower(text), parts), found).otherwise(
        F.array().cast("array<string>")
    )


def extract_pairs(
    text: Column, pattern: str, parts: list[str], pair: Callable[[Column, Column], Column]
) -> Column:
    """Combine groups 1 and 2 of every match; the text is searched once, each short match again."""
    return F.transform(
        extract_all(text, pattern, 0, parts),
        lambda m: pair(F.regexp_extract(m, pattern, 1), F.regexp_extract(m, pattern, 2)),
    )


def tokens(text: Column) -> Column:
    """All words of a lower-cased text, in order."""
    return extract_all(F.lower(text), WORD)


def token_set(text: Column) -> Column:
    return F.array_distinct(tokens(text))


def has_word(text: Column, *words: str) -> Column:
    """One of the words or phrases stands in the text between word ends, in any case."""
    between_ends = text.rlike(f"(?i){BEFORE}(?:{'|'.join(words)}){AFTER}")
    return contains_any(F.lower(text), list(words)) & between_ends


def keywords(text: Column) -> Column:
    """Plain lower-case words of two letters or more that are no stop words; order and repeats stay."""
    stop = F.array(*[F.lit(w) for w in STOP_WORDS])
    return F.filter(
        tokens(text), lambda t: t.rlike("^[a-z]{2,}$") & ~F.array_contains(stop, t)
    )


def column_mentions(text: Column) -> Column:
    """Words in places where a question names a column, sorted."""
    found = [extract_all(text, p, 1, parts) for p, parts in MENTION_PATTERNS]
    return F.array_sort(F.array_distinct(F.flatten(F.array(*found))))


def aggregation_intent(text: Column) -> Column:
    """The first kind of aggregate whose words occur, or 'none'."""
    case = None
    for kind, words in AGGREGATION_WORDS.items():
        hit = has_word(text, *words)
        case = F.when(hit, kind) if case is None else case.when(hit, kind)
    return case.otherwise("none")


def question_filters(text: Column) -> Column:
    """Conditions in a question as (column, operator, value), by pattern and then by place."""

    def conditions(pattern: str, op: str, parts: list[str]) -> Column:
        return extract_pairs(
            text,
            pattern,
            parts,
            lambda c, v: F.struct(
                F.upper(c).alias("column"), F.lit(op).alias("operator"), v.alias("value")
            ),
        )

    return F.flatten(F.array(*[conditions(*f) for f in FILTER_PATTERNS]))


def question_type(text: Column) -> Column:
    case = None
    for kind, words in QUESTION_TYPES.items():
        hit = has_word(text, *words)
        case = F.when(hit, kind) if case is None else case.when(hit, kind)
    plain = case.otherwise("general")
    counted = (aggregation_intent(text) == "count") & (F.size(question_filters(text)) > 0)
    return F.when(counted, "filtered_count").otherwise(plain)


def one_line(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def search_terms(text: Column) -> Column:
    """The question, its words each with their upper case, then names and values of 'X = Y' pairs."""
    skip = F.array(*[F.lit(w) for w in SEARCH_SKIP_WORDS])

    def terms(question: Column) -> Column:
        words = F.filter(
            extract_all(question, WORD),
            lambda w: (F.length(w) >= 3) & ~F.array_contains(skip, F.lower(w)),
        )
        both_cases = F.flatten(F.transform(words, lambda w: F.array(w, F.upper(w))))
        pairs = [
            F.flatten(
                extract_pairs(
                    question,
                    p,
                    PAIR_PARTS,
                    lambda left, right: F.array(
                        F.upper(F.regexp_replace(F.trim(left), r"\s+", "_")), F.upper(right)
                    ),
                )
            )
            for p in PAIR_PATTERNS
        ]
        return F.filter(F.array_distinct(F.flatten(F.array(F.array(question), both_cases, *pairs))), lambda t: t != "")

    # a list of one is transformed, so that the question is put on one line once
    return F.get(F.transform(F.array(one_line(text)), terms), F.lit(0))


def analysis_terms(text: Column, mentions_used: int | None = None) -> Column:
    """Search terms from the analysis of a question: its keywords, mentions (all, or so many), conditions
    and kind of aggregate, after the question itself."""
    mentions = column_mentions(text)
    if mentions_used is not None:
        mentions = F.slice(mentions, 1, mentions_used)
    filters = F.flatten(
        F.transform(
            question_filters(text),
            lambda f: F.array(F.concat_ws(" ", f["column"], f["value"]), f["value"]),
        )
    )
    kind = F.filter(F.array(aggregation_intent(text)), lambda k: k != "none")
    head = F.array(text, F.array_join(keywords(text), " "))
    return F.array_distinct(F.flatten(F.array(head, mentions, filters, kind)))


def numbers(text: Column) -> Column:
    """Whole numbers that stand alone, in order."""
    return F.filter(extract_all(text, WORD), lambda t: t.rlike(r"^\p{Nd}+$"))


def prompt_hints(text: Column) -> dict[str, Column]:
    """What a question asks the answering query to do."""
    low = F.lower(text)
    limit = low.rlike(LIMIT_PATTERN)
    order = has_word(low, "highest", "lowest", "max", "min")
    group = contains_any(low, GROUPING_PARTS)
    same = low.contains("same") & contains_any(low, SAME_PARTS)
    find = low.contains("find") & contains_any(low, FIND_PARTS)
    return {
        "numbers": numbers(text),
        "advice": F.when(limit, "limit").when(order, "order by").when(group, "group by").otherwise("none"),
        "grouping": group,
        "same_value": same,
        "duplicates": find,
        "needs_join": contains_any(low, JOIN_PARTS),
    }


def numbers_lost(question: Column, sql: Column) -> Column:
    """Numbers of the question that occur nowhere in the SQL text."""
    return F.filter(numbers(question), lambda n: ~F.contains(sql, n))


def numbers_added(question: Column, sql: Column) -> Column:
    """Numbers of the SQL text that the question does not have, in order."""
    asked = numbers(question)
    return F.filter(numbers(sql), lambda n: ~F.array_contains(asked, n))
