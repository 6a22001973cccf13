"""Column functions over answer text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are taken out of answers, and words that mark them.
SQL_WORDS = ["SELECT", "FROM", "WHERE", "GROUP BY", "ORDER BY", "LIMIT"]
INSIGHT_WORDS = ["approximately", "about", "roughly", "shows", "indicates", "suggests"]
HARMFUL_WORDS = ["confidential", "password", "secret", "delete all", "corrupt"]
LETTER = r"[\p{L}\p{N}_]"
NUMBER = r"[0-9]+[,.]?[0-9]*"


def clean_answer(text: Column) -> Column:
    """Answer text without SQL words, chat tags and brackets, as a sentence."""
    out = text
    for word in SQL_WORDS:
        out = F.regexp_replace(out, rf"(?i)(?<!{LETTER}){word}(?!{LETTER})", "")
    out = F.regexp_replace(out, r"<\|.*?\|>", "")
    out = F.regexp_replace(out, r"[\{\}\[\]]", "")
    out = F.trim(F.regexp_replace(out, r"\s+", " "))
    first = F.substring(out, 1, 1)
    lifted = F.concat(F.upper(first), F.substring(out, F.lit(2), F.length(out)))
    out = F.when(first.rlike(r"^\p{Ll}"), lifted).otherwise(out)
    return F.when((out != "") & ~out.rlike(r"[.!?]$"), F.concat(out, F.lit("."))).otherwise(out)


def first_number(text: Column) -> Column:
    """The first number of a text, read without thousands separators."""
    found = F.regexp_extract(text, NUMBER, 0)
    return F.nullif(F.replace(found, F.lit(","), F.lit("")), F.lit("")).try_cast("double")


def has_insight(text: Column) -> Column:
    return F.lower(text).rlike("|".join(INSIGHT_WORDS))


def is_harmful(text: Column) -> Column:
    return F.lower(text).rlike("|".join(HARMFUL_WORDS))


# Texts for results of one cell.
ONE_CELL_TEXTS = {"SUM": "Total", "AVG": "Average", "MAX": "Maximum", "MIN": "Minimum"}
COUNT_TEXT = ("Found **", "** matching records.")


def one_cell_text(sql: Column, name: Column, value: Column) -> Column:
    """A sentence about the single number a query returned: counts first, then the kind of aggregate."""
    upper = F.upper(sql)
    count = F.concat(F.lit(COUNT_TEXT[0]), value.cast("bigint").cast("string"), F.lit(COUNT_TEXT[1]))
    number = F.call_function("format_number", value.cast("double"), F.lit("#,##0.00"))
    case = F.when(upper.contains("COUNT"), count)
    any_call = upper.rlike("|".join(f"{k}\\(" for k in ONE_CELL_TEXTS))
    for kind, text in ONE_CELL_TEXTS.items():
        sentence = F.concat(F.lit(f"{text} **"), name, F.lit("**: **"), number, F.lit("**"))
        case = case.when(any_call & upper.contains(kind), sentence)
    return case
