"""Prompt text for a table of questions, to be answered elsewhere."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridlore.functions.text import prompt_hints

SYSTEM_TEXT = "Write one SQL query for the table described below. Keep names and numbers exactly as given."
ADVICE = {
    "limit": "The question asks for a number of rows: use LIMIT.",
    "order by": "The question asks for an extreme: use ORDER BY.",
    "group by": "The question asks for groups: use GROUP BY without ORDER BY or LIMIT.",
}
NUMBERS_TEXT = "Numbers to keep as they are: "
MATCHING_TEXT = "Records with equal values: use GROUP BY with HAVING COUNT(*) > 1, or a self-join."


def render_prompt(question: Column, context: Column, system_text: str = SYSTEM_TEXT) -> Column:
    """System text, context, question and hints, one section below the other."""
    hints = prompt_hints(question)
    advice = F.create_map(*[F.lit(x) for pair in ADVICE.items() for x in pair])
    numbers = F.when(
        F.size(hints["numbers"]) > 0,
        F.concat(F.lit(NUMBERS_TEXT), F.array_join(hints["numbers"], ", ")),
    )
    return F.concat_ws(
        "\n",
        F.lit(system_text),
        F.lit("Table:"),
        context,
        F.lit("Question:"),
        question,
        F.try_element_at(advice, hints["advice"]),
        numbers,
        F.when(hints["same_value"] | hints["duplicates"], F.lit(MATCHING_TEXT)),
        F.lit("SQL:"),
    )
