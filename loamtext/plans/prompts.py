"""Prompts and output schemas of the two stages, as columns."""

from __future__ import annotations

import json

from pyspark.sql import Column
from pyspark.sql import functions as F

ITEM_SCHEMA = json.dumps(
    {
        "type": "array",
        "items": {
            "type": "object",
            "properties": {k: {"type": "string"} for k in ("item_title", "start_id", "end_id")},
            "required": ["item_title", "start_id", "end_id"],
        },
    }
)
_ANSWER = "Answer with one JSON array and nothing else."
_EXAMPLE_ITEMS = 'Example answer: [{"item_title": "Opening", "start_id": "S1", "end_id": "S4"}, {"item_title": "Budget", "start_id": "S5", "end_id": "S9"}]\n\n'


def subject_schema(theme: bool = False, topics: bool = False) -> str:
    """The schema of stage 2: ids always, theme and topics by flag."""
    fields: dict = {}
    if theme:
        fields["theme"] = {"type": "string"}
    if topics:
        fields["topics"] = {"type": "array", "items": {"type": "string"}}
    fields |= {"start_id": {"type": "string"}, "end_id": {"type": "string"}}
    return json.dumps({"type": "array", "items": {"type": "object", "properties": fields, "required": list(fields)}})


def items_prompt(lines: Column, n: Column, few_shot: bool = True) -> Column:
    """Stage 1 for minutes."""
    head = (_EXAMPLE_ITEMS if few_shot else "") + "The numbered sentences below are the minutes of a meeting. List its agenda items in order, each with its title and the ids of its first and last sentence. Ids run from S1 to S"
    return F.concat(F.lit(head), n.cast("string"), F.lit(f". {_ANSWER}\n\n"), lines)


def sections_prompt(lines: Column, n: Column, parent: Column, few_shot: bool = True) -> Column:
    """Stage 1 for articles: the whole text, or the part under a parent's title."""
    root = F.lit("The numbered sentences below are an article. Divide it into its main sections")
    below = F.concat(F.lit("The numbered sentences below are the section '"), parent, F.lit("' of an article. Divide it into its subsections; give an empty array if it has none"))
    example = F.lit(_EXAMPLE_ITEMS if few_shot else "")
    tail = F.concat(F.lit(", each with its title and the ids of its first and last sentence. Ids run from S1 to S"), n.cast("string"), F.lit(f". {_ANSWER}\n\n"), lines)
    return F.concat(example, F.when(F.coalesce(parent, F.lit("")) != "", below).otherwise(root), tail)


def subjects_prompt(lines: Column, title: Column, municipality: Column, theme: bool = False, topics: tuple[str, ...] = (), title_first: tuple[str, ...] = ("porto",), few_shot: bool = True) -> Column:
    """Stage 2: the subjects of one agenda item.

    ``topics`` is the user's list of categories (empty: not asked for); ``title_first``
    names the municipalities whose minutes open an item with its title.
    """
    fields = [*(["theme: a short noun phrase for the matter"] if theme else []), *(["topics: one or two of the categories below"] if topics else []), "start_id: the id of its first sentence", "end_id: the id of its last sentence"]
    asked = "\n".join(f"{k}. {f}" for k, f in enumerate(fields, 1))
    listed = "\nCategories:\n" + "\n".join(f"- {t}" for t in topics) + "\n" if topics else ""
    example = {**({"theme": "Road works"} if theme else {}), **({"topics": list(topics[:1])} if topics else {}), "start_id": "S1", "end_id": "S3"}
    shown = f"Example answer: [{json.dumps(example, ensure_ascii=False)}]\n\n" if few_shot else ""
    named = F.lit(False)
    for m in title_first:
        named = named | F.coalesce(F.lower(municipality).contains(m), F.lit(False))
    hint = F.when(named, "The item's title, if it opens the text, belongs to the first subject.").otherwise("The item's title, if it opens the text, belongs to no subject.")
    return F.concat(F.lit(shown + "The numbered sentences below belong to the agenda item '"), title, F.lit(f"'. List its subjects in order, each with\n{asked}\n{listed}"), hint, F.lit(f" {_ANSWER}\n\n"), lines)
