"""Answers of a language model to rows.

JSON is read by Python's parser, which refuses what follows a value; Spark's own reader
would accept it.  One Arrow-batched function does all strategies.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loamtext.functions import sentence_number

#: Keys that may wrap the list, by kind of request.
WRAPPERS = {"items": ("items",), "sections": ("items", "sections", "agenda_items"), "subjects": ("subjects",)}
ITEM = "struct<item_title:string,theme:string,topics:array<string>,topics_is_list:boolean,start_id:string,end_id:string>"
FENCE, LANGUAGE = "```", "json"


def fenced(text: str) -> str | None:
    """The inside of the first fenced block whose marks stand on lines of their own."""
    at = text.find(FENCE)
    while at >= 0:
        rest = text[at + len(FENCE) :].removeprefix(LANGUAGE)
        body = rest.lstrip()
        breaks = rest[: len(rest) - len(body)].count("\n")
        if breaks > 1 and body.startswith(FENCE):
            return ""
        stop = body.find(FENCE) if breaks else -1
        while stop >= 0:
            inside = body[:stop].rstrip()
            if "\n" in body[len(inside) : stop]:
                return inside
            stop = body.find(FENCE, stop + 1)
        at = text.find(FENCE, at + 1)
    return None


def without_fences(text: str) -> str:
    first, *rest = text.split(FENCE)
    return (first + "".join(x.removeprefix(LANGUAGE).lstrip() for x in rest)).strip()


def list_under(text: str, key: str) -> str | None:
    """From the bracket behind the first ``"key":`` that has one to the last bracket of the text."""
    named, end = f'"{key}"', text.rfind("]")
    at = text.find(named)
    while 0 <= at < end:
        value = text[at + len(named) : end + 1].lstrip()
        if value[:1] == ":" and (value := value[1:].lstrip())[:1] == "[":
            return value
        at = text.find(named, at + 1)
    return None


def _loads(text: str):
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _span(text: str, left: str, right: str) -> str | None:
    a, b = text.find(left), text.rfind(right)
    return text[a : b + 1] if 0 <= a < b else None


def unwrap(text: str, kind: str) -> list | None:
    """The list under a wrapper key, or None to leave the text to :func:`extract`."""
    keys = WRAPPERS[kind]
    whole = _loads(text)
    for found in [whole, *([_loads(_span(text, "{", "}") or "")] if kind == "items" and whole is None else [])]:
        if isinstance(found, dict):
            for key in keys:
                if key in found:
                    return found[key] if isinstance(found[key], list) else None
    if kind == "subjects" or isinstance(whole, list):
        return None
    for key in keys:
        found = _loads(list_under(text, key) or "")
        if isinstance(found, list):
            return found
    return None


def extract(text: str) -> list | None:
    """The first list that one of these gives: the whole text, the first fenced block, the
    outermost brackets, one object per line, the text without fences."""
    tries = [text]
    if (block := fenced(text)) is not None:
        tries.append(block)
    if (inner := _span(text, "[", "]")) is not None:
        tries.append(inner)
    for t in tries:
        found = _loads(t)
        if isinstance(found, list):
            return found
    lines = [x.strip() for x in text.split("\n")]
    objects = [o for x in lines if x[:1] == "{" and x[-1:] == "}" and (o := _loads(x)) is not None]
    if objects:
        return objects
    if FENCE in text:
        found = _loads(without_fences(text))
        if isinstance(found, list):
            return found
    return None


def _row(item: dict) -> dict:
    text = lambda k: None if item.get(k) is None else str(item[k])
    topics = item.get("topics")
    title = item["item_title"] if "item_title" in item else item.get("section_title")
    return {
        "item_title": None if title is None else str(title),
        "theme": text("theme"),
        "topics": [str(t) for t in topics] if isinstance(topics, list) else None,
        "topics_is_list": isinstance(topics, list) if "topics" in item else None,
        "start_id": text("start_id"),
        "end_id": text("end_id"),
    }


def parse(text: str | None, kind: str = "items") -> list[dict] | None:
    if text is None:
        return None
    found = unwrap(text, kind)
    if found is None:
        found = extract(text)
    return None if found is None else [_row(x) for x in found if isinstance(x, dict)]


def parse_responses(responses: DataFrame, kind: str = "items") -> DataFrame:
    """Adds ``items`` (array of structs, null where nothing could be read) to ``response`` rows."""

    @F.pandas_udf(f"array<{ITEM}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            yield pd.Series([parse(t, kind) for t in texts], dtype=object)

    return responses.withColumn("items", read("response"))


def parsed_items(parsed: DataFrame, *keys: str) -> DataFrame:
    """One row per item: keys, ``idx, title, theme, topics, start_num, end_num`` and the raw ids."""
    rows = parsed.where("items is not null").select(*keys, F.posexplode("items").alias("idx", "i"))
    return rows.select(
        *keys,
        "idx",
        F.col("i.item_title").alias("title"),
        "i.theme",
        "i.topics",
        "i.topics_is_list",
        "i.start_id",
        "i.end_id",
        sentence_number(F.col("i.start_id")).alias("start_num"),
        sentence_number(F.col("i.end_id")).alias("end_num"),
    )


def structural_errors(parsed: DataFrame, *keys: str, required: tuple[str, ...] = ("title", "start_id", "end_id")) -> DataFrame:
    """``error`` rows for items without the required keys or with ids not of the form ``S1``."""
    rows = parsed_items(parsed, *keys)
    checks = [F.when(F.col(c).isNull(), F.lit(f"missing {c}")) for c in required]
    checks += [F.when(F.col(f"{e}_id").isNotNull() & F.col(f"{e}_num").isNull(), F.lit(f"bad {e}_id")) for e in ("start", "end")]
    return rows.select(*keys, "idx", F.explode(F.array_compact(F.array(*checks))).alias("error"))


def correction_requests(parsed: DataFrame, chars: int = 500) -> DataFrame:
    """Requests that ask again for what could not be read (``request_id, prompt``)."""
    head = F.substring("response", 1, chars)
    ask = F.concat(F.lit("This answer is not a JSON array. Give the same content as one JSON array and nothing else.\n\n"), head)
    return parsed.where("items is null and response is not null").select("request_id", ask.alias("prompt"))
