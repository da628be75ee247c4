"""What a Markdown text says: front matter, headings, links."""

from __future__ import annotations

import re

import pandas as pd
from hybridkb.functions.html import _text
from hybridkb.functions.udf import arrow_function

_INLINE = re.compile(r"\]\(|<(?=http)")


def front_matter(text: str) -> tuple[str | None, str]:
    """(block, rest): the block between '---' and '---' or '...', None where it is absent or open."""
    bare = text.lstrip("﻿")
    if not re.match(r"---\r?\n", bare):
        return None, text
    start = bare.index("\n") + 1
    end = re.compile(r"^(?:---|\.\.\.)\r*(?:\n|\Z)", re.M).search(bare, start)
    return (bare[start : end.start()], bare[end.end() :]) if end else (None, text)


def front_value(block: str | None, key: str) -> str | None:
    for line in (block or "").split("\n"):
        line = line.strip()
        if line.startswith(f"{key}:") and (value := line[len(key) + 1 :].strip().strip("\"'").strip()):
            return value
    return None


def headings(body: str, limit: int = 8) -> list[tuple[int, str]]:
    """(level, text) of lines that begin with one to three '#', blank ones left out."""
    out = []
    for line in body.split("\n"):
        m = re.match(r"\s*(#+)(.*)", line, re.S)
        if m and len(m[1]) <= 3 and (t := m[2].strip()):
            out.append((len(m[1]), t))
            if len(out) == limit:
                break
    return out


def first_heading(body: str) -> str | None:
    """The first heading of any level."""
    for line in body.split("\n"):
        s = line.lstrip()
        if s.startswith("#") and (t := s.lstrip("#").strip()):
            return t
    return None


def markdown_links(body: str) -> list[str]:
    """Inline targets (images and '#…' left out) and autolinks in order, then reference definitions."""
    out, i = [], 0
    while m := _INLINE.search(body, i):
        at, i = m.start(), m.end()
        if m[0] == "](":
            opening = body.rfind("[", 0, at)
            end = body.find(")", i)
            if end >= 0 and not (opening > 0 and body[opening - 1] == "!"):
                word = body[i:end].split(None, 1)
                if word and not word[0].startswith("#"):
                    out.append(word[0])
        else:
            end = body.find(">", at + 1)
            if end >= 0:
                target = body[at + 1 : end]
                if not re.search(r"\s", target):
                    out.append(target)
                i = end + 1
    for line in body.split("\n"):
        s = line.lstrip()
        if s.startswith("[") and (close := s.find("]:")) > 0:
            word = s[close + 2 :].split(None, 1)
            if word and not word[0].startswith("#"):
                out.append(word[0])
    return out


def markdown_facts(text: str) -> dict:
    block, body = front_matter(text)
    heads = headings(body)
    return {
        "title": front_value(block, "title") or first_heading(body),
        "lang": front_value(block, "lang"),
        "headings": [t for _, t in heads],
        "levels": [level for level, _ in heads],
        "body": body,
        "links": markdown_links(body),
    }


@arrow_function("struct<title:string,lang:string,headings:array<string>,levels:array<int>,body:string,links:array<string>>")
def markdown_facts_udf(text: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([markdown_facts(_text(t)) for t in text], columns=["title", "lang", "headings", "levels", "body", "links"])


@arrow_function("struct<title:string,lang:string,headings:array<string>,levels:array<int>>")
def markdown_head_udf(text: pd.Series) -> pd.DataFrame:
    """The facts without body and links: no text comes back."""

    def one(t: str) -> tuple:
        block, body = front_matter(t)
        heads = headings(body)
        return front_value(block, "title") or first_heading(body), front_value(block, "lang"), [h for _, h in heads], [level for level, _ in heads]

    return pd.DataFrame([one(_text(t)) for t in text], columns=["title", "lang", "headings", "levels"])
