"""Prompt pieces as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .text import stripped

SEPARATOR = "\n\n---\n\n"
#: What stands for the context where there is none. Fixed value.
NO_CONTEXT = "No context provided."


def source_name(source_filepath: Column, doc_id: Column) -> Column:
    """File or document id, line feeds as blanks, stripped."""
    return stripped(F.replace(F.coalesce(F.nullif(source_filepath, F.lit("")), doc_id, F.lit("")), F.lit("\n"), F.lit(" ")))


def context_item(source: Column, content: Column, page: Column) -> Column:
    """'Source ID: [...]', 'Content: ...' and, for a page other than null and 0, 'Page: n', a line each."""
    head = F.concat(F.lit("Source ID: ["), source, F.lit("]\nContent: "), F.coalesce(content, F.lit("")))
    return F.when(page.isNotNull() & (page != 0), F.concat(head, F.lit("\nPage: "), page.cast("string"))).otherwise(head)


def context(items: Column) -> Column:
    """Items joined in their order; the fixed sentence where there are none."""
    return F.when(F.coalesce(F.size(items), F.lit(0)) > 0, F.array_join(items, SEPARATOR)).otherwise(NO_CONTEXT)


def checked_template(template: str) -> str:
    """The template; raises ValueError where it lacks {context_str} or {query_str}."""
    for name in ("{context_str}", "{query_str}"):
        if name not in template:
            raise ValueError(f"the template lacks {name}")
    return template


def prompt(template: str, context_str: Column, query_str: Column) -> Column:
    """A checked template with context and query put in; other braces stay."""
    parts = checked_template(template)
    return F.replace(F.replace(F.lit(parts), F.lit("{context_str}"), context_str), F.lit("{query_str}"), query_str)
