"""Chunk rules by document type."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession, functions as F

SCHEMA = "doc_type string, strategy string, min_tokens int, max_tokens int, overlap int"
#: The rules of the data model: strategy, least and most tokens, overlap. Fixed values.
DEFAULT_RULES = {
    "eml": ("by_email_block", 20, 300, 5),
    "docx": ("by_paragraph", 50, 300, 20),
    "rtf": ("by_paragraph", 50, 300, 20),
    "pdf": ("by_paragraph", 50, 300, 20),
    "pptx": ("by_slide", 10, 80, 0),
    "txt": ("by_paragraph", 40, 300, 15),
    "test_txt_small": ("blank_line", 30, 100, 0),
    "csv": ("split_on_rows", 10, 30, 20),
    "html": ("split_on_headings", 150, 760, 20),
    "json": ("split_on_objects", 150, 460, 20),
    "log": ("split_on_timestamp", 180, 660, 20),
    "md": ("split_on_headings", 150, 660, 20),
    "py": ("split_on_functions", 150, 460, 20),
    "xlsx": ("split_on_sheets", 150, 800, 20),
    "xml": ("split_on_elements", 150, 760, 20),
    "default": ("by_paragraph", 50, 250, 20),
}
_KEYS = ("strategy", "min_tokens", "max_tokens", "overlap")


def validated(rules: Mapping[str, Mapping]) -> dict[str, tuple[str, int, int, int]]:
    """Rules by document type as tuples; raises ValueError for a missing key, a number that is none, or min >= max."""
    out = {}
    for doc_type, rule in rules.items():
        missing = [k for k in _KEYS if k not in rule]
        if missing:
            raise ValueError(f"rule {doc_type!r} lacks {', '.join(missing)}")
        low, high, overlap = (int(rule[k]) for k in _KEYS[1:])
        if low >= high:
            raise ValueError(f"rule {doc_type!r}: min_tokens {low} is not below max_tokens {high}")
        out[doc_type] = (str(rule["strategy"]), low, high, overlap)
    if "default" not in out:
        raise ValueError("there is no rule 'default'")
    return out


def rules_frame(spark: SparkSession, rules: Mapping[str, tuple] | None = None) -> DataFrame:
    """Rules (default: those of the data model) as a table."""
    return spark.createDataFrame([(k, *v) for k, v in (rules or DEFAULT_RULES).items()], SCHEMA)


def doc_types(rules: DataFrame) -> DataFrame:
    """The document types that have a rule."""
    return rules.select("doc_type").distinct()


def with_rule(df: DataFrame, rules: DataFrame, doc_type="doc_type") -> DataFrame:
    """df with a column rule: that of the row's document type, else 'default'.

    The rules are read once as a literal map, at most a few hundred entries, so the lookup costs
    neither a join nor a shuffle. More rules than that raise.
    """
    rows = rules.select("doc_type", "strategy", "min_tokens", "max_tokens", "overlap").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 rules")
    named = {r.doc_type: r for r in rows}
    if "default" not in named:
        raise ValueError("there is no rule 'default'")
    literal = lambda r: F.struct(F.lit(r.strategy).alias("strategy"), F.lit(r.min_tokens).alias("min_tokens"), F.lit(r.max_tokens).alias("max_tokens"), F.lit(r.overlap).alias("overlap"))
    table = F.create_map(*[x for k, r in named.items() for x in (F.lit(k), literal(r))])
    key = F.col(doc_type) if isinstance(doc_type, str) else doc_type
    return df.withColumn("rule", F.coalesce(table[key], literal(named["default"])))
