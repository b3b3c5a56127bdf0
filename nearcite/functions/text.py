"""Scalar column functions: dates, ids, display text, scores."""

from __future__ import annotations

from string import Formatter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Score tiers as (lowest percent, tier, colour), best first.
SCORE_TIERS = (
    (95, 6, "#1a7431"),
    (90, 5, "#2E8540"),
    (85, 4, "#4A90D9"),
    (80, 3, "#F0C419"),
    (75, 2, "#FF9D1E"),
)
LOWEST_TIER = (1, "#DD361C")

# Classification sections and their labels.
CPC_LABELS = {
    "A": "Human Necessities",
    "B": "Operations / Transport",
    "C": "Chemistry / Metallurgy",
    "D": "Textiles / Paper",
    "E": "Fixed Constructions",
    "F": "Mechanical Engineering",
    "G": "Physics",
    "H": "Electricity",
    "Y": "Emerging Tech",
}

# Fixed value: the pattern of a formatted id.
FORMATTED_ID = r"^[A-Z]{2}-[0-9]+-[A-Z][0-9]$"


def format_date(day: Column) -> Column:
    """``YYYYMMDD`` integers as ``YYYY-MM-DD`` text, without calendar checks; nothing becomes N/A."""
    digits = day.cast("bigint").cast("string")
    return (
        F.when(day.isNull() | F.isnan(day) | (day == 0), F.lit("N/A"))
        .when(
            F.length(digits) == 8,
            F.concat_ws("-", F.substring(digits, 1, 4), F.substring(digits, 5, 2), F.substring(digits, 7, 2)),
        )
        .otherwise(digits)
    )


def extract_text(df: DataFrame, name: str) -> Column:
    """The text of a ``{value}`` struct column, or of a plain column; null becomes empty."""
    column = F.col(name)
    if isinstance(df.schema[name].dataType, T.StructType):
        column = column["value"]
    return F.coalesce(column.cast("string"), F.lit(""))


def or_na(column: Column) -> Column:
    return F.coalesce(F.nullif(column, F.lit("")), F.lit("N/A"))


def first_name(names: Column) -> Column:
    """Name of element 0, null when there is none."""
    return F.get(names, 0)["name"]


def clean_id(raw: Column) -> Column:
    """Trim, drop commas and spaces, upper-case."""
    return F.upper(F.translate(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), ", ", ""))


def is_formatted_id(cleaned: Column) -> Column:
    return cleaned.rlike(FORMATTED_ID)


def id_number(cleaned: Column) -> Column:
    """The bare number behind an optional US, null for anything else."""
    number = F.regexp_replace(cleaned, "^US", "")
    return F.when(~is_formatted_id(cleaned) & number.rlike("^[0-9]+$"), number)


def percent(score: Column) -> Column:
    """100 * score, clipped to 0..100; null stays null."""
    return F.when(score.isNotNull(), F.least(F.greatest(score * 100, F.lit(0.0)), F.lit(100.0)))


def unit_score(score: Column) -> Column:
    """Score clamped to 0..1; missing counts as 0."""
    known = F.when(F.isnan(score), None).otherwise(score)
    return F.least(F.greatest(F.coalesce(known, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))


def whole_percent(score: Column) -> Column:
    """Percent truncated to an integer."""
    return (score * 100).cast("int")


def score_tier(score: Column) -> Column:
    tier = F.lit(LOWEST_TIER[0])
    for lowest, number, _ in reversed(SCORE_TIERS):
        tier = F.when(score * 100 >= lowest, number).otherwise(tier)
    return tier


def score_color(score: Column) -> Column:
    color = F.lit(LOWEST_TIER[1])
    for lowest, _, name in reversed(SCORE_TIERS):
        color = F.when(score * 100 >= lowest, name).otherwise(color)
    return color


def score_tier_legacy(score: Column) -> Column:
    """Older legend with four steps: below 0.6, to 0.8, to 0.9, above."""
    return F.when(score > 0.9, 4).when(score > 0.8, 3).when(score >= 0.6, 2).otherwise(1)


def node_size(score: Column) -> Column:
    return F.lit(14) + (score * 52).cast("int")


def similar_width(score: Column) -> Column:
    return F.lit(1.0) + score * 2


def cpc_section(code: Column) -> Column:
    """Upper-cased first letter of a classification code, null unless it is a letter."""
    return F.when(code.rlike(r"^\p{L}"), F.upper(F.substring(code, 1, 1)))


def cpc_label(section: Column) -> Column:
    pairs = [F.lit(part) for item in CPC_LABELS.items() for part in item]
    name = F.coalesce(F.element_at(F.create_map(*pairs), section), section)
    return F.concat(section, F.lit(" - "), name)


def percent_text(score: Column) -> Column:
    """``12.34%``. The shift keeps exact halves from falling either way."""
    return F.format_string("%.2f%%", score * 100 + 1e-10)


def fixed4_text(value: Column) -> Column:
    return F.format_string("%.4f", value + 1e-12)


def content_key(text: Column) -> Column:
    """First 12 hex digits of SHA-1: a stable cache key."""
    return F.substring(F.sha1(text.cast("binary")), 1, 12)


def fill_template(template: str, slots: dict[str, Column]) -> Column:
    """Fill ``{slot}`` places of a literal template; slot values are never read as templates."""
    parts: list[Column] = []
    for text, slot, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if slot:
            parts.append(F.coalesce(slots[slot], F.lit("")))
    return F.concat(*parts)
