"""Tag text to map, and the environment and team read from it."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from costlens import constants as C
from costlens.functions.mapping import literal_map


def parse_tags(text: Column) -> Column:
    """Malformed or non-object text becomes an empty map."""
    empty = F.from_json(F.lit("{}"), "map<string,string>")
    return F.coalesce(F.from_json(text, "map<string,string>"), empty)


def environment(tags: Column) -> Column:
    """Value of the first key present, lower-cased and passed through the aliases."""
    value = None
    for k in C.ENVIRONMENT_KEYS:
        here, found = F.map_contains_key(tags, k), F.try_element_at(tags, F.lit(k))
        value = F.when(here, found) if value is None else value.when(here, found)
    lowered = F.lower(value)
    return F.coalesce(F.try_element_at(literal_map(C.ENVIRONMENT_ALIASES), lowered), lowered)


def team(tags: Column) -> Column:
    """First non-empty value over the team keys."""
    return F.coalesce(*[F.nullif(F.try_element_at(tags, F.lit(k)), F.lit(""))
                        for k in C.TEAM_KEYS])
