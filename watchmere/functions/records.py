"""Reading keys of JSON records where a missing key and a present null mean different things.

A record is parsed once into MAP<STRING, STRING>: text values unquoted, numbers and nested values as
their JSON text. A key with a null value is in the map, a missing key is not.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text that could be the JSON of something other than text; a quoted "5" looks like that too.
_JSON_LITERAL = r"^(-?[0-9]+(\.[0-9]+)?([eE][-+]?[0-9]+)?|true|false|[{\[].*)$"


# A key whose value does not start like text or null. Text may look like that inside, too.
_OTHER_THAN_TEXT = r'"\s*:\s*[-0-9tf{\[]'


def may_hold_other_than_text(text: Column) -> Column:
    """Whether a record may have a value that is neither text nor null, from one look at its text."""
    return F.coalesce(text.rlike(_OTHER_THAN_TEXT), F.lit(False))


def parse_record(text: Column) -> Column:
    return F.from_json(text, "MAP<STRING, STRING>")


class Record:
    """Column expressions over the keys of one record: the parsed map and the text it came from."""

    def __init__(self, parsed: str, text: str):
        self.parsed = F.col(parsed)
        self.source = text

    def has(self, key: str) -> Column:
        """The key is present, be it with null."""
        return F.map_contains_key(self.parsed, key)

    def text(self, key: str, inner: str | None = None) -> Column:
        """The value as text, or that of a key inside it; null when it is missing or null."""
        value = self.parsed[key]
        return F.get_json_object(value, f"$.{inner}") if inner else value

    def first(self, *keys: str, default: str | None = None) -> Column:
        """The value of the first key that is present, or the default when none is."""
        chain = F
        for key in keys:
            chain = chain.when(self.has(key), self.text(key))
        return chain.otherwise(F.lit(default).cast("string"))

    def not_text(self, *keys: str) -> Column:
        """One of the keys holds a value that is neither text nor null.

        Only a value that looks like a JSON literal is parsed again to see whether it was quoted.
        """
        out = F.lit(False)
        for key in dict.fromkeys(keys):
            kind = F.expr(f"schema_of_variant(variant_get(try_parse_json({self.source}), '$.{key}', 'variant'))")
            looks_odd = F.coalesce(self.text(key).rlike(_JSON_LITERAL), F.lit(False))
            out = out | F.when(looks_odd, F.coalesce(kind != "STRING", F.lit(False))).otherwise(False)
        return out
