"""PAR-2 and UDF-1: from log HTML to plain text."""

from __future__ import annotations

import html
import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

TAG = r"<[^>]++>"

# Entities log formatters write all the time. They are replaced natively; "&amp;" comes last,
# so text it uncovers is not decoded twice.
COMMON_ENTITIES = {
    "&lt;": "<",
    "&gt;": ">",
    "&quot;": '"',
    "&#39;": "'",
    "&nbsp;": "\xa0",
    "&middot;": "·",
    "&larr;": "←",
    "&rarr;": "→",
    "&bull;": "•",
    "&copy;": "©",
    "&hellip;": "…",
    "&ndash;": "–",
    "&mdash;": "—",
    "&amp;": "&",
}
# Any reference that is not one of the above, closed by its semicolon. It may match more than
# real references; such rows only take the slower way.
_OTHER_ENTITY = (
    "&(?!(?:" + "|".join(re.escape(e[1:-1]) for e in COMMON_ENTITIES) + r");)[^\t\n\f <&;]"
)


def _entity_decoder():
    # local, so that it ships by value and workers need not have this package installed
    def decode(text: pd.Series) -> pd.Series:
        return text.map(html.unescape, na_action="ignore")

    return F.pandas_udf(decode, StringType())


def strip_tags(raw: Column) -> Column:
    """Drop tags; a tag may span lines."""
    return F.regexp_replace(raw, TAG, "")


def decode_entities(text: Column) -> Column:
    """Decode character references once, over the full HTML5 table.

    The Python worker sees only rows holding a reference outside ``COMMON_ENTITIES``; the
    others cross as nulls.
    """
    known = reduce(
        lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), COMMON_ENTITIES.items(), text
    )
    return F.coalesce(_entity_decoder()(F.when(text.rlike(_OTHER_ENTITY), text)), known)
