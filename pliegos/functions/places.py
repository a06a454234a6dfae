"""Where patterns match in a text, in time linear in the text: one Arrow pass finds the matches of all patterns with the signs around them."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

MATCH = T.StructType([
    T.StructField("start", T.IntegerType()), T.StructField("match", T.StringType()), T.StructField("groups", T.ArrayType(T.StringType())),
    T.StructField("before", T.StringType()), T.StructField("around", T.StringType()),
])


def places(patterns: dict[str, str], before: int = 0, around: int = 0) -> Callable[[Column], Column]:
    """A function of a text that gives a struct with an array of matches for each pattern (of Python's ``re``).

    A match has start (from 0), match, groups, the ``before`` signs before it, and it with ``around`` signs on both sides. Null has no matches.
    """
    compiled = {name: re.compile(p) for name, p in patterns.items()}

    def found(pattern: re.Pattern, text: str) -> list[tuple]:
        out = []
        for m in pattern.finditer(text):
            a, b = m.span()
            out.append((a, m[0], list(m.groups()), text[max(0, a - before) : a], text[max(0, a - around) : b + around] if around else ""))
        return out

    @F.pandas_udf(T.StructType([T.StructField(name, T.ArrayType(MATCH)) for name in patterns]))
    def of_texts(texts: pd.Series) -> pd.DataFrame:
        texts = texts.fillna("")
        return pd.DataFrame({name: [found(p, t) for t in texts] for name, p in compiled.items()}, columns=list(compiled))

    return of_texts
