"""SQL names for the kernels and text functions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from logweave.functions import align
from logweave.shipping import ship


def register(spark: SparkSession) -> list[str]:
    """Register template_merge, template_cover, template_ground, merge_repeats as Arrow functions and
    merge_wilds, mask_paths, squeeze_spaces as SQL functions that inline to built-ins; returns the names."""
    ship(spark)

    def two(function):
        @F.pandas_udf("string")
        def apply(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else function(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return apply

    @F.pandas_udf("boolean")
    def covers(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or y is None else align.cover(x, y)[0] for x, y in zip(a, b, strict=True)], dtype=object)

    @F.pandas_udf("string")
    def repeats(a: pd.Series) -> pd.Series:
        return a.map(align.merge_repeats, na_action="ignore")

    kernels = {"template_merge": two(lambda a, b: align.merge(a, b)[0]), "template_ground": two(lambda a, b: align.ground(a, b)[0]), "template_cover": covers, "merge_repeats": repeats}
    for name, function in kernels.items():
        spark.udf.register(name, function)
    inlined = {
        "merge_wilds": r"regexp_replace(regexp_replace(s, r'<\*>|<>|<\*|\*>', '<*>'), r'<\*>(?:[^\p{L}\p{N} ]*<\*>)+', '<*>')",
        "mask_paths": r"""regexp_replace(regexp_replace(s, r"/[a-zA-Z0-9\-._~:/?#@!$&'*+,;=]*", '<*>'), r'\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b', '<*>')""",
        "squeeze_spaces": "regexp_replace(s, '  ', ' ')",
    }
    for name, body in inlined.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(s STRING) RETURNS STRING RETURN {body}")
    return [*kernels, *inlined]
