"""The engine's functions for SQL: scalar ones as SQL functions, names as a table function."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.names import find_names


class Names:
    """Rows (value, start, end, confidence, nominal, gender) for the names of a text."""

    def eval(self, text: str | None) -> Iterator[tuple]:
        for c in find_names(text):
            yield c[1], c[2], c[3], c[5], c[7][3], c[7][2]


NATIVE = (
    "pii_fingerprint(t STRING) RETURNS STRING RETURN sha2(t, 256)",
    "pii_token_count(t STRING) RETURNS INT RETURN CASE WHEN length(t) = 0 THEN 0 ELSE greatest(length(t) DIV 4, 1) END",
    r"pii_luhn_valid(t STRING) RETURNS BOOLEAN RETURN length(regexp_replace(t, '\\D', '')) > 0 AND luhn_check(regexp_replace(t, '\\D', ''))",
    r"pii_mask_alnum(t STRING) RETURNS STRING RETURN regexp_replace(t, '[\\p{L}\\p{N}]', '*')",
)


def register(spark: SparkSession) -> None:
    """Makes pii_fingerprint, pii_token_count, pii_luhn_valid, pii_mask_alnum and pii_names known to a session."""
    for f in NATIVE:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {f}")
    spark.udtf.register("pii_names", F.udtf(Names, returnType="value string, start int, end int, confidence double, nominal string, gender string"))


