"""The SQL surface: functions and a table function registered in a session."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from gramquarry.functions.binary import C1, C2, F1, F2, H_ADD


def _steps(steps: list[str], first: str = "x") -> str:
    """SQL that applies the steps, each a formula of x, one after another, computing each value once."""
    for step in steps:
        first = f"element_at(transform(array({first}), x -> {step}), 1)"
    return first


def register(spark: SparkSession) -> None:
    """fp_contains(value, pattern), fp_windows(value, width, step), fp_bucket(gram), and the table function
    fp_slices(pattern)."""
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fp_contains(v BINARY, p BINARY) RETURNS BOOLEAN RETURN octet_length(p) > 0 AND contains(v, p)")
    spark.sql(
        """CREATE OR REPLACE TEMPORARY FUNCTION fp_windows(v BINARY, w INT, s INT) RETURNS ARRAY<BINARY> RETURN
        CASE WHEN octet_length(v) = 0 THEN array() WHEN octet_length(v) < w THEN array(v)
        ELSE transform(array_distinct(concat(sequence(0, octet_length(v) - w, s), array(octet_length(v) - w))), x -> substring(v, x + 1, w)) END"""
    )
    times = "((x & 65535) * {0} + shiftleft(shiftright(x, 16) * {0} & 65535, 16)) & 4294967295"
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fp_mix(x BIGINT) RETURNS BIGINT RETURN " + _steps([times.format(C1), "(shiftleft(x, 15) | shiftright(x, 17)) & 4294967295", times.format(C2)]))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION fp_byte(g BINARY, i INT) RETURNS BIGINT RETURN CAST(conv(hex(substring(g, i, 1)), 16, 10) AS BIGINT)")
    steps = _steps([f"((shiftleft(x, 13) | shiftright(x, 19)) & 4294967295) * 5 + {H_ADD} & 4294967295 ^ fp_mix(fp_byte(g, 5)) ^ 5", "x ^ shiftright(x, 16)", times.format(F1), "x ^ shiftright(x, 13)", times.format(F2), "x ^ shiftright(x, 16)"], "fp_mix(fp_byte(g, 1) | shiftleft(fp_byte(g, 2), 8) | shiftleft(fp_byte(g, 3), 16) | shiftleft(fp_byte(g, 4), 24))")
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION fp_bucket(g BINARY) RETURNS INT RETURN
        CASE WHEN octet_length(g) BETWEEN 1 AND 4 THEN CAST(shiftleft(octet_length(g), 24) | (CAST(conv(hex(g), 16, 10) AS BIGINT) & 16777215) AS INT)
        WHEN octet_length(g) = 5 THEN CAST(shiftleft(5, 24) | ({steps} & 16777215) AS INT) END"""
    )

    @udtf(returnType="at int, slice binary")
    class Slices:
        def eval(self, pattern: bytes) -> Iterator[tuple[int, bytes]]:
            from gramquarry.functions.binary import query_slices

            yield from enumerate(query_slices(bytes(pattern or b"")))

    spark.udtf.register("fp_slices", Slices)
