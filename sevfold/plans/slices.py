"""Functions cut to a line scope, one job per scope and all scopes from one scan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from sevfold.functions import code as fc

SCOPES = ("whole", "lines_without_context", "lines_with_surrounding_context", "context_only", "surrounding_only", "random_context")
SURROUNDING = 6


def with_lines(df: DataFrame, code: str = "func_before", vul_line: str = "vul_line") -> DataFrame:
    """Split the code and parse the line list once for all scopes."""
    return df.withColumns({"lines": fc.split_lines(F.col(code)), "vul": fc.parse_lines(F.col(vul_line))})


def scope(name: str, key: str, k: int = SURROUNDING, seed: int = 42) -> Column:
    lines, vul = F.col("lines"), F.col("vul")
    if name == "whole":
        return fc.slice_all(lines)
    if name == "lines_without_context":
        return fc.slice_vuln(lines, vul)
    if name == "lines_with_surrounding_context":
        return fc.slice_surrounding(lines, vul, k)
    if name == "context_only":
        return fc.slice_context(lines, vul)
    if name == "surrounding_only":
        return fc.slice_surrounding_only(lines, vul, k)
    if name == "random_context":
        return fc.slice_random(lines, vul, F.col(key), seed)
    raise ValueError(f"unknown scope {name!r}")


def slice_table(df: DataFrame, name: str, labels: list[str], key: str = "id", k: int = SURROUNDING) -> DataFrame:
    """``key``, the labels and the code in one scope."""
    return with_lines(df).select(F.col(key).alias("key"), *labels, scope(name, key, k).alias("code"))


def slice_all_scopes(df: DataFrame, labels: list[str], key: str = "id", k: int = SURROUNDING) -> DataFrame:
    """One column per scope, from one scan and one split of each function."""
    return with_lines(df).select(F.col(key).alias("key"), *labels, *[scope(s, key, k).alias(s) for s in SCOPES])
