"""Scalars callable from SQL text, as temporary SQL functions that Catalyst inlines."""

from __future__ import annotations

from pyspark.sql import SparkSession

from pairloom.operators.similarity import ARTIFACT_WEIGHTS, WEIGHTS

_DOT = "aggregate(zip_with({0}, {1}, (x, y) -> x * y), 0D, (acc, v) -> acc + v)"


def _clip(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN NULL ELSE greatest(0D, least(1D, {x})) END"


def sql_function_texts() -> dict[str, str]:
    size = f"sqrt({_DOT.format('a', 'a')}) * sqrt({_DOT.format('b', 'b')})"
    cosine = _clip(f"({_DOT.format('a', 'b')}) / nullif({size}, 0D)")
    fourier = " + ".join(f"v[{i}]" for i in range(12, 22))
    terms = (
        _clip("(v[0] - 1D) / 1.5D"), _clip("1D - v[7] / 20D"), _clip("v[8] * 5D"), _clip("abs(v[10] - 0.87D) / 0.3D"), f"({fourier}) / 10D",
    )
    artifact = " + ".join(f"{weight}D * {term}" for weight, term in zip(ARTIFACT_WEIGHTS, terms))
    names = list(WEIGHTS)
    top = " + ".join(f"coalesce({k}, 0D) * {w}D" for k, w in WEIGHTS.items())
    den = " + ".join(f"CASE WHEN {k} IS NULL THEN 0D ELSE {w}D END" for k, w in WEIGHTS.items())
    return {
        "cosine01": f"cosine01(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {cosine}",
        "cache_key": (
            "cache_key(path STRING, variant INT) RETURNS STRING RETURN sha2(concat_ws('|', path, '10.0', '5.0', "
            "'16000', CASE WHEN variant > 0 THEN concat('aug_', variant) END), 256)"
        ),
        "artifact_score": f"artifact_score(v ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {_clip('(' + artifact + ')')}",
        "attribution_score": (
            f"attribution_score({', '.join(k + ' DOUBLE' for k in names)}) RETURNS DOUBLE "
            f"RETURN ({top}) / nullif({den}, 0D)"
        ),
    }


def register_sql_functions(spark: SparkSession) -> list[str]:
    texts = sql_function_texts()
    for text in texts.values():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {text}")
    return list(texts)
