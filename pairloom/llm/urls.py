"""Verdicts on the links from which tracks are fetched: rules first, boosted trees for the rest."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pairloom.llm.storage import stored

#: labelled links a model is fitted on at most, chosen by hash; trees, depth, pseudo-counts of a suffix
MAX_LABELLED, TREES, DEPTH, PRIOR = 20_000, 15, 4, 5.0
PARTS = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CHARACTERS = "abcdefghijklmnopqrstuvwxyz0123456789-._~/?&=%"
SUFFIXES = ("top", "registered", "extension")


def link_parts(url: Column) -> tuple[Column, Column]:
    """(host, path): host after the first ``://``, A-Z lowered; both empty without one."""
    url = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(url, PARTS, 1), UPPER, LOWER), F.regexp_extract(url, PARTS, 2)


def longest_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, host/path) that fits; null if none does.

    A rule fits its host and all subdomains of it when the path starts with the rule's.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, prefix in sorted(rules, key=lambda r: len(r[1])):
        at, _, below = prefix.partition("/")
        fits = ((host == at) | host.endswith(f".{at}")) & path.startswith(f"/{below}")
        rule, verdict = F.when(fits, prefix).otherwise(rule), F.when(fits, said).otherwise(verdict)
    return rule, verdict


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def lexical_features(links: DataFrame) -> DataFrame:
    """Adds lengths, depth, digit share, entropy, parameter counts and the suffixes of ``url``."""
    url = F.translate(F.coalesce("url", F.lit("")), UPPER, LOWER)
    size = F.greatest(F.length(url), F.lit(1)).cast("double")
    shares = [_count(url, rf"\{c}" if not c.isalnum() else c) / size for c in CHARACTERS]
    entropy = sum((F.when(p > 0, -p * F.log2(p)).otherwise(0.0) for p in shares), F.lit(0.0))
    host, path = link_parts(F.col("url"))
    features = {
        "length": F.length(url).cast("double"), "host_length": F.length(host).cast("double"),
        "labels": _count(host, r"\."), "depth": _count(path, "/[^/]"), "digits": _count(url, "[0-9]") / size,
        "host_digits": _count(host, "[0-9]"), "hyphens": _count(host, "-"), "parameters": _count(url, r"[?&][^=&#]*="),
        "fragment": url.contains("#").cast("double"), "secure": url.startswith("https:").cast("double"), "entropy": entropy,
    }
    suffixes = {
        "top": F.substring_index(host, ".", -1), "registered": F.substring_index(host, ".", -2),
        "extension": F.regexp_extract(path, r"\.([a-z0-9]{1,5})/?$", 1),
    }
    return links.withColumns({f"f_{k}": v for k, v in features.items()} | {f"s_{k}": v for k, v in suffixes.items()})


def link_verdicts(
    links: DataFrame, labelled: DataFrame, rules: Sequence[tuple[str, str]] = (), max_labelled: int = MAX_LABELLED,
) -> DataFrame:
    """(track_id, host, path, rule, verdict) of every link (track_id, url).

    The longest fitting rule decides. For all others boosted trees do, fitted on ``labelled`` (url,
    blocked 0/1), of which at most about ``max_labelled`` distinct links, chosen by hash, are used.
    Suffix statistics are smoothed shares of blocked links. With labels of one kind only that kind
    is the verdict, without labels ``allow``. Null labels are left out; a null url has empty parts
    and is judged like any other; repeated rows and rows without track_id are kept.
    """
    known = labelled.where(F.col("url").isNotNull() & F.col("blocked").isNotNull())
    known = known.groupBy("url").agg(F.max("blocked").cast("double").alias("blocked"))
    total = known.count()
    share = F.pmod(F.xxhash64("url"), F.lit(1 << 30)) < F.lit((1 << 30) * max_labelled // max(total, 1))
    sample = stored(lexical_features(known.where(share)))
    kinds = {r["blocked"]: r["n"] for r in sample.groupBy("blocked").agg(F.count(F.lit(1)).alias("n")).collect()}
    host, path = link_parts(F.col("url"))
    rule, verdict = longest_rule(host, path, rules)
    judged = links.select("track_id", "url", host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("said"))
    if len(kinds) < 2:
        model = F.lit("block" if set(kinds) == {1.0} else "allow")
    else:
        base = kinds[1.0] / sum(kinds.values())
        statistics = {}
        for name in SUFFIXES:  # no larger than the sample, whose size is bounded
            counts = sample.groupBy(f"s_{name}").agg(F.count(F.lit(1)).alias("n"), F.sum("blocked").alias("b"))
            shares = counts.select(f"s_{name}", ((F.col("b") + PRIOR * base) / (F.col("n") + PRIOR)).alias(f"f_{name}_share"))
            statistics[name] = stored(shares)
        known_suffixes = lambda df: _with_statistics(df, statistics, base)
        columns = sorted(c for c in known_suffixes(sample).columns if c.startswith("f_"))
        assembler = VectorAssembler(inputCols=columns, outputCol="features")
        trees = GBTClassifier(labelCol="blocked", maxIter=TREES, maxDepth=DEPTH, seed=7)
        fitted = trees.fit(assembler.transform(known_suffixes(sample)).select("features", "blocked"))
        judged = fitted.transform(assembler.transform(known_suffixes(lexical_features(judged))))
        model = F.when(F.col("prediction") == 1.0, "block").otherwise("allow")
    return judged.select("track_id", "host", "path", "rule", F.coalesce("said", model).alias("verdict"))


def _with_statistics(df: DataFrame, statistics: dict[str, DataFrame], base: float) -> DataFrame:
    for name, shares in statistics.items():
        df = df.join(F.broadcast(shares), f"s_{name}", "left").fillna({f"f_{name}_share": base})
    return df
