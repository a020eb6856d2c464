"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import all_queries
from pairloom.session import local_session

HEADLINE = (
    "z01_pair_scoring",
    "c09_shared_key_positives",
    "c10_all_pairs",
    "c12_stratified_split",
    "d02_chunk_rows",
    "e02_spectrum",
    "e02_spectrum_fft",
    "e06_mel_bands",
    "e15_fourier_artifacts",
    "e16_assemble_combined",
    "e16_full_size_windows",
    "j06_convolve_blocks",
    "k04_feature_stats",
    "f01_cosine01_native",
    "f01_cosine01_arrow",
    "f04_text_similarity",
    "f06_structural_similarity",
    "f07_melodic_similarity_arrow",
    "f14_score_pairs_full",
    "h05_auc",
    "i02_value_counts",
    "i07_top_words",
    "i09_quartiles",
    "i19_pairwise_cohens_d",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(name="bench")
    queries = all_queries()
    # start the JVM and the Python workers outside the timing
    spark.range(1000).selectExpr("sum(id)").collect()
    seconds: dict[str, float] = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
        # a query may have persisted its spectrum: do not let it serve the next one
        spark.catalog.clearCache()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
