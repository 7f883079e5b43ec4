"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: one warm-up and the median of three runs each, as one JSON line."""

import json
import os
import statistics
import time

from sulcus.plans.catalogue import QUERIES
from sulcus.session import session, ship

HEADLINE = [
    "fc_sliding_edges", "fc_sliding_edges_kernel", "fc_node_strength", "hilbert_envelope", "hfo_features", "lagged_coherence", "envelope_corr_layers", "ten_centralities",
    "evolution_node_metrics", "ccm_scores", "fragility_heatmap", "mlevc", "time_bins", "feature_vectors", "roc_auc", "topk_metrics", "balanced_sample", "filtered_signals",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = ship(session(f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, **{"spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "8g"}))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        runs = []
        for k in range(4):
            t = time.perf_counter()
            QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            if k:
                runs.append(time.perf_counter() - t)
        took[name] = round(statistics.median(runs), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf)}))


if __name__ == "__main__":
    main()
