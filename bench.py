"""Times the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Every query is run to completion through a no-op write, so that no time goes
into bringing rows to the driver.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from inkgrid.plans import QUERIES  # noqa: E402
from inkgrid.session import build_session  # noqa: E402

HEADLINE = [
    "mask_warnings", "image_metrics", "denoise", "bgr_to_lab", "unique_colors", "palette", "label_pixels", "layer_fidelity",
    "layer_contamination", "trace_layers", "trace_masks", "rasterize", "svg_to_vertices", "svg_stats", "polygon_area", "simplify",
    "open_paths", "duplicate_pairs", "touch_pairs", "containment_pairs", "components", "check", "latest_version", "cache_hits",
    "assign_versions", "fold_edits", "consolidated_layers", "document_graph", "save_checkpoint_layers", "duplicate_project_layers",
    "list_projects", "integrity_check", "safe_file_name", "connected_components",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", cores=cores)
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
