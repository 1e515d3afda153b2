"""Times the headline queries: BENCH_SF_DIR (default /root/testdata/sf0.1) on local[BENCH_CPUS]; one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lodestone.plans import catalog  # noqa: E402
from lodestone.session import local_session  # noqa: E402

HEADLINE = (
    "importance_score", "dir_grouping", "deepest_ancestor", "suffix_unique_match", "lift_edges", "evidence_top3", "hub_nodes", "facade_closure", "transitive_paths",
    "drift_classify", "undocumented_filtered", "manifest_diff", "dir_signature", "subtree_signature", "loc_metrics", "branch_count", "link_extract", "quota_admission",
    "audit_summary", "top_k_insights", "import_extract", "import_resolve", "sanitize_sources", "file_statics",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    spark = local_session(cpus, **{"spark.sql.shuffle.partitions": cpus})
    found = catalog.queries()
    try:
        import corpus_pipeline  # noqa: F401
        from lodestone.llm import queries as llm

        found |= llm.queries()
        names = (*HEADLINE, *llm.queries())
    except ImportError:
        names = HEADLINE
    took: dict[str, float] = {}
    for name in names:
        runs = []
        for _ in range(1 if name.startswith("op") else 2):
            began = time.time()
            found[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.time() - began)
        took[name] = round(min(runs), 3)
    total = round(sum(took.values()), 3)
    print(json.dumps({"metric": "headline queries, total seconds", "value": total, "unit": "sec", "queries": took, "median": round(statistics.median(took.values()), 3), "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus}))


if __name__ == "__main__":
    main()
