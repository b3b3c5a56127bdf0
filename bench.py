"""Time the headline queries: one JSON line on standard output.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores. Every query is written to a
no-op sink, which computes all rows and columns. The corpus is built once, as its own entry, and stored,
as are the resolved query ids; ``search_e2e`` repeats all steps after that, for all queries at once, and
``search_one`` does so for a single query.
"""

from __future__ import annotations

import json
import os
import time

import registry
from nearcite.plans.search import Search
from nearcite.session import drop_materialized, local_session

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
NAMES = [
    "resolve_ids",
    "knn_join",
    "vector_topk",
    "ivf_exact",
    "ivf_probe",
    "citation_neighbors",
    "graph_edges",
    "ppr",
    "search_text_only",
    "search_e2e",
    "analytics_e2e",
    "network_e2e",
    "prompt",
    "merge_upsert",
    "refresh_status",
]


def main() -> None:
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), name="bench")
    spark.range(1000).selectExpr("sum(id)").collect()
    tables = registry.tables(spark, FOLDER)
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.time()
        work()
        times[name] = round(time.time() - start, 3)

    def consume(frame) -> None:
        frame.write.format("noop").mode("overwrite").save()

    timed("build_corpus", lambda: tables.corpus)
    timed("resolve_queries", lambda: tables.queries)
    timed("build_index", lambda: tables.index)
    timed("search_tables", lambda: tables.search.scored)
    for name in NAMES:
        timed(name, lambda: consume(registry.QUERIES[name](spark, FOLDER)))
    one = tables.queries.orderBy("query_id").limit(1)
    timed("search_one", lambda: Search(one, tables.corpus).result_table().collect())
    print(
        json.dumps(
            {
                "metric": "total seconds of headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(FOLDER).removeprefix("sf"),
                "n_queries": tables.queries.count(),
            }
        )
    )
    drop_materialized(spark)


if __name__ == "__main__":
    main()
