"""Write the final (post-AQE) physical plans of key queries to PLANS.md.

python tests/dump_plans.py [sf_dir]
"""

from __future__ import annotations

import os
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

NOTES = {
    "most_active_categories": "A13: comments reduced per post (partial + final aggregate) before the join to "
    "posts; per-category aggregate; categories left-joined; TakeOrderedAndProject for the top 10.",
    "user_engagement_literal": "A15 literal: two per-author pre-aggregates joined 1:1 to users; the fan-out "
    "sums are closed forms, no posts x comments join.",
    "category_growth": "D3: comments reduced to (post, day) before the semi join with categorised posts; "
    "a 31-row spine left-joined; no nested-loop join.",
    "invalid_likes": "V5: identical requests folded by a partial aggregate; first request per pair from the "
    "folded rows; existence checks against primary keys without de-duplication.",
    "like_events_final_state": "W3: the log has been walked and stored (one range exchange, not in this plan); "
    "the few pairs at the borders of partitions are chained by a window, then pairs meet the stored likes.",
    "most_commented_posts_full": "A16: ranking on post ids and counts only; the 10 winning posts fetched by a "
    "broadcast of the 10-row key list.",
    "comments_by_author": "F15: the equality filter reaches the Parquet scan (PushedFilters) and only the "
    "needed columns are read (ReadSchema).",
}


def main(argv):
    from contentlens.session import build_session
    from __spark_entry__ import queries

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.1"
    spark = build_session("plans", shuffle_partitions=16)
    out = [
        "# Physical plans of key queries",
        "",
        f"Final plans after adaptive execution (`{sf_dir}`, local[*], 16 shuffle partitions), "
        "written by `tests/dump_plans.py`.",
        "",
    ]
    for name, note in NOTES.items():
        df = queries()[name](spark, sf_dir)
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        plan = "\n".join(line[:200] for line in plan.splitlines() if "Initial Plan" not in line)
        final = plan.split("+- == Initial Plan ==")[0] if "Initial Plan" in plan else plan
        out += [f"## {name}", "", note, "", "```", final.rstrip(), "```", ""]
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    with open(os.path.join(root, "PLANS.md"), "w") as f:
        f.write("\n".join(out))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv)
