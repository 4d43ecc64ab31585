"""Write the physical plan trees of the headline queries to PLANS.md (AQE off, so the
static plan shows the exchanges and join strategies chosen before runtime re-planning)."""
import os
import re
import sys

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from uas_spark.plans.registry import QUERIES  # noqa: E402
from uas_spark.session import build_session  # noqa: E402

KEYS = ["zone_observed_at_point", "zone_latest_fresh", "join_zone_asof", "join_positions_zone_current",
        "join_positions_covering_auth", "join_boxes_flight_plans", "sensor_coverage", "join_positions_registration",
        "registration_overlap", "registration_sequential_accept", "authorization_lifecycle", "dedup_append_live",
        "sun_times"]


def tree(df) -> str:
    plan = df._jdf.queryExecution().executedPlan().toString()
    out = []
    for line in plan.splitlines():
        line = re.sub(r"#\d+L?", "", line)
        line = re.sub(r"\[[^\]]{160,}\]", "[...]", line)
        out.append(line[:220])
    return "\n".join(out)


def main():
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = build_session("local[8]", 16, extra={"spark.sql.adaptive.enabled": "false",
                                                 "spark.sql.autoBroadcastJoinThreshold": "-1"})
    parts = ["# Physical plans of the headline queries\n",
             "Generated by `tools/show_plans.py` with AQE and automatic broadcast off, i.e. the plan a "
             "large input gets before runtime re-planning: every join is an exchange on its key. "
             "Attribute ids removed, long lists elided.\n"]
    for k in KEYS:
        parts.append(f"## {k}\n\n```\n{tree(QUERIES[k](spark, sf))}\n```\n")
    with open(os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "PLANS.md"), "w") as f:
        f.write("\n".join(parts))


if __name__ == "__main__":
    main()
