"""Time the headline queries: one JSON line on stdout.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).  With
arguments, only queries whose names start with one of them are timed; ``all``
times every registered query.
"""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusgauge.registry import all_queries  # noqa: E402
from corpusgauge.session import local_session  # noqa: E402

HEADLINE = (
    "entry_lexical_diversity", "src5_json_repair", "src11_keep_first", "prj7_quality_card", "mth4_robust_scale",
    "join1_master_table", "join5_fuzzy_match", "join6_class_pairs", "join7_nearest_match", "join9_pareto_orders",
    "join12_lexicon_scores", "join14_entity_mentions", "agg1_group_stats", "agg2_grouping_sets", "agg5_exact_quantiles_all",
    "agg14_weighted_wins", "agg32_word_frequency", "win1_adjacent_similarity", "win4_moving_average", "win7_ranks",
    "win9_fluctuation", "win11_cooldown_decisions", "arr1_arc_labels", "txt1_distinct_n", "txt2_self_bleu", "txt3_overlap_bleu",
    "txt5_perplexity", "txt7_sentence_continuity", "txt9_lexicon_emotion", "txt14_structure_complexity", "txt18_near_copies",
    "sta2_mann_whitney", "sta4_factorial_anova", "sta8_correlations", "sta12_robust_ols", "sta15_permutation_test",
    "sta16_bootstrap_means", "sta25_icc", "stm1_cost_ledger", "stm4_sessions",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = int(os.environ.get("BENCH_CPUS", "8"))
    known = all_queries()
    wanted = sys.argv[1:]
    if wanted == ["all"]:
        names = list(known)
    elif wanted:
        names = [n for n in known if n.startswith(tuple(wanted))]
    else:
        names = list(HEADLINE)
    spark = local_session(cores, "corpusgauge-bench")
    known["agg4_pair_coverage"].run(spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in names:
        start = time.perf_counter()
        # The sink takes every row and column of the result, so nothing is pruned away.
        known[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        if wanted:
            print(f"{times[name]:8.2f}  {name}", file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
