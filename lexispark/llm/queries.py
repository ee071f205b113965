"""The registered queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from lexispark.llm import epsilon_grid, minhash, mixing, packing, quality, secrets, sharding, substring, suffixes, voronoi


def queries() -> dict:
    return {
        "op1_epsilon_grid_near_dedup": epsilon_grid.op1_epsilon_grid_near_dedup,
        "op2_rlz_substring_dedup": substring.op2_rlz_substring_dedup,
        "op3_minhash_near_dedup": minhash.op3_minhash_near_dedup,
        "op4_pareto_mixing": mixing.op4_pareto_mixing,
        "op5_quality_gam": quality.op5_quality_gam,
        "op6_residual_packing": packing.op6_residual_packing,
        "op7_secret_scan": secrets.op7_secret_scan,
        "op8_rendezvous_sharding": sharding.op8_rendezvous_sharding,
        "op9_voronoi_top_k": voronoi.op9_voronoi_top_k,
        "op10_deep_shallow_dedup": suffixes.op10_deep_shallow_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_epsilon_grid_near_dedup": epsilon_grid.OP1_SQL,
        "op2_rlz_substring_dedup": substring.OP2_SQL,
        "op3_minhash_near_dedup": minhash.OP3_SQL,
        "op4_pareto_mixing": mixing.OP4_SQL,
        "op9_voronoi_top_k": voronoi.OP9_SQL,
    }
