"""Where each operator id is implemented: (module:attribute, query that shows it or None)."""

from __future__ import annotations

_OPS, _PLANS, _SRC, _STR = "millrace.operators", "millrace.plans", "millrace.sources", "millrace.streaming"


def _many(prefix: str, numbers: range, width: int, where: str, query: str | None) -> dict[str, tuple[str, str | None]]:
    return {f"{prefix}{n:0{width}d}": (where, query) for n in numbers}


W, A = f"{_PLANS}.warehouse", f"{_PLANS}.analytics"
IDS: dict[str, tuple[str, str | None]] = {
    "SRC-01": (f"{_SRC}.kafka:kafka_stream", None), "SRC-02": (f"{_STR}.jobs:validated", "rules_pos_transactions"), "SRC-03": (f"{_SRC}.kafka:file_stream", "str_stream_windows"), "SRC-04": (f"{_SRC}.landing:discover", "snk_landing_cycle"), "SRC-05": (f"{_SRC}.landing:load_landed", "snk_landing_cycle"), "SRC-06": (f"{_SRC}.landing:read_stores", None), "SRC-07": (f"{_SRC}.landing:changed_files", None),
    "SRC-08": (f"{W}:dim_date", "wh_dim_date"), "SRC-09": (f"{W}:dim_store", "q02_revenue_by_outlet"), "SRC-10": (f"{_PLANS}.pipeline:Pipeline", None), "SRC-11": (f"{_OPS}.reconcile:gather", "rec_report"), "SRC-12": (f"{_SRC}.generator:sales", "gen_dry_run"), "SRC-13": (f"{_SRC}.generator:with_faults", "gen_dry_run"),
    "SNK-01": (f"{_STR}.sinks:IngestWriter", "snk_landing_cycle"), "SNK-02": (f"{_SRC}.landing:batch_path", "snk_landing_cycle"), "SNK-03": (f"{_STR}.sinks:query_id", "snk_landing_cycle"), "SNK-04": (f"{_SRC}.kafka:kafka_sink", None), "SNK-05": (f"{_STR}.sinks:WindowTable", "str_stream_windows"), "SNK-06": (f"{_STR}.sinks:expired", None), "SNK-07": (f"{_SRC}.landing:load_landed", "snk_landing_cycle"),
    "SNK-08": (f"{_SRC}.landing:purge_archive", None), "SNK-09": (f"{_OPS}.merge:insert_only", "snk_merge_insert"), "SNK-10": (f"{_OPS}.merge:changed", "snk_merge_scd1"), "SNK-11": (f"{_OPS}.merge:rebuild", "snk_rebuild"), "SNK-12": (f"{_OPS}.merge:rekey", "snk_rekey"), "SNK-13": ("millrace.session:build_session", None), "SNK-14": (f"{_STR}.sinks:topic_folder", None), "SNK-15": (f"{_SRC}.generator:dry_run", "gen_dry_run"),
    **_many("DEC-", range(1, 4), 2, f"{_OPS}.decode:unframe", "rules_pos_transactions"), **_many("DEC-", range(4, 7), 2, f"{_OPS}.decode:parse", "rules_pos_transactions"), "DEC-07": (f"{_OPS}.outputs:landed", "ing_landed"), "DEC-08": (f"{_OPS}.outputs:dead_records", "dlq_inspect"), "DEC-09": (f"{_OPS}.outputs:dead_letters", "ing_dead_letters"), "DEC-10": (f"{W}:typed_sales", "wh_fact_sales"), "DEC-11": (f"{W}:stage_lines", "wh_fact_sales"), "DEC-12": (f"{_OPS}.windows:product_units_1h", "str_product_units_1h"),
    **_many("ENV-", range(1, 7), 3, f"{_OPS}.rules:envelope_rules", "rules_mutated"), **_many("POS-", range(1, 10), 3, f"{_OPS}.rules:PAYLOAD_RULES", "rules_mutated"), **_many("INV-", range(1, 4), 3, f"{_OPS}.rules:PAYLOAD_RULES", "rules_mutated"), **_many("CUS-", range(1, 3), 3, f"{_OPS}.rules:PAYLOAD_RULES", "rules_customer_events"), **_many("PRD-", range(1, 3), 3, f"{_OPS}.rules:PAYLOAD_RULES", "rules_mutated"),
    "FLT-01": (f"{_OPS}.rules:apply_rules", "rules_pos_transactions"), "FLT-02": (f"{_OPS}.outputs:landed", "ing_landed"), "FLT-03": (f"{_OPS}.contract:violations", "flt03_contract_all"), "FLT-04": (f"{W}:stage_customers", "wh_dim_customer"),
    "JOIN-01": (f"{W}:fact_sales", "wh_vw_sales"), "JOIN-02": (f"{W}:stage_lines", "wh_fact_sales"), "JOIN-03": (f"{_OPS}.asof:attach_as_of", "wh_fact_sales"), "JOIN-04": (f"{W}:inventory_snapshots", "wh_snapshots"), "JOIN-05": (f"{A}:d01_top_stores_series", "d01_top_stores_series"), "JOIN-06": (f"{W}:with_inferred_products", "wh_dim_product"), "JOIN-07": (f"{A}:q04_as_was_as_is", "q04_as_was_as_is"), "JOIN-08": (f"{A}:q12_underperformers", "q12_underperformers"),
    "JOIN-09": (f"{A}:q13_price_changes", "q13_price_changes"), "JOIN-10": (f"{_OPS}.quality:sf006", "dq_results"), "JOIN-11": (f"{A}:position", "q15_inventory_position"), "JOIN-12": (f"{A}:q12_underperformers", "q12_underperformers"), "JOIN-13": (f"{_OPS}.quality:sf006", "dq_results"), "JOIN-14": (f"{A}:d01_top_stores_series", "d01_top_stores_series"), "JOIN-15": (f"{_OPS}.quality:sf005", "dq_results"),
    "AGG-01": (f"{A}:q01_revenue_30d", "q01_revenue_30d"), "AGG-02": (f"{A}:q19_shrinkage", "q19_shrinkage"), "AGG-03": (f"{_OPS}.quality:sf008", "dq_results"), "AGG-04": (f"{_OPS}.reconcile:gather", "rec_report"), "AGG-05": (f"{A}:q09_baskets_by_store", "q09_baskets_by_store"), "AGG-06": (f"{A}:q10_baskets_by_payment_tier", "q10_baskets_by_payment_tier"), "AGG-07": (f"{A}:q09_baskets_by_store", "q09_baskets_by_store"), "AGG-08": (f"{A}:q17_turnover", "q17_turnover"),
    "AGG-09": (f"{A}:q02_revenue_by_outlet", "q02_revenue_by_outlet"), "AGG-10": (f"{_OPS}.outputs:audit", "ing_audit"), "AGG-11": (f"{_STR}.jobs:observed", "snk_landing_cycle"), "AGG-12": (f"{_OPS}.windows:store_revenue_5m", "str_store_revenue_5m"), "AGG-13": (f"{_OPS}.quality:sf001", "dq_results"), "AGG-14": (f"{W}:with_inferred_products", "wh_dim_product"), "AGG-15": (f"{A}:q06_daily_changes", "q06_daily_changes"), "AGG-16": (f"{_OPS}.redrive:inspect", "dlq_inspect"), "AGG-17": (f"{_OPS}.alerts:evaluate", "alr_fired"),
    "WIN-01": (f"{W}:first_events", "wh_fact_sales"), "WIN-02": (f"{W}:stage_stores", "q02_revenue_by_outlet"), **_many("WIN-", range(3, 6), 2, f"{W}:version_chain", "wh_dim_product"), "WIN-06": (f"{A}:q06_daily_changes", "q06_daily_changes"), "WIN-07": (f"{A}:q07_moving_average", "q07_moving_average"), "WIN-08": (f"{A}:q02_revenue_by_outlet", "q02_revenue_by_outlet"), "WIN-09": (f"{A}:q14_store_performance", "q14_store_performance"), "WIN-10": (f"{A}:q14_store_performance", "q14_store_performance"),
    "WIN-11": (f"{A}:q12_underperformers", "q12_underperformers"), "WIN-12": (f"{A}:q11_top10_per_category", "q11_top10_per_category"), "WIN-13": (f"{A}:q21_tier_migrations", "q21_tier_migrations"), "WIN-14": (f"{_OPS}.quality:sf008", "dq_results"), "WIN-15": (f"{W}:inventory_snapshots", "wh_snapshots"), "WIN-16": (f"{A}:q02_revenue_by_outlet", "q02_revenue_by_outlet"),
    "ORD-01": (f"{_OPS}.redrive:inspect", "dlq_inspect"), "ORD-02": (f"{A}:q16_low_stock", "q16_low_stock"), "ORD-03": (f"{A}:q03_top_products", "q03_top_products"), "ORD-04": (f"{_OPS}.rules:apply_rules", "rules_pos_transactions"), "SET-01": (f"{_PLANS}.ingest:wh_freshness", "wh_freshness"), "SET-02": (f"{_OPS}.outputs:dead_records", "dlq_inspect"),
    "STR-01": (f"{_OPS}.windows:watermarked", "str_stream_windows"), "STR-02": (f"{_OPS}.windows:watermarked", "str_stream_windows"), "STR-03": (f"{_OPS}.windows:store_revenue_5m", "str_stream_windows"), "STR-04": (f"{_OPS}.windows:product_units_1h", "str_product_units_1h"), "STR-05": (f"{_STR}.listener:samples_of", None), "STR-06": (f"{_STR}.jobs:start_realtime", "str_stream_windows"), "STR-07": (f"{_STR}.jobs:start_ingest", "snk_landing_cycle"), "STR-08": ("millrace.session:SETTINGS", None), "STR-09": (f"{_SRC}.kafka:file_stream", "snk_landing_cycle"),
    "STR-10": (f"{_STR}.jobs:start_ingest", "snk_landing_cycle"), "STR-11": (f"{_STR}.jobs:start_ingest", None), "STR-12": (f"{_STR}.listener:SampleListener", None), "STR-13": (f"{_STR}.jobs:supervise", None), "STR-14": (f"{_STR}.jobs:start_realtime", None),
    "WH-01": (f"{W}:stage_stores", "q02_revenue_by_outlet"), "WH-02": (f"{W}:stage_lines", "wh_fact_sales"), "WH-03": (f"{W}:business_duplicates", "wh_business_duplicates"), "WH-04": (f"{W}:stage_movements", "wh_fact_inventory"), "WH-05": (f"{W}:stage_customers", "wh_dim_customer"), "WH-06": (f"{W}:stage_products", "wh_dim_product"), "WH-07": (f"{_PLANS}.pipeline:Pipeline", None), "WH-08": (f"{W}:dim_store", "q02_revenue_by_outlet"), "WH-09": (f"{W}:dim_product", "wh_dim_product"), "WH-10": (f"{W}:dim_customer", "wh_dim_customer"),
    "WH-11": (f"{W}:with_inferred_customers", "wh_dim_customer"), "WH-12": (f"{W}:fact_sales", "wh_fact_sales"), "WH-13": (f"{W}:fact_inventory", "wh_fact_inventory"), "WH-14": (f"{W}:inventory_snapshots", "wh_snapshots"), "WH-15": (f"{W}:inventory_snapshots", "wh_snapshots"), "WH-16": (f"{W}:dim_date", "wh_dim_date"), "WH-17": (f"{A}:wh_vw_sales", "wh_vw_sales"), "WH-18": ("millrace.functions.keys:scd2_key", "wh_dim_product"), "WH-19": (f"{_PLANS}.pipeline:Pipeline", None), "WH-20": (f"{_PLANS}.pipeline:Pipeline", None),
    **{f"SF-{n:03d}": (f"{_OPS}.quality:sf{n:03d}", "dq_results") for n in range(1, 9)}, "DQ-09": (f"{_OPS}.quality:run_checks", "dq_results"), "REC-01": (f"{_OPS}.reconcile:reconcile", "rec_report"), "REC-02": (f"{_OPS}.reconcile:gather", "rec_report"), "REC-03": (f"{_OPS}.reconcile:gate", "rec_gate"), "DLQ-01": (f"{_OPS}.redrive:redrive", "dlq_redrive"), "DLQ-02": (f"{_OPS}.redrive:inspect", "dlq_inspect"),
    **_many("ALR-", range(1, 13), 2, f"{_OPS}.alerts:evaluate", "alr_fired"),
}
from millrace.plans.analytics import QUERIES as _NAMED  # noqa: E402

IDS |= {name.split("_")[0].upper(): (f"{A}:{name}", name) for name in _NAMED if name[0] in "qd" and name[1:3].isdigit()}
#: Ids that have no counterpart on Spark: migrations and grants of a table service.
OUT_OF_SCOPE = ("WH-21", "WH-22")
