
from __future__ import annotations

OPERATORS: dict[str, str] = {
    "S1": "sources.estate.scan_files", "S2": "sources.estate.changed_files", "S3": "sources.estate.save_cache, load_cache", "S4": "sources.estate.commit_log, operators.score.churn",
    "S5": "operators.score.authorship", "S6": "sources.estate.diff", "S7": "sources.estate.write_index", "S8": "sources.estate.open_index", "S9": "sources.estate.write_json, read_json",
    "S10": "sources.estate.export_analysis", "S11": "sources.estate.project_config", "S12": "sources.estate.path_aliases, apply_aliases",
    "E1": "operators.detect.stack", "E2": "operators.detect.modules", "E3": "operators.detect.risks", "E4": "operators.detect.endpoints", "E5": "operators.detect.http_calls",
    "E6": "operators.detect.plsql_objects", "E6b": "operators.detect.plsql_table_access", "E6c": "operators.detect.plsql_calls", "E7": "operators.detect.db_calls", "E8": "operators.parse.db_schema",
    "E9": "operators.detect.orm_mappings", "E9b": "operators.detect.sql_tables, sql_columns", "E10": "operators.detect.osw_links", "E11": "operators.detect.business_rules", "E12": "operators.detect.permissions, nearest_after",
    "E13": "operators.detect.transactions", "E14": "operators.detect.batch_jobs", "E15": "operators.parse.angular", "E16": "operators.detect.patterns", "E17": "operators.detect.classes, inheritance",
    "E18": "operators.parse.symbols", "E19": "operators.search.terms, snippet", "E20": "operators.detect.file_layer", "E21": "not built: no model is available; operators.search.vector_search takes given vectors",
    "G1": "operators.build.dependency_edges, degrees, central_files", "G1b": "operators.build.resolve_imports", "G2": "operators.build.symbol_edges, barrels", "G3": "operators.build.dependency_edges",
    "G4": "operators.build.call_graph", "G5": "operators.build.match_routes, operators.routes.route_trie", "G6": "operators.build.match_names", "G7": "functions.text.node_id", "G8": "operators.build.typed_edges",
    "G9": "operators.build.resolve_names", "G10": "operators.traverse.impact_index, operators.closure.Closure", "G11": "operators.parse.symbol_relations",
    "Q1": "operators.traverse.resolve_id", "Q2": "operators.traverse.resolve_file", "Q3": "operators.traverse.impact_of, operators.reachability.save, Reach", "Q4": "operators.traverse.blast_radius", "Q5": "operators.traverse.file_impact",
    "Q6": "operators.traverse.find_path", "Q7": "operators.traverse.trace", "Q8": "operators.traverse.resolve_entry", "Q9": "operators.traverse.flow", "Q10": "operators.levels.level, operators.lattice.save, Lattice", "Q11": "operators.levels.module_matrix",
    "Q12": "operators.search.bm25", "Q13": "operators.search.snippet", "Q14": "operators.search.inverted", "Q15": "operators.search.vector_search", "Q16": "operators.levels.call_graph_dump", "Q17": "api.get_table_columns",
    "Q18": "api.get_table_impact", "Q19": "operators.traverse.diff_impact", "Q20": "api.get_table_access", "Q21": "operators.levels.object_report", "Q22": "operators.levels.dead_objects", "Q23": "operators.levels.dead_files",
    "Q24": "operators.levels.fuzzy_modules", "Q25": "operators.levels.zoom_out", "Q26": "operators.levels.zoom_out_entity", "Q27": "operators.levels.concept_map", "Q28": "api.get_diagnosis", "Q29": "api.get_agent_brief", "Q30": "operators.levels.gaps",
    "Q31": "operators.levels.multigraph, top_per_layer", "Q32": "operators.levels.module_pairs", "Q33": "operators.levels.openapi", "Q34": "operators.detect.children_report", "Q35": "operators.levels.module_index",
    "Q36": "api.get_quick_context", "Q37": "operators.levels.module_context", "Q38": "operators.levels.executive_report", "Q39": "operators.detect.transaction_report", "Q40": "sources.estate.summary",
    "M1": "operators.score.complexity", "M2": "operators.score.file_metrics", "M3": "operators.score.module_metrics", "M4": "operators.score.top_metrics", "M5": "operators.score.health_score", "M6": "operators.score.predict_risk",
    "M7": "operators.score.bus_factor", "M8": "operators.score.ownership", "M9": "operators.score.knowledge_risk", "M10": "operators.score.start_here", "M11": "operators.score.reviewers", "M12": "operators.score.roi, roi_total",
    "M13": "operators.score.within_budget", "M14": "operators.score.usage", "M15": "operators.score.risk_level, operators.govern.portfolio_totals", "M16": "operators.score.health_delta",
    "V1": "operators.govern.layer_violations", "V2": "operators.traverse.circular", "V3": "operators.govern.arch_rules", "V4": "functions.text.glob_regex", "V5": "operators.govern.deepening", "V6": "operators.govern.self_delta",
    "V7": "operators.govern.prediction_feedback", "V8": "operators.govern.compare, pr_review", "V9": "operators.govern.gates", "V10": "operators.govern.triage_sync", "V11": "operators.govern.triage_transition", "V12": "operators.govern.triage_list",
    "V13": "operators.govern.portfolio", "V14": "operators.govern.alerts", "V15": "operators.govern.capped", "V16": "operators.govern.capped", "V17": "operators.govern.manual_item", "V18": "operators.govern.portfolio, summarise, portfolio_totals", "V19": "operators.govern.rule_compliance",
    "L1": "streaming.live.watch_files, debounced, streaming.changes.watch_changes, streaming.debounce.quiet_bursts, reanalyse", "L2": "streaming.live.once", "L3": "streaming.live.push", "L4": "streaming.live.append_activity, compact_activity", "L5": "streaming.live.dispatch_alerts, streaming.ledger.deliver_alerts, Ledger", "L6": "streaming.live.incremental", "L7": "streaming.ledger.deliver_alerts",
}
