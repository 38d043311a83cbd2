"""Explicit schemas of the nested records; nothing is inferred from the data."""

RUN_KEY = ("repo", "sha", "label", "rep")
GRAPH_KEY = ("repo", "sha")

# Effect kinds a unit may declare.
EFFECT_KINDS = ("network", "filesystem", "database", "subprocess", "env", "clock", "random", "hardware", "other")

# Failure codes of run observations.
FAILURE_CODES = {
    "F1": "unassigned", "F2": "dir-copy", "F3": "over-merge", "F4": "over-split", "F5": "ep-underlist",
    "F6": "internal-reach", "F7": "effect-miss", "F8": "budget", "F9": "context", "F10": "unstable", "F11": "recall",
}

_PATH_REASON = "array<struct<path string, reason string>>"
_UNIT = (
    "struct<name string, kind string, description string, role string, files array<string>, "
    "entrypoints array<struct<name string, kind string, type string, location string, signature string, plain string>>, "
    "depends_on array<struct<unit string, entrypoint string>>, "
    "effects array<struct<kind string, description string>>, version string>"
)

MANIFEST = {
    "repo": "string",
    "units": f"array<{_UNIT}>",
    "excluded": _PATH_REASON,
    "unpartitioned": _PATH_REASON,
    "violations_observed": "array<struct<from_unit string, to_unit string, location string, note string>>",
}

RESULT = {
    "total_cost_usd": "double", "num_turns": "int", "subtype": "string", "terminal_reason": "string",
    "is_error": "boolean", "duration_ms": "bigint", "session_id": "string",
    "usage": "struct<input_tokens bigint, output_tokens bigint, cache_read_input_tokens bigint, "
             "cache_creation_input_tokens bigint>",
}

META = {
    "repo": "string", "sha": "string", "rep": "string", "skill_label": "string", "overlay_hash": "string",
    "condition": "string", "hide_docs": "int", "has_claude_md": "int", "exit": "int", "max_turns": "int",
    "model": "string", "claude_code": "string", "date": "string", "session_id": "string", "stratum": "string",
}

UNIT_RECORD = {
    "name": "string", "kind": "string", "n_files": "int", "is_singleton": "boolean", "entered_from_outside": "boolean",
    "entrypoint_p": "double", "entrypoint_r": "double", "effects_p": "double", "effects_r": "double",
    "n_missed_entrypoints": "int", "n_undeclared_effects": "int",
}

# The 34 fields of a score record, in their stored order.
SCORE = {
    "valid_nontrivial": "boolean", "q_gain_dir": "double", "coverage": "double", "edge_resolution": "double",
    "trivial": "boolean", "budget_exhausted": "boolean", "run_error": "boolean", "result_subtype": "string",
    "singleton_unit_frac": "double", "n_units": "int", "unpartitioned": "int", "lint_rounds": "int",
    "units": "array<struct<" + ", ".join(f"{k} {v}" for k, v in UNIT_RECORD.items()) + ">>",
    "q_llm": "double", "q_one": "double", "q_dir": "double", "q_ceiling": "double",
    "q_cochange_llm": "double", "q_cochange_gain": "double", "gold_ari": "double", "gold_nmi": "double",
    "entrypoint_p": "double", "entrypoint_r": "double", "effects_p": "double", "effects_r": "double",
    "contract_r": "double", "units_with_missed_entrypoints": "int", "units_with_undeclared_effects": "int",
    "graph_source": "string", "cost_usd": "double", "turns": "int", "duration_ms": "bigint",
    "input_tokens": "bigint", "output_tokens": "bigint",
}

LEDGER = {"utc": "string", "repo": "string", "rep": "string", "outcome": "string", "attempts": "int", "pass_args": "string"}

RESULTS_TSV = {
    "label": "string", "n_repos": "bigint", "n_runs": "bigint", "valid_rate": "string", "mean_gain": "string",
    "mean_jaccard": "string", "mean_cost": "string",
}

CORPUS_META = {
    "snapshot": "string", "seed": "bigint", "n_requested": "bigint",
    "cells": "map<string, struct<query string, candidates int, picked array<string>>>",
}


def ddl(fields: dict[str, str]) -> str:
    return ", ".join(f"{name} {kind}" for name, kind in fields.items())
