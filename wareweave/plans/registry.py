"""All queries of the price-comparison engine and their SQL oracles."""

from __future__ import annotations

from wareweave.plans import cleaning, corpus, matching, rules, sheets, similarity, summaries

MODULES = (sheets, cleaning, rules, matching, similarity, summaries, corpus)


def queries() -> dict:
    return {name: run for m in MODULES for name, (run, _) in m.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, (_, sql) in m.QUERIES.items() if sql}
