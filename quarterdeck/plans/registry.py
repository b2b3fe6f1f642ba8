"""All queries of the panel engine and their DuckDB SQL, by name."""

from quarterdeck.plans import audit_queries, file_queries, panel_queries, selection_queries

_MODULES = (panel_queries, selection_queries, audit_queries, file_queries)


def queries() -> dict:
    return {name: query for module in _MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in _MODULES for name, sql in module.SQL.items()}
