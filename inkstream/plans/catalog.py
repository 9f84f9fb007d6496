"""All queries of the library's own operators, with their DuckDB texts."""

from inkstream.plans import registry, reports, staged, tables, texts

QUERIES, ORACLE_SQL = registry.QUERIES, registry.ORACLE_SQL
FLAGSHIP = tables.weekly_top
MODULES = (texts, tables, reports, staged)
