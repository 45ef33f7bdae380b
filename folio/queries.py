"""Registered queries and the SQL that checks them."""

from folio.plans import page_queries, table_queries, text_queries

QUERIES = {**text_queries.R.queries, **table_queries.R.queries, **page_queries.R.queries}
ORACLE_SQL = {**text_queries.R.oracle, **table_queries.R.oracle, **page_queries.R.oracle}
