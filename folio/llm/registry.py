"""The queries of the training-data operators and the SQL that checks them."""

from folio.llm import ann, chat, cluster, langid, mixing, neardup, packing, pii, quality, sharding, tokens, urls, whiten

_MODULES = (ann, sharding, chat, quality, mixing, tokens, pii, neardup, urls, packing, langid, whiten, cluster)

QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.ORACLE_SQL.items()}
