"""Training-data operators. Nothing else in the library imports this subpackage."""

from . import alignment, byte_bpe, conversation_trie, decontamination, exact_dedup, jaccard_join, language_id, line_dedup, mixing, pii, quality, topk, url_filter

_MODULES = (url_filter, jaccard_join, mixing, exact_dedup, byte_bpe, pii, quality, language_id, topk, line_dedup, decontamination, alignment, conversation_trie)
QUERIES = {name: f for m in _MODULES for name, f in m.QUERIES.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
