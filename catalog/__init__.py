"""The registered queries: each operator on stand-ins derived from the test tables, with its SQL."""

from catalog import library_queries, post_queries, source_queries, tag_queries, text_queries, vector_queries

_MODULES = (text_queries, post_queries, tag_queries, library_queries, vector_queries, source_queries)


def all_queries():
    return {name: run for module in _MODULES for name, (run, _) in module.QUERIES.items()}


def all_oracles():
    return {name: sql for module in _MODULES for name, (_, sql) in module.QUERIES.items() if sql}
