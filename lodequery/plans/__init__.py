"""Named queries and the SQL they are compared with."""

from . import score_queries, text_queries, title_match_queries, title_queries, whole_corpus_queries

MODULES = [title_queries, text_queries, score_queries, title_match_queries, whole_corpus_queries]
