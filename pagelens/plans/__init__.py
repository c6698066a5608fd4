"""The query catalogue; importing it registers every query."""

from pagelens.plans import catalog, document_queries, merge_queries, page_queries, score_queries, url_queries

__all__ = ["catalog", "document_queries", "merge_queries", "page_queries", "score_queries", "url_queries"]
