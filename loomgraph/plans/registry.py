"""Queries of the text-graph operators, by name, with their SQL twins."""

from __future__ import annotations

from loomgraph.plans import edge_queries, log_queries, metric_queries, more_queries, path_queries, source_queries, split_queries, text_queries

BOOKS = [m.BOOK for m in (edge_queries, path_queries, split_queries, text_queries, metric_queries, log_queries, source_queries, more_queries)]
QUERIES = {k: v for b in BOOKS for k, v in b.queries.items()}
SQL = {k: v for b in BOOKS for k, v in b.sql.items()}
FLAGSHIP = "h03_common_neighbours"
