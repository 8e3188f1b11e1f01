"""End-to-end flows: raw dumps to tables, queries, filters, vectors and audits."""
