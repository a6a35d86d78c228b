"""Queries of the engine; importing the modules registers them."""

from sori.plans import audits, cases, casework, files, inputs, intake, lookups, metrics, queries, reports, worker

__all__ = ["audits", "cases", "casework", "files", "inputs", "intake", "lookups", "metrics", "queries", "reports", "worker"]
