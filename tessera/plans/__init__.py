"""Whole plans: retrieval, ingestion, hierarchy building, answering."""
