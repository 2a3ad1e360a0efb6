"""Operators of a training-data pipeline, on whole tables of documents, pages and vectors."""
