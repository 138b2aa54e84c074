"""Readers and writers of documents, stores, corpora, reports and rules."""
