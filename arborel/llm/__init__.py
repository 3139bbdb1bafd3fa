"""Corpus preparation for language models: ten operators over documents, vectors and pages."""
