"""Training-data operators over documents, pages and embeddings.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.
"""
