"""Training-data operators over documents, pages, conversations and embeddings.

One module per operator; ``queries`` registers one ``opN_<name>`` query for
each, and the top-level ``corpus_pipeline`` chains five of them. Nothing else
in the library imports this subpackage.
"""
