"""Training-data operators: ten stages that prepare a text corpus for language-model training.

Nothing outside this subpackage imports it; its queries are in :mod:`lexweave.llm.queries`.
"""
