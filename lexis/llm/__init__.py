"""Operators for preparing large text collections for language-model training.

Thirteen operators over a ``documents`` table (``doc_id``, ``text``, ...), their
registered queries (``lexis.llm.queries``) and the corpus pipeline at the
repository top.  Nothing outside this subpackage imports it.
"""
