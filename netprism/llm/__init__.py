"""Training-data operators (token files, filters, de-duplication, search,
language-model scoring, packing, sharding, chat formatting).

Nothing else in the library imports this subpackage; its queries are in
``netprism.llm.queries``.
"""
