"""Training-data operators: language id, quality, dedup, toxicity, packing, URLs, tokens, mixing, secrets, manifests, licenses, clusters.

Each module holds one operator with its own general interface; :mod:`chatterflow.llm.queries` holds the thin
``opN_<name>`` queries over the ``documents`` and ``pages`` tables. Nothing outside this package imports it.
"""
