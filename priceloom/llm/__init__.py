"""Operators of a training-data pipeline; nothing else in the library imports this package."""


def all_llm_queries():
    """{name: (query, SQL counterpart or None)}."""
    from .alignment import op12_alignment
    from .chat import OP4_SQL, op4_chat_formatting
    from .decontaminate import OP6_SQL, op6_decontaminate
    from .fingerprint import op10_fingerprint
    from .jaccard import OP2_SQL, op2_ngram_jaccard
    from .langid import op8_language_id
    from .mixing import op1_mixing
    from .near_vectors import OP11_SQL, op11_near_vectors
    from .pii import op5_pii
    from .sharding import op3_sharding
    from .toxicity import op9_toxicity
    from .trie import OP13_SQL, op13_prefix_trie
    from .warc import OP7_SQL, op7_warc

    found = {
        op1_mixing: None, op2_ngram_jaccard: OP2_SQL, op3_sharding: None, op4_chat_formatting: OP4_SQL, op5_pii: None,
        op6_decontaminate: OP6_SQL, op7_warc: OP7_SQL, op8_language_id: None, op9_toxicity: None, op10_fingerprint: None,
        op11_near_vectors: OP11_SQL, op12_alignment: None, op13_prefix_trie: OP13_SQL,
    }
    return {query.__name__: (query, sql) for query, sql in found.items()}
