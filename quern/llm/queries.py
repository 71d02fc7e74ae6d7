"""The registered queries of this subpackage and their SQL."""
from quern.llm import (q_bpe, q_content_sort, q_conversation_trie, q_importance, q_infill, q_media, q_minhash, q_mixing, q_packing, q_repeats, q_secrets,
                       q_toxicity, q_warc)

_MODULES = [q_secrets, q_mixing, q_bpe, q_importance, q_minhash, q_toxicity, q_repeats, q_content_sort, q_warc, q_media, q_infill, q_conversation_trie, q_packing]


def queries():
    return {m.NAME: m.run for m in _MODULES}


def oracle_sql():
    return {m.NAME: m.SQL for m in _MODULES if m.SQL}
