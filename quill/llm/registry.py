"""The queries of this package, for __spark_entry__.py."""

from __future__ import annotations

from quill.llm.chat_format import OP13_SQL, op13_chat_format
from quill.llm.containment import OP10_SQL, op10_containment
from quill.llm.hard_negatives import OP12_SQL, op12_hard_negatives
from quill.llm.importance import op4_importance
from quill.llm.language_id import op3_language_id
from quill.llm.minhash_dedup import OP6_SQL, op6_minhash_dedup
from quill.llm.packing import op2_packing
from quill.llm.prefix_trie import OP11_SQL, op11_prefix_trie
from quill.llm.quality_rules import op8_quality_rules
from quill.llm.secret_scan import op5_secret_scan
from quill.llm.separator_scan import op9_separator_scan
from quill.llm.token_arrow import op1_token_arrow
from quill.llm.warc_bundle import OP7_SQL, op7_warc_bundle

QUERIES = {
    "op1_token_arrow": op1_token_arrow,
    "op2_packing": op2_packing,
    "op3_language_id": op3_language_id,
    "op4_importance": op4_importance,
    "op5_secret_scan": op5_secret_scan,
    "op6_minhash_dedup": op6_minhash_dedup,
    "op7_warc_bundle": op7_warc_bundle,
    "op8_quality_rules": op8_quality_rules,
    "op9_separator_scan": op9_separator_scan,
    "op10_containment": op10_containment,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_chat_format": op13_chat_format,
}

ORACLE_SQL: dict[str, str] = {
    "op6_minhash_dedup": OP6_SQL,
    "op7_warc_bundle": OP7_SQL,
    "op10_containment": OP10_SQL,
    "op11_prefix_trie": OP11_SQL,
    "op12_hard_negatives": OP12_SQL,
    "op13_chat_format": OP13_SQL,
}
