"""The training-data queries: one opN_<name> for each operator, over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ._oracles import ARCHIVES, NEAR_TEXTS, NEAR_VECTORS, SHARDS, SUBSTRINGS
from .chat_format import CALLS_SQL, chat_tool_calls, op3_chat_formatting
from .chat_format import ORACLE_SQL as CHAT_SQL
from .decontamination import op1_decontamination
from .embedding_dedup import op9_embedding_dedup
from .hard_negatives import ORACLE_SQL as NEGATIVES_SQL
from .hard_negatives import op12_hard_negatives
from .html_extraction import op10_html_extraction
from .language_id import op5_language_id
from .ngram_join import op4_ngram_jaccard_join
from .packing import op7_packing
from .personal_data import op13_personal_data
from .prefix_trie import ORACLE_SQL as TRIE_SQL
from .prefix_trie import op11_prefix_trie
from .sharding import op6_sharding
from .substring_dedup import op2_substring_dedup
from .warc import op8_warc

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontamination": op1_decontamination,
    "op2_substring_dedup": op2_substring_dedup,
    "op4_ngram_jaccard_join": op4_ngram_jaccard_join,
    "op7_packing": op7_packing,
    "op5_language_id": op5_language_id,
    "op6_sharding": op6_sharding,
    "op8_warc": op8_warc,
    "op10_html_extraction": op10_html_extraction,
    "op9_embedding_dedup": op9_embedding_dedup,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_personal_data": op13_personal_data,
    "op3_chat_formatting": op3_chat_formatting,
    "chat_tool_calls": chat_tool_calls,
}

ORACLES: dict[str, str] = {"op2_substring_dedup": SUBSTRINGS, "op3_chat_formatting": CHAT_SQL, "op4_ngram_jaccard_join": NEAR_TEXTS, "op6_sharding": SHARDS, "op8_warc": ARCHIVES, "op9_embedding_dedup": NEAR_VECTORS, "op11_prefix_trie": TRIE_SQL, "op12_hard_negatives": NEGATIVES_SQL, "chat_tool_calls": CALLS_SQL}
