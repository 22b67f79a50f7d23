"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from .byte_bpe import op9_byte_bpe
from .chat_format import OP4_SQL, op4_chat_format
from .fingerprints import op7_fingerprints
from .jaccard_join import OP8_SQL, op8_jaccard_join
from .mixing import op6_source_mix
from .quality_rules import op5_quality_rules
from .suffix_dedup import OP2_SQL, op2_suffix_dedup
from .token_counts import op3_token_counts
from .token_shards import op10_token_shards
from .toxicity import op1_toxicity
from .vector_codes import OP13_SQL, op13_vector_codes
from .warc import OP12_SQL, op12_warc
from .whitening import op11_whitening

QUERIES = {
    f.__name__: f
    for f in (op1_toxicity, op2_suffix_dedup, op3_token_counts, op4_chat_format, op5_quality_rules, op6_source_mix, op7_fingerprints, op8_jaccard_join, op9_byte_bpe, op10_token_shards, op11_whitening, op12_warc, op13_vector_codes)
}
ORACLE_SQL = {"op2_suffix_dedup": OP2_SQL, "op4_chat_format": OP4_SQL, "op8_jaccard_join": OP8_SQL, "op12_warc": OP12_SQL, "op13_vector_codes": OP13_SQL}
