"""The queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from .embedding_dedup import OP2_SQL, op2_embedding_near_dedup
from .hilbert import op9_nearest_neighbours
from .langid import op3_language_id
from .lines import OP6_SQL, op6_line_dedup
from .mixing import OP5_SQL, op5_source_mixing
from .pii import op7_personal_data
from .piece_bpe import op10_sentencepiece
from .simhash import op1_simhash_near_dedup
from .suffix_dedup import op4_suffix_array_dedup
from .wordpiece import op8_token_counts

QUERIES = {
    "op1_simhash_near_dedup": op1_simhash_near_dedup,
    "op2_embedding_near_dedup": op2_embedding_near_dedup,
    "op3_language_id": op3_language_id,
    "op4_suffix_array_dedup": op4_suffix_array_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_line_dedup": op6_line_dedup,
    "op7_personal_data": op7_personal_data,
    "op8_token_counts": op8_token_counts,
    "op9_nearest_neighbours": op9_nearest_neighbours,
    "op10_sentencepiece": op10_sentencepiece,
}

ORACLE_SQL: dict[str, str] = {
    "op2_embedding_near_dedup": OP2_SQL,
    "op5_source_mixing": OP5_SQL,
    "op6_line_dedup": OP6_SQL,
}
