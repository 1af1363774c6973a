"""The queries of this package: opN_<name>, and pipeline. ORACLES: DuckDB SQL where it can express one."""

from __future__ import annotations

from . import conversation_repair, source_divergence
from .byte_bpe import op5_byte_bpe
from .conversation_repair import op11_conversation_repair
from .fingerprints import op3_fingerprints
from .language_id import op10_language_id
from .language_model import op1_language_model
from .neighbours import op8_neighbours
from .ngram_join import op2_ngram_join
from .packing import op6_packing
from .sharding import op7_sharding
from .source_divergence import op12_source_divergence
from .suffix_dedup import op4_suffix_dedup
from .token_files import op9_token_files
from .toxicity import op13_toxicity

QUERIES = {f.__name__: f for f in (op1_language_model, op2_ngram_join, op3_fingerprints, op4_suffix_dedup, op5_byte_bpe, op6_packing, op7_sharding, op8_neighbours, op9_token_files, op10_language_id, op11_conversation_repair, op12_source_divergence, op13_toxicity)}
ORACLES: dict[str, str] = {"op11_conversation_repair": conversation_repair.ORACLE, "op12_source_divergence": source_divergence.ORACLE}
