"""The queries of this subpackage, and their SQL where SQL can say them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .bottom_k import op3_fingerprints
from .decontaminate import op4_decontaminate
from .decontaminate import oracle as contamination_sql
from .fill_in_middle import op11_fill_in_middle
from .fill_in_middle import oracle as fill_in_middle_sql
from .hard_negatives import op13_hard_negatives
from .hard_negatives import oracle as hard_negatives_sql
from .html_main import op1_main_text
from .identifiers import op8_identifiers
from .jaccard_join import op6_jaccard_join
from .language_id import op2_language
from .mixing import op7_mixing
from .mixing import oracle as mixing_sql
from .packing import op12_packing
from .quality_lm import op10_quality
from .secrets_ledger import op9_secrets
from .token_planes import op5_token_planes

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_main_text": op1_main_text,
    "op2_language": op2_language,
    "op3_fingerprints": op3_fingerprints,
    "op4_decontaminate": op4_decontaminate,
    "op5_token_planes": op5_token_planes,
    "op6_jaccard_join": op6_jaccard_join,
    "op7_mixing": op7_mixing,
    "op8_identifiers": op8_identifiers,
    "op9_secrets": op9_secrets,
    "op10_quality": op10_quality,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_packing": op12_packing,
    "op13_hard_negatives": op13_hard_negatives,
}

#: None for 1, 2, 3, 5, 6, 8, 9, 10 and 12: models, hashes, files, token ids and code-point offsets that SQL has no words for; see tests/llm.
ORACLES: dict[str, str] = {
    "op4_decontaminate": contamination_sql(),
    "op7_mixing": mixing_sql(),
    "op11_fill_in_middle": fill_in_middle_sql(),
    "op13_hard_negatives": hard_negatives_sql(),
}
