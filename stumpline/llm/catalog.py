"""The queries of this subpackage and their SQL, for __spark_entry__.py."""

from __future__ import annotations

from .entropy_mix import op10_mix
from .exact_dedup import OP4_SQL, op4_exact_dedup
from .fingerprint_index import op5_substring_dedup
from .jaccard_join import op6_jaccard_join
from .ppm_language import op2_ppm_language
from .preference_format import COMPLETIONS_SQL, OP9_SQL, op9_preference_format, preference_completions
from .pu_quality import op7_pu_quality
from .role_grammar import op12_role_grammar
from .sentencepiece_codec import op1_sentencepiece
from .simhash_variants import op13_simhash_variants
from .spelling_variants import op11_spelling_variants
from .suffix_dedup import op3_suffix_dedup
from .telephony_audio import op8_telephony_audio


def queries() -> dict:
    return {f.__name__: f for f in (op1_sentencepiece, op2_ppm_language, op3_suffix_dedup, op4_exact_dedup, op5_substring_dedup, op6_jaccard_join, op7_pu_quality, op8_telephony_audio, op9_preference_format, op10_mix, op11_spelling_variants, op12_role_grammar, op13_simhash_variants, preference_completions)}


def oracle_sql() -> dict[str, str]:
    return {"op4_exact_dedup": OP4_SQL, "op9_preference_format": OP9_SQL, "preference_completions": COMPLETIONS_SQL}
