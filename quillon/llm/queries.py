"""The queries of this subpackage and, where SQL can express them, their SQL."""

from quillon.llm.ctw import op2_lm_score
from quillon.llm.decontam import op10_decontamination
from quillon.llm.fixity import FIXITY_SQL, op8_fixity
from quillon.llm.jaccard import op3_jaccard_join
from quillon.llm.langid import op1_language_id
from quillon.llm.media import op9_media
from quillon.llm.mixing import MIXING_SQL, op6_mixing
from quillon.llm.pii import op5_pii
from quillon.llm.repeats import op4_repeats
from quillon.llm.viterbi import op7_token_counts

QUERIES = {
    f.__name__: f
    for f in (op1_language_id, op2_lm_score, op3_jaccard_join, op4_repeats, op5_pii, op6_mixing, op7_token_counts, op8_fixity, op9_media, op10_decontamination)
}
SQL = {"op6_mixing": MIXING_SQL.replace("@docs", "documents"), "op8_fixity": FIXITY_SQL}
