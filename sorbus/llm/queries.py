"""The registered queries of this subpackage; those without SQL are held against brute force in the tests."""

from sorbus.llm.aq import op5_aq_search
from sorbus.llm.bpe import op9_bpe
from sorbus.llm.chat import CHAT_SQL, op12_chat
from sorbus.llm.fingerprint import op3_fingerprint
from sorbus.llm.html import op4_html
from sorbus.llm.jaccard import op8_jaccard
from sorbus.llm.langid import op10_langid
from sorbus.llm.lm import LM_SQL, op7_lm
from sorbus.llm.negatives import NEGATIVES_SQL, op13_negatives
from sorbus.llm.packing import op1_packing
from sorbus.llm.resample import RESAMPLE_SQL, op11_resampling
from sorbus.llm.suffix import op6_suffix_dedup
from sorbus.llm.toxicity import op2_toxicity

QUERIES = {
    f.__name__: f
    for f in (
        op1_packing, op2_toxicity, op3_fingerprint, op4_html, op5_aq_search, op6_suffix_dedup, op7_lm, op8_jaccard, op9_bpe, op10_langid, op11_resampling,
        op12_chat, op13_negatives,
    )
}
SQL = {"op7_lm": LM_SQL, "op11_resampling": RESAMPLE_SQL, "op12_chat": CHAT_SQL, "op13_negatives": NEGATIVES_SQL}
