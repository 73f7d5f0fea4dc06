"""Registry of the corpus queries and their oracles."""

import corpus_pipeline
from gridloom.llm.bpe import op1_bpe
from gridloom.llm.hpylm import op9_hpylm
from gridloom.llm.knn import ORACLE_OP4, op4_top_k
from gridloom.llm.linededup import ORACLE_OP3, op3_line_dedup
from gridloom.llm.minhash import ORACLE_OP2, op2_near_duplicates
from gridloom.llm.packing import op6_packing
from gridloom.llm.pii import op5_pii
from gridloom.llm.quality import op7_quality_rules
from gridloom.llm.repeats import op8_repeats
from gridloom.llm.toxicity import op10_toxicity

QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_near_duplicates": op2_near_duplicates,
    "op3_line_dedup": op3_line_dedup,
    "op4_top_k": op4_top_k,
    "op5_pii": op5_pii,
    "op6_packing": op6_packing,
    "op7_quality_rules": op7_quality_rules,
    "op8_repeats": op8_repeats,
    "op9_hpylm": op9_hpylm,
    "op10_toxicity": op10_toxicity,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {
    "op2_near_duplicates": ORACLE_OP2,
    "op3_line_dedup": ORACLE_OP3,
    "op4_top_k": ORACLE_OP4,
}
