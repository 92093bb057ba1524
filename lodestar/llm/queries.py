"""Registration of the training-data operators: one query each over whole tables."""

from __future__ import annotations

from lodestar.functions.workers import reachable
from lodestar.llm.collocations import OP13_SQL, op13_collocations
from lodestar.llm.decontam import op8_decontamination
from lodestar.llm.html_text import op1_html_text
from lodestar.llm.langid import op6_language_id
from lodestar.llm.mixlm import op9_mixing_lm
from lodestar.llm.packing import op4_packing
from lodestar.llm.quality import op7_quality_cascade
from lodestar.llm.rare_digest import op12_rare_digest
from lodestar.llm.resample import OP11_SQL, op11_importance_resampling
from lodestar.llm.secret_ledger import op2_secret_ledger
from lodestar.llm.simhash import op10_simhash
from lodestar.llm.toxicity import op5_toxicity
from lodestar.llm.warc import op3_warc_roundtrip

QUERIES = {f.__name__: reachable(f) for f in (
    op1_html_text, op2_secret_ledger, op3_warc_roundtrip, op4_packing, op5_toxicity, op6_language_id, op7_quality_cascade, op8_decontamination, op9_mixing_lm, op10_simhash,
    op11_importance_resampling, op12_rare_digest, op13_collocations)}

#: The other operators' methods (models, archives, tokens, offsets, cascades) go beyond SQL; tests/llm holds them against brute force.
ORACLE_SQL: dict[str, str] = {"op11_importance_resampling": OP11_SQL, "op13_collocations": OP13_SQL}
