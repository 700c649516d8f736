"""The corpus operators' queries, one for each operator, and the SQL for those that SQL can express."""

from __future__ import annotations

from tidewave.llm.bpe import op5_bpe
from tidewave.llm.decontaminate import op4_decontamination
from tidewave.llm.hmm import op8_lm
from tidewave.llm.importance import OP11_SQL, op11_resampling
from tidewave.llm.minhash import OP7_SQL, op7_minhash
from tidewave.llm.periodic import op13_runs
from tidewave.llm.quality import op3_quality
from tidewave.llm.secrets import op6_secrets
from tidewave.llm.sharding import OP1_SQL, op1_sharding
from tidewave.llm.substrings import op9_substrings
from tidewave.llm.tokens import op12_token_files
from tidewave.llm.toxicity import op2_toxicity
from tidewave.llm.warc import OP10_SQL, op10_warc

QUERIES = {q.__name__: q for q in (op1_sharding, op2_toxicity, op3_quality, op4_decontamination, op5_bpe, op6_secrets, op7_minhash, op8_lm, op9_substrings, op10_warc, op11_resampling, op12_token_files, op13_runs)}

ORACLES: dict[str, str] = {"op1_sharding": OP1_SQL, "op7_minhash": OP7_SQL, "op10_warc": OP10_SQL, "op11_resampling": OP11_SQL}
