"""The queries of this subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

import corpus_pipeline
from prismtab.llm.bpe import op7_bpe
from prismtab.llm.fingerprints import op2_fingerprints
from prismtab.llm.html_extract import op1_html_text
from prismtab.llm.media import op3_media
from prismtab.llm.minhash import op10_minhash_near_dedup
from prismtab.llm.oracle import ORACLE_SQL as _SQL
from prismtab.llm.pack import op8_best_fit_packing
from prismtab.llm.secrets import op9_secret_scans
from prismtab.llm.substring import op5_substring_dedup
from prismtab.llm.token_counts import op6_token_counts
from prismtab.llm.toxicity import op4_toxicity

QUERIES = {f.__name__: f for f in (op1_html_text, op2_fingerprints, op3_media, op4_toxicity, op5_substring_dedup, op6_token_counts, op7_bpe, op8_best_fit_packing, op9_secret_scans, op10_minhash_near_dedup)} | {"pipeline": corpus_pipeline.run}

ORACLE_SQL: dict[str, str] = dict(_SQL)
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
