"""The registered queries of the subpackage, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
from assize.llm import alignment, divergence, imatch, licenses, lm, mixing, pieces, pii, quality, sharding, simhash, toxicity, vectors

QUERIES: dict[str, Callable] = {
    "op1_pii": pii.op1_pii,
    "op2_simhash": simhash.op2_simhash,
    "op3_vectors": vectors.op3_vectors,
    "op4_toxicity": toxicity.op4_toxicity,
    "op5_quality": quality.op5_quality,
    "op6_imatch": imatch.op6_imatch,
    "op7_mixing": mixing.op7_mixing,
    "op8_pieces": pieces.op8_pieces,
    "op9_licenses": licenses.op9_licenses,
    "op10_sharding": sharding.op10_sharding,
    "op11_alignment": alignment.op11_alignment,
    "op12_lm": lm.op12_lm,
    "op13_divergence": divergence.op13_divergence,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op7_mixing": mixing.OP7_SQL,
    "op13_divergence": divergence.OP13_SQL,
}
