"""The queries of the training-data operators, op1 to op10 and the pipeline, with their SQL where there is one."""

from __future__ import annotations

import corpus_pipeline
from lodestone.llm import op_queries

QUERIES = {f.__name__: f for f in op_queries.ALL} | {"pipeline": corpus_pipeline.run}
ORACLES = dict(op_queries.ORACLES) | ({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})
