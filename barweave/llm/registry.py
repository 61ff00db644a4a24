"""The queries of this subpackage by name, and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import stages
from .licenses import OP11_SQL, op11_licenses
from .linededup import op9_linededup
from .lm import op3_lm
from .neardup_text import op10_bagminhash
from .neardup_vectors import OP5_SQL, op5_vector_neardup
from .packing import op8_packing
from .pieces import op6_pieces
from .pii import op4_pii
from .quality import op7_quality
from .search import OP2_SQL, op2_maxscore
from .spelling import OP12_SQL, op12_spelling
from .toxicity import op1_toxicity
from .trie import OP13_SQL, op13_trie


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": stages.run} | {f.__name__: f for f in (op1_toxicity, op2_maxscore, op3_lm, op4_pii, op5_vector_neardup, op6_pieces, op7_quality, op8_packing, op9_linededup, op10_bagminhash, op11_licenses, op12_spelling, op13_trie)}


def oracle_sql() -> dict[str, str]:
    return {"op2_maxscore": OP2_SQL, "op5_vector_neardup": OP5_SQL, "op11_licenses": OP11_SQL, "op12_spelling": OP12_SQL, "op13_trie": OP13_SQL}
