"""The queries of this subpackage, by name, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from .ann import op2_prefix_forest
from .fingerprints import op1_imatch
from .langid import op7_bitmask
from .mixing import op6_curriculum
from .near_dedup import op5_minhash
from .packing import op9_concat_cut
from .secret_scan import op10_markov
from .sharding import op4_hypergeometric
from .token_files import op3_token_files
from .tool_calls import op8_tool_calls

_ALL = (op1_imatch, op2_prefix_forest, op3_token_files, op4_hypergeometric, op5_minhash, op6_curriculum, op7_bitmask, op8_tool_calls, op9_concat_cut, op10_markov)
QUERIES = {f.__name__: f for f in _ALL}
#: Hashes, models, tokenizers and random draws are not SQL: tests hold these queries against brute force.
ORACLE_SQL: dict[str, str] = {}
