"""The queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from veilgraph.llm.content_store import op10_content_store
from veilgraph.llm.decontamination import op5_edit_decontamination
from veilgraph.llm.knn import OP2_SQL, op2_voronoi_knn
from veilgraph.llm.langid import op8_crf_langid
from veilgraph.llm.near_dedup import OP4_SQL, op4_setsketch_dedup
from veilgraph.llm.packing import op7_bm25_packing
from veilgraph.llm.quality import op9_nbsvm_quality
from veilgraph.llm.sharding import op1_shard_packing
from veilgraph.llm.suffix_dedup import op3_suffix_dedup
from veilgraph.llm.token_counts import op6_token_counts


def queries() -> dict:
    return {f.__name__: f for f in (op1_shard_packing, op2_voronoi_knn, op3_suffix_dedup, op4_setsketch_dedup, op5_edit_decontamination, op6_token_counts, op7_bm25_packing, op8_crf_langid, op9_nbsvm_quality, op10_content_store)}


def oracle_sql() -> dict[str, str]:
    return {"op2_voronoi_knn": OP2_SQL, "op4_setsketch_dedup": OP4_SQL}
