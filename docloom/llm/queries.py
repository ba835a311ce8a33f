"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from docloom.llm.alignment import op13_token_alignment
from docloom.llm.bpe import op1_bpe_round_trip
from docloom.llm.merkle import OP12_SQL, op12_merkle_manifest
from docloom.llm.mixing import OP10_SQL, op10_pareto_mix
from docloom.llm.quality import op3_quality_forest
from docloom.llm.quotations import OP6_SQL, op6_quotation_links
from docloom.llm.rotated_codes import OP7_SQL, op7_rotated_codes
from docloom.llm.sharding import OP4_SQL, op4_hash_tree
from docloom.llm.simhash import op8_simhash_components
from docloom.llm.simhash_sql import OP8_SQL
from docloom.llm.token_counts import op5_token_counts
from docloom.llm.toxicity import op11_toxicity
from docloom.llm.url_reputation import OP2_SQL, op2_host_reputation
from docloom.llm.warc import OP9_SQL, op9_revisit_records

QUERIES = {
    "op1_bpe_round_trip": op1_bpe_round_trip,
    "op2_host_reputation": op2_host_reputation,
    "op3_quality_forest": op3_quality_forest,
    "op4_hash_tree": op4_hash_tree,
    "op5_token_counts": op5_token_counts,
    "op6_quotation_links": op6_quotation_links,
    "op7_rotated_codes": op7_rotated_codes,
    "op8_simhash_components": op8_simhash_components,
    "op9_revisit_records": op9_revisit_records,
    "op10_pareto_mix": op10_pareto_mix,
    "op11_toxicity": op11_toxicity,
    "op12_merkle_manifest": op12_merkle_manifest,
    "op13_token_alignment": op13_token_alignment,
}

ORACLE_SQL: dict[str, str] = {
    "op2_host_reputation": OP2_SQL,
    "op4_hash_tree": OP4_SQL,
    "op6_quotation_links": OP6_SQL,
    "op7_rotated_codes": OP7_SQL,
    "op8_simhash_components": OP8_SQL,
    "op9_revisit_records": OP9_SQL,
    "op10_pareto_mix": OP10_SQL,
    "op12_merkle_manifest": OP12_SQL,
}
