"""Queries of this subpackage by name, and the SQL of those that SQL can express."""

from cladewise.llm import licences
from cladewise.llm.bitsliced import OP7_SQL, op7_bitsliced_topk
from cladewise.llm.exact_dedup import OP6_SQL, op6_exact_dedup
from cladewise.llm.fim import OP12_SQL, op12_fill_in_middle
from cladewise.llm.html_blocks import op13_html_blocks
from cladewise.llm.licences import op8_licence_sentences
from cladewise.llm.line_dedup import op4_line_dedup
from cladewise.llm.lm import op10_attention_lm
from cladewise.llm.merkle import OP11_SQL, op11_merkle_manifest
from cladewise.llm.mixing import op1_pareto_mix
from cladewise.llm.packing import op9_power_of_two_packing
from cladewise.llm.quality import op2_pu_quality
from cladewise.llm.sharding import op5_balanced_shards
from cladewise.llm.simhash import op3_simhash_near_dedup

QUERIES = {
    "op1_pareto_mix": op1_pareto_mix,
    "op2_pu_quality": op2_pu_quality,
    "op3_simhash_near_dedup": op3_simhash_near_dedup,
    "op4_line_dedup": op4_line_dedup,
    "op5_balanced_shards": op5_balanced_shards,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bitsliced_topk": op7_bitsliced_topk,
    "op8_licence_sentences": op8_licence_sentences,
    "op9_power_of_two_packing": op9_power_of_two_packing,
    "op10_attention_lm": op10_attention_lm,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_html_blocks": op13_html_blocks,
}

ORACLE_SQL = {
    "op6_exact_dedup": OP6_SQL,
    "op7_bitsliced_topk": OP7_SQL,
    "op8_licence_sentences": licences.oracle_sql(),
    "op11_merkle_manifest": OP11_SQL,
    "op12_fill_in_middle": OP12_SQL,
}
