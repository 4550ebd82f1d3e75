"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from chronoweave.llm.ann import op10_ann
from chronoweave.llm.decontaminate import op9_decontaminate
from chronoweave.llm.fill_in_middle import OP12_SQL, op12_fill_in_middle
from chronoweave.llm.line_dedup import OP1_SQL, op1_line_dedup
from chronoweave.llm.periodic_runs import op11_periodic_runs
from chronoweave.llm.sentencepiece_codec import op3_sentencepiece
from chronoweave.llm.sharding import op5_sharding
from chronoweave.llm.simhash import op2_simhash
from chronoweave.llm.substring_dedup import OP6_SQL, op6_substring_dedup
from chronoweave.llm.suffix_array import OP7_SQL, op7_suffix_array
from chronoweave.llm.token_counts import op4_token_counts
from chronoweave.llm.toxicity import op8_toxicity
from chronoweave.llm.vector_dedup import op13_vector_dedup


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_line_dedup": op1_line_dedup,
        "op2_simhash": op2_simhash,
        "op3_sentencepiece": op3_sentencepiece,
        "op4_token_counts": op4_token_counts,
        "op5_sharding": op5_sharding,
        "op6_substring_dedup": op6_substring_dedup,
        "op7_suffix_array": op7_suffix_array,
        "op8_toxicity": op8_toxicity,
        "op9_decontaminate": op9_decontaminate,
        "op10_ann": op10_ann,
        "op11_periodic_runs": op11_periodic_runs,
        "op12_fill_in_middle": op12_fill_in_middle,
        "op13_vector_dedup": op13_vector_dedup,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_line_dedup": OP1_SQL, "op6_substring_dedup": OP6_SQL, "op7_suffix_array": OP7_SQL, "op12_fill_in_middle": OP12_SQL}
