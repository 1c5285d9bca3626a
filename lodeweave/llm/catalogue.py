"""The subpackage's registered queries and the SQL that some of them can be checked with."""

from __future__ import annotations

import corpus_pipeline
from lodeweave.llm.bpe import op9_bpe
from lodeweave.llm.decontaminate import op6_decontaminate
from lodeweave.llm.exact_dedup import OP8_SQL, op8_exact_dedup
from lodeweave.llm.html_extract import op10_html
from lodeweave.llm.langid import op7_langid
from lodeweave.llm.ngram_join import op1_ngram_join
from lodeweave.llm.secret_scan import op3_secrets
from lodeweave.llm.sharding import op5_sharding
from lodeweave.llm.suffix_dedup import op2_suffix_dedup
from lodeweave.llm.warc import OP4_SQL, op4_warc


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    return {
        "op1_ngram_join": op1_ngram_join,
        "op2_suffix_dedup": op2_suffix_dedup,
        "op3_secrets": op3_secrets,
        "op4_warc": op4_warc,
        "op5_sharding": op5_sharding,
        "op6_decontaminate": op6_decontaminate,
        "op7_langid": op7_langid,
        "op8_exact_dedup": op8_exact_dedup,
        "op9_bpe": op9_bpe,
        "op10_html": op10_html,
        "pipeline": corpus_pipeline.run,
    }


def oracle_sql() -> dict:
    """DuckDB SQL by query name; queries that SQL can't express have none and are tested against brute force."""
    return {"op4_warc": OP4_SQL, "op8_exact_dedup": OP8_SQL}
