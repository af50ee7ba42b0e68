"""The registered queries of this subpackage and, where SQL can express them, their DuckDB twins."""

from __future__ import annotations

import importlib

from . import common

#: query name: (module, function of documents or pages, table)
_QUERIES = {
    "op1_substring_dedup": ("substring_dedup", "report", "documents"),
    "op2_language_id": ("langid", "report", "documents"),
    "op3_huffman_ids": ("huffman", "report", "documents"),
    "op4_class_lm": ("classlm", "report", "documents"),
    "op5_quality_divergence": ("quality", "report", "documents"),
    "op6_simhash_near_dedup": ("simhash", "report", "documents"),
    "op7_best_fit_packing": ("packing", "report", "documents"),
    "op8_mix_sources": ("mixing", "report", "documents"),
    "op9_html_crf": ("htmlcrf", "report", "pages"),
    "op10_exact_dedup": ("exact_dedup", "report", "documents"),
}


#: Texts in a batch to Python; packing gains by more, as a batch repeats more of its words.
_ROWS = {"packing": 2400}
#: Their last step gives whole texts to Python: it runs while the batches are small, and its few columns are written.
_LAST_IN_PYTHON = {"langid", "quality", "htmlcrf"}


def _query(module: str, function: str, table: str):
    f = getattr(importlib.import_module(f"{__package__}.{module}"), function)

    def run(spark, sf_dir):
        with common.batches(spark, _ROWS.get(module, 500)):
            out = f(spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            return common.materialize(out) if module in _LAST_IN_PYTHON else out

    return run


def queries() -> dict:
    return {name: _query(*x) for name, x in _QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    from . import mixing

    ws = common.WS
    return {
        "op8_mix_sources": mixing.ORACLE,
        "op10_exact_dedup": rf"""
WITH d AS (SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{ws}', '', 'g')) AS h FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY h) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, h AS text_sha256
FROM d WINDOW w AS (PARTITION BY h ORDER BY n DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""",
    }
