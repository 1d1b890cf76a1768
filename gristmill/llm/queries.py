"""The queries of this folder: one for each operator, and the SQL of those that SQL can express."""

from __future__ import annotations

import importlib

#: query -> module, and whether the module has ORACLE.
_WHERE = {
    "op1_suffix_tree": ("suffix_tree", False),
    "op2_range_coder": ("range_coder", False),
    "op3_host_rules": ("host_quality", True),
    "op4_line_dedup": ("line_dedup", True),
    "op5_range_shards": ("range_shards", False),
    "op6_poisson_mix": ("poisson_mix", True),
    "op7_disclosure": ("disclosure", False),
    "op8_pivot_search": ("pivot_search", True),
    "op9_superminhash": ("superminhash", True),
    "op10_byte_bpe": ("byte_bpe", False),
    "op11_language_mix": ("language_mix", False),
    "op12_whitening": ("whitening", False),
    "op13_hard_negatives": ("hard_negatives", True),
}


def _call(name: str, module: str):
    def run(spark, sf_dir):
        return getattr(importlib.import_module(f"{__package__}.{module}"), name)(spark, sf_dir)

    return run


def _pipeline(spark, sf_dir):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict:
    return {name: _call(name, module) for name, (module, _) in _WHERE.items()} | {"pipeline": _pipeline}


def oracle_sql() -> dict[str, str]:
    return {name: importlib.import_module(f"{__package__}.{module}").ORACLE for name, (module, has) in _WHERE.items() if has}
