"""The queries of this subpackage, each with the SQL that gives the same rows, or None."""

from __future__ import annotations

import importlib

from .common import prepared

# name of the query: module that has the function of that name
_MODULES = {
    "op1_decontaminate": "decontaminate",
    "op5_simhash": "simhash",
    "op6_toxicity": "toxicity",
    "op2_pii": "pii",
    "op7_packing": "packing",
    "op3_records": "records",
    "op8_token_counts": "token_counts",
    "op9_host_rules": "host_rules",
    "op10_html": "html_extract",
    "op4_warc": "warc",
    "op11_alignment": "alignment",
    "op12_byte_bpe": "byte_bpe",
    "op13_collocations": "collocations",
}


def catalog() -> dict[str, tuple]:
    entries = {}
    for name, module in _MODULES.items():
        loaded = importlib.import_module(f".{module}", __package__)
        query = getattr(loaded, name)
        entries[name] = (
            lambda spark, sf_dir, query=query: query(prepared(spark), sf_dir),
            getattr(loaded, f"{name.split('_')[0].upper()}_SQL", None),
        )
    return entries
