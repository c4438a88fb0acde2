"""The engine's commands by name, as functions over DataFrames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from .functions import charsets as cs
from .operators import canary, capacity, clean, codec, conceal, fidelity, file_commands, forensic, heavy, licenses, provenance, regions, sealing, wordmark
from .sources import credentials, files, images

COMMANDS: dict[str, Callable[..., DataFrame]] = {
    "analyze": forensic.reported,
    "measure_text": forensic.measured,
    "entropy": forensic.entropy,
    "sanitize": clean.sanitized,
    "normalize_text": clean.normalized,
    "capacity_report": capacity.capacities,
    "recommend_settings": capacity.recommended,
    "mark_batch": canary.batch,
    "trace_origin": canary.traced,
    "verify_claims": provenance.verified,
    "policy_requirements": provenance.requirements,
    "strongest_claim": provenance.strongest,
    "wordmark_sweep": wordmark.scores,
    "wordmark_scrub": wordmark.scrub_report,
    "fidelity_align": fidelity.aligned,
    "fidelity_marks": fidelity.marks,
    "roundtrip_check": codec.round_trips,
    "protected_regions": codec.regions,
    "file_extract": files.extracted,
    "conceal": conceal.conceal,
    "reveal": conceal.reveal,
    "inspect": conceal.shapes,
    "fidelity_assess": fidelity.assessed,
    "fidelity_baseline": fidelity.baseline,
    "fidelity_distribution": fidelity.distribution,
    "fidelity_density": fidelity.density,
    "fidelity_word_selection": fidelity.word_selection,
    "fidelity_bidi_balance": fidelity.bidi_balance,
    "fidelity_audit": fidelity.audit,
    "seal": conceal.sealed,
    "recovery_sweep": conceal.sweep,
    "compare_code_points": forensic.compared,
    "content_credentials": credentials.inspected,
    "image_metadata": images.tables,
    "fidelity_reflow": fidelity.reflowed,
    "open_regions": regions.opened,
    "checksums": codec.checksums,
    "excerpts": codec.excerpts,
    "recoverable_frames": heavy.round_trips,
    "sign_documents": sealing.signatures,
    "sign_claims": sealing.claims,
    "license_sign_verify": licenses.licensed,
    "claim_bindings": licenses.bound,
    "clean_file": file_commands.clean,
    "pristine_file": file_commands.pristine,
    "strip_file": file_commands.strip,
    "inspect_file": file_commands.inspect,
    "analyze_file": file_commands.analyze,
    "conceal_file": file_commands.conceal,
    "convert_file": file_commands.convert,
}

#: Carriers in canonical order; only the last rewrites visible text.
CANONICAL = ("zero_width", "whitespace_var", "bidi", "homoglyph")


def run(command: str, *args, **options) -> DataFrame:
    if command not in COMMANDS:
        raise KeyError(f"unknown command: {command}")
    return COMMANDS[command](*args, **options)


def chain_validate(carriers: list[str]) -> list[str]:
    """Carriers in canonical order without repeats. Unknown and empty selections are refused, as are alphabets that meet."""
    unknown = [c for c in carriers if c not in CANONICAL]
    if unknown or not carriers:
        raise ValueError(f"unknown_carrier:{unknown[0]}" if unknown else "no_carrier")
    chosen = [c for c in CANONICAL if c in carriers]
    alphabets = [set("".join(cs.CARRIERS[c][:3])) if c in cs.CARRIERS else set(cs.LATIN_LOOKALIKES + cs.CYRILLIC_LOOKALIKES) for c in chosen]
    for k, a in enumerate(alphabets):
        for b in alphabets[k + 1 :]:
            if a & b:
                raise ValueError("alphabets_meet")
    return chosen


#: SQL expressions of the text measures over a column t, for spark.sql: SELECT ink_invisible(text) FROM documents.
SQL_FUNCTIONS = {
    "ink_invisible": ("BIGINT", "length(t) - length(translate(t, '{forensic}', ''))"),
    "ink_bidi": ("BIGINT", "length(t) - length(translate(t, '{bidi}', ''))"),
    "ink_pristine": ("STRING", "translate(t, '{forensic}', '')"),
}


def register(spark) -> None:
    """The text measures as temporary SQL functions: expressions that Catalyst sees through, not UDFs."""
    for name, (kind, body) in SQL_FUNCTIONS.items():
        text = body.format(forensic=cs.FORENSIC, bidi=cs.BIDI)
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(t STRING) RETURNS {kind} RETURN {text}")
