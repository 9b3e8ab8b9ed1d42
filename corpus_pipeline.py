"""The corpus pipeline: its stages, in order, and what runs them. They live in ``panelweave.llm.stages``, so that the package alone can run them."""

from panelweave.llm.stages import ORACLE_SQL, STAGES, near_dedup, pack_sequences, personal_data, quality_rules, run, toxicity_filter

__all__ = ["ORACLE_SQL", "STAGES", "near_dedup", "pack_sequences", "personal_data", "quality_rules", "run", "toxicity_filter"]
