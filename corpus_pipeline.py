"""The corpus pipeline at the place where it is looked for; see ``loanscope/llm/pipeline.py``."""

from loanscope.llm.pipeline import ORACLE_SQL, STAGES, run

__all__ = ["ORACLE_SQL", "STAGES", "run"]
