"""Translate document corpora and score translations with Spark."""

from .operators.translators import (
    GlossaryTranslator,
    MemoryTranslator,
    ModelTranslator,
    ResumingTranslator,
    build_glossary,
    build_memory,
)
from .operators.distinct import translate_distinct
from .operators.tables import translate_cells, translate_wide
from .plans.benchmark import run_benchmark, system_hypotheses, timed_hypotheses
from .plans.evaluate import Evaluation, choose_pairs, evaluate, file_pairs, proxy_pairs
from .plans.translate import CountedAnalyst, Options, counted_briefs, make_briefs, translate_corpus, translate_paragraphs
from .session import build_session, drop_intermediates

__all__ = [
    "CountedAnalyst",
    "Evaluation",
    "GlossaryTranslator",
    "MemoryTranslator",
    "ModelTranslator",
    "Options",
    "ResumingTranslator",
    "build_glossary",
    "build_memory",
    "build_session",
    "choose_pairs",
    "counted_briefs",
    "drop_intermediates",
    "evaluate",
    "file_pairs",
    "make_briefs",
    "proxy_pairs",
    "run_benchmark",
    "system_hypotheses",
    "timed_hypotheses",
    "translate_cells",
    "translate_corpus",
    "translate_distinct",
    "translate_paragraphs",
    "translate_wide",
]
