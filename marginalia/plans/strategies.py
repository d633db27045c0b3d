"""Labelling strategies: how a document is cut, by which workflow, with which prompt."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Strategy:
    """A named run configuration."""

    id: str
    name: str
    description: str
    chunker: str = "full_doc"
    chunker_params: dict = field(default_factory=dict)
    workflow: str = "single"
    prompt: str = "baseline"
    model: str = "rules"

    def label(self) -> str:
        return f"{self.id} — {self.name}"


def _presets() -> dict[str, Strategy]:
    rows = [
        Strategy("baseline", "whole document", "One call over the whole document."),
        Strategy("keyword_window_20", "keyword windows", "Windows of 20 sentences either side of a hit.", "keyword_window", {"window_sentences": 20}),
        Strategy("keyword_per_sentence", "keyword sentences", "A call for each sentence with a hit.", "keyword_per_sentence"),
        Strategy("sequential_batched", "four phases", "Candidates, kind, category, strength.", workflow="sequential"),
        Strategy("hai_tuned", "tuned, first rules", "One call, with rules and examples from reviewers.", prompt="tuned"),
        Strategy("hai_tuned_v2", "tuned, second rules", "One call, with the second set of rules.", prompt="tuned_v2"),
        Strategy("sequential_passage_aware", "six phases", "Passages, sweep, context filter, kind, category, strength.", workflow="passage_aware", prompt="tuned_v3"),
        Strategy("xml_cot", "reasoned", "One call that states its reasoning.", prompt="reasoned"),
        Strategy("n_sentence_chunk_20", "blocks of 20", "Blocks of 20 sentences.", "n_sentence", {"n_sentences": 20}),
        Strategy("n_sentence_chunk_40", "blocks of 40", "Blocks of 40 sentences.", "n_sentence", {"n_sentences": 40}),
    ]
    return {s.id: s for s in rows}


STRATEGIES = _presets()


def get_strategy(name: str) -> Strategy:
    """The named preset; KeyError for another name."""
    return STRATEGIES[name]
