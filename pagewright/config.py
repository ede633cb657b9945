"""Options, as plain values that become literals of a plan."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class TriageThresholds:
    min_text_chars: int = 120
    max_image_area_ratio: float = 0.45
    max_math_density: float = 0.015
    max_path_objects: int = 220
    min_avg_word_len: float = 2.0
    max_chars_per_page: int = 12000


@dataclass(frozen=True)
class EndpointOptions:
    base_url: str = "http://localhost:8000/v1"
    model: str = ""
    max_attempts: int = 8
    max_output_tokens: int = 8000
    max_context: int = 16384
    longest_side: int = 1288
    timeout_s: float = 600.0
    page_budget_s: float = 240.0
    ngram_size: int = 64
    min_repeats: int = 3
    min_span_chars: int = 200
    fallback_to_text_layer: bool = True

    def __post_init__(self) -> None:
        if not 1 <= self.max_attempts <= 8:
            raise ValueError("max_attempts is from 1 to 8")


@dataclass(frozen=True)
class PipelineOptions:
    thresholds: TriageThresholds = field(default_factory=TriageThresholds)
    endpoint: EndpointOptions = field(default_factory=EndpointOptions)
    tier2_enabled: bool = True
    force_tier2_all: bool = False
    recover_formatting: bool = True
    detect_headings: bool = True
    emit_layout: bool = False
    max_tier2_workers: int = 8

    def __post_init__(self) -> None:
        if not 1 <= self.max_tier2_workers <= 64:
            raise ValueError("max_tier2_workers is from 1 to 64")


#: The three ways to run a corpus that are compared with each other.
TOPOLOGIES = (("vlm_only", True, True), ("hybrid", True, False), ("tier1_only", False, False))  # name, tier2_enabled, force_tier2_all
TEMPERATURES = (0.1, 0.1, 0.2, 0.3, 0.5, 0.8, 0.9, 1.0)
