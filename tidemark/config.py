"""Typed parameters. Every operator takes these as keyword defaults; callers override per run."""

from __future__ import annotations

from dataclasses import dataclass, field

PHASES = ("waiting_or_music", "talking", "gameplay", "unknown")

# Layout state -> phase.
LAYOUT_TO_PHASE = {
    "no_face": "waiting_or_music",
    "fullscreen_face": "talking",
    "small_facecam": "gameplay",
    "unknown": "unknown",
}

# Language hints looked for in the probe text.
GAMEPLAY_WORDS = [
    "jugar", "juego", "partida", "nivel", "misión", "mision", "boss", "enemigo", "mapa",
    "inventario", "empezamos", "vamos a jugar", "abrimos el juego",
]
TALKING_WORDS = ["chat", "contar", "historia", "anécdota", "anecdota", "opinión", "opinion"]
TALKING_CHAPTER_WORDS = ["chat", "charla", "talk", "just chatting"]
GAMEPLAY_CHAPTER_WORDS = ["game", "juego", "jugando", "partida", "gaming"]


@dataclass(frozen=True)
class SilenceConfig:
    minimum: float = 1.2
    remove_after: float = 2.5
    padding: float = 0.2
    threshold_db: float = -35.0


@dataclass(frozen=True)
class LayoutConfig:
    sample_seconds: float = 2.0
    confirmation: int = 3


@dataclass(frozen=True)
class TranscriptConfig:
    chunk_seconds: int = 1800
    overlap_seconds: int = 15
    duplicate_jaccard: float = 0.72
    duplicate_window: int = 8
    window_target: float = 60.0
    window_min: float = 30.0


@dataclass(frozen=True)
class TopicConfig:
    min_seconds: float = 300.0
    max_seconds: float = 1500.0
    low_similarity: float = 0.38
    low_lexical: float = 0.12


@dataclass(frozen=True)
class CandidateConfig:
    target_min: float = 480.0
    target_max: float = 900.0
    max_seconds: float = 1200.0
    margin: float = 5.0
    max_candidates: int = 10
    min_score: float = 55.0
    min_coherence: float = 0.38
    speaker: str = "Speaker"


@dataclass(frozen=True)
class BoxConfig:
    accept: float = 0.55
    profile_accept: float = 0.40
    layout_confidence: float = 0.60
    fullscreen_area: float = 0.025
    position_tolerance: float = 0.04
    size_tolerance: float = 0.20
    merge_iou: float = 0.70
    merge_center: float = 0.05
    expand_left: float = 0.80
    expand_right: float = 0.80
    expand_top: float = 0.55
    expand_bottom: float = 1.60
    facecam_height: float = 0.38
    output_width: int = 1080
    output_height: int = 1920
    scene_change: float = 0.08
    scene_min: float = 1.5
    segment_min: float = 1.5


@dataclass(frozen=True)
class PhaseConfig:
    language: str = "es"
    sustained_talking: float = 240.0
    minimum_block: float = 600.0
    talking_voice: float = 0.35
    talking_continuity: float = 0.40
    talking_quality: float = 0.45
    talking_words: float = 0.45
    gameplay_motion: float = 0.18
    gameplay_scene: float = 0.16
    waiting_voice: float = 0.20
    min_confidence: float = 0.43
    min_margin: float = 0.07
    radius: int = 2
    waiting_min_segment: float = 90.0
    gameplay_min_segment: float = 120.0
    microsegment_max: float = 60.0
    max_blocks: int = 6
    max_total: float = 14400.0
    # Classifier weights.
    weights: dict = field(default_factory=lambda: {
        "talking_voice": 0.24, "talking_continuity": 0.18, "talking_transcript": 0.18,
        "talking_words": 0.12, "talking_spanish": 0.06, "talking_face": 0.10,
        "talking_low_motion": 0.12, "talking_repetition_penalty": 0.18,
        "waiting_low_voice": 0.28, "waiting_silence": 0.20, "waiting_repetition": 0.12,
        "waiting_music": 0.18, "waiting_no_face": 0.10, "waiting_stable_visual": 0.12,
        "gameplay_motion": 0.26, "gameplay_scene": 0.20, "gameplay_overlay": 0.22,
        "gameplay_dynamics": 0.14, "gameplay_fragmented_speech": 0.18,
    })
    # Cost of moving between phases.
    penalties: dict = field(default_factory=lambda: {
        "same": 0.0, "unknown": 0.05, "common": 0.10,
        "waiting_gameplay": 0.20, "gameplay_waiting": 0.24,
    })


SILENCE = SilenceConfig()
LAYOUT = LayoutConfig()
TRANSCRIPT = TranscriptConfig()
TOPIC = TopicConfig()
CANDIDATE = CandidateConfig()
BOX = BoxConfig()
PHASE = PhaseConfig()
