"""Settings of the operators, as frozen groups with the defaults of the domain."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class ChatRates:
    window: float = 5.0
    baseline: float = 60.0
    multiplier: float = 3.0
    min_rate: float = 0.5
    keywords: tuple[str, ...] = ("clip it", "clip that", "clip")
    keyword_score: float = 0.7
    spike_score: float = 0.85
    dedupe_gap: float = 1.0


@dataclass(frozen=True)
class AudioLevels:
    frame: float = 0.5
    baseline: float = 30.0
    multiplier: float = 2.5
    min_rms: float = 0.02
    score: float = 0.75


@dataclass(frozen=True)
class Fusion:
    proximity: float = 5.0
    audio_weight: float = 0.5
    coalesce_gap: float = 20.0


@dataclass(frozen=True)
class Bounds:
    min_seconds: float = 10.0
    max_seconds: float = 45.0
    target_seconds: float = 30.0
    hook_lookback: float = 30.0
    reaction_tail: float = 3.0
    min_context: float = 1.5
    start_tolerance: float = 1.5
    end_tolerance: float = 2.5
    utterance_gap: float = 0.6


@dataclass(frozen=True)
class DeadAir:
    enabled: bool = True
    mode: str = "cut"
    min_gap: float = 0.8
    keep_pad: float = 0.2
    min_keep: float = 0.5
    max_removed_ratio: float = 0.4
    speed_factor: float = 1.5


@dataclass(frozen=True)
class Cues:
    max_chars: int = 18
    max_lines: int = 2
    min_seconds: float = 0.5
    max_seconds: float = 2.2
    pause: float = 0.35


@dataclass(frozen=True)
class Layout:
    strategy: str = "auto"
    canvas_width: int = 1080
    canvas_height: int = 1920
    smoothing: float = 0.12
    deadband: float = 0.02
    max_segments: int = 24
    min_tracked_height: int = 720
    facecam_pad: float = 1.6
    zoom: float = 1.0
    caption_margin: float = 260.0
    caption_lines: int = 2
    avoid_ratio: float = 0.25
    warn_upscale: float = 2.0
    track_backend: str = "motion"


@dataclass(frozen=True)
class Faces:
    min_hits: int = 4
    min_hit_ratio: float = 0.2
    link_distance: float = 0.15
    area_ratio: float = 2.5


@dataclass(frozen=True)
class Metadata:
    max_hashtags: int = 6
    title_max_chars: int = 60


@dataclass(frozen=True)
class Settings:
    chat: ChatRates = field(default_factory=ChatRates)
    audio: AudioLevels = field(default_factory=AudioLevels)
    fusion: Fusion = field(default_factory=Fusion)
    bounds: Bounds = field(default_factory=Bounds)
    deadair: DeadAir = field(default_factory=DeadAir)
    cues: Cues = field(default_factory=Cues)
    layout: Layout = field(default_factory=Layout)
    faces: Faces = field(default_factory=Faces)
    metadata: Metadata = field(default_factory=Metadata)
    pre_context: float = 30.0
    post_context: float = 30.0
