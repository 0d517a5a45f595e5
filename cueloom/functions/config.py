"""Thresholds of all operators, in seconds unless named otherwise. Fixed values; every operator takes its own as keywords."""

from dataclasses import dataclass

#: Words that no segment should start or end on, for Russian speech.
HANGING = ("и", "а", "но", "что", "это", "как", "в", "на", "потому", "чтобы", "если", "когда", "то", "есть", "вот")


@dataclass(frozen=True)
class Config:
    min_score: int = 65
    min_meaningful: float = 18.0
    min_duration: float = 15.0
    max_duration: float = 59.0
    overlap: float = 0.5
    sentence_pause: float = 0.35
    paragraph_pause: float = 1.75
    tail: float = 0.3
    tail_pad: float = 0.7
    lead_pad: float = 0.3
    window: float = 1.5
    phrase_pause: float = 1.5
    micro_pause: float = 0.4
    longer_ratio: float = 0.7
    longer_steps: int = 2
    sentence_buffer: float = 30.0
    chunk_tokens: int = 4000
    overlap_tokens: int = 300
    split_every: float = 600.0
    split_window: float = 30.0
    long_minutes: float = 15.0
    long_bytes: int = 20_971_520
    hanging: tuple[str, ...] = HANGING

    @property
    def sentence_limit(self) -> float:
        return self.max_duration + self.sentence_buffer


@dataclass(frozen=True)
class CaptionStyle:
    words: int = 3
    pause: float = 0.4
    font_size: int = 72
    char_ratio: float = 0.55
    width: float = 1000.0
    upper: bool = True
    fade_in: int = 150
    fade_out: int = 100
    fade_share: float = 0.4


DEFAULT, CAPTIONS = Config(), CaptionStyle()
