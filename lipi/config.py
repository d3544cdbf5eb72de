"""Job parameters and the fixed values the results depend on."""

from __future__ import annotations

from dataclasses import dataclass

# --- Fixed values (must equal the source pipeline for equal results) -------
# Special tokens, in id order 0..4.
SPECIAL_TOKENS = ("[PAD]", "[UNK]", "[CLS]", "[SEP]", "[MASK]")
UNK_ID = 1
# Default training parameters.
DEFAULT_VOCAB_SIZE = 8000
DEFAULT_MIN_FREQUENCY = 2
# Lines per training chunk and per progress report.
DEFAULT_CHUNK_LINES = 50000
DEFAULT_LOG_INTERVAL = 200000
# Evaluation sample: first N non-empty lines.
DEFAULT_EVAL_LINES = 1000
# Stats sample of the old stats endpoint.
DEFAULT_STATS_LINES = 500
# Page filter: kept when len(cleaned) > 30; corpus filter: len >= 30.
PAGE_MIN_CHARS_EXCLUSIVE = 30
FILTER_MIN_CHARS = 30
# Colour key: hue = h % 360, saturation = 60 + h % 30, lightness = 75 + h % 15.
HUE_MOD, SAT_BASE, SAT_MOD, LIGHT_BASE, LIGHT_MOD = 360, 60, 30, 75, 15
# ---------------------------------------------------------------------------


@dataclass(frozen=True)
class TrainParams:
    vocab_size: int = DEFAULT_VOCAB_SIZE
    min_frequency: int = DEFAULT_MIN_FREQUENCY

    def __post_init__(self):
        # A vocabulary smaller than specials + alphabet is allowed: the
        # specials and the whole alphabet are always kept, no merge is made.
        if self.vocab_size < 0:
            raise ValueError("vocab_size must be >= 0")
        if self.min_frequency < 0:
            raise ValueError("min_frequency must be >= 0")
