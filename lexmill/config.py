"""Settings of the segmenter."""

from __future__ import annotations

from dataclasses import dataclass

from lexmill.functions.classes import CharClasses, default_classes


@dataclass(frozen=True)
class SegmentConfig:
    """How text is cut into tokens.

    merge: letters and digits next to each other form one token. separate: digits stand alone; it wins over merge.
    joint: characters that hold a token together. omni: the least score frequency of a sub-word that is reported.
    lookahead_inclusive: whether words that start at a run's last character take part in the lookahead.
    compat: frequencies wrap at 16 bits. compress_space is accepted and has no effect.
    """

    merge: bool = False
    separate: bool = False
    joint: str = ""
    omni: int = 2
    lookahead_inclusive: bool = False
    compat: bool = False
    compress_space: bool = False
    classes: CharClasses = default_classes()
    max_term_bytes: int = 36
