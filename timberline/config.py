"""Settings of the log engine."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class LogConfig:
    """How a log is framed, parsed, mined and encoded.

    boundary: a full-match pattern of a record's first token; None means that each line is a record. With search, it may be
    found anywhere in that token.
    The limits route records to the failure stream; they never drop them.
    """

    head_slots: int = 4
    boundary: str | None = None
    search: bool = False
    block_lines: int = 100_000
    max_chars: int = 300_000
    max_tokens: int = 2_046
    max_vars: int = 128
    max_templates: int = 100_000
    similarity: float = 0.1
    depth: int = 6
    max_children: int = 100
    sample_rate: float = 0.001
    sample_block: int = 20
    sample_least: int = 50
    sample_most: int = 50_000
    head_sample: int = 5_000
    head_share: float = 0.95
    fixed_columns_share: float = 0.8
    max_ids: int = 3
    max_numeric: int = 32
    rule_rows: int = 600
    level: str = "0"
    delta: bool = True
    codec: str = "Z"

    def __post_init__(self):
        if self.level not in ("0", "N") or self.codec not in ("Z", "NE", "P"):
            raise ValueError("level is 0 or N, codec is Z, NE or P")
        if self.block_lines < 1 or self.head_slots < 0:
            raise ValueError("block_lines must be positive and head_slots not negative")


#: Header layouts by log kind: (slots, boundary of multi-line records or None). Fixed values.
DATED = r"\[\d{4}-\d{2}-\d{2}.*"
PRESETS: dict[str, tuple[int, str | None]] = {
    "Android": (5, None),
    "Apache": (6, r"\[\w{3}.*"),
    "Bgl": (9, None),
    "Hadoop": (3, r"\d{4}-\d{2}-\d{2}.*"),
    "Hdfs": (4, None),
    "Healthapp": (3, None),
    "Hpc": (2, None),
    "Linux": (3, None),
    "Mac": (3, None),
    "Openstack": (5, None),
    "Proxifier": (2, None),
    "Spark": (3, r"\d{2}/\d{2}/\d{2}.*"),
    "Ssh": (5, None),
    "Thunderbird": (8, None),
    "Windows": (4, None),
    "Zookeeper": (4, None),
    # families without public names, by the columns before the content
    **dict.fromkeys(("LogA", "LogB", "LogG", "LogH", "LogJ", "LogM", "LogN", "LogP", "LogR"), (4, DATED)),
    **dict.fromkeys(("LogC", "LogD", "LogE", "LogF", "LogO"), (3, DATED)),
    **dict.fromkeys(("LogI", "LogK"), (2, DATED)),
    "LogL": (1, None),
    "LogQ": (4, None),
}


def preset(kind: str, **changes) -> LogConfig:
    slots, boundary = PRESETS[kind]
    return LogConfig(**{"head_slots": slots, "boundary": boundary, **changes})
