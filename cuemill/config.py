"""Rule constants shared by the operators.

Everything here is a fixed value of the rule set; `RULES_VERSION` names the set so that
written results can be tied to the rules that produced them.
"""

RULES_VERSION = "2026.1"

# Execution: width of the time slices that long tracks are cut into before an ordered pass.
CHUNK_MS = 600_000

# Completeness (fixed values)
MAX_COVERAGE = 1.5
LATE_START_RATIO = 1.12
MAX_ACTIVE_MS = 12_000
MIN_EVENTS = 100
MIN_EVENTS_PER_MINUTE_SHARE = 0.8
MIN_COVERAGE = 0.65
MIN_BINS = 6
MIN_EVENTS_PER_MINUTE = 0.9
MIN_ACTIVE_RATIO = 0.04

# Offsets (fixed values)
MAX_AUTOMATIC_OFFSET_MS = 10_000
FIT_INLIER_MS = 1_500
FIT_MIN_PAIRS = 20
FIT_MIN_SPAN = 0.55
FIT_MIN_QUARTERS = 3
FIT_MEDIAN_MS = 350
FIT_P90_MS = 800
TIMELINE_SCALES = (
    ("1", 1.0),
    ("24/23.976", 24.0 / 23.976),
    ("23.976/24", 23.976 / 24.0),
    ("25/24", 25.0 / 24.0),
    ("24/25", 24.0 / 25.0),
    ("25/23.976", 25.0 / 23.976),
    ("23.976/25", 23.976 / 25.0),
)
