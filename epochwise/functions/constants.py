"""Fixed values that results depend on."""

# Frequency bands in Hz, each [lo, hi).
BANDS = {
    "delta": (0.5, 4.0),
    "theta": (4.0, 8.0),
    "alpha": (8.0, 13.0),
    "beta": (13.0, 30.0),
    "gamma": (30.0, 45.0),
}

# The ten per-channel features, in order.
CHANNEL_FEATURES = [
    "delta",
    "theta",
    "alpha",
    "beta",
    "gamma",
    "hjorth_activity",
    "hjorth_mobility",
    "hjorth_complexity",
    "line_length",
    "rms",
]
FEATURES = [f"{n}_mean" for n in CHANNEL_FEATURES] + [f"{n}_std" for n in CHANNEL_FEATURES]

# Rate of the raw segments, Welch segment length.
SEGMENT_RATE = 173.61
NPERSEG = 512

# Caps, thresholds and alert levels.
NEGATIVES_PER_POSITIVE = 8
NEGATIVE_FILES = 2
SWEEP_TENTHS = [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]
SWEEP_OPERATING = [0.5, 0.4, 0.3, 0.25, 0.2, 0.15]
SPECIFICITY_TARGETS = [0.90, 0.95, 0.99]
PSI_ALERT = 0.25
SENSITIVITY_ALERT = 0.30
T_FIXED = 2.069
EPS = 1e-12
