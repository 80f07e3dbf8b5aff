from qoeflow.functions.columns import (  # noqa: F401
    epoch_seconds, tick_of, hash_u32, draw_index, is_empty, strip_chars,
    round4, TRIM_CHARS, scaled_units, exact_mean4, pick, in_ticks,
)
