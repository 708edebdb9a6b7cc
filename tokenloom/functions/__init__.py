from .arrays import (IGNORE_INDEX, append_col, consecutive_pairs_col, labels_col, mask_col,
                     pad_col, shifted_pairs_col, truncate_col)
from .mathx import (nll_col, perplexity_col, rms_normalize_col, safe_div,
                    schedule_factor_col)
from .text import (NONBLANK_PATTERN, TOKEN_PATTERN, nonblank_col, text_fallback_col,
                   tokens_col)

__all__ = [
    "IGNORE_INDEX", "append_col", "consecutive_pairs_col", "labels_col", "mask_col", "pad_col",
    "shifted_pairs_col", "truncate_col", "nll_col", "perplexity_col", "rms_normalize_col",
    "safe_div", "schedule_factor_col", "NONBLANK_PATTERN", "TOKEN_PATTERN", "nonblank_col",
    "text_fallback_col", "tokens_col",
]
