from slopefield.functions.numeric import (
    average_log_loss,
    close_to,
    class_from_probability,
    linear_score,
    log_loss_from_score,
    ratio,
    same_final_loss,
    sigmoid,
    six_digits,
)
from slopefield.functions.text_values import (
    boolean_or_null,
    is_missing,
    number_or_null,
    short_text,
)

__all__ = [
    "average_log_loss",
    "boolean_or_null",
    "class_from_probability",
    "close_to",
    "is_missing",
    "linear_score",
    "log_loss_from_score",
    "number_or_null",
    "ratio",
    "same_final_loss",
    "short_text",
    "sigmoid",
    "six_digits",
]
