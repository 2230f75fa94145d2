from tamis.functions.text import (mask, contains_any, normalize, first_match, is_ascii,
                                  severity_weight, weight_micros)
from tamis.functions.arrays import exclusive_prefix_sum, running_max
from tamis.functions.sqlutil import sql_str, literal_rows

__all__ = ["mask", "contains_any", "normalize", "first_match", "is_ascii", "severity_weight",
           "weight_micros", "exclusive_prefix_sum", "running_max", "sql_str", "literal_rows"]
