"""DataFrame operators that Spark SQL has no single form for."""

from lumenframe.operators.distinct import count_rows_with_all, keep_first
from lumenframe.operators.joins import anti_join_null_aware, null_safe_join, range_join, salted_join, spread_join
from lumenframe.operators.sorting import order_by, top_k_per_group
from lumenframe.operators.unions import widened_union
from lumenframe.operators.windows import bounded_rows, numbered, running

__all__ = ["anti_join_null_aware", "bounded_rows", "count_rows_with_all", "keep_first", "null_safe_join", "numbered", "order_by", "range_join", "running", "salted_join", "spread_join", "top_k_per_group", "widened_union"]
