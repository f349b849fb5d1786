from floodflow.operators.nearest import has_nearer, nearest_distance, nearest_join  # noqa: F401
from floodflow.operators.relational import (  # noqa: F401
    argmin_rows, cached, fill_nulls, select_distinct, split,
)
