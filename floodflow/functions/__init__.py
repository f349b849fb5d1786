from floodflow.functions.columns import (  # noqa: F401
    cell_of, change_ratio, map_style, sampling_weight, sq_distance, tolerant_long,
    with_cell,
)
