from floodflow.sources.files import (  # noqa: F401
    read_elevation, read_nodes, read_orc, read_parquet, run_key, write_orc,
)
