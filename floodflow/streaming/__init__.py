from floodflow.streaming.windowed import encode_updates, windowed_updates  # noqa: F401
