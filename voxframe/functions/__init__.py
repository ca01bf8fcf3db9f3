from voxframe.functions.core import (  # noqa: F401
    md5_key,
    md5_uniform,
    group_position,
    global_position,
    range_join,
    rebuild_tokens,
    round_doubles,
    safe_div,
)
