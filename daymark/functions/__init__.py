from daymark.functions.columns import (  # noqa: F401
    bucket_label,
    col_of,
    date_list,
    digits,
    first_non_null,
    flag_label,
    group_key,
    key_family,
    list_len,
    money,
    norm_id,
    num,
    read_flag,
    safe_div,
    status_in,
    streak_of,
    to_binary,
    to_day,
)
from daymark.functions.metric import MetricSpec, aggregate_column  # noqa: F401
