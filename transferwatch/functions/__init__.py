from transferwatch.functions.scalars import (  # noqa: F401
    as_flag,
    calendar_parts,
    composite_key,
    exact_key,
    epoch_seconds,
    objective,
    or_zero,
    parse_timestamp,
    ratio,
    share,
    to_number,
)
