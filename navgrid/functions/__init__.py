from navgrid.functions.columns import (  # noqa: F401
    base100_to_return, format_day, label, normalise_id, overlaps, parse_day_first, positive, rate_factor,
    shorten, status, subclass_or_blank, to_day, to_double, trim_all, utc_day, valid_period, window_is_open,
)
