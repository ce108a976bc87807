from opsledger.functions.timeparts import (  # noqa: F401
    at_clock, boundary_diff, boundary_duration_text, date_lit, day_abbrev, duration_text,
    elapsed_duration_text, epoch_micros, hms_text, is_business_day, iso_dow, iso_with_offset,
    ntz_lit, offset_text, ordinal_text, seconds_of_day, utc_to_local,
)
