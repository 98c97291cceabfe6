from strata.functions.columns import (  # noqa: F401
    add_flag, band_rule, between, clip_lower, close_vocab, cyclical, eq_flag, fill_where, geo_prefix, is_in,
    minute_of_day, parse_hm, recode, residual, score100, time_index, to_float, to_int,
)
from strata.functions.geo import (  # noqa: F401
    geohash_decode, geohash_decode_rounded, is_valid_geohash, round_to_cell, with_geohash_coords,
)
