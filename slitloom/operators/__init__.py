"""Array and time-series operators on DataFrames.

An *image* is a DataFrame of pixels `(x, y, v)` plus any key columns; a
*series* is `(x, value)` with null for an unmeasured place.  Operators take
the key columns (`by`) that keep several scans apart, so that no window or
aggregate spans more than one of them.
"""
