"""Numpy volumes to rows and back."""

import numpy as np


def rows_of(array, volume=0, name="label", background=0):
    """Sparse rows of one numpy volume."""
    at = np.argwhere(array != background)
    return [(volume, int(z), int(y), int(x), array[z, y, x].item()) for z, y, x in at]


def dense(df, shape, name="label", volume=0, dtype=np.int64):
    out = np.zeros(shape, dtype=dtype)
    for r in df.where(f"volume_id = {volume}").collect():
        out[r.z, r.y, r.x] = r[name]
    return out
