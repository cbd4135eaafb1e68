"""Order-free comparison of two pandas frames (column names sorted, floats
rounded to 6 places, NULL/NaN/NA one value, ints and integral floats equal)."""

import math

import pandas as pd


def _cell(v):
    if v is None or v is pd.NA or (isinstance(v, float) and math.isnan(v)):
        return "None"
    if hasattr(v, "item") and not isinstance(v, (list, tuple, dict, str)):
        try:
            return _cell(v.item())
        except (ValueError, AttributeError):
            pass
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        v = round(v, 6)
        return str(int(v)) if v.is_integer() else repr(v)
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist"):
        seq = v.tolist() if hasattr(v, "tolist") else v
        return "[" + ",".join(_cell(x) for x in seq) + "]"
    return str(v)


def normalize(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)].copy()
    for c in df.columns:
        df[c] = [_cell(v) for v in df[c].tolist()]
    return df.sort_values(list(df.columns)).reset_index(drop=True)


def same_rows(a: pd.DataFrame, b: pd.DataFrame) -> tuple[bool, str]:
    if sorted(a.columns) != sorted(b.columns):
        return False, f"columns differ: {sorted(a.columns)} vs {sorted(b.columns)}"
    if len(a) != len(b):
        return False, f"row counts differ: {len(a)} vs {len(b)}"
    na, nb = normalize(a), normalize(b)
    diff = (na.values != nb.values).any(axis=1)
    if diff.any():
        return False, "first differing rows:\n" + na[diff].head(3).to_string() + "\n" + nb[diff].head(3).to_string()
    return True, ""
