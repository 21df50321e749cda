"""What tests share."""

SMALL = "/root/testdata/sf0.001"


def rows_of(frame) -> list[str]:
    """Rows of a pandas frame by sorted column names, without regard to order and number types."""
    import pandas as pd

    def plain(x):
        if x is None or x is pd.NA or x != x:
            return None
        return int(x) if isinstance(x, float) and x == int(x) and abs(x) < 1e15 else x

    cols = sorted(frame.columns)
    return sorted(repr(r) for r in zip(*[[plain(x) for x in frame[c].tolist()] for c in cols], strict=True))
