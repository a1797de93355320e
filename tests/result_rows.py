"""Results as sorted tuples."""


def collected(df, *cols):
    return sorted((tuple(r[c] for c in cols) if cols else tuple(r) for r in df.collect()), key=repr)
