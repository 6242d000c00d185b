"""What several test files share."""

SMALL = "/root/testdata/sf0.001"


def rows(df, *columns):
    return sorted((tuple(r) for r in (df.select(*columns) if columns else df).collect()), key=repr)
