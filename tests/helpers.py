"""What tests share."""

SF = "/root/testdata/sf0.001"


def rows_of(df):
    """Rows as sorted strings, columns by name."""
    cols = sorted(df.columns)
    return sorted(str(tuple(r[c] for c in cols)) for r in df.select(*cols).collect())


def duck_rows(duck, sql):
    rel = duck.sql(sql)
    at = [rel.columns.index(c) for c in sorted(rel.columns)]
    return sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())
