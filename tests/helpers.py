"""What several test modules use."""

SF = "/root/testdata/sf0.001"


def rows_of(df):
    """Rows with columns by name, sorted."""
    names = sorted(df.columns)
    return names, sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    r = con.sql(sql)
    order = sorted(range(len(r.columns)), key=lambda i: r.columns[i])
    return [r.columns[i] for i in order], sorted((tuple(x[i] for i in order) for x in r.fetchall()), key=repr)
