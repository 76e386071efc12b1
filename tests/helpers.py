import math


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, float):
        return round(v, 6)
    return int(v) if hasattr(v, "as_integer_ratio") and not isinstance(v, (int, bool)) else v


def rows_of(df, columns=None):
    columns = columns or sorted(df.columns)
    return sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)


def rows_of_sql(connection, sql, columns):
    got = connection.execute(sql)
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(columns)
    return sorted((tuple(plain(r[names.index(c)]) for c in columns) for r in got.fetchall()), key=repr)
