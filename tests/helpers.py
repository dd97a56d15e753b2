def plain(v):
    """A value that is alike from both engines."""
    return round(v, 6) if isinstance(v, float) else v


def rows_of(df):
    names = sorted(df.columns)
    return names, sorted(repr([plain(r[n]) for n in names]) for r in df.collect())


def duck_rows(duck, sql):
    r = duck.execute(sql)
    names = [d[0] for d in r.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted(repr([plain(x[i]) for i in order]) for x in r.fetchall())
