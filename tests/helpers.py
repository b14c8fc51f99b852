"""Runs a query and its SQL side by side."""

import heapq
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def canonical(rows, columns):
    def plain(x):
        if hasattr(x, "item"):
            x = x.item()
        if isinstance(x, float):
            return None if x != x else round(x, 6)
        return x

    return sorted((tuple(plain(r[c]) for c in columns) for r in rows), key=str)


def compare(query, sql, spark, sf_dir):
    """Number of rows, if both give the same."""
    found = query(spark, sf_dir)
    columns = sorted(found.columns)
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{sf_dir}/{t}.parquet"):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    told = con.sql(sql)
    assert sorted(told.columns) == columns
    names = told.columns
    expected = [dict(zip(names, r, strict=True)) for r in told.fetchall()]
    rows = found.collect()
    assert canonical([r.asDict() for r in rows], columns) == canonical(expected, columns)
    return len(rows)


def heap_fill(images, at, fitted, budget, drift):
    """Filling from its rule: every image has one open move, to its nearest sharper rung with another version; a heap gives the cheapest per rung and page. An image whose move does not fit has none from then on.

    images: ref to (own bytes, coverage, {rung: (bytes, version)}). The file may come out ``drift`` larger than its parts; then the aim is lower by as much, once. (rungs, moves, bytes).
    """
    stays = {r: at for r in images}

    def move(ref, rung):
        own, cover, stored = images[ref]
        size, version = stored.get(rung, (own, None))
        sharper = [k for k in stored if k < rung and stored[k][1] != version]
        if sharper:
            extra = stored[max(sharper)][0] - size
            heapq.heappush(open_, (extra / ((rung - max(sharper)) * cover), ref, max(sharper), extra))

    for aim in (budget * 0.985, budget * 0.985 - drift):
        open_, now, total, moves = [], dict(stays), fitted, 0
        for r in images:
            move(r, at)
        while open_:
            _, r, to, extra = heapq.heappop(open_)
            if total + extra <= aim:
                now[r], total, moves = to, total + extra, moves + 1
                move(r, to)
        if not moves:
            return stays, 0, fitted
        if total + drift <= budget:
            return now, moves, total + drift
    return stays, 0, fitted
