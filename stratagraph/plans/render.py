"""A matrix and a trend as self-contained HTML pages with inline SVG."""

from __future__ import annotations

from html import escape

from pyspark.sql import DataFrame

_PAGE = "<!doctype html><html><head><meta charset='utf-8'><title>{title}</title><style>body{{font:14px sans-serif;margin:2em}}text{{font-size:10px}}</style></head><body><h1>{title}</h1>{body}</body></html>"


def matrix_page(order: DataFrame, cells: DataFrame, title: str = "Dependency matrix", most: int = 400) -> str:
    """One square a cell, back edges marked; refuses more than most nodes."""
    names = [(r["node"], r["grp"]) for r in order.orderBy("pos").limit(most + 1).collect()]
    if len(names) > most:
        raise ValueError(f"more than {most} nodes")
    size, lead = 10, 160
    out = [f"<text x='{lead - 4}' y='{lead + size * k + 9}' text-anchor='end'>{escape(str(n))}</text>" for k, (n, _) in enumerate(names)]
    for k, (_, g) in enumerate(names):
        if k and g != names[k - 1][1]:
            at = lead + size * k
            out.append(f"<path d='M{lead} {at}H{lead + size * len(names)}M{at} {lead}V{lead + size * len(names)}' stroke='#bbb'/>")
    for r in cells.orderBy("row", "col").collect():  # at most most ** 2
        label = f"{names[r['row']][0]} to {names[r['col']][0]}: {r['weight']:g}"
        out.append(f"<rect x='{lead + size * r['col']}' y='{lead + size * r['row']}' width='{size - 1}' height='{size - 1}' fill='{'#c33' if r['row'] > r['col'] else '#357'}'><title>{escape(label)}</title></rect>")
    side = lead + size * len(names) + 10
    return _PAGE.format(title=escape(title), body=f"<svg width='{side}' height='{side}'>{''.join(out)}</svg>")


def trend_page(history: DataFrame, title: str = "Score", last: int = 200) -> str:
    """A line of (day, overall), the last rows of it."""
    rows = sorted((str(r["day"]), r["overall"]) for r in history.orderBy(history["day"].desc()).limit(last).collect())
    if not rows:
        return _PAGE.format(title=escape(title), body="<p>No history.</p>")
    low, high = min(v for _, v in rows), max(v for _, v in rows)
    x, y = (lambda k: 40 + 720 * k / max(len(rows) - 1, 1)), (lambda v: 220 - 200 * (v - low) / ((high - low) or 1))
    line = " ".join(f"{x(k):.1f},{y(v):.1f}" for k, (_, v) in enumerate(rows))
    dots = "".join(f"<circle cx='{x(k):.1f}' cy='{y(v):.1f}' r='3'><title>{escape(d)}: {v:.4f}</title></circle>" for k, (d, v) in enumerate(rows))
    ends = f"<text x='2' y='224'>{low:.3f}</text><text x='2' y='24'>{high:.3f}</text><text x='40' y='245'>{escape(rows[0][0])}</text><text x='700' y='245'>{escape(rows[-1][0])}</text>"
    return _PAGE.format(title=escape(title), body=f"<svg width='800' height='250'><polyline points='{line}' fill='none' stroke='#357'/>{dots}{ends}</svg>")
