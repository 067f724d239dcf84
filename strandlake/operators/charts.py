"""Charts as SVG text, from plot-ready frames of a few rows a cycle."""

from __future__ import annotations

from html import escape

COLOURS = {"A": "#3a7d44", "C": "#3566a8", "G": "#c77f1a", "T": "#b23a48", "N": "#777777"}


def _page(title: str, marks: list[str], width: int, height: int) -> str:
    head = f'<svg xmlns="http://www.w3.org/2000/svg" width="{width}" height="{height}" font-family="sans-serif" font-size="10">'
    return "\n".join([head, f'<text x="{width / 2:g}" y="14" text-anchor="middle">{escape(title)}</text>', *marks, "</svg>"])


def box_plot(rows, title: str = "Quality") -> str:
    """Rows of (cycle, q1, lw, rw, q3, med); scores -15 to 45."""
    y = lambda q: 220 - (q + 15) * 190 / 60
    marks = []
    for r in sorted(rows, key=lambda r: r["cycle"]):
        x = 30 + 12 * r["cycle"]
        marks += [
            f'<line x1="{x}" x2="{x}" y1="{y(r["lw"]):g}" y2="{y(r["rw"]):g}" stroke="black"/>',
            f'<rect x="{x - 4}" width="8" y="{y(r["q3"]):g}" height="{max(y(r["q1"]) - y(r["q3"]), 0.5):g}" fill="#f4d35e" stroke="black"/>',
            f'<line x1="{x - 4}" x2="{x + 4}" y1="{y(r["med"]):g}" y2="{y(r["med"]):g}" stroke="#b23a48"/>',
        ]
    return _page(title, marks, 60 + 12 * max((r["cycle"] for r in rows), default=1), 240)


def composition(rows, title: str = "Nucleotide distribution", lines: bool = False) -> str:
    """Rows of (cycle, nuc, pct), as stacked bars, or as a line with points for each nucleotide."""
    table: dict[int, dict[str, float]] = {}
    for r in rows:
        table.setdefault(r["cycle"], {})[r["nuc"]] = r["pct"]
    marks = []
    if lines:
        for nuc, colour in COLOURS.items():
            points = [(30 + 12 * cycle, 220 - shares.get(nuc, 0) * 1.9) for cycle, shares in sorted(table.items())]
            marks.append(f'<polyline points="{" ".join(f"{x},{y:g}" for x, y in points)}" fill="none" stroke="{colour}"><title>{nuc}</title></polyline>')
            marks += [f'<circle cx="{x}" cy="{y:g}" r="2" fill="{colour}"/>' for x, y in points]
    for cycle, shares in sorted(table.items()) if not lines else ():
        floor = 220.0
        for nuc, colour in COLOURS.items():
            high = shares.get(nuc, 0) * 1.9
            floor -= high
            marks.append(f'<rect x="{25 + 12 * cycle}" width="10" y="{floor:g}" height="{high:g}" fill="{colour}"/>')
    return _page(title, marks, 60 + 12 * max(table, default=1), 240)


def length_bars(rows, title: str = "Lengths after clipping") -> str:
    """Rows of (len, n)."""
    most = max((r["n"] for r in rows), default=1) or 1
    marks = [f'<rect x="{30 + 12 * r["len"]}" width="10" y="{220 - 190 * r["n"] / most:g}" height="{190 * r["n"] / most:g}" fill="#3566a8"/>' for r in sorted(rows, key=lambda r: r["len"])]
    return _page(title, marks, 60 + 12 * max((r["len"] for r in rows), default=1), 240)
