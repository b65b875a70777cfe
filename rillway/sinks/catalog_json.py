"""A catalog tree as nested JSON, an indented listing, and a page that shows it."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame


def nested(tree: DataFrame) -> dict:
    """The tree of ``catalog.nodes`` as nested dicts; a catalog is small enough for one document."""
    rows = [r.asDict(recursive=True) for r in tree.toLocalIterator()]
    kids: dict = {}
    for r in rows:
        kids.setdefault(r["parent_id"], []).append(r)
    made: dict = {}
    for r in sorted(rows, key=lambda r: -r["depth"]):
        made[r["river_id"]] = {k: v for k, v in r.items() if k not in ("parent_id", "role", "ordinal", "river_id")} | {"id": r["river_id"], "mainline": None, "tributaries": []}
    for parent, rs in kids.items():
        for r in sorted(rs, key=lambda r: r["ordinal"]):
            if parent is None:
                continue
            if r["role"] == "mainline":
                made[parent]["mainline"] = made[r["river_id"]]
            else:
                made[parent]["tributaries"].append(made[r["river_id"]])
    root = next(r for r in rows if r["role"] == "root")
    return {"meta": {"root_id": root["river_id"], "root_name": root["name"], "n_nodes": len(rows)}, "tree": made[root["river_id"]]}


def geo(block: DataFrame) -> dict:
    """The geo block of ``courses.geo_block`` as the catalog's: its box, and each river's lines, mouth, catchment and camera."""
    xy = lambda points: [[p["lon"], p["lat"]] for p in points]
    rivers, box = {}, None
    for r in block.toLocalIterator():
        row = r.asDict(recursive=True)
        one = {"line": [xy(part) for part in row["lines"]], "outlet": xy([row["outlet"]])[0], "catchment": None if row["catchment"] is None else [xy(ring) for ring in row["catchment"]]}
        if row.get("camera"):
            one["camera"] = json.loads(row["camera"]) if isinstance(row["camera"], str) else row["camera"]
        rivers[row["river_id"]] = one
        sides = [row[k] for k in ("west", "south", "east", "north")]
        box = sides if box is None else [min(box[0], sides[0]), min(box[1], sides[1]), max(box[2], sides[2]), max(box[3], sides[3])]
    return {"bbox": box, "rivers": dict(sorted(rivers.items()))}


def dump(obj: object, path: str) -> None:
    Path(path).write_text(json.dumps(obj, indent=2, ensure_ascii=False) + "\n", encoding="utf-8")


def listing(node: dict, most: int | None = None, level: int = 0) -> list[str]:
    """One line a river, indented by depth; beyond ``most`` levels the number of branches."""
    below = ([node["mainline"]] if node["mainline"] else []) + node["tributaries"]
    lines = [f"{'  ' * level}{node['name'] or node['id']} ({node['length_km']} km)"]
    if most is not None and level >= most:
        return lines + ([f"{'  ' * (level + 1)}... {len(below)} branches"] if below else [])
    return lines + [x for k in below for x in listing(k, most, level + 1)]


def printed(tree: DataFrame, most: int | None = None) -> list[str]:
    """A trace (``trace.ordered_children``) as lines with branches drawn; beyond ``most`` levels how many branches and segments follow."""
    kids: dict = {}
    for row in tree.toLocalIterator():
        kids.setdefault(row["parent"], []).append(row.asDict())
    for below in kids.values():
        below.sort(key=lambda r: r["ordinal"])

    def label(r: dict) -> str:
        facts = [f"order {r['ord']}"] if r.get("ord") is not None else []
        facts.append(f"{((r['length_m'] or 0) + (r.get('folded_m') or 0)) / 1000:.1f} km")
        facts += [f"{r['n_folded'] + 1} seg"] if r.get("n_folded") else []
        return f"{r.get('name') or '(unnamed)'}  ({', '.join(facts + (['fictif'] if r.get('fictif') else []))})"

    out, todo = ["● (pour point)"], [(None, "", 0, None)]
    while todo:  # a chain may be longer than calls nest
        name, prefix, depth, shown = todo.pop()
        if shown is not None:
            out.append(shown)
        below = kids.get(name, [])
        if most is not None and depth >= most and below:
            out.append(f"{prefix}… {len(below)} branch(es), {sum(r['n_upstream'] for r in below)} seg")
            continue
        for k, r in reversed(list(enumerate(below))):
            last = k == len(below) - 1
            todo.append((r["cleabs"], prefix + ("    " if last else "│   "), depth + 1, f"{prefix}{'└── ' if last else '├── '}{label(r)}"))
    return out


def page(title: str, data: str = "catalog.json") -> str:
    """A page that fetches the catalog and lists it."""
    return f"<!doctype html><meta charset=utf-8><title>{html.escape(title)}</title><h1>{html.escape(title)}</h1><ul id=t></ul><script>fetch({json.dumps(data)}).then(r=>r.json()).then(d=>{{const w=(n,u)=>{{const l=document.createElement('li');l.textContent=n.name||n.id;u.append(l);const k=document.createElement('ul');l.append(k);[n.mainline,...n.tributaries].filter(Boolean).forEach(c=>w(c,k))}};w(d.tree,document.getElementById('t'))}})</script>"
