"""Order-dependent layout algorithms of one page, and the Spark wrapper that runs them.

A page has a bounded number of items, so an algorithm sees it whole; rows are
sorted by their documented key first, so results don't depend on partitioning or input order. Boxes are (x1, y1, x2, y2)."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions import fixed as X


@dataclass
class Box:
    x1: float
    y1: float
    x2: float
    y2: float

    @property
    def width(self) -> float:
        return self.x2 - self.x1

    @property
    def height(self) -> float:
        return self.y2 - self.y1

    def over_x(self, o: Box) -> float:
        return min(self.x2, o.x2) - max(self.x1, o.x1)

    def over_y(self, o: Box) -> float:
        return min(self.y2, o.y2) - max(self.y1, o.y1)

    def share_x(self, o: Box) -> float:
        """Overlap over the narrower."""
        narrow = min(self.width, o.width)
        return self.over_x(o) / narrow if narrow > 0 else 0.0

    def hull(self, *others: Box) -> Box:
        all_ = (self, *others)
        return Box(min(b.x1 for b in all_), min(b.y1 for b in all_), max(b.x2 for b in all_), max(b.y2 for b in all_))

    def inside(self, o: Box) -> float:
        w, h, area = self.over_x(o), self.over_y(o), self.width * self.height
        return w * h / area if w > 0 and h > 0 and area > 0 else 0.0


@dataclass
class Item:
    id: str
    box: Box
    text: str = ""
    type: str = "paragraph"
    font: float = 10.0
    column: int | None = None
    members: list[str] = field(default_factory=list)
    module: str | None = None
    extra: dict = field(default_factory=dict)


def run(df: DataFrame, algorithm: Callable[[list[dict]], Iterable[dict]], schema: str, order: tuple[str, ...] = ("ord",), keys: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """Apply ``algorithm`` to every page's rows (dicts in ``order``); it returns rows without the keys.

    Pages meet by their keys and stream through in order: a task holds one page and one batch, whatever the size of a document."""
    fields = StructType.fromDDL(schema)
    kind = to_arrow_schema(fields)

    def stream(batches):
        import pyarrow as pa

        now, page, out = None, [], []

        def done():
            if page:
                out.extend(dict(zip(keys, now)) | row for row in algorithm(page))

        for b in batches:
            for row in b.to_pylist():
                key = tuple(row[k] for k in keys)
                if key != now:
                    done()
                    now, page = key, []
                page.append(row)
            if len(out) > 5000:
                yield pa.RecordBatch.from_pylist(out, kind)
                out = []
        done()
        yield pa.RecordBatch.from_pylist(out, kind)

    return df.repartition(*keys).sortWithinPartitions(*keys, *order).mapInArrow(stream, fields)


def item(row: dict) -> Item:
    return Item(str(row.get("id", row.get("ord"))), Box(row["x1"], row["y1"], row["x2"], row["y2"]), row.get("text") or "", row.get("type") or "paragraph", row.get("font") or 10.0, row.get("column"))


# --- rows and columns ----------------------------------------------------------------------------------------------------


def baseline_rows(items: list[Item]) -> list[list[Item]]:
    """W02 (y up): from the top, an item joins the first row whose centre is within 0.6 of a height; the row's box grows."""
    rows: list[tuple[Box, list[Item]]] = []
    for it in sorted(items, key=lambda i: (-i.box.y2, i.box.x1)):
        middle = (it.box.y1 + it.box.y2) / 2
        for k, (box, members) in enumerate(rows):
            if abs((box.y1 + box.y2) / 2 - middle) <= 0.6 * max(box.height, it.box.height):
                members.append(it)
                rows[k] = (box.hull(it.box), members)
                break
        else:
            rows.append((it.box, [it]))
    return [sorted(m, key=lambda i: i.box.x1) for _, m in rows]


def bands(values: list[float], tolerance: float) -> list[float]:
    """First member of each band of sorted centres; a band reaches ``tolerance`` beyond its first member."""
    out: list[float] = []
    for v in sorted(values):
        if not out or v > out[-1] + tolerance:
            out.append(v)
    return out


def _covered(intervals: np.ndarray, n: int) -> np.ndarray:
    """How many of the intervals (first and last grid line) lie over each of n cells."""
    lo, hi = np.clip(np.rint(intervals), 0, n).astype(int).T
    real = hi > lo
    return np.cumsum(np.bincount(lo[real], minlength=n + 1) - np.bincount(hi[real], minlength=n + 1))[:n]


def _stretches(mask: np.ndarray) -> np.ndarray:
    """(first, behind the last) of every run of true cells."""
    return np.flatnonzero(np.diff(np.concatenate([[False], mask, [False]]).astype(np.int8))).reshape(-1, 2)


def coverage_channels(boxes: list[Box], step: float = 2, least: float = 6, intrusion: float = 0.1) -> list[tuple[float, float]]:
    """Inner x-ranges of at least ``least`` points that at most a tenth of the boxes cross."""
    if len(boxes) < 6:
        return []
    x = np.array([(b.x1, b.x2) for b in boxes], float)
    left, right = x[:, 0].min(), x[:, 1].max()
    cover = _covered((x - left) / step, int(np.ceil((right - left) / step)))
    found = left + step * _stretches(cover <= max(1, int(len(boxes) * intrusion)))
    inner = (found[:, 1] - found[:, 0] >= least) & (found[:, 0] > left + 1) & (found[:, 1] < right - 1)
    return [(float(a), float(b)) for a, b in found[inner]]


def gutters(rows: list[list[Box]], width: float, step: float = 2) -> list[float]:
    """A10: middles of x-ranges that 60 % of the wide rows leave empty, in the inner part of the page; six wide rows at least."""
    n = int(np.ceil(width / step))
    cell = np.arange(n)
    votes = []
    for row in rows:
        x = np.array([(b.x1, b.x2) for b in row], float).reshape(-1, 2)
        if len(x) and x[:, 1].max() - x[:, 0].min() >= width * 0.5:
            inside = (cell >= np.ceil(x[:, 0].min() / step)) & (cell <= np.floor(x[:, 1].max() / step))
            votes.append(inside & (_covered(x / step, n) == 0))
    if len(votes) < 6:
        return []
    found = step * _stretches(np.sum(votes, axis=0) >= 0.6 * len(votes)).astype(float)
    inner = (found[:, 1] - found[:, 0] >= 6) & (found[:, 0] > width * 0.12) & (found[:, 1] < width * 0.88)
    return [float(m) for m in found[inner].mean(axis=1)]


def columns(boxes: list[Box], width: float, height: float = 0.0) -> list[tuple[float, float]]:
    """Column bands of a page: chains of narrow boxes, split at coverage channels, left edge at the median, slivers dropped."""
    gutter = max(11.0, width * 0.018)
    valid = [b for b in boxes if b.width > 0]
    edge = height * 0.06
    usable = [b for b in valid if b.width >= width * 0.05 and not (edge and (b.y1 > height - edge or b.y2 < edge))] or valid
    narrow = sorted([b for b in usable if b.width < width * 0.62] or usable, key=lambda b: b.x1)
    chains: list[list[Box]] = []
    reach = float("-inf")
    for b in narrow:
        if not chains or b.x1 > reach + gutter:
            chains.append([])
            reach = b.x2
        chains[-1].append(b)
        reach = max(reach, b.x2)
    out = []
    for chain in chains:
        cuts = coverage_channels(chain)
        parts: list[list[Box]] = [[] for _ in range(len(cuts) + 1)]
        for b in chain:
            parts[sum((b.x1 + b.x2) / 2 > (lo + hi) / 2 for lo, hi in cuts)].append(b)
        if any(len(p) < 3 for p in parts) and cuts:
            cuts, parts = [], [chain]
        for k, p in enumerate(parts):
            left, right = p[0].hull(*p).x1, p[0].hull(*p).x2
            left, right = max(left, cuts[k - 1][1] if k else left), min(right, cuts[k][0] if k < len(cuts) else right)
            left = max(left, sorted(b.x1 for b in p)[len(p) // 2])
            if right - left >= width * 0.12:
                out.append((left, right))
    return out


def assign_columns(boxes: list[Box]) -> list[int]:
    """First band that shares 55 % of the wider of the two; the band widens."""
    found: list[Box] = []
    out = []
    for b in boxes:
        k = next((i for i, o in enumerate(found) if max(b.width, o.width) > 0 and b.over_x(o) / max(b.width, o.width) >= 0.55), None)
        if k is None:
            found.append(b)
            out.append(len(found) - 1)
        else:
            found[k] = replace(found[k], x1=min(found[k].x1, b.x1), x2=max(found[k].x2, b.x2))
            out.append(k)
    return out


def column_runs(lines: list[Box]) -> list[list[Box]]:
    """W09 (y up): a block's lines by column: a new run where a line starts right of the middle of the run, or jumps up by over half a line."""
    out: list[list[Box]] = []
    for b in lines:
        if out:
            hull, last = out[-1][0].hull(*out[-1]), out[-1][-1]
            if b.x1 <= hull.x1 + 0.5 * hull.width and b.y1 - last.y1 <= 0.5 * last.height:
                out[-1].append(b)
                continue
        out.append([b])
    return out


# --- regions ---------------------------------------------------------------------------------------------------------------

MOST_CHARS = X.REGION_CHARS
_END = re.compile(X.REGION_END)
_LABEL = re.compile(r"(figure|fig\.?|table|图|表)\s*\d", re.I)


def blocked(a: Box, b: Box, figures: list[Box]) -> bool:
    """J09 (y up): a figure stands in the gap between two boxes."""
    upper, lower = (a, b) if a.y1 >= b.y1 else (b, a)
    gap = upper.y1 - lower.y2
    return gap >= 2 and any(f.over_x(a) >= 6 and f.over_x(b) >= 6 and min(upper.y1, f.y2) - max(lower.y2, f.y1) >= min(4, gap / 2) for f in figures)


def _same_column(a: Item, b: Item) -> bool:
    return a.column is None or b.column is None or a.column < 0 or b.column < 0 or a.column == b.column


def _like_sized(a: Item, b: Item) -> bool:
    return not (a.font > 0 and b.font > 0) or abs(a.font - b.font) <= 0.16 * max(a.font, b.font)


def separator(a: Item, b: Item) -> str:
    """X11: nothing after a hyphen, a blank line after a finished sentence and a gap, else a space."""
    t = a.text.strip()
    if re.search("[A-Za-z]-$", t):
        return ""
    return "\n\n" if _END.search(t) and a.box.y1 - b.box.y2 > 0.55 * max(a.font, 6) else " "


def fuse(a: Item, b: Item) -> Item:
    sep = separator(a, b)
    left = a.text.strip()
    return replace(a, text=(left.removesuffix("-") if not sep else left + sep) + b.text.strip(), box=a.box.hull(b.box), members=[*(a.members or [a.id]), *(b.members or [b.id])], font=b.font if len(b.text) > len(a.text) else a.font)


def mergeable(a: Item, b: Item, figures: list[Box]) -> bool:
    """W15's test of a region and the next block (y up)."""
    gap, em = a.box.y1 - b.box.y2, max(a.font, 6)
    return a.type == b.type == "paragraph" and _same_column(a, b) and a.box.share_x(b.box) >= 0.55 and -0.6 * em <= gap <= 1.9 * em and _like_sized(a, b) and len(a.text) + len(b.text) <= MOST_CHARS and not blocked(a.box, b.box, figures)


def continues_caption(a: Item, b: Item, figures: list[Box]) -> bool:
    """W16's test of a caption and a block below it (y up)."""
    gap, em = a.box.y1 - b.box.y2, max(a.font, 6)
    fits = a.box.x1 - em <= b.box.x1 and b.box.x2 <= a.box.x2 + em and a.box.share_x(b.box) >= 0.6 and -1.2 * em <= gap <= 1.9 * em
    sound = not _LABEL.match(b.text.strip()) and (not _END.search(a.text.strip()) or re.match(r"[a-z(\[]", b.text.strip()))
    return a.type == "caption" and b.type in ("paragraph", "list") and _same_column(a, b) and fits and bool(sound) and _like_sized(a, b) and len(a.text) + len(b.text) <= MOST_CHARS and not blocked(a.box, b.box, figures)


def is_shard(i: Item) -> bool:
    """F23."""
    t = i.text.strip()
    return i.type == "paragraph" and bool(t) and (len(t) <= 12 or t[0].isascii() and t[0].islower() or bool(re.fullmatch(X.BARE_CITATION, t)))


def absorbs(host: Item, shard: Item, figures: list[Box]) -> bool:
    """W17's test (y up)."""
    gap = max(host.box.y1 - shard.box.y2, shard.box.y1 - host.box.y2)
    narrow = min(host.box.width, shard.box.width)
    return host.type == "paragraph" and _same_column(host, shard) and (narrow <= 0 or host.box.share_x(shard.box) >= 0.4) and gap <= 3 * max(host.font, 6) and len(host.text) + len(shard.text) <= 1.5 * MOST_CHARS and not blocked(host.box, shard.box, figures)


def coalesce(blocks: list[Item], figures: list[Box] | None = None) -> list[Item]:
    """Consecutive blocks grow regions, captions take what continues them, shards go to a neighbour."""
    figures = figures or []
    out: list[Item] = []
    for b in blocks:
        if out and mergeable(out[-1], b, figures):
            out[-1] = fuse(out[-1], b)
        else:
            out.append(b)
    for caption in [b for b in out if b.type == "caption"]:
        at = next(i for i, b in enumerate(out) if b is caption)
        while below := [b for b in out if b is not out[at] and continues_caption(out[at], b, figures)]:
            top = max(below, key=lambda b: b.box.y2)  # the first of equals
            grown = fuse(out[at], top)
            out[at] = grown
            out = [b for b in out if b is not top]
            at = next(i for i, b in enumerate(out) if b is grown)
    for i in range(len(out) - 1, -1, -1):
        if i < len(out) and is_shard(out[i]):
            if i and absorbs(out[i - 1], out[i], figures):
                out[i - 1 : i + 1] = [fuse(out[i - 1], out[i])]
            elif i + 1 < len(out) and absorbs(out[i + 1], out[i], figures):
                out[i : i + 2] = [fuse(out[i], out[i + 1])]
    return out


def join_labels(blocks: list[Item], em: float = 10.0) -> list[Item]:
    """A bare label ("Figure 6:") and the block right after it in its column become one, from the end on."""
    out = list(blocks)
    for i in range(len(out) - 2, -1, -1):
        if re.fullmatch(r"(?i)(figure|fig\.?|table|图|表|圖)\s*\d+[a-z]?\s*[.:：]?", out[i].text.strip()) and _same_column(out[i], out[i + 1]) and abs(out[i].box.y1 - out[i + 1].box.y2) <= 2 * em:
            out[i : i + 2] = [fuse(out[i], out[i + 1])]
    return out


def modules(blocks: list[Item], page: int = 0) -> list[tuple[str, str, list[str]]]:
    """(module id, kind of its anchor, members): headings, captions and tables open modules, references swallow the rest."""
    out: list[tuple[str, str, int, list[str]]] = []
    for b in blocks:
        refs = bool(re.match(r"(?i)(references|bibliography|参考文献)\s*:?\s*$", b.text.strip()))
        kind = "references" if refs else "heading" if b.type in ("title", "heading") else "figure" if b.type == "caption" else "table" if b.type == "table" else "column-continuation"
        col = 0 if b.column is None else b.column
        if out:
            _, now, at, members = out[-1]
            stays = now == "references" or (kind in ("figure", "table") and now == kind) or (kind == "column-continuation" and now in ("heading", "column-continuation") and (col == at or -1 in (col, at)))
            if stays:
                members.append(b.id)
                continue
        out.append((f"page-{page}-mod-{len(out)}", kind, col, [b.id]))
    return [(m, k, ids) for m, k, _, ids in out]


# --- tables ------------------------------------------------------------------------------------------------------------------


def tabular(text: str) -> bool:
    """F13 for one string."""
    t = text.strip()
    if not t or len(t) > 160:
        return False
    letters, marks = len(re.findall("[A-Za-z一-鿿]", t)), len(re.findall(X.CELL_MARKS, t))
    return (not letters and marks > 0) or (len(t) <= 80 and bool(re.search("[0-9]", t)) and marks >= max(3, len(t) * 0.3)) or (len(t.split()) <= 3 and bool(re.search(r"[0-9%±<>=/]", t)) and len(t) <= 40)


def _gap_y(a: Box, b: Box) -> float:
    return max(0.0, -a.over_y(b))


def _centre(b: Box) -> tuple[float, float]:
    return (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2


def tables(items: list[Item], em: float, figures: list[Box] | None = None) -> list[tuple[Box, list[Item]]]:
    """W19 / P03 / P04 (y down): clusters of tabular cells, merged by closeness, shared rows or row groups, grown over contained items.

    Clusters of at least four cells in two rows or beside a table caption are tables."""
    em, figures = max(6.0, em), figures or []
    cells = [i for i in items if tabular(i.text)]
    found: list[tuple[Box, list[Item]]] = []
    for c in sorted(cells, key=lambda i: i.box.y1):
        for k, (box, members) in enumerate(found):
            if _gap_y(box, c.box) <= 2.2 * em and box.over_x(c.box) > -2.5 * em:
                found[k] = (box.hull(c.box), [*members, c])
                break
        else:
            found.append((c.box, [c]))

    def rows(m: list[Item]) -> list[float]:
        return bands([_centre(i.box)[1] for i in m], em)

    def wide(m: list[Item]) -> int:
        return len(bands([_centre(i.box)[0] for i in m], 2 * em))

    def between(a: Box, b: Box, slack: float) -> Box | None:
        x1, x2, y1, y2 = min(a.x2, b.x2), max(a.x1, b.x1), max(a.y1, b.y1) - slack, min(a.y2, b.y2) + slack
        return Box(x1, y1, x2, y2) if x2 > x1 and y2 > y1 else None

    def one(a: tuple[Box, list[Item]], b: tuple[Box, list[Item]]) -> bool:
        near, gutter = _gap_y(a[0], b[0]) <= 2.2 * em, between(a[0], b[0], 0)
        if near and a[0].over_x(b[0]) > -3 * em:
            return True
        if gutter and any(f.over_x(gutter) > 0 and f.over_y(gutter) > 0 for f in figures):
            return False
        shared = sum(any(abs(y - z) <= em for z in rows(b[1])) for y in rows(a[1]))
        room = between(a[0], b[0], em)
        peopled = room is not None and any(room.x1 < _centre(c.box)[0] < room.x2 and room.y1 < _centre(c.box)[1] < room.y2 for c in cells)
        if shared >= 3 and (-a[0].over_x(b[0]) <= 8 * em or peopled):
            return True
        return not near and _gap_y(a[0], b[0]) <= 4 * em and a[0].share_x(b[0]) >= 0.7 and wide(a[1]) >= 2 and wide(b[1]) >= 2

    for _ in range(8):
        merged = False
        for i in range(len(found)):
            for j in range(len(found) - 1, i, -1):
                if i < len(found) and j < len(found) and one(found[i], found[j]):
                    found[i] = (found[i][0].hull(found[j][0]), found[i][1] + found[j][1])
                    del found[j]
                    merged = True
        if not merged:
            break
    captions = [i.box for i in items if i.type == "table"]
    out = []
    for box, members in found:
        if len(members) >= 4 and len(rows(members)) >= 2 or len(members) >= 2 and any(_gap_y(box, c) <= 3 * em and box.over_x(c) > 0 for c in captions):
            for _ in range(4):
                more = [i for i in items if i not in members and i.box.inside(box) >= 0.6]
                if not more:
                    break
                members = members + more
                box = box.hull(*[i.box for i in more])
            out.append((box, members))
    return out


def grid(members: list[Item]) -> list[dict]:
    """Cells of a table: (row, col, text, kind, members). Narrow members seed the bands; mostly numeric columns are data."""

    def infer(spans: list[tuple[float, float]]) -> list[list[float]]:
        out: list[list[float]] = []
        for lo, hi in sorted(spans, key=lambda s: s[1] - s[0]):
            for b in out:
                least = min(b[1] - b[0], hi - lo)
                if least > 0 and min(b[1], hi) - max(b[0], lo) > 0.4 * least:
                    b[:] = [min(b[0], lo), max(b[1], hi)]
                    break
            else:
                out.append([lo, hi])
        return sorted(out)

    def place(lo: float, hi: float, found: list[list[float]]) -> tuple[int, bool]:
        over = [min(b[1], hi) - max(b[0], lo) for b in found]
        best = max(range(len(found)), key=lambda i: (over[i], -i))
        return (best if over[best] > 0 else 0), sum(o > 0.5 * (b[1] - b[0]) > 0 for o, b in zip(over, found)) >= 2

    across, down = infer([(m.box.x1, m.box.x2) for m in members]), infer([(m.box.y1, m.box.y2) for m in members])
    slots: dict[tuple[int, int], tuple[list[Item], bool]] = {}
    for m in members:
        (col, straddles), (row, _) = place(m.box.x1, m.box.x2, across), place(m.box.y1, m.box.y2, down)
        there, s = slots.get((row, col), ([], False))
        slots[row, col] = ([*there, m], s or straddles)
    out = []
    for (row, col), (there, straddles) in sorted(slots.items()):
        there = sorted(there, key=lambda m: (m.box.y1, m.box.x1))
        text = " ".join(t for t in (m.text.strip() for m in there) if t)
        numeric = bool(re.fullmatch(X.NUMERIC_CELL, text))
        header = row == 0 and bool(re.search("[A-Za-z一-鿿]", text)) and not numeric
        data = straddles or not text or not header and (tabular(text) or len(text) < 3)
        out.append({"row": row, "col": col, "text": text, "kind": "data" if data else "text", "members": [m.id for m in there]})
    for col in range(len(across)):
        body = [c for c in out if c["col"] == col and c["row"] > 0]
        if len(body) >= 3 and sum(c["kind"] == "data" for c in body) / len(body) >= 0.7:
            for c in body:
                c["kind"] = "data"
    return out


# --- flow --------------------------------------------------------------------------------------------------------------------


def clear(top: float, height: float, spans: list[tuple[float, float]]) -> float:
    """First place from ``top`` on where ``height`` fits between the sorted spans."""
    for lo, hi in spans:
        if hi > top:
            if lo >= top + height:
                break
            top = hi
    return top


def flow(items: list[dict], obstacles: list[dict], page_height: float, gap: float) -> list[dict]:
    """W24 (y down): per column, by source top: an anchored item is not above its own place, others follow on; obstacles are hopped."""
    out = []
    for column in dict.fromkeys(i["column"] for i in items):
        spans = sorted((o for o in obstacles if o["column"] == column and o["bottom"] > o["top"]), key=lambda o: o["top"])
        cursor = None
        for i in sorted((i for i in items if i["column"] == column), key=lambda i: i["top"]):
            start = i["top"] if cursor is None else cursor if not i.get("anchor", True) else max(i["top"], cursor)
            mine = [(o["top"], o["bottom"]) for o in spans if o.get("left") is None or (o["right"] > i["left"] and o["left"] < i["left"] + i["width"])]
            at = clear(start, i["height"], mine)
            out.append({"id": i["id"], "top": at, "displaced": at > i["top"] + 0.5, "overflow": at + i["height"] > page_height})
            cursor = at + i["height"] + gap
    return out


def push_down(items: list[dict], gap: float) -> list[dict]:
    """top = max(own top, previous bottom + gap)."""
    out, bottom = [], float("-inf")
    for i in sorted(items, key=lambda i: i["top"]):
        top = max(i["top"], bottom + gap)
        out.append({"id": i["id"], "top": top})
        bottom = top + i["height"]
    return out


def sweep(movable: list[tuple[str, Box]], fixed: list[Box], gap: float, passes: int = 40) -> dict[str, float]:
    """W26 (y down): from the top, each box moves below what it hits; sharing 12 % of the narrower width doesn't count as a hit."""
    settled, out = list(fixed), {}
    for name, b in sorted(movable, key=lambda m: m[1].y1):
        for _ in range(passes):
            start = b
            for o in settled:
                if b.over_x(o) > 0.12 * min(b.width, o.width) and b.over_y(o) > 0:
                    b = replace(b, y1=o.y2 + gap, y2=o.y2 + gap + b.height)
            if b is start:
                break
        out[name] = b.y1
        settled.append(b)
    return out


def ink_spans(ink: list[list[bool]], cell: float, lo: int, hi: int, least: int = 2) -> list[tuple[float, float, float, float]]:
    """(top, bottom, left, right) of runs of at least ``least`` rows with ink between two grid columns; x is tight."""
    out, run = [], []
    for r, row in enumerate([*ink, []]):
        hit = [c for c in range(lo, min(hi + 1, len(row))) if row[c]]
        if hit:
            run.append((r, hit))
        elif run:
            if len(run) >= least:
                every = [c for _, h in run for c in h]
                out.append((run[0][0] * cell, r * cell, min(every) * cell, (max(every) + 1) * cell))
            run = []
    return out


# --- text in boxes -------------------------------------------------------------------------------------------------------------

_ABBREVIATION = re.compile(X.ABBREVIATION)
_STOP = re.compile(X.SENTENCE_STOP)


def sentences(text: str) -> list[str]:
    """CJK marks always end one; Latin marks before white space and a likely start, unless after an abbreviation."""
    t, out, start = text.strip(), [], 0
    for m in _STOP.finditer(t):
        if m.start() < start:
            continue
        if m[1] in ".!?;" and m.end() < len(t):
            rest = t[m.end() :].lstrip()
            if not t[m.end()].isspace() or not re.match(X.SENTENCE_START, rest) or _ABBREVIATION.search(t[max(0, m.start() - 12) : m.start() + 1]):
                continue
        out.append(t[start : m.end()].strip())
        start = m.end() + len(t[m.end() :]) - len(t[m.end() :].lstrip())
    return [s for s in [*out, t[start:].strip()] if s]


def distribute(text: str, areas: list[float]) -> list[str]:
    """A text over boxes by area: whole sentences where that works, else cut at a space."""
    total, parts, out = sum(areas) or 1.0, sentences(text), []
    if len(parts) < len(areas):
        parts = re.findall(r"\S+\s*", text)
    size, done, at = sum(map(len, parts)) or 1, 0, 0
    share = 0.0
    for k, a in enumerate(areas):
        share += a / total
        take = []
        while at < len(parts) and (k == len(areas) - 1 or done + len(parts[at]) / 2 <= share * size):
            take.append(parts[at].strip())
            done += len(parts[at])
            at += 1
        out.append(" ".join(take))
    return out


def wrap(text: str, width: float, measure: Callable[[str], float]) -> list[str]:
    """Greedy lines; CJK characters break anywhere, a word that is too wide is cut."""
    lines, now = [], ""
    for tok in re.findall(r"[　-鿿豈-﫿＀-￯]|[^\s　-鿿豈-﫿＀-￯]+|\s+", text):
        while tok:
            if measure(now + tok.rstrip()) <= width or (not now and len(tok) == 1):
                now += tok
                break
            if now.strip():
                lines.append(now.rstrip())
                now = ""
                tok = tok.lstrip()
                continue
            n = max(1, next((i for i in range(len(tok), 0, -1) if measure(tok[:i]) <= width), 1))
            lines.append(tok[:n])
            now, tok = "", tok[n:]
    return [*lines, now.rstrip()] if now.strip() else lines


def fit(text: str, width: float, height: float, font: float, least: float, measure: Callable[[str, float], float]) -> tuple[float, list[str], bool]:
    """Shrink by 0.92 until the lines fit, else clip with an ellipsis: (font, lines, clipped)."""
    while True:
        lines = wrap(text, width, lambda s: measure(s, font))
        room = int(height // (font * 1.3))
        if len(lines) <= room:
            return font, lines, False
        if font * 0.92 < least:
            return font, [*lines[: max(0, room - 1)], lines[max(0, room - 1)].rstrip() + "…"] if room else [], True
        font *= 0.92


def formula_runs(glyphs: list[dict], base: float) -> list[str]:
    """Runs of formula glyphs: mathematical fonts or symbols, small type after two body characters, brackets within a run."""
    flags, strong, depth, body = [], [], 0, 0
    for g in glyphs:
        c = g.get("c") or ""
        hard = bool(re.search(X.MATH_FONT, (g.get("font_name") or "").lower()) or re.match(X.MATH_SYMBOL, c) or c.startswith("(cid:"))
        small = 0 < (g.get("font") or 0) < 0.79 * base and body >= 2 and bool(c.strip())
        on = hard or small or bool(flags and flags[-1] and (c == "(" or c == ")" and depth))
        depth = depth + (c == "(") - (c == ")" and depth > 0) if on else depth if flags and flags[-1] else 0
        flags.append(on)
        strong.append(hard)
        body += not on and bool(c.strip())
    for i in range(1, len(flags) - 1):
        flags[i] = flags[i] or (glyphs[i].get("c") == " " and flags[i - 1] and flags[i + 1])
    out: dict[str, None] = {}
    i = 0
    while i < len(flags):
        j = i
        while j < len(flags) and flags[j]:
            j += 1
        if j > i:
            t = "".join((g.get("c") or "") + (" " if g.get("space_after") and k < j - 1 else "") for k, g in enumerate(glyphs[i:j], i)).strip()
            if len(t) >= (2 if any(strong[i:j]) else 4) and not re.fullmatch(r"[\d\s,.]+", t):
                out[t] = None
        i = max(j, i + 1)
    return list(out)


def image_boxes(ops: list[dict], least: float = 12.0) -> list[Box]:
    """Boxes of painted images under a stack of matrices (save, restore, transform, paint)."""
    now, stack, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], []
    for op in ops:
        if op["op"] == "save":
            stack.append(now)
        elif op["op"] == "restore" and stack:
            now = stack.pop()
        elif op["op"] == "transform":
            a, b, c, d, e, f = op["m"]
            p, q, r, s, t, u = now
            now = (p * a + r * b, q * a + s * b, p * c + r * d, q * c + s * d, p * e + r * f + t, q * e + s * f + u)
        elif op["op"] == "paint":
            a, b, c, d, e, f = now
            xs, ys = [e, e + a, e + c, e + a + c], [f, f + b, f + d, f + b + d]
            box = Box(min(xs), min(ys), max(xs), max(ys))
            if box.width >= least and box.height >= least:
                out.append(box)
    return out
