"""Fusing the selections of whole documents in the task that holds them.

The same steps as the joins in ``union``, on arrays: runs of pixels, their regions,
the links that bridges make, and the rings of what is accepted.
"""

from __future__ import annotations

import numpy as np

from inkgrid.operators.raster import _TURNS

#: Crossings of edges and pixel rows that a document may have to be fused in a task, and that a task works on at a time.
MOST = 400_000
#: A document of more pixels a side is left to the joins.
WIDEST = 100_000
INPUT = ["kind", "doc_id", "selection_id", "piece", "other", "x1", "y1", "x2", "y2", "width", "height", "crossings"]
OUTPUT = (
    "kind byte, selection_id long, doc_id long, regions_before long, regions_after long, regions_expected long, accepted boolean, area double, holes long, hole_area double, "
    "subpath_index int, i int, x double, y double"
)
EDGE, MEMBER, BRIDGE = 0, 1, 2
REPORT, VERTEX = 0, 1
Columns = dict[str, np.ndarray]
_PAIRS = np.array([[*_TURNS.get(p, []), (-1, -1), (-1, -1)][:2] for p in range(16)])


def _centre(v: np.ndarray) -> np.ndarray:
    return np.ceil(v - 0.5).astype(np.int64)


def _spread(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Row ``k`` repeated ``n[k]`` times, and the number of each repetition."""
    row = np.repeat(np.arange(len(n)), n)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)


def _codes(*columns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The place of the first row of every distinct combination, in their order, and the number of each row's combination."""
    order = np.lexsort(columns[::-1])
    begins = np.zeros(len(order), dtype=bool)
    begins[:1] = True
    for c in columns:
        begins[1:] |= c[order][1:] != c[order][:-1]
    code = np.empty(len(order), np.int64)
    code[order] = np.cumsum(begins) - 1
    return order[begins], code


def _filled(key: np.ndarray, c: Columns) -> tuple[np.ndarray, ...]:
    """``key, y, a, b``: the runs whose pixel centres are inside by the even-odd rule."""
    lo = np.maximum(_centre(np.minimum(c["y1"], c["y2"])), 0)
    n = np.maximum(np.minimum(_centre(np.maximum(c["y1"], c["y2"])) - 1, c["height"] - 1) - lo + 1, 0)
    e, k = _spread(n)
    y = lo[e] + k
    at = c["x1"][e] + (y + 0.5 - c["y1"][e]) * (c["x2"][e] - c["x1"][e]) / (c["y2"][e] - c["y1"][e])
    order = np.lexsort((at, y, key[e]))
    key, y, at, right = key[e][order], y[order], at[order], c["width"][e][order] - 1
    begins = np.ones(len(y), dtype=bool)
    begins[1:] = (key[1:] != key[:-1]) | (y[1:] != y[:-1])
    place = np.arange(len(y))
    odd = (place - np.maximum.accumulate(np.where(begins, place, 0))) % 2 == 0
    a, b = np.maximum(_centre(at), 0), right.copy()
    ends = np.flatnonzero(~begins[1:])
    b[ends] = np.minimum(_centre(at[ends + 1]) - 1, right[ends])
    kept = odd & (a <= b)
    return key[kept], y[kept], a[kept], b[kept]


def _merged(key: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
    """Maximal runs of every key, sorted."""
    if not len(key):
        return key, y, a, b
    order = np.lexsort((a, y, key))
    key, y, a, b = key[order], y[order], a[order], b[order]
    begins = np.ones(len(key), dtype=bool)
    begins[1:] = (key[1:] != key[:-1]) | (y[1:] != y[:-1])
    line, wide = np.cumsum(begins), b.max() + 2
    before = np.maximum.accumulate(line * wide + b)[:-1] - line[1:] * wide
    begins[1:] |= a[1:] > before + 1
    at = np.flatnonzero(begins)
    return key[at], y[at], a[at], np.maximum.reduceat(b, at)


class Runs:
    """Sorted maximal runs, asked for those of a key and row that share a column with others."""

    def __init__(self, runs: tuple[np.ndarray, ...], rows: int, wide: int):
        self.key, self.y, self.a, self.b = runs
        self.rows, self.wide = rows + 3, wide + 4
        line = self.key * self.rows + self.y + 1
        self.starts, self.ends = line * self.wide + self.a, line * self.wide + self.b

    def meeting(self, key: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        line = (key * self.rows + y + 1) * self.wide
        first = np.searchsorted(self.ends, line + a)
        row, k = _spread(np.maximum(np.searchsorted(self.starts, line + b, "right") - first, 0))
        return row, first[row] + k

    def regions(self) -> np.ndarray:
        """The first run of the 4-connected region of every run."""
        return _roots(len(self.y), *self.meeting(self.key, self.y + 1, self.a, self.b))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while (apart := root[a] != root[b]).any():
        ra, rb = root[a[apart]], root[b[apart]]
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while not np.array_equal(up := root[root], root):
            root = up
    return root


def _rings(mask: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> Columns:
    """``mask, ring, i, x, y`` of the corners of every mask's outlines; runs are maximal."""
    events = [np.concatenate(x) for x in zip((mask, y + 1, a, y * 0 + 1, y * 0), (mask, y + 1, b + 1, y * 0 - 1, y * 0), (mask, y, a, y * 0, y * 0 + 1), (mask, y, b + 1, y * 0, y * 0 - 1), strict=True)]
    first, code = _codes(*events[:3])
    up, down = (np.bincount(code, e, len(first)).astype(np.int64) for e in events[3:])
    over, under = np.cumsum(up), np.cumsum(down)  # a line's sums end at 0
    pattern = (over - up > 0) + 2 * (over > 0) + 4 * (under - down > 0) + 8 * (under > 0)
    turns = _PAIRS[pattern]
    point, which = np.nonzero(turns[:, :, 0] >= 0)
    mask, y, x = (events[k][first][point] for k in (0, 1, 2))
    into, out = turns[point, which, 0], turns[point, which, 1]
    order = np.lexsort((into, x, y, mask))
    mask, y, x, into, out = mask[order], y[order], x[order], into[order], out[order]
    n, way = len(x), np.concatenate([out, into])
    flat = way % 2 == 0
    line, along = np.where(flat, np.tile(y, 2), np.tile(x, 2)), np.where(flat, np.tile(x, 2), np.tile(y, 2))
    order = np.lexsort((np.where(way < 2, along, -along), line, way, np.tile(mask, 2)))
    after = np.empty(2 * n, np.int64)
    after[order[:-1]] = order[1:]
    far = after[:n] - n
    ring, off, reach = np.arange(n), np.zeros(n, np.int64), 1
    while (better := ring[far] < ring).any():
        off, ring, far, reach = np.where(better, off[far] + reach, off), np.minimum(ring, ring[far]), far[far], reach * 2
    size = np.bincount(ring, minlength=n)[ring]
    i = (size - off) % size
    order = np.lexsort((i, ring))
    return {"mask": mask[order], "ring": ring[order], "i": i[order], "x": x[order].astype(float), "y": y[order].astype(float)}


def fused(c: Columns) -> Columns:
    """``OUTPUT`` of the documents whose rows (``INPUT``) these are, some documents at a time."""
    _, doc = _codes(c["doc_id"])
    weight = np.bincount(doc, c["crossings"])
    part = (np.cumsum(weight) // MOST).astype(np.int64)[doc]
    done = [_fused({k: v[part == p] for k, v in c.items()}) for p in np.unique(part)]
    return {k: np.concatenate([x[k] for x in done]) for k in done[0]}


def _fused(c: Columns) -> Columns:
    edge, member, bridge = ({k: v[c["kind"] == kind] for k, v in c.items()} for kind in (EDGE, MEMBER, BRIDGE))
    rows, wide = int(c["height"].max()) + 1, int(c["width"].max()) + 1
    _, doc = _codes(c["doc_id"])
    doc = {kind: doc[c["kind"] == kind] for kind in (EDGE, MEMBER, BRIDGE)}
    # pieces, and selections, by number
    at, piece = _codes(np.concatenate([doc[EDGE], doc[MEMBER]]), np.concatenate([edge["piece"], member["piece"]]))
    piece_doc = np.concatenate([doc[EDGE], doc[MEMBER]])[at]
    in_edge, in_member = piece[:len(edge["piece"])], piece[len(edge["piece"]):]
    s_at, s = _codes(np.concatenate([doc[MEMBER], doc[BRIDGE]]), np.concatenate([member["selection_id"], bridge["selection_id"]]))
    s_doc, s_id = (np.concatenate([member[k], bridge[k]])[s_at] for k in ("doc_id", "selection_id"))
    s_num = np.concatenate([doc[MEMBER], doc[BRIDGE]])[s_at]
    s_member, s_bridge, k = s[:len(doc[MEMBER])], s[len(doc[MEMBER]):], len(s_at)

    own = _filled(in_edge, edge)  # sorted by piece
    runs = Runs(_merged(piece_doc[own[0]], *own[1:]), rows, wide)
    region = runs.regions()
    before = np.bincount(runs.key[region == np.arange(len(region))], minlength=int(max(map(np.max, (x for x in doc.values() if len(x))))) + 1)
    home = region[runs.meeting(piece_doc[own[0]], own[1], own[2], own[2])[1]]  # of the first column of each run
    first = np.searchsorted(own[0], in_member)
    row, j = _spread(np.searchsorted(own[0], in_member, "right") - first)
    ours = first[row] + j
    our_s = s_member[row]

    g_at, g = _codes(s_bridge, bridge["piece"], bridge["other"])
    g_s = s_bridge[g_at]
    added = _filled(g, bridge)
    added_s = g_s[added[0]] if len(g_s) else added[0]
    laid = Runs(_merged(added_s, *added[1:]), rows, wide)
    around = [np.concatenate(x) for x in zip(*[(np.arange(len(added[0])), added[1] + dy, added[2] - dx, added[3] + dx) for dy, dx in ((0, 1), (1, 0), (-1, 0))], strict=True)]
    q, hit = runs.meeting(s_num[added_s[around[0]]], *around[1:])
    linked_g, linked = added[0][around[0][q]], region[hit]
    q, hit = laid.meeting(added_s[around[0]], *around[1:])
    near_g, near = added[0][around[0][q]], hit

    # nodes: regions a selection touches or its bridges meet, bridges with pixels, runs of all bridges of a selection together
    n_at, node = _codes(np.concatenate([our_s, g_s[linked_g]]), np.concatenate([home[ours], linked]))
    n_s = np.concatenate([our_s, g_s[linked_g]])[n_at]
    touched = np.zeros(len(n_at), dtype=bool)
    touched[node[:len(our_s)]] = True
    b0, u0 = len(n_at), len(n_at) + len(g_at)
    root = _roots(u0 + len(laid.y), np.concatenate([b0 + linked_g, b0 + near_g]), np.concatenate([node[len(our_s):], u0 + near]))
    seen = np.zeros(len(g_at), dtype=bool)
    seen[added[0]] = True
    met = np.bincount(n_s, minlength=k)
    every, every_s = np.concatenate([root[:b0], root[b0:u0][seen]]), np.concatenate([n_s, g_s[seen]])
    parts = np.bincount(every_s[_codes(every_s, every)[0]], minlength=k)
    chosen = np.bincount(n_s[touched], minlength=k)
    kinds = np.bincount(n_s[touched][_codes(n_s[touched], root[:b0][touched])[0]], minlength=k)
    least = np.full(k, u0 + len(laid.y))
    np.minimum.at(least, n_s[touched], root[:b0][touched])
    strange = np.bincount(n_s[~touched & (root[:b0] == least[n_s])], minlength=k) > 0
    total = before[s_num]
    after, expected = total - met + parts, total - chosen + 1
    accepted = (kinds == 1) & ~strange & (after == expected)

    take = accepted[our_s]
    give = accepted[added_s]
    whole = Runs(_merged(np.concatenate([our_s[take], added_s[give]]), *[np.concatenate([o[ours][take], a[give]]) for o, a in zip(own[1:], added[1:], strict=True)]), rows, wide)
    if len(whole.y):
        rings = _rings(whole.regions(), whole.y, whole.a, whole.b)
    else:
        rings = {x: np.zeros(0, np.int64) for x in ("mask", "ring", "i", "x", "y")}
    starts = np.flatnonzero(rings["i"] == 0)
    size = np.diff(np.append(starts, len(rings["i"])))
    number = np.repeat(np.arange(len(starts)), size)
    follow = np.where(np.append(rings["i"][1:], 0) == 0, starts[number] if len(starts) else number, np.arange(len(number)) + 1)
    signed = np.bincount(number, rings["x"] * rings["y"][follow] - rings["x"][follow] * rings["y"], len(starts)) / 2.0
    hole, mask = signed < 0, rings["mask"][starts]
    ring_s = whole.key[mask]
    order = np.lexsort((rings["ring"][starts], hole, mask))  # masks are sorted by selection
    sub = np.empty(len(order), np.int64)
    sub[order] = np.arange(len(order)) - np.searchsorted(ring_s[order], ring_s[order])

    told = np.flatnonzero(chosen > 0)
    out_s = np.concatenate([told, ring_s[number]])
    m, n = len(told), len(number)

    def column(report: np.ndarray, vertex: np.ndarray, kind: type) -> np.ndarray:
        return np.concatenate([np.asarray(report), np.asarray(vertex)]).astype(kind)

    none, blank = np.zeros(n), np.zeros(m)
    sums = [np.bincount(ring_s, w, k)[told] for w in (signed, hole, np.where(hole, -signed, 0.0))]
    return {
        "kind": column(blank, none + VERTEX, np.int8), "selection_id": s_id[out_s], "doc_id": s_doc[out_s], "regions_before": column(total[told], none, np.int64),
        "regions_after": column(after[told], none, np.int64), "regions_expected": column(expected[told], none, np.int64), "accepted": column(accepted[told], none, bool),
        "area": column(sums[0], none, float), "holes": column(sums[1], none, np.int64), "hole_area": column(sums[2], none, float),
        "subpath_index": column(blank, sub[number], np.int32), "i": column(blank, rings["i"], np.int32), "x": column(blank, rings["x"], float), "y": column(blank, rings["y"], float),
    }
