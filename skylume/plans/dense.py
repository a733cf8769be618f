"""The same networks as ``operators.models`` on one small graph in NumPy, for the search."""

from __future__ import annotations

import numpy as np


def _sum_in(values: np.ndarray, src: np.ndarray, dst: np.ndarray, n: int) -> np.ndarray:
    out = np.zeros((n, values.shape[1]))
    np.add.at(out, dst, values[src])
    return out


def gcn(x: np.ndarray, src: np.ndarray, dst: np.ndarray, outside: np.ndarray, layers, projected: bool = True) -> np.ndarray:
    """``x`` holds first-layer products if ``projected``; ``outside`` adds to in-degrees."""
    n = len(x)
    scale = 1 / np.sqrt(np.bincount(dst, minlength=n) + outside + 1.0)
    h = x
    for k, (w, b) in enumerate(layers):
        if k or not projected:
            h = (np.maximum(h, 0) if k else h) @ np.asarray(w)
        s = h * scale[:, None]
        h = (_sum_in(s, src, dst, n) + s) * scale[:, None] + np.asarray(b)
    return h


def gin(x, src, dst, outside, model) -> np.ndarray:
    blocks, (lw, lb) = model
    for (w1, b1), (w2, b2), eps in blocks:
        t = x * (1 + eps) + _sum_in(x, src, dst, len(x))
        x = np.maximum(np.maximum(t @ np.asarray(w1) + b1, 0) @ np.asarray(w2) + b2, 0)
    return x @ np.asarray(lw) + lb


def sage(x, src, dst, outside, layers) -> np.ndarray:
    degree = np.maximum(np.bincount(dst, minlength=len(x)), 1)[:, None]
    for k, ((wn, bn), (wo, bo)) in enumerate(layers):
        y = _sum_in(x, src, dst, len(x)) / degree @ np.asarray(wn) + bn + x @ np.asarray(wo) + bo
        x = np.maximum(y, 0) if k + 1 < len(layers) else y
    return x


def gat(x, src, dst, outside, layers, slope: float = 0.2) -> np.ndarray:
    n = len(x)
    other = src != dst
    s, d = np.append(src[other], np.arange(n)), np.append(dst[other], np.arange(n))
    for k, ((w, b), a_src, a_dst) in enumerate(layers):
        a_src, a_dst = np.asarray(a_src), np.asarray(a_dst)
        z = (x @ np.asarray(w)).reshape(n, *a_src.shape)
        e = (z * a_src).sum(axis=2)[s] + (z * a_dst).sum(axis=2)[d]
        e = np.where(e > 0, e, slope * e)
        top = np.full((n, e.shape[1]), -np.inf)
        np.maximum.at(top, d, e)
        p = np.exp(e - top[d])
        total, sums = np.zeros_like(top), np.zeros_like(z)
        np.add.at(total, d, p)
        np.add.at(sums, d, p[:, :, None] * z[s])
        x = (sums / total[:, :, None]).reshape(n, -1) + b
        if k + 1 < len(layers):
            x = np.where(x > 0, x, np.expm1(x))
    return x


def outputs(name: str, model, x, src, dst, outside) -> np.ndarray:
    """Raw outputs of a named model; gcn models take raw features here."""
    if name.startswith("gcn"):
        return gcn(x, src, dst, outside, model, projected=False)
    return {"gin": gin, "sage": sage, "gat": gat}[name](x, src, dst, outside, model)


def softmax(z: np.ndarray) -> np.ndarray:
    p = np.exp(z - z.max(axis=-1, keepdims=True))
    return p / p.sum(axis=-1, keepdims=True)


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ranges [start, start + count) behind each other."""
    ends = np.cumsum(counts)
    return np.repeat(starts - (ends - counts), counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class Egos:
    """Many small graphs behind each other, so that one pass scores many states of many egos.

    ``nodes`` has rows (vt, node, outside, h), ``edges`` (vt, edge_id, src, dst), both arrays by name;
    edges with an end that is no node of their vt are left out.
    """

    def __init__(self, nodes: dict, edges: dict):
        order = np.lexsort((nodes["node"], nodes["vt"]))
        vt, node = nodes["vt"][order], nodes["node"][order]
        self.x, self.outside = nodes["h"][order], nodes["outside"][order].astype(float)
        self.vts, self.node_at = np.unique(vt, return_index=True)
        self.node_at = np.append(self.node_at, len(vt))
        every = np.unique(node)
        key = np.searchsorted(self.vts, vt) * len(every) + np.searchsorted(every, node)

        def place(of: np.ndarray, v: np.ndarray) -> np.ndarray:
            """Place of each node, -1 if it is not there."""
            i, j = np.searchsorted(self.vts, of), np.searchsorted(every, v)
            known = (i < len(self.vts)) & (j < len(every))
            at = np.searchsorted(key, np.where(known, i * len(every) + j, 0))
            at = np.minimum(at, max(0, len(key) - 1))
            return np.where(known & (vt[at] == of) & (node[at] == v), at, -1) if len(key) else np.full(len(of), -1)

        order = np.lexsort((edges["edge_id"], edges["vt"]))
        of, src, dst = edges["vt"][order], edges["src"][order], edges["dst"][order]
        self.src, self.dst = place(of, src), place(of, dst)
        there = (self.src >= 0) & (self.dst >= 0)
        self.order, self.src, self.dst = order[there], self.src[there], self.dst[there]
        self.edge_vt, self.edge_id = of[there], edges["edge_id"][self.order]
        self.edge_at = np.append(np.searchsorted(self.edge_vt, self.vts), len(self.edge_vt))
        self.row = place(self.vts, self.vts)

    def shares(self, of: np.ndarray, masks: np.ndarray, with_rest: bool, layers, most: int = 1 << 21) -> np.ndarray:
        """Class shares of the centres of egos ``of``, each under its part of ``masks`` (over its edges, behind each other)."""
        m, n = np.diff(self.edge_at)[of], np.diff(self.node_at)[of]
        size = np.cumsum(m + n)
        if len(of) > 1 and size[-1] > most:
            cuts = np.unique(np.searchsorted(size, np.arange(most, size[-1], most)) + 1)
            starts, at = [0, *cuts[cuts < len(of)]], np.append(0, np.cumsum(m))
            parts = zip(starts, [*starts[1:], len(of)], strict=True)
            return np.concatenate([self._shares(of[a:b], masks[at[a] : at[b]], with_rest, layers) for a, b in parts])
        return self._shares(of, masks, with_rest, layers)

    def _shares(self, of, masks, with_rest, layers) -> np.ndarray:
        m, n = np.diff(self.edge_at)[of], np.diff(self.node_at)[of]
        nodes, shift = _ranges(self.node_at[of], n), np.cumsum(n) - n - self.node_at[of]
        at, shift_of = _ranges(self.edge_at[of], m)[masks], np.repeat(shift, m)[masks]
        src, dst, total = self.src[at] + shift_of, self.dst[at] + shift_of, len(nodes)
        scale = 1 / np.sqrt(np.bincount(dst, minlength=total) + (self.outside[nodes] if with_rest else 0.0) + 1.0)
        h = self.x[nodes]
        for k, (w, b) in enumerate(layers):
            if k:
                h = np.maximum(h, 0) @ np.asarray(w)
            s = h * scale[:, None]
            sums = np.stack([np.bincount(dst, weights=s[src, j], minlength=total) for j in range(s.shape[1])], axis=1)
            h = (sums + s) * scale[:, None] + np.asarray(b)
        return softmax(h[self.row[of] + shift])

    def origins(self, layers) -> tuple[np.ndarray, np.ndarray]:
        """(label, p0): class of each centre on its whole ego, and its share."""
        shares = self.shares(np.arange(len(self.vts)), np.ones(len(self.edge_id), dtype=bool), False, layers)
        return shares.argmax(axis=1), shares.max(axis=1)

    def ring(self, k: int) -> Ring | bool:
        """One ego for waves of a two-layer network; False if it has loops or parallel edges."""
        edges, first = slice(self.edge_at[k], self.edge_at[k + 1]), self.node_at[k]
        nodes = slice(first, self.node_at[k + 1])
        src, dst = self.src[edges] - first, self.dst[edges] - first
        n = nodes.stop - nodes.start
        if (src == dst).any() or len(np.unique(src * n + dst)) < len(src):
            return False
        return Ring(self.x[nodes], self.outside[nodes], src, dst, int(self.row[k] - first))


class Ring:
    """One ego, for the centre's shares when single edges of a state go or come (two gcn layers).

    Only the centre's row and those of its in-neighbours count in the first layer.  An edge into d
    changes d's degree, so d's own row and the rows that d sends to; the sums of all others stay.
    """

    def __init__(self, x: np.ndarray, outside: np.ndarray, src: np.ndarray, dst: np.ndarray, centre: int):
        # Nodes along the last axis: long inner loops.
        self.x, self.outside, self.src, self.dst, self.centre = np.ascontiguousarray(x.T), outside, src, dst, centre
        self.into = np.flatnonzero(dst == centre)
        self.rows = np.append(centre, src[self.into])
        self.row_of = np.full(len(x), -1)
        self.row_of[self.rows] = np.arange(len(self.rows))
        # Edges into these rows, by source.
        sent = np.flatnonzero(self.row_of[dst] >= 0)
        self.sent = sent[np.argsort(src[sent], kind="stable")]

    def shares(self, mask: np.ndarray, edges: np.ndarray, come: bool, layers) -> np.ndarray:
        """Class shares under ``mask``, and with each of ``edges`` taken from it (or, with ``come``, added, among outside degrees)."""
        (_, b), (w, c) = ((np.asarray(v) for v in layer) for layer in layers)
        x, rows, centre, sign, b = self.x, self.rows, self.centre, 1 if come else -1, b[:, None]
        degree = np.bincount(self.dst[mask], minlength=x.shape[1]) + (self.outside if come else 0.0) + 1.0
        scale = 1 / np.sqrt(degree)
        sent = self.sent[mask[self.sent]]
        source, row = self.src[sent], self.row_of[self.dst[sent]]
        scaled = x * scale
        sums = np.stack([np.bincount(row, weights=v, minlength=len(rows)) for v in scaled.take(source, axis=1)])
        own = scale[rows]
        total = sums + scaled.take(rows, axis=1)
        h = np.maximum(total * own + b, 0)
        # What each row counts for at the centre; its own counts by its own scale.
        part = own * np.append(1.0, mask[self.into])
        base = h @ part
        out = np.empty((len(base), len(edges) + 1))
        out[:, 0] = base * scale[centre]
        if len(edges):
            a, d = self.src[edges], self.dst[edges]
            # The scale of a node with an edge more or less; nodes that no edge leads to are not asked for.
            after = 1 / np.sqrt(np.maximum(degree + sign, 1.0))
            asked = np.zeros(x.shape[1], dtype=bool)
            asked[d] = True
            use = np.flatnonzero(asked[source] & ((part[row] != 0) | (source == centre)))
            s, r = source[use], row[use]
            moved = ((after - scale) * x).take(s, axis=1)
            moved += total.take(r, axis=1)
            moved *= own[r]
            moved += b
            np.maximum(moved, 0, out=moved)
            change = np.repeat(base[:, None], x.shape[1], axis=1)
            if len(s):
                starts = np.flatnonzero(np.r_[True, s[1:] != s[:-1]])
                change[:, s[starts]] += np.add.reduceat((moved - h.take(r, axis=1)) * part[r], starts, axis=1)
            y = out[:, 1:]
            np.take(change, d, axis=1, out=y, mode="clip")
            mine = np.flatnonzero(self.row_of[d] >= 0)
            if len(mine):
                k, then = self.row_of[d[mine]], after[d[mine]]
                fresh = (sign * scaled).take(a[mine], axis=1)
                fresh += (sums + after[rows] * x.take(rows, axis=1)).take(k, axis=1)
                fresh *= then
                fresh += b
                np.maximum(fresh, 0, out=fresh)
                fresh *= part[k] * then / own[k]
                fresh -= (h * part).take(k, axis=1)
                y[:, mine] += fresh
            ends = np.flatnonzero(d == centre)
            if len(ends):
                of, here = h.copy(), np.flatnonzero(s == centre)
                of[:, r[here]] = moved.take(here, axis=1)
                y[:, ends] += sign * scale[a[ends]] * of.take(self.row_of[a[ends]], axis=1)
            y *= np.where(d == centre, after[centre], scale[centre])
        z = w.T @ out + c[:, None]
        z -= z.max(axis=0)
        np.exp(z, out=z)
        return (z / z.sum(axis=0)).T
