"""Forces between all pairs of points by a tree of cells.

Points of neighbouring cells meet one by one. Cells farther apart meet by the values of the potential 1 / sqrt(r^2 + 1) at the
Chebyshev nodes of each, level by level, so the time grows about as the number of points. No pair is left out; ``ORDER``
nodes an axis set the error."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import product

import numpy as np

#: Chebyshev nodes an axis of a cell.
ORDER = 9
#: Deepest level of cells.
DEEPEST = 7
#: Pairs of points met at a time (half a MB an array).
TILE_PAIRS = 1 << 16
#: Pairs of cells met at a time (12 kB each).
CELLS_AT_ONCE = 2048
#: Seconds of a pair of points, of a pair of cells and of the kernel of a pair of places, by which a level is chosen.
PAIR_S, CELLS_S, KERNEL_S = 3e-9, 4 * ORDER**6 / 20e9, 6e-9 * ORDER**6

NODES = np.cos((np.arange(ORDER) + 0.5) * np.pi / ORDER)


def turns() -> dict[tuple[int, ...], list[tuple[tuple[int, ...], np.ndarray, np.ndarray]]]:
    """By an offset of cells: those that turning and mirroring make of it, where each node then is, and the way back."""
    found: dict[tuple[int, ...], list] = {}
    grid = np.indices((ORDER,) * 3).reshape(3, -1)
    for offset in product(range(-3, 4), repeat=3):
        if max(map(abs, offset)) > 1:
            axes = sorted(range(3), key=lambda x: abs(offset[x]))  # noqa: B023
            x, y, z = (ORDER - 1 - grid[a] if offset[a] < 0 else grid[a] for a in axes)
            place = (x * ORDER + y) * ORDER + z
            found.setdefault(tuple(abs(offset[a]) for a in axes), []).append((offset, place, np.argsort(place)))
    return found


TURNS = turns()


def polynomials(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chebyshev polynomials under ``ORDER`` and their derivatives at each x."""
    t, d = np.ones((len(x), ORDER)), np.zeros((len(x), ORDER))
    t[:, 1], d[:, 1] = x, 1.0
    for m in range(2, ORDER):
        t[:, m] = 2 * x * t[:, m - 1] - t[:, m - 2]
        d[:, m] = 2 * t[:, m - 1] + 2 * x * d[:, m - 1] - d[:, m - 2]
    return t, d


_TO_NODES = polynomials(NODES)[0].T * np.where(np.arange(ORDER) == 0, 1, 2)[:, None] / ORDER
#: What the nodes of a lower or upper half give to those of the whole.
HALVES = [polynomials((NODES + side) / 2)[0] @ _TO_NODES for side in (-1, 1)]


def cells_of(at: np.ndarray, half: float, level: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order of the points, coordinates of the cells that have any, where each begins) of the cube from -half to half."""
    side = 1 << level
    cell = np.clip(((at + half) * (side / (2 * half))).astype(np.int64), 0, side - 1)
    key = (cell[:, 0] * side + cell[:, 1]) * side + cell[:, 2]
    order = np.argsort(key, kind="stable")
    keys, first = np.unique(key[order], return_index=True)
    return order, np.column_stack([keys // side**2, keys // side % side, keys % side]), np.append(first, len(at))


def around(grid: np.ndarray) -> np.ndarray:
    """Sums over each cell and its neighbours."""
    for axis in range(3):
        padded = np.pad(grid, [(int(x == axis),) * 2 for x in range(3)])
        pick = lambda low, n=grid.shape[axis]: np.take(padded, range(low, low + n), axis)  # noqa: B023, E731
        grid = pick(0) + pick(1) + pick(2)
    return grid


def plan(at: np.ndarray, half: float, tasks: int) -> tuple[int, list[tuple[int, int]]]:
    """The level of least work, and ranges of its cells of about the same work."""
    best = None
    for level in range(1, DEEPEST + 1):
        _, cells, begin = cells_of(at, half, level)
        size, side = np.diff(begin), 1 << level
        grid = np.zeros((side,) * 3)
        grid[tuple(cells.T)] = size
        points, full = around(grid), (grid > 0).astype(float)
        parents = around(full.reshape(side // 2, 2, side // 2, 2, side // 2, 2).sum(axis=(1, 3, 5)))
        far = parents[tuple((cells >> 1).T)] - around(full)[tuple(cells.T)]
        work = size * points[tuple(cells.T)] * PAIR_S + far * CELLS_S + size * 2e-6
        total = work.sum() + far.sum() * CELLS_S / 3 + (level - 1) * len(TURNS) * KERNEL_S * tasks
        if best is None or total < best[0]:
            best = total, level, work
        elif total > 4 * best[0]:
            break
    _, level, work = best
    ends = np.searchsorted(np.cumsum(work), np.linspace(0, work.sum(), tasks + 1)[1:-1])
    ends = [0, *ends.tolist(), len(work)]
    return level, list(zip(ends[:-1], ends[1:], strict=True))


def turned(values: np.ndarray, octant: tuple[int, ...], up: bool) -> np.ndarray:
    """(cells, 2, nodes) of children at ``octant`` as those of their parents, or the other way."""
    x = values.reshape(-1, 2, ORDER, ORDER, ORDER)
    for side in octant:
        x = np.moveaxis(x, 2, -1) @ (HALVES[side] if up else HALVES[side].T)
    return x.reshape(len(values), 2, ORDER**3)


def octants(cells: np.ndarray) -> Iterator[tuple[tuple[int, ...], np.ndarray]]:
    for octant in product((0, 1), repeat=3):
        yield octant, np.flatnonzero(((cells & 1) == octant).all(axis=1))


def gathered(cells: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(parents, parent of each cell)."""
    up = cells >> 1
    keys, parent = np.unique((up[:, 0] << 2 * bits) | (up[:, 1] << bits) | up[:, 2], return_inverse=True)
    low = (1 << bits) - 1
    return np.column_stack([keys >> 2 * bits, keys >> bits & low, keys & low]), parent.reshape(-1)


def kernel(offset: tuple[int, ...], width: float) -> np.ndarray:
    """The potential at the nodes of a cell of those of the one at ``offset``."""
    x, y, z = (((NODES[:, None] - NODES[None]) * (width / 2) - o * width) ** 2 for o in offset)
    square = (x[:, None, :, None] + y[None, :, None, :]).reshape(ORDER**2, 1, ORDER**2, 1) + (z + 1)[None, :, None, :]
    np.sqrt(square, out=square)
    return np.divide(1.0, square, out=square).reshape(ORDER**3, ORDER**3)


def from_afar(at: np.ndarray, charge: np.ndarray, cells: np.ndarray, begin: np.ndarray, half: float, level: int, low: int, high: int) -> np.ndarray:
    """(points of the cells low to high, 2, 3): the fields of both charges of all points that are not in neighbouring cells."""
    width = 2 * half / (1 << level)
    inside = ((at + half) / width - np.repeat(cells, np.diff(begin), axis=0)) * 2 - 1
    held = np.empty((len(cells), 2, ORDER**3))
    for c in range(len(cells)):
        here = slice(begin[c], begin[c + 1])
        x, y, z = (polynomials(inside[here, axis])[0] @ _TO_NODES for axis in range(3))
        flat = (x[:, :, None] * y[:, None, :]).reshape(len(x), -1).T @ (charge[here, :, None] * z[:, None, :]).reshape(len(x), -1)
        held[c] = np.moveaxis(flat.reshape(-1, 2, ORDER), 1, 0).reshape(2, -1)
    own = cells[low:high]
    stack = [(cells, held, own, None)]
    for up in range(level - 1, 1, -1):
        parents, parent = gathered(stack[-1][0], level)
        total = np.zeros((len(parents), 2, ORDER**3))
        for octant, which in octants(stack[-1][0]):
            total[parent[which]] += turned(stack[-1][1][which], octant, True)
        targets, above = gathered(stack[-1][2], level)
        stack[-1] = (*stack[-1][:3], above)
        stack.append((parents, total, targets, None))
    local = None
    for depth, (sources, values, targets, above) in zip(range(2, level + 1), reversed(stack), strict=True):
        found = np.zeros((len(targets), 2, ORDER**3))
        if local is not None:
            for octant, which in octants(targets):
                found[which] = turned(local[above[which]], octant, False)
        side, wide = 1 << depth, 2 * half / (1 << depth)
        grid = np.full((side + 6,) * 3, -1, np.int32)
        grid[tuple((sources + 3).T)] = np.arange(len(sources))
        for offset, images in TURNS.items():
            made, met = kernel(offset, wide).T, []
            for i, (turned_to, place, back) in enumerate(images):
                there = targets + turned_to
                source = grid[tuple((there + 3).T)]
                which = np.flatnonzero((source >= 0) & (np.abs((there >> 1) - (targets >> 1)) <= 1).all(axis=1))
                if len(which):
                    met.append((which, place, values[source[which]].reshape(-1, ORDER**3)[:, back]))
                if met and (sum(len(x[0]) for x in met) >= CELLS_AT_ONCE or i + 1 == len(images)):
                    out, done = np.concatenate([x[2] for x in met]) @ made, 0
                    for which, place, given in met:
                        found[which] += out[done : done + len(given), place].reshape(-1, 2, ORDER**3)
                        done += len(given)
                    met = []
        local = found
    field = np.empty((begin[high] - begin[low], 2, 3))
    for c in range(low, high):
        here = slice(begin[c], begin[c + 1])
        (x, dx), (y, dy), (z, dz) = ([v @ _TO_NODES for v in polynomials(inside[here, axis])] for axis in range(3))
        values = np.moveaxis(local[c - low].reshape(2, ORDER, -1), 2, 0).reshape(ORDER**2, -1)
        along = lambda y, z, x: np.einsum("nqa,na->nq", ((y[:, :, None] * z[:, None, :]).reshape(len(x), -1) @ values).reshape(len(x), 2, ORDER), x)  # noqa: B023, E731
        to = slice(begin[c] - begin[low], begin[c + 1] - begin[low])
        for axis, parts in enumerate(((y, z, dx), (dy, z, x), (y, dz, x))):
            field[to, :, axis] = along(*parts) * (-2 / width)
    return field


def from_near(at: np.ndarray, charge: np.ndarray, cells: np.ndarray, begin: np.ndarray, level: int, low: int, high: int) -> np.ndarray:
    """(points of the cells low to high, 2, 3): the fields of both charges of the points of the same and of neighbouring cells."""
    side, square = 1 << level, (at**2).sum(axis=1)
    left, right = np.column_stack([at, square, np.ones(len(at))]), np.column_stack([-2 * at, np.ones(len(at)), square + 1])
    held = np.column_stack([charge, at * charge[:, :1], at * charge[:, 1:]])
    keys = (cells[:, 0] * side + cells[:, 1]) * side + cells[:, 2]
    field = np.empty((begin[high] - begin[low], 2, 3))
    for c in range(low, high):
        x, y, z = cells[c].tolist()
        rows = [(i * side + j) * side for i in range(max(0, x - 1), min(side, x + 2)) for j in range(max(0, y - 1), min(side, y + 2))]
        first = np.searchsorted(keys, [r + max(0, z - 1) for r in rows])
        last = np.searchsorted(keys, [r + min(side - 1, z + 1) for r in rows], "right")
        spans = [(begin[i], begin[j]) for i, j in zip(first, last, strict=True) if j > i]
        there, given = np.concatenate([right[i:j] for i, j in spans]), np.concatenate([held[i:j] for i, j in spans])
        here, sums = slice(begin[c], begin[c + 1]), np.zeros((begin[c + 1] - begin[c], 8))
        rows_at_once = min(len(sums), 256)
        step = TILE_PAIRS // rows_at_once
        for i in range(0, len(sums), rows_at_once):
            for j in range(0, len(there), step):
                near = left[here][i : i + rows_at_once] @ there[j : j + step].T
                root = np.sqrt(near)
                root *= near
                sums[i : i + rows_at_once] += np.divide(1.0, root, out=root) @ given[j : j + step]
        field[begin[c] - begin[low] : begin[c + 1] - begin[low]] = at[here, None, :] * sums[:, :2, None] - sums[:, 2:].reshape(-1, 2, 3)
    return field


def fields(at: np.ndarray, weight: np.ndarray, half: float, level: int, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, (rows, 2, 3)): of the points of cells low to high, the sums over all points of (own - other) / (distance^2 + 1)^1.5,
    plain and times the other's weight."""
    order, cells, begin = cells_of(at, half, level)
    at, charge = at[order], np.column_stack([np.ones(len(at)), weight[order]])
    found = from_near(at, charge, cells, begin, level, low, high)
    if level > 1 and high > low:
        found += from_afar(at, charge, cells, begin, half, level, low, high)
    return order[begin[low] : begin[high]], found
