"""Normal equations of lagged windows from lag products and edges.

The windows of a run of rows overlap, so the products of cell ``a`` and cell ``b`` of all windows, ``G[a, b]``, differ
from ``G[a + 1, b + 1]`` by two rows only: the one after the last window's cells and the first window's. With the lag
products ``G[0, j]`` of ``tw + 1`` lags and the ``tw`` rows at either end of each run, ``G`` can be applied to any
vectors by fast Fourier transforms; it is never formed.
"""

from __future__ import annotations

import numpy as np


class WindowEquations:
    """``G`` over the ``tw + 1`` positions of a window and its target, and the sums of each position.

    ``products[j]`` is the sum of ``x[s] x[s + j]'`` over all window starts ``s``, ``first`` that of ``x[s]``.
    ``starts`` has the first ``tw`` rows of each run of windows, ``ends`` the ``tw`` rows after each run's last start.
    """

    def __init__(self, products: np.ndarray, first: np.ndarray, n: float, starts: np.ndarray, ends: np.ndarray):
        self.length, self.width = len(products), products.shape[1]
        self.n = n
        size = self.size = 2 * self.length
        wrapped = np.zeros((size, self.width, self.width))
        wrapped[0] = products[0]
        wrapped[size - np.arange(1, self.length)] = products[1:]
        wrapped[1 : self.length] = products[1:].transpose(0, 2, 1)
        self.kernel = np.fft.rfft(wrapped, axis=0)
        self.edges = [(sign, np.fft.rfft(rows, size, axis=0)) for sign, group in ((1, ends), (-1, starts)) for rows in group]
        moved = ends.sum(0) - starts.sum(0) if len(starts) else np.zeros((self.length - 1, self.width))
        self.sums = first + np.vstack([np.zeros(self.width), np.cumsum(moved, axis=0)])

    def apply(self, vectors: np.ndarray) -> np.ndarray:
        """``G`` times vectors of shape ``(tw + 1, F, outputs)``."""
        spectrum = np.fft.rfft(vectors, self.size, axis=0)
        total = np.matmul(self.kernel, spectrum)
        for sign, rows in self.edges:
            # one number for each shift of the edge's rows by 1 to tw positions
            shifts = np.fft.irfft(np.einsum("fk,fko->fo", rows.conj(), spectrum), self.size, axis=0)
            shifts[0], shifts[self.length :] = 0, 0
            total += sign * rows[:, :, None] * np.fft.rfft(shifts, axis=0)[:, None, :]
        return np.fft.irfft(total, self.size, axis=0)[: self.length]

    def solve(self, ridge: float, tolerance: float, max_steps: int) -> np.ndarray:
        """Coefficients ``(1 + tw * F, F)`` of the target on a constant and all cells, by conjugate gradients.

        The constant is eliminated first. No step reads data.
        """
        tw, width = self.length - 1, self.width
        unit = np.zeros((self.length, width, width))
        unit[tw] = np.eye(width)
        right, sums, target = self.apply(unit)[:tw], self.sums[:tw], self.sums[tw]
        weight = self.n + ridge

        def centred(vectors: np.ndarray) -> np.ndarray:
            padded = np.concatenate([vectors, np.zeros((1, *vectors.shape[1:]))])
            level = np.einsum("tk,tko->o", sums, vectors) / weight
            return self.apply(padded)[:tw] - sums[:, :, None] * level + ridge * vectors

        residual = right - sums[:, :, None] * target / weight
        beta, direction = np.zeros_like(residual), residual.copy()
        now = first = (residual**2).sum((0, 1))
        for _ in range(max_steps):
            if (now <= tolerance**2 * np.maximum(first, 1e-300)).all():
                level = (target - np.einsum("tk,tko->o", sums, beta)) / weight
                return np.vstack([level, beta.reshape(tw * width, width)])
            image = centred(direction)
            step = now / np.maximum((direction * image).sum((0, 1)), 1e-300)
            beta, residual = beta + step * direction, residual - step * image
            before, now = now, (residual**2).sum((0, 1))
            direction = residual + now / np.maximum(before, 1e-300) * direction
        raise ValueError(f"no solution after {max_steps} steps; raise max_steps or the ridge")
