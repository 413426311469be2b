"""Ink components of grey rasters, for whole Arrow batches at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def threshold(pixels: np.ndarray) -> int:
    """The grey value that parts a histogram best (Otsu): the variance between values up to it and above it is largest.

    The first of equal ones; 0 where all pixels are of one value.
    """
    share = np.bincount(pixels, minlength=256) / max(len(pixels), 1)
    below, mass = np.cumsum(share), np.cumsum(share * np.arange(256))
    above = 1 - below
    both = (below > 1e-7) & (above > 1e-7)
    between = np.zeros(256)
    between[both] = (mass[both] * above[both] - (mass[-1] - mass[both]) * below[both]) ** 2 / (below[both] * above[both])
    return int(between.argmax())


def _joined(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest member of each of n nodes' component, over links between a and b."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)  # roots are hung on smaller ones,
        np.minimum.at(label, label[b], low)
        while (label[label] != label).any():  # and paths are halved down to the roots
            label = label[label]
        if (label == before).all():
            return label


def components(images: list[tuple[int, int, bytes]]) -> pa.Array:
    """For each image (width, height, grey bytes) a list of its ink components: box, pixels and middle, in scan order.

    Ink is what is as dark as the image's threshold, or darker; pixels that touch at a corner are joined. All images of
    a batch lie one below the other with a blank row between. Runs of ink in a row are the nodes, runs of adjacent rows
    that touch are linked, found by two sorted searches, and joined by labels: no step goes pixel by pixel.
    """
    width = max((w for w, _, _ in images), default=0) + 2
    heights = np.array([h + 1 for _, h, _ in images], np.int64)
    top = np.cumsum(heights) - heights
    ink = np.zeros((int(heights.sum()) + 1, width), bool)
    for (w, h, raw), y in zip(images, top):
        if w and h:
            grey = np.frombuffer(raw, np.uint8, w * h)
            ink[y : y + h, 1 : w + 1] = (grey <= threshold(grey)).reshape(h, w)
    flat = np.concatenate([[False], ink.ravel(), [False]])
    edge = np.flatnonzero(flat[1:] != flat[:-1])
    start, end = edge[0::2], edge[1::2]  # every row has a blank pixel at both ends, so runs stay in their row
    # a run's neighbours in the next row begin no later than where it ends, and end no earlier than where it begins
    first, last = np.searchsorted(end, start + width), np.searchsorted(start, end + width, "right")
    count = np.maximum(last - first, 0)
    a = np.repeat(np.arange(len(start)), count)
    b = np.repeat(first - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
    root, of = np.unique(_joined(len(start), a, b), return_inverse=True)
    y, x0 = start // width, start % width - 1
    x1 = x0 + end - start
    image = np.searchsorted(top, y[root], "right") - 1 if len(root) else np.zeros(0, np.int64)
    n = len(root)
    box = [np.full(n, 1 << 40), np.full(n, 1 << 40), np.zeros(n, np.int64), np.zeros(n, np.int64)]
    local = y - top[image[of]] if n else y
    for target, values, ufunc in ((box[0], x0, np.minimum), (box[1], local, np.minimum), (box[2], x1, np.maximum), (box[3], local + 1, np.maximum)):
        ufunc.at(target, of, values)
    area = np.bincount(of, end - start, n)
    cx, cy = np.bincount(of, (end - start) * (x0 + x1 - 1) / 2, n) / np.maximum(area, 1), np.bincount(of, (end - start) * local, n) / np.maximum(area, 1)
    fields = [box[0], box[1], box[2] - box[0], box[3] - box[1], area.astype(np.int64)]
    parts = pa.StructArray.from_arrays([*(pa.array(f.astype(np.int32)) for f in fields), pa.array(cx), pa.array(cy)], ["x", "y", "w", "h", "area", "cx", "cy"])
    offsets = np.searchsorted(image, np.arange(len(images) + 1))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), parts)
