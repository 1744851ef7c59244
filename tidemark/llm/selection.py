"""How the settings of the two classifiers were chosen: on a validation part of the training folds alone.

``python -m tidemark.llm.selection FOLDER`` fits each setting on three quarters of the labelled
rows outside the held-out fold, measures it on the fourth quarter, and prints all of them, best
first. No label of the held-out fold is read. The first one printed is what the modules have.
"""

from __future__ import annotations

import itertools
import sys
import zlib
from concurrent.futures import ProcessPoolExecutor

import numpy as np
import pyarrow.parquet as pq

from tidemark.llm import quality, toxicity

GRIDS = {
    "quality": {"ALPHA": (0.3, 1.0), "L1": (0.005, 0.02, 0.08), "L2": (0.05, 0.5), "PASSES": (2, 4)},
    "toxic": {"STEPS": (32, 64), "RATE": (0.004, 0.012), "PENALTY": (1e-4, 1e-3, 1e-2, 1e-1)},
}


def rows_of(folder: str, label: str, mod: int, held_out: int) -> list[tuple[int, str, int]]:
    texts = pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    labels = pq.read_table(f"{folder}/labels.parquet", columns=["doc_id", label]).to_pydict()
    of = dict(zip(labels["doc_id"], labels[label], strict=True))
    kept = ((i, t or "", of[i]) for i, t in zip(texts["doc_id"], texts["text"], strict=True) if i in of and zlib.crc32(str(i).encode()) % mod != held_out)
    return sorted(kept)


def measured(job: tuple[str, str, dict]) -> tuple[float, float]:
    """Share of wrong predictions and mean log loss on the validation quarter."""
    folder, label, setting = job
    module = quality if label == "quality" else toxicity
    for k, v in setting.items():
        setattr(module, k, v)
    rows = rows_of(folder, label, module.MOD, module.HELD_OUT)
    fourth = [zlib.crc32(f"validation {i}".encode()) % 4 == 0 for i, _, _ in rows]
    model = module.fit([(t, y) for (_, t, y), f in zip(rows, fourth, strict=True) if not f])
    texts, y = zip(*((t, y) for (_, t, y), f in zip(rows, fourth, strict=True) if f), strict=True)
    if label == "quality":
        z = np.array([model[at] @ v for at, v in quality.features(list(texts))]) + model[-1]
    else:
        z = np.array([model[0][toxicity.grams(t)].sum(dtype=np.float64) for t in texts]) + model[1]
    return float(np.mean((z >= 0) != np.array(y))), float(np.mean(np.logaddexp(0, -z * (2 * np.array(y) - 1))))


def main(folder: str) -> None:
    with ProcessPoolExecutor() as pool:
        for label, grid in GRIDS.items():
            settings = [dict(zip(grid, v, strict=True)) for v in itertools.product(*grid.values())]
            for found, setting in sorted(zip(pool.map(measured, [(folder, label, s) for s in settings]), settings, strict=True), key=lambda x: x[0]):
                print(label, [round(x, 5) for x in found], setting)


if __name__ == "__main__":
    main(sys.argv[1])
