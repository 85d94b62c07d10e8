"""Small dataset folders for the tests."""

from __future__ import annotations

import json
import struct
import zlib
from pathlib import Path


def png_bytes(w: int = 6, h: int = 4) -> bytes:
    def chunk(kind: bytes, data: bytes) -> bytes:
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + b"\x00\x00\x00" * w for _ in range(h))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b"")


# A small scene of our own: 6 x 4 pixels, a camera turned about the vertical axis, a crate and a lamp.
WIDTH, HEIGHT = 6, 4
POSE = [0.8, 0.0, 0.6, 2.5, 0.0, 1.0, 0.0, 1.25, -0.6, 0.0, 0.8, -4.0, 0.0, 0.0, 0.0, 1.0]
PLACED = [2.0, 0.0, 0.0, 0.5, 0.0, 2.0, 0.0, 0.0, 0.0, 0.0, 2.0, -1.0, 0.0, 0.0, 0.0, 1.0]


def thing(instance_id: int, scale: float) -> dict:
    return {"instance_id": instance_id, "position": [0.5, 0.0, -1.0], "rotation_deg": [0.0, 30.0, 0.0], "scale": [scale] * 3, "local_to_world_row_major": PLACED}


def meta(w: int = WIDTH, h: int = HEIGHT, **changes) -> dict:
    doc = {
        "frame_id": 3, "split": "train", "image_width": w, "image_height": h,
        "camera": {"fov_deg": 40.0}, "sun": {"elevation_deg": 35.0}, "render": {"seed": 11}, "convention": {"handedness": "right"},
        "camera_extrinsics": POSE, "camera_intrinsics": {"fx": 5.5, "fy": 5.5, "cx": 2.5, "cy": 1.5},
        "objects": [thing(4, 2.0), thing(9, 0.5)],
    }
    doc.update(changes)
    return doc


def coco(images=None, annotations=None, categories=None) -> dict:
    image = {"id": 7, "file_name": "frame_0000.png", "width": WIDTH, "height": HEIGHT}
    crate = {"id": 12, "image_id": 7, "category_id": 5, "bbox": [1, 0, 4, 3], "area": 12, "iscrowd": 0}
    return {
        "images": [image] if images is None else images,
        "annotations": [crate] if annotations is None else annotations,
        "categories": [{"id": 5, "name": "crate"}, {"id": 6, "name": "lamp"}] if categories is None else categories,
    }


LABEL = "5 0.5 0.375 0.666667 0.75\n"


def frame(folder: Path, stem: str = "frame_0000", label: str | None = LABEL, doc: dict | str | None = None, png: bytes | None = None) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"{stem}.png").write_bytes(png_bytes() if png is None else png)
    if label is not None:
        (folder / f"{stem}.txt").write_text(label)
    if doc is not None:
        (folder / f"{stem}_meta.json").write_text(doc if isinstance(doc, str) else json.dumps(doc))


def good(root: Path) -> Path:
    frame(root / "train", doc=meta())
    (root / "annotations_coco.json").write_text(json.dumps(coco()))
    return root
