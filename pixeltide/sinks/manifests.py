"""Run manifests and validation reports: small documents written by the driver, tables by Spark."""

from __future__ import annotations

import json
from hashlib import sha256

from pyspark.sql import DataFrame

from pixeltide import __version__
from pixeltide import constants as K
from pixeltide.plans.validation import exit_code, issue_rollup
from pixeltide.sinks.storage import replacing


def manifest_document(
    *, argv: str, cwd: str, timestamp_utc: str, job_kind: str, dataset_root: str, seed: int, frames_total: int, train_frames: int,
    frames_rendered: int, config_path: str = "", resolved_config: dict | None = None, shard_index: int = 0, shard_count: int = 1,
    active_scenario: str | None = None, render_summary: dict | None = None,
) -> dict:
    """Manifest of one run. Counts come from layout_counts, ids are the same hashes as functions.text.dataset_id."""
    joined = "\n".join([dataset_root, timestamp_utc, argv, str(seed), job_kind])
    stem, coco = ("frame", "annotations_coco") if job_kind == "forge" else ("sfrm", "scenario_coco")
    config = resolved_config or {}
    digest = sha256(json.dumps(config, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    doc = {
        "version_info": {"engine_version": __version__, "schema_version": K.MANIFEST_SCHEMA_VERSION, "git_commit": "unknown"},
        "execution": {
            "argv": argv, "cwd": cwd, "timestamp_utc": timestamp_utc, "random_seed": {"render_config_seed": seed},
            "dataset_id": sha256(joined.encode()).hexdigest()[:32],
        },
        "config_audit": {"config_path": config_path, "resolved_config": config, "resolved_config_sha256": digest},
        "dataset_layout": {
            "job_kind": job_kind, "dataset_root": dataset_root, "frames_total": frames_total, "frames_total_global": frames_total,
            "frames_rendered_this_process": frames_rendered, "train_frames": train_frames, "val_frames": frames_total - train_frames,
            "train_subdirectory": "train", "val_subdirectory": "val", "shard": {"index": shard_index, "count": shard_count},
            "rgb_stem_pattern": f"{stem}_%04d", "sidecar_suffixes": list(K.SIDECAR_SUFFIXES),
            "coco_annotations_file": f"{coco}_shard_{shard_index}.json" if shard_count > 1 else f"{coco}.json",
        },
    }
    if active_scenario is not None:
        doc["execution"]["active_scenario"] = active_scenario
        doc["dataset_layout"]["active_scenario"] = active_scenario
    if render_summary:
        doc["render_summary"] = render_summary
    return doc


def manifest_path(root: str, shard_index: int = 0, shard_count: int = 1) -> str:
    name = f"manifest_shard_{shard_index}.json" if shard_count > 1 else "manifest.json"
    return f"{root.rstrip('/')}/{name}"


def write_manifest(path: str, document: dict) -> None:
    """Atomic replace: readers see the old or the new document."""
    with replacing(path) as out:
        out.write(json.dumps(document, indent=2).encode("utf-8"))


def write_report(issues: DataFrame, histogram: DataFrame, stats: dict, path: str, head: dict | None = None, strict: bool = False) -> int:
    """Issues as JSON lines at <path>/issues, the class histogram at <path>/histogram, a summary at <path>/summary.json.

    Only the rollup (one row per code) reaches the driver. Returns the exit code.
    """
    base = path.rstrip("/")
    issues.write.mode("overwrite").json(f"{base}/issues")
    histogram.write.mode("overwrite").json(f"{base}/histogram")
    written = issues.sparkSession.read.schema(issues.schema).json(f"{base}/issues")
    code = exit_code(written, strict=strict).first()["exit_code"]
    rollup = [r.asDict() for r in issue_rollup(written).orderBy("severity", "code").collect()]
    with replacing(f"{base}/summary.json") as out:
        out.write(json.dumps({**(head or {}), "exit_code": code, "issue_counts": rollup, "stats": stats}, indent=2).encode("utf-8"))
    return code
