"""``python -m frameloom.cli evaluate|compare --candidate FRAMES [FRAMES ...] [--source FRAMES] [--preset P] [--labels L ...] [--out DIR]``.

FRAMES are Parquet tables of ``model, k, t, h, w, luma`` (the source's needs no ``model``). ``evaluate`` writes ``report.json`` and
``timeline.md`` of each candidate, ``compare`` writes ``ranking.json``. The exit code is 1 if a candidate has no score."""

from __future__ import annotations

import argparse
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, functions as F

from .plans.evaluate import PRESETS, Evaluation, evaluation
from .report import timeline, write_json


def read_candidates(spark: SparkSession, paths: list[str], labels: list[str] | None) -> DataFrame:
    """All candidates' frames; a table without ``model``, or one with a label, is named by the label or the path's stem."""
    out: DataFrame | None = None
    for i, path in enumerate(paths):
        frames = spark.read.parquet(path)
        if labels or "model" not in frames.columns:
            frames = frames.withColumn("model", F.lit(labels[i] if labels else Path(path).stem))
        frames = frames.select("model", "k", "t", "h", "w", "luma")
        out = frames if out is None else out.unionByName(frames)
    if out is None:
        raise ValueError("no candidates")
    return out


def reports(run: Evaluation) -> dict[str, dict]:
    """One report for each candidate: its row of the ranking, median features and worst windows (a dozen at most)."""
    found = {r["model"]: r.asDict() | {"worst_windows": [], "features": {}} for r in run.ranking.collect()}
    for r in run.features.groupBy("model", "feature").agg(F.percentile("value", F.lit(0.5)).alias("median")).orderBy("model", "feature").collect():
        found[r["model"]]["features"][r["feature"]] = r["median"]
    for r in run.worst.orderBy("model", F.desc("severity")).collect():
        found[r["model"]]["worst_windows"].append({"start": r["start"], "end": r["end"], "center_index": r["centre"], "type": r["labels"], "severity": r["severity"], "confidence": found[r["model"]]["confidence"]})
    return found


def main(argv: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="frameloom")
    p.add_argument("verb", choices=("evaluate", "compare"))
    p.add_argument("--candidate", nargs="+", required=True)
    p.add_argument("--source")
    p.add_argument("--labels", nargs="+")
    p.add_argument("--preset", choices=sorted(PRESETS), default="fast")
    p.add_argument("--out")
    a = p.parse_args(argv)
    if a.labels and len(a.labels) != len(a.candidate):
        p.error("as many labels as candidates")
    spark = SparkSession.builder.appName("frameloom").getOrCreate()
    run = evaluation(read_candidates(spark, a.candidate, a.labels), spark.read.parquet(a.source) if a.source else None, a.preset)
    found = reports(run)
    ranking = sorted(found.values(), key=lambda r: r["rank"])
    for r in ranking:
        print("{rank}  {model}  {overall}  {status}  {warnings}".format(**r))
    if a.out and a.verb == "compare":
        write_json({"ranking": [{k: r[k] for k in ("model", "overall", "relative", "rank", "confidence", "status")} for r in ranking]}, f"{a.out}/ranking.json")
    elif a.out:
        worst = run.worst.withColumnRenamed("model", "stream")
        lines = timeline(run.windows.withColumnRenamed("model", "stream"), worst).orderBy("stream", "centre").collect()
        for model, r in found.items():
            write_json(r, f"{a.out}/{model}/report.json")
            head = "| centre | start | end | labels | severity |\n|-|-|-|-|-|\n"
            Path(f"{a.out}/{model}/timeline.md").write_text(head + "\n".join(x["line"] for x in lines if x["stream"] == model) + "\n")
    return 0 if ranking and all(r["overall"] is not None for r in ranking) else 1


if __name__ == "__main__":
    sys.exit(main())
