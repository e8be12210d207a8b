"""python -m tidemark all|cowork|cli|cloud|analyze|empty --out DIR ..."""

from __future__ import annotations

import argparse
import sys
import tempfile
import time

from .operators.graph import fresh_folder
from .plans import build as plan
from .session import build
from .sources import archives


def main(args: list[str] | None = None) -> int:
    p = argparse.ArgumentParser(prog="tidemark")
    p.add_argument("verb", choices=["all", "cowork", "cli", "cloud", "analyze", "empty"])
    p.add_argument("--out", required=True)
    p.add_argument("--zip", help="an export archive; else the latest in --downloads")
    p.add_argument("--downloads")
    p.add_argument("--no-cloud", action="store_true")
    p.add_argument("--transcripts")
    p.add_argument("--cowork")
    p.add_argument("--desktop")
    p.add_argument("--phase2-output", help="sessions of an earlier run, whose desktop ones stand for manifests without --desktop; else those of --out")
    p.add_argument("--progress", action="store_true", help="one JSON object a line for each phase that ends")
    p.add_argument("--now", type=int, help="milliseconds; else the clock's time")
    a = p.parse_args(args)
    if a.no_cloud and a.zip:
        p.error("--no-cloud and --zip exclude each other")
    spark, now = build(), a.now or int(time.time() * 1000)
    if a.verb == "analyze":
        plan.reanalyse(spark, a.out, now)
        return 0
    if a.verb == "empty":
        plan.empty(spark, a.out, now)
        return 0
    src = plan.Sources()
    if a.verb in ("all", "cowork"):
        src.cowork, src.desktop = a.cowork, a.desktop
    if a.verb in ("all", "cli"):
        src.transcripts, src.desktop, src.earlier = a.transcripts, a.desktop, a.phase2_output or f"{a.out}/sessions"
    archive = None if a.no_cloud or a.verb not in ("all", "cloud") else a.zip or (archives.latest_export(spark, a.downloads) if a.downloads else None)
    if archive:
        # unpacked on the driver, then put where executors read
        with tempfile.TemporaryDirectory(prefix="tidemark-export-") as local:
            archives.extract(archive.removeprefix("file:"), local)
            folder = fresh_folder(spark)
            archives.upload(spark, local, folder)
        src.conversations, src.projects = f"{folder}/conversations.json", f"{folder}/projects.json"
    errors = plan.build(spark, src, a.out, now, print if a.progress else None)
    bad = errors.count()
    if bad:
        errors.show(20, truncate=False)
    return int(bad > 0)


if __name__ == "__main__":
    sys.exit(main())
